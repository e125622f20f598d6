"""The registered queries put the whole table through their operator, and give what the SQL gives."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trellis.plans import control

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["S11", "M07", "S01", "S02", "S08", "S13", "S14", "P06", "X08"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    found, want = control.QUERIES[name](spark, SF), duck.sql(control.SQL[name])
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_the_whole_audit_log_is_appended(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(control, "folder", lambda s, label: f"file://{tmp_path}/{label}")
    control.QUERIES["S11"](spark, SF).collect()
    assert spark.read.json(f"{tmp_path}/audit").count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_all_nodes_are_embedded(spark, monkeypatch):
    large = SF.replace("0.001", "0.01")  # more than 20 nodes a tree
    seen, embed = [], control.ingest.seams.embed
    monkeypatch.setattr(control.ingest.seams, "embed", lambda nodes, **how: seen.append(nodes.count()) or embed(nodes, **how))
    control.QUERIES["M07"](spark, large)
    assert seen == [spark.read.parquet(f"{large}/documents.parquet").count()]


def test_every_conversation_is_a_file(spark, tmp_path, monkeypatch):
    seen, read = [], control.ingest.read_texts
    monkeypatch.setattr(control, "folder", lambda s, label: f"file://{tmp_path}/{label}")
    monkeypatch.setattr(control.ingest, "read_texts", lambda *a: seen.append(read(*a)) or seen[0])
    control.QUERIES["S01"](spark, SF).collect()
    want = control.fx.markdown(spark, SF).select("tree_id", F.length("text") + 1).collect()
    assert len(want) > 1 and sorted(map(tuple, seen[0].select("tree_id", F.length("text")).collect())) == sorted(map(tuple, want))


def test_metadata_comes_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(control, "folder", lambda s, label: f"file://{tmp_path}/{label}")
    got = [tuple(r) for r in control.QUERIES["S08"](spark, SF).collect()]
    names = os.listdir(tmp_path / "meta")
    assert "broken.meta.json" in names and sum(n.endswith(".meta.json") for n in names) == len(got) + 1
    assert got == sorted(got) == sorted(tuple(r) for r in control.rt.meta(spark, SF).collect())
