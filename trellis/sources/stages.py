"""Ingestion stage by stage, so that a run that broke off is taken up where it was.

A stage works on rows with a key. What it has made is kept below ``folder`` as runs of Parquet
files, with a fingerprint of what each row was made from. The next time, only rows whose key is
new or whose fingerprint differs are worked on; the rest is read. A run counts when its files are
committed as a whole; one that broke off is written again. So whatever is killed, and however
often it is started, each key is there once and nothing that is done is done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions import scalar
from trellis.schema import CONFIG, RetrievalConfig
from trellis.sources.scratch import keep


def fingerprint(*columns: Column) -> Column:
    """A digest of values, null and empty told apart."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)])), 256)


class Stage:
    """The runs of one stage: ``done`` reads them, ``run`` adds one."""

    def __init__(self, spark: SparkSession, folder: str, name: str, key: list[str]) -> None:
        self.spark, self.key, self.path = spark, key, f"{folder.rstrip('/')}/{name}"

    def runs(self) -> list[str]:
        """Folders of committed runs, the oldest first."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = sorted((int(p.getName().removeprefix("run-")), p) for p in (s.getPath() for s in fs.listStatus(where)) if p.getName().startswith("run-"))
        return [p.toString() for _, p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def done(self, schema: T.StructType) -> DataFrame:
        """The latest row of each key: the key, _made_from, and what was made of it."""
        found = self.runs()
        own = T.StructType([*schema.fields, T.StructField("_made_from", T.StringType()), T.StructField("_run", T.IntegerType())])
        if not found:
            return self.spark.createDataFrame([], own).drop("_run")
        rows = self.spark.read.schema(own).parquet(*found)
        fields = [c for c in rows.columns if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*fields), "_run").alias("_x"))
        return last.select(*self.key, *[F.col(f"_x.`{c}`").alias(c) for c in fields if c != "_run"])

    def run(self, rows: DataFrame, made_from: Column, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` of all ``rows``: a row a key, the key and new columns, with ``redone``: whether
        it was made now. ``work`` sees the rows that have to be made and keeps their key."""
        named = rows.withColumn("_made_from", made_from)
        made = work(named.limit(0))  # for its columns
        columns = [c for c in made.columns if c not in self.key and c != "_made_from"]
        schema = made.select(*self.key, *columns).schema
        before = self.done(schema)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*self.key, "_made_from"]]
        todo = named.alias("a").join(before.select(*self.key, "_made_from").alias("b"), same, "left_anti")
        committed = self.runs()
        n = 1 + max((int(p.rsplit("run-", 1)[1]) for p in committed), default=0)
        out = work(todo).select(*self.key, *columns).join(todo.select(*self.key, "_made_from"), self.key)
        out.select(*self.key, *columns, "_made_from", F.lit(n).alias("_run")).write.mode("overwrite").parquet(f"{self.path}/run-{n}")
        new = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_made_from", T.StringType())])).parquet(f"{self.path}/run-{n}")
        old = before.alias("a").join(named.select(*self.key, "_made_from").alias("b"), same, "left_semi")
        return old.withColumn("redone", F.lit(False)).unionByName(new.withColumn("redone", F.lit(True))).drop("_made_from")


def summaries(spark: SparkSession, folder: str, nodes: DataFrame, summariser: Callable[[Column, Column], Column], cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """(tree_id, node_id, ord, parent_id, depth, title, summary, redone) of all nodes, deepest level
    first, each level a stage. A node is summarised again if its own text or a child's summary
    changed, so a change goes up its branch and stops where a summary stays as it was."""
    nodes = keep(nodes.select("tree_id", "node_id", "ord", "parent_id", "depth", "title", "content"), "stage-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = done = None
    for d in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == d)
        if below is None:
            level = level.withColumn("_kids", F.lit(None).cast("string"))
        else:
            line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("summary"))
            kids = below.where(F.coalesce("summary", F.lit("")) != "").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("k"))
            level = level.join(kids.select("tree_id", "node_id", F.array_join("k.line", "\n").alias("_kids")), ["tree_id", "node_id"], "left")
        text = F.left(scalar.summary_input(F.col("content"), F.col("_kids")), F.lit(cfg.summary_chars))
        level = keep(level.select("tree_id", "node_id", "ord", "parent_id", "depth", "title", text.alias("_text")), "stage-level")
        made_from = fingerprint(*[F.col(c) for c in ("title", "_text")])
        stage = Stage(spark, folder, f"summary-{d}", ["tree_id", "node_id"])
        found = stage.run(level, made_from, lambda x: x.select("tree_id", "node_id", F.when(F.col("_text").isNotNull(), summariser(F.col("title"), F.col("_text"))).alias("summary")))
        below = level.drop("_text").join(found, ["tree_id", "node_id"])
        done = below if done is None else done.unionByName(below)
    return done


def image_rows(spark: SparkSession, folder: str, files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``extract`` makes of (doc_id, content), with ``redone``; an image is known by its
    document, page and place, so a second run adds none that is there."""
    stage = Stage(spark, folder, "images", ["doc_id"])
    kept = [f for f in extract(files.limit(0)).schema.fields if f.name != "doc_id"]
    pack = lambda x: extract(x).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(*[f.name for f in kept]))).alias("_images"))
    found = stage.run(files, fingerprint(F.sha2(F.col("content"), 256)), lambda x: x.select("doc_id").join(pack(x), "doc_id", "left"))
    return found.select("doc_id", F.explode("_images").alias("_i"), "redone").select("doc_id", "_i.*", "redone")
