"""Readers, writers and the way from text to summarised, embedded trees."""

from __future__ import annotations

import itertools
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis import schema, seams
from trellis.functions import images, scalar
from trellis.operators import tree
from trellis.sources import treejson


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, text) of Markdown and text files, one a file; other suffixes are left out."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return files.where(F.lower("name").rlike(r"\.(md|txt)$")).select(F.regexp_replace("name", r"\.[^.]+$", "").alias("tree_id"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, size, head, content) of any files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.decode(F.substring("content", 1, 4), "ISO-8859-1").alias("head"), "content")


def _mounted(path: str) -> str:
    """A new folder that tasks can write to."""
    if not path.startswith(("file:", "/")):
        raise ValueError(f"tasks write the files, so the shared folder must be mounted, not {path}")
    own = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(own)
    return own


def write_files(files: DataFrame, path: str) -> None:
    """A file for each (name, content), written by the tasks, so the folder has to be a mounted
    one; under a temporary name first, so a retried task does no harm."""
    own = _mounted(path)

    def write(rows) -> None:
        for r in rows:
            tmp = f"{own}/.{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(r["content"])
            os.replace(tmp, f"{own}/{r['name']}")

    files.select("name", F.col("content").cast("binary").alias("content")).foreachPartition(write)


def convert(files: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(filename, text) of (filename, content), by a converter to Markdown for each suffix;
    text files need none. A suffix without a converter is an error."""
    own = {".md": bytes.decode, ".txt": bytes.decode} | (converters or {})

    def one(content: bytes, filename: str) -> str:
        end = os.path.splitext(filename)[1].lower()
        if end not in own:
            raise ValueError(f"no converter for {filename}")
        return own[end](content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"filename": b["filename"], "text": [one(c, n) for c, n in zip(b["content"], b["filename"], strict=True)]})

    return files.select("filename", "content").mapInPandas(run, "filename string, text string")


def extract_images(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, int, bytes]]]) -> DataFrame:
    """(doc_id, page, idx, width, height, image) out of (doc_id, content), by an extractor that
    gives page, place and bytes of each image in a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, page, idx, *images.size(image), image) for d, c in zip(b["doc_id"], b["content"], strict=True) for page, idx, image in extractor(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "idx", "width", "height", "image"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page long, idx long, width int, height int, image binary")


def capped_images(found: DataFrame, cfg: schema.RetrievalConfig = schema.CONFIG) -> DataFrame:
    """Images of some size, the first ``max_images`` of each document in page order."""
    big = found.where((F.col("width") >= cfg.min_image_px) & (F.col("height") >= cfg.min_image_px))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "idx"))
    return big.withColumn("_n", n).where(F.col("_n") <= cfg.max_images).drop("_n")


def standalone_images(files: DataFrame, describe: Callable[[Column], Column]) -> DataFrame:
    """Image files (path, filename, content) as image rows: page 1, place 0; a size of 0 if
    the first bytes do not tell it."""
    sized = files.withColumn("_size", images.size_of(F.col("content"))).withColumn("_raw", describe(F.col("path")))
    text, kind = tree.parse_vision(F.col("_raw"))
    return sized.select(F.col("filename").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("idx"), F.lit("standalone").alias("source"), kind.alias("image_type"), F.col("path").alias("image_path"), "_size.width", "_size.height", text.alias("description"))


_NODE = "node_id string, ord int, parent_id string, depth int, title string, content string, summary string, embedding array<float>"


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nodes out of nested tree JSON (title, node_id, content, summary, embedding, nodes), in
    pre-order; missing fields get their defaults, unknown ones are dropped. A file is one tree of
    any depth; files that are not JSON objects are left out."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(_unescaped(F.col("_metadata.file_name")), r"\.json$", "")
    return walk(files.select(_unescaped(name).alias("tree_id"), F.col("value").alias("json")))


def _unescaped(name: Column) -> Column:
    """A percent-encoded name as it was; one that is not so encoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def walk(trees: DataFrame) -> DataFrame:
    """Nodes of (tree_id, json). A text is read once from left to right, without recursion."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tree_id, text in zip(b["tree_id"], b["json"], strict=True):
                rows = treejson.nodes(text) if text is not None else []
                for lo in range(0, len(rows), 10_000):
                    part = pd.DataFrame(rows[lo : lo + 10_000], columns=treejson.COLUMNS)
                    part.insert(0, "tree_id", tree_id)
                    yield part

    return trees.select("tree_id", "json").mapInPandas(run, f"tree_id string, {_NODE}")


def json_pieces(nodes: DataFrame, content: bool = True, embedding: bool = False) -> DataFrame:
    """(tree_id, ord, piece): the pieces of each tree's JSON, one a node, in the order of ``ord``,
    which is pre-order with one root of depth 0. A node's object opens where it stands; how many
    objects end behind it is told by the next node's depth, so depth is unbounded and no row
    holds more than a node."""
    own = nodes.select("tree_id", "ord", "depth", "title", "node_id", *(["content"] if content else []), F.coalesce("summary", F.lit("")).alias("summary"), *(["embedding"] if embedding else []))
    fields = [c for c in ("title", "node_id", "content", "summary", "embedding") if c in own.columns]
    w = Window.partitionBy("tree_id").orderBy("ord")
    before, after = F.lag("depth").over(w), F.coalesce(F.lead("depth").over(w), F.lit(0))
    inner = F.regexp_replace(F.to_json(F.struct(*fields)), r"\}$", "")
    opened = F.concat(F.when(before >= F.col("depth"), ",").otherwise(""), inner, F.when(inner != "{", ",").otherwise(""), F.lit('"nodes":['))
    ends = F.when(F.lead("depth").over(w).isNull(), F.col("depth") + 1).otherwise(F.greatest(F.col("depth") - after + 1, F.lit(0)))
    return own.select("tree_id", "ord", F.concat(opened, F.repeat(F.lit("]}"), ends)).alias("piece"))


def nested_json(nodes: DataFrame, content: bool = True, embedding: bool = False) -> DataFrame:
    """(tree_id, json): each tree as one text; for trees that fit a row, see :func:`write_trees`."""
    lists = json_pieces(nodes, content, embedding).groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    return lists.select("tree_id", F.array_join("p.piece", "").alias("json"))


def write_trees(nodes: DataFrame, path: str, content: bool = True, embedding: bool = False) -> None:
    """A file <tree_id>.json for each tree, written piece by piece by the task that has the tree;
    a file gets its name when it is whole. Ids are percent-encoded in file names."""
    own = _mounted(path)
    pieces = json_pieces(nodes, content, embedding).repartition("tree_id").sortWithinPartitions("tree_id", "ord").select(F.replace(F.url_encode("tree_id"), F.lit("+"), F.lit("%20")).alias("name"), "piece")

    def write(rows) -> None:
        for name, part in itertools.groupby(rows, lambda r: r["name"]):
            tmp = f"{own}/.{uuid.uuid4().hex}"
            with open(tmp, "w", encoding="utf-8") as f:
                for r in part:
                    f.write(r["piece"] + "\n")
            os.replace(tmp, f"{own}/{name}.json")

    pieces.foreachPartition(write)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, nodes) of all *.meta.json below ``path``, in path order; broken
    files are left out."""
    f = spark.read.schema(schema.META).option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(path)
    return f.withColumn("_p", F.col("_metadata.file_path")).orderBy("_p").drop("_p")


def titles(meta: DataFrame) -> DataFrame:
    """(doc_id, filename) of the documents that have a name, in id order: a prompt's list of titles
    as rows, which may be many."""
    return meta.where(F.coalesce("filename", F.lit("")) != "").select("doc_id", "filename").orderBy("doc_id")


AUDIT = "ts timestamp_ntz, user_id string, action string, detail string, seq long"


def append_audit(entries: DataFrame, path: str, order: str = "seq") -> None:
    """One JSON object an entry, in a folder for each append, its files in the order of ``order``;
    times keep their microseconds."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    own = entries.repartitionByRange(order).sortWithinPartitions(order)
    own.write.option("timestampNTZFormat", micros).option("timestampFormat", micros + "XXX").json(f"{path}/batch={time.time_ns():020d}")


def audit_lines(spark: SparkSession, path: str, schema_: str = AUDIT) -> DataFrame:
    """The log's entries with ``place``, which orders them as they were written: append, file,
    start of the piece of the file, line in it. Lines that are not JSON objects are left out."""
    # A line's number in its piece of a file comes from the task that reads it, so nothing is sorted.
    lines = spark.read.option("basePath", path).text(path).select("value", F.struct(F.lpad(F.col("batch").cast("string"), 20, "0").alias("batch"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("place"))
    parsed = F.from_json("value", f"{schema_}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return lines.select(parsed.alias("e"), "place").where("e is not null and e._broken is null").select("e.*", "place").drop("_broken")


def audit_tail(spark: SparkSession, path: str, limit: int, user_id: str | None = None, schema_: str = AUDIT) -> DataFrame:
    """The newest ``limit`` entries, of one user if given, the newest first. Each file is cut to
    ``limit`` before files are merged, so that no more than that of a file is shuffled."""
    own = audit_lines(spark, path, schema_)
    if user_id is not None:
        own = own.where(F.col("user_id") == user_id)
    w = Window.partitionBy("place.batch", "place.file").orderBy(F.col("place").desc())
    cut = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return cut.orderBy(F.col("place").desc()).limit(limit)


def find_documents(ids: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(id, path): the file ``<id>.<suffix>`` of each asked ``id`` that is well formed and has one,
    the first by path. Only files right in ``folder`` count; a path that leads out of it, or
    deeper, is not served. ``files`` has a ``path`` a row, as file sources list them."""
    base = re.sub(r"^file:/*", "/", folder.rstrip("/")) + "/"
    plain = F.regexp_replace("path", "^file:/*", "/")
    rest = F.substring(plain, len(base) + 1, 1 << 20)
    inside = files.where(plain.startswith(base) & ~F.contains(rest, F.lit("/"))).select(F.regexp_extract(rest, r"^([^.]+)\.", 1).alias("id"), plain.alias("path"))
    first = inside.where("id <> ''").groupBy("id").agg(F.min("path").alias("path"))
    return ids.select("id").where(scalar.is_doc_id(F.col("id"))).distinct().join(first, "id")


def summarise(nodes: DataFrame, summariser: Callable[[Column, Column], Column] = seams.extractive_summary, max_depth: int | None = None, scratch: str | None = None, cfg: schema.RetrievalConfig = schema.CONFIG) -> DataFrame:
    """Nodes with summaries, deepest level first, as a parent's text holds its children's
    summaries. Existing summaries stay. Each level joins one level down; with ``scratch`` a
    level is written there before the next is built, which cuts the lineage."""
    spark = nodes.sparkSession
    deepest = max_depth if max_depth is not None else (nodes.agg(F.max("depth")).first()[0] or 0)
    done = None
    for d in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == d)
        if done is not None:
            line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("summary"))
            kids = done.where((F.col("depth") == d + 1) & (F.coalesce("summary", F.lit("")) != "")).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("k"))
            level = level.join(kids.select("tree_id", "node_id", F.array_join("k.line", "\n").alias("_kids")), ["tree_id", "node_id"], "left")
        else:
            level = level.withColumn("_kids", F.lit(None).cast("string"))
        text = F.left(scalar.summary_input(F.col("content"), F.col("_kids")), F.lit(cfg.summary_chars))
        new = F.when(text.isNotNull(), summariser(F.col("title"), text))
        level = level.withColumn("summary", F.coalesce(F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")), new)).select(*nodes.columns)
        if scratch:
            level.write.mode("overwrite").parquet(f"{scratch}/depth={d}")
            level = spark.read.schema(level.schema).parquet(f"{scratch}/depth={d}")
        done = level if done is None else done.unionByName(level)
    return done


#: Names of the prompts a run renders, and the words they need.
PROMPTS = {
    "answer": ("Answer {query} from:\n{context}", ("query", "context")),
    "image_description": ("Describe the image {title}.", ("title",)),
    "node_summary": ("Summarise {title}:\n{content}", ("title", "content")),
    "node_summary_fallback": ("{title}:\n{content}", ("title", "content")),
    "query_rewrite": ("Rewrite {query} for documents {titles}", ("query", "titles")),
}


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t, list(v)) for k, (t, v) in PROMPTS.items()], "key string, template string, variables array<string>").orderBy("key")
