"""An exact index of vectors in balls of bounded size.

Vectors of a tree that point alike are kept together: rows are sorted by the signs of their
products with fixed random directions and cut into balls of at most ``ball_rows``. A ball is one
row: its centre, its radius, and the vectors packed as one matrix. An inner product with any of
them is at most that with the centre plus radius times the query's length, so a search looks
into the most promising balls of each query and tree first, and then only into balls that can still
hold something better than the k-th found. Results equal those of a flat search.

Balls are sorted by tree and number and written as few files, so that statistics of files and
row groups tell which trees are where; a scope reads only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trellis.operators import vector
from trellis.sources.scratch import keep

SCHEMA = "tree_id string, ball long, n int, dim int, centre array<double>, radius double, node_ids array<string>, ords array<int>, vectors array<float>"
_SLACK = 1e-7


def write(nodes: DataFrame, path: str, ball_rows: int = 64, bits: int = 16) -> None:
    """The balls of the embedded nodes (tree_id, node_id, ord, embedding)."""
    own = nodes.where(vector.embedded(F.col("embedding"))).select("tree_id", "node_id", "ord", F.col("embedding").cast("array<float>").alias("embedding"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("embedding")
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            code = np.zeros(len(b), np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = np.nan_to_num(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                signs = x @ np.random.default_rng(dim).standard_normal((dim, bits)) > 0
                code[at] = signs @ (1 << np.arange(bits)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], [*b.schema.names, "code"])

    coded = keep(own.mapInArrow(codes, T.StructType([*own.schema.fields, T.StructField("code", T.LongType())])), "index-codes")
    placed = coded.repartitionByRange("tree_id", F.size("embedding"), "code", "ord", "node_id").sortWithinPartitions("tree_id", F.size("embedding"), "code", "ord", "node_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            rows = pa.Table.from_batches(held).combine_chunks()
            out, used = _balls(rows, ball_rows, False)
            held = rows.slice(used).to_batches()
            if out:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
        if held:
            out, _ = _balls(pa.Table.from_batches(held).combine_chunks(), ball_rows, True)
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    placed.mapInArrow(pack, SCHEMA).withColumn("ball", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)


_ARROW = pa.schema([("tree_id", pa.string()), ("ball", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("node_ids", pa.list_(pa.string())), ("ords", pa.list_(pa.int32())), ("vectors", pa.list_(pa.float32()))])


def _balls(rows: pa.Table, most: int, end: bool) -> tuple[list[dict], int]:
    """Balls of the sorted rows, and how many rows they use; without ``end`` the last may grow."""
    tree, size = rows.column("tree_id").to_pylist(), rows.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    out, lo = [], 0
    for i in range(1, len(tree) + 1):
        if i < len(tree) and tree[i] == tree[lo] and size[i] == size[lo] and i - lo < most:
            continue
        if i == len(tree) and not end and i - lo < most:
            break
        own = rows.slice(lo, i - lo)
        x = own.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(i - lo, -1)
        d = x.astype(np.float64)
        centre = d.mean(axis=0)
        out.append({"tree_id": tree[lo], "ball": 0, "n": i - lo, "dim": int(size[lo]), "centre": centre, "radius": float(np.sqrt(((d - centre) ** 2).sum(axis=1)).max()), "node_ids": own.column("node_id").to_pylist(), "ords": own.column("ord").to_pylist(), "vectors": x.ravel()})
        lo = i
    return out, lo


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def unpacked(index: DataFrame) -> DataFrame:
    """(tree_id, node_id, ord, embedding) of all vectors."""
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.get("node_ids", i).alias("node_id"), F.get("ords", i).alias("ord"), F.slice("vectors", i * F.col("dim") + 1, F.col("dim")).alias("embedding")))
    return index.select("tree_id", F.explode(at).alias("x")).select("tree_id", "x.*")


def _bounds(balls: DataFrame, block: vector.Block) -> DataFrame:
    """(tree_id, ball, n, q, near, most) of all balls and queries of one length: the products with
    the centre, and the most that a vector of the ball can have."""
    length = np.sqrt((block.vectors**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centre, known = vector.matrix(b.column("centre"), block.vectors.shape[1])
            step = max(1, (1 << 16) // max(1, len(b)))
            for lo in range(0, len(block.vectors), step):
                near = centre @ block.vectors[lo : lo + step].T
                most = near + b.column("radius").to_numpy()[:, None] * length[lo : lo + step]
                at, q = np.nonzero(np.repeat(known[:, None], near.shape[1], axis=1))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ("tree_id", "ball", "n")], pa.array((q + lo).astype(np.int32)), pa.array(near[at, q]), pa.array(most[at, q])], ["tree_id", "ball", "n", "q", "near", "most"])

    return balls.select("tree_id", "ball", "n", "centre", "radius").mapInArrow(run, "tree_id string, ball long, n int, q int, near double, most double")


def _looked_into(index: DataFrame, pairs: DataFrame, block: vector.Block, k: int) -> DataFrame:
    """(tree_id, q, node_id, ord, sim): of each ball and query in ``pairs`` what can be among the k
    best. A ball meets all of its queries in one matrix product; a ball that very many queries
    ask for comes in pieces of them."""
    asked = pairs.groupBy("ball", F.floor(F.col("q") / 4096).alias("piece")).agg(F.collect_list("q").alias("qs")).drop("piece")
    own = index.select("tree_id", "ball", "dim", "node_ids", "ords", "vectors").join(asked, "ball")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                row = b.slice(r, 1)
                part = lambda c, row=row: row.column(c).flatten()
                qs = part("qs").to_numpy(zero_copy_only=False)
                x = part("vectors").to_numpy(zero_copy_only=False).reshape(-1, row.column("dim")[0].as_py()).astype(np.float64)
                sim = x @ block.vectors[qs].T
                good = np.ones(sim.shape, bool)
                if len(x) > k:
                    good = sim >= -np.partition(-sim, k - 1, axis=0)[k - 1] - _SLACK
                at, q = np.nonzero(good)
                tree = pa.array([row.column("tree_id")[0].as_py()] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([tree, pa.array(qs[q].astype(np.int32)), part("node_ids").take(pa.array(at)), part("ords").take(pa.array(at)), pa.array(sim[at, q])], ["tree_id", "q", "node_id", "ord", "sim"])

    return own.mapInArrow(run, "tree_id string, q int, node_id string, ord int, sim double")


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Exact top k of each query and tree: query_id, variant_no, query_text, tree_id, node_id, ord, sim,
    rank. Queries and vectors of other lengths do not meet."""
    spark = index.sparkSession

    def one(block: vector.Block) -> DataFrame:
        _, _, first, rest = _phases(index, block, k)
        best = vector.top(vector.union([first, _looked_into(index, rest, block, k)]), k, "sim", ["q", "tree_id"], ["ord"])
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(block.query_id)), pa.int32()), "query_id": block.query_id, "variant_no": block.variant_no, "query_text": block.query_text}))
        return best.join(F.broadcast(names), "q").drop("q")  # one block of queries

    found = vector.each_block(queries, one)
    if found is not None:
        return found
    return spark.createDataFrame([], "tree_id string, node_id string, ord int, sim double, rank int, query_id long, variant_no int, query_text string")


def _phases(index: DataFrame, block: vector.Block, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bounds of all balls; the most promising balls, which hold k vectors; what these hold; the
    balls to look into after that. No more than k balls of a query and tree can be among the most
    promising, so a tree of any size is cut to these before its balls meet."""
    bounds = keep(_bounds(index, block), "index-bounds")
    best = Window.partitionBy("q", "tree_id").orderBy(F.col("near").desc(), "ball")
    few = bounds.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    before = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    promising = keep(few.withColumn("_b", before).where(F.col("_b") < k).select("tree_id", "ball", "q"), "index-promising")
    first = keep(_looked_into(index, promising, block, k), "index-first")
    kth = vector.top(first, k, "sim", ["q", "tree_id"], ["ord"]).where(F.col("rank") == k).select("q", "tree_id", F.col("sim").alias("kth"))
    hope = bounds.join(kth, ["q", "tree_id"], "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - _SLACK))
    return bounds, promising, first, hope.join(promising, ["tree_id", "ball", "q"], "left_anti")


def share_skipped(index: DataFrame, queries: DataFrame, k: int = 20) -> float:
    """The share of (ball, query) pairs that a search does not look into."""
    every = skipped = 0
    for b in vector.blocks(queries):
        bounds, promising, _, rest = _phases(index, b, k)
        n = bounds.count()
        every += n
        skipped += n - promising.count() - rest.count()
    return skipped / every if every else 0.0
