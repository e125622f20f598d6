"""Merkle manifest of a dataset: a root digest, and a proof for each row that it is part of it.

A row's leaf is the digest of its fields, each with its length before it. The leaves of a
tree (``tree_col``) stand in the order of their key and are hashed two by two, level by
level, until one digest is left, the subroot; a node without a partner is hashed alone. The
subroots, in the order of the trees (null first, by bytes), are hashed to the root alike.

Ranks come from one range shuffle of the narrow leaf rows and the counts of its partitions,
so no tree is ever sorted in one task. The binary digits of a rank are columns. Within
blocks of ``2 ** block_bits`` leaves they are grouped away one after the other, the lowest
first, and each grouping nests the nodes of the level below as structs: one shuffle and one
sort by (tree, block, digits) serve all levels, as each grouping's keys are a prefix of that
order. Roots of blocks are the leaves of the next tier, a ``2 ** block_bits``-th as many. Coming
back, what stands above a block enters the same grouping as one more row of the block, and
a last transform and explode unfolds the nested structs into leaves with their siblings;
nothing is joined for that. Tables between tiers are written to the shared folder.

Defined results: a null field is written as ``-``; a null tree is a tree of its own, the
first; a null key comes before all others; rows that repeat a key are ordered by their leaf
and equal rows each have a place; an only leaf is its subroot, an only subroot is the root; an
empty table has no rows; texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.llm.common import materialize, table

#: Rows of (tree, range partition) that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 100_000
_STEP = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as its byte count, a colon and itself; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def fold_up(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """The digests of a proof in one text, from the leaf's level upwards."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def ranked(leaves: DataFrame) -> DataFrame:
    """(t, key, hash, own) with the rank of each row in its tree, and the tree's height: the
    number of levels until one node is left."""
    order = ["t", "key", "hash", "nth"]
    own = materialize(leaves.withColumn("nth", F.monotonically_increasing_id()), "merkle-leaves")
    placed = materialize(own.repartitionByRange(*order).sortWithinPartitions(*order).select("t", "hash", "own", F.monotonically_increasing_id().alias("at")), "merkle-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("t", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    by_part = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("t", "part", "start", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("t")).alias("size"))
    parts = materialize(parts, "merkle-parts")
    few = parts.count() <= MAX_BROADCAST
    height = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    both = placed.join(F.broadcast(parts) if few else parts, ["t", "part"])
    return both.select("t", (F.col("before") + F.col("at") - F.col("start")).alias("rank"), height.alias("height"), "hash", "own")


def _rollup(nodes: DataFrame, bits: int, above: DataFrame | None = None) -> DataFrame:
    """A row for each block: t, block, height, node. With ``above`` (t, rank, above), what
    stands above the block as well, and node has all nodes of the block nested in it."""
    nest = above is not None
    digits = [f"d{j}" for j in range(bits)]
    own = [F.col("rank"), F.col("own")] if nest else []
    rows = nodes.select("t", F.shiftright("rank", bits).alias("block"), "height", F.struct("hash", *own).alias("node"), *[F.shiftright("rank", j).bitwiseAND(1).cast("int").alias(d) for j, d in enumerate(digits)])
    if nest:
        rows = rows.unionByName(above.select("t", F.col("rank").alias("block"), "above"), allowMissingColumns=True)
    rows = rows.repartition("t", "block").sortWithinPartitions("t", "block", *reversed(digits))
    further = ["height", *(["above"] if nest else [])]
    for j, d in enumerate(digits):
        keys = ["t", "block", *reversed(digits[j + 1 :])]
        two = [F.first(F.when(F.col(d) == i, F.col("node")), ignorenulls=True).alias(f"k{i}") for i in (0, 1)]
        rows = rows.groupBy(*keys).agg(*two, *[F.first(c, ignorenulls=True).alias(c) for c in further])
        h0, h1 = F.col("k0.hash"), F.coalesce("k1.hash", F.lit(""))
        up = F.when(F.col("height") > j, digest(h0, h1)).otherwise(h0).alias("hash")
        kids = [F.filter(F.array("k0", "k1"), lambda k: k.isNotNull()).alias("kids")] if nest else []
        rows = rows.select(*keys, *further, F.when(F.col("k0").isNotNull(), F.struct(up, *kids)).alias("node"))
    return rows


def _unfold(blocks: DataFrame, bits: int) -> DataFrame:
    """t, rank, hash, own, path, above of all leaves nested in the blocks."""

    def down(node: Column, path: Column, level: int) -> Column:
        if not level:
            return F.array(F.struct(node["rank"].alias("rank"), node["hash"].alias("hash"), node["own"].alias("own"), path.alias("path")))
        kids = node["kids"]

        def one(kid: Column, i: Column) -> Column:
            left = F.when(i == 1, kids[0]["hash"]).otherwise("")
            right = F.when((i == 0) & (F.size(kids) == 2), F.try_element_at(kids, F.lit(2))["hash"]).otherwise("")
            step = F.when(F.col("height") >= level, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(f"array<{_STEP}>"))
            return down(kid, F.concat(step, path), level - 1)

        return F.flatten(F.transform(kids, one))

    leaves = blocks.select("t", "above", F.explode(down(F.col("node"), F.col("above.path"), bits)).alias("x"))
    return leaves.select("t", "x.rank", "x.hash", "x.own", "x.path", "above")


def _tiers(nodes: DataFrame, bits: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The leaves, the roots of their blocks, the roots of those, until each tree is one
    block, with the digits of each; and the roots of all trees (t, rank, hash)."""
    tiers = []
    while True:
        last = nodes.agg(F.max("rank")).first()[0] or 0
        own = min(bits, max(1, last.bit_length()))
        roots = _rollup(nodes, own).select("t", F.col("block").alias("rank"), F.greatest(F.col("height") - own, F.lit(0)).alias("height"), "node.hash", F.lit(None).cast("string").alias("own"))
        roots = materialize(roots, "merkle-roots")
        tiers.append((nodes, own))
        if last < 1 << bits:
            return tiers, roots.select("t", "rank", "hash")
        nodes = roots


def _proofs(tiers: list[tuple[DataFrame, int]], above: DataFrame) -> DataFrame:
    """Leaves of the first tier with their whole path, tier by tier from the top."""
    for tier, bits in reversed(tiers[1:]):
        rows = _unfold(_rollup(tier, bits, above), bits)
        above = materialize(rows.select("t", "rank", F.struct("path", "above.subroot", "above.root").alias("above")), "merkle-above")
    return _unfold(_rollup(tiers[0][0], tiers[0][1], above), tiers[0][1])


def manifest(leaves: DataFrame, tree_col: str, key_col: str, leaf_col: str, carry: list[str] | None = None, block_bits: int = 10) -> DataFrame:
    """tree, rank, leaf, the ``carry`` columns, path array<struct<left, right>> (siblings from
    the leaf upwards, to the root over all trees), subroot and root of each row of ``leaves``."""
    if not 1 <= block_bits <= 16:
        raise ValueError("block_bits must be 1 to 16")
    tree = F.col(tree_col).cast("string")
    own = F.struct(tree.alias("tree"), *[F.col(c) for c in carry or []])
    # a text that sorts as the tree does, null first, and can be grouped and joined by
    t = F.coalesce(F.concat(F.lit("="), tree), F.lit(""))
    nodes = ranked(leaves.select(t.alias("t"), F.col(key_col).alias("key"), F.col(leaf_col).alias("hash"), own.alias("own")))
    tiers, subroots = _tiers(nodes, block_bits)
    over = ranked(subroots.select(F.lit("").alias("t"), F.col("t").alias("key"), "hash", F.col("t").alias("own")))
    top, root = _tiers(over, block_bits)
    first = root.select("t", "rank", F.struct(F.array().cast(f"array<{_STEP}>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("above"))
    langs = _proofs(top, first)
    above = materialize(langs.select(F.col("own").alias("t"), F.lit(0).cast("long").alias("rank"), F.struct("path", F.col("hash").alias("subroot"), "above.root").alias("above")), "merkle-trees")
    found = _proofs(tiers, above)
    return found.select("own.tree", "rank", F.col("hash").alias("leaf"), *[F.col(f"own.`{c}`") for c in carry or []], "path", "above.subroot", "above.root")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def documents_manifest(docs: DataFrame, block_bits: int = 10) -> DataFrame:
    """The manifest of documents, a tree for each language, with the leaf that each row would
    have if its n_chars were one more where 7 divides the id's crc32 (else null)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = digest(*[field(F.col(c)) for c in FIELDS])
    bad = digest(*[field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS])
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), bad).alias("bad"))
    return manifest(leaves, "lang", "doc_id", "leaf", ["doc_id", "bad"], block_bits)


def verify(found: DataFrame) -> DataFrame:
    """Digests of proofs, and whether the leaves as they are now still give the root."""
    again = fold_up(F.coalesce("bad", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the manifest of all documents, checked with some of them tampered with."""
    return verify(documents_manifest(table(spark, sf_dir, "documents")))


_F = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_F.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


SQL = f"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), crc AS (
  SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tbl.t[(xor(c, b) & 255) + 1]))) AS crc FROM documents d, tbl
), l0 AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql("(n_chars + 1)")} END AS bad FROM crc
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY lang, doc_id) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM l0
), lv AS (
  SELECT lang, 0 AS j, p, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, j + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM lv WHERE n > 1 GROUP BY lang, j, p // 2, n
), subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM lv WHERE n = 1
), up AS (
  SELECT 0 AS j, p, n, subroot AS h FROM subs
  UNION ALL SELECT j + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY j, p // 2, n
), a AS (
  SELECT id, lang, 0 AS j, p, n, '' AS proof, coalesce(bad, leaf) AS f FROM leaves
  UNION ALL SELECT a.id, a.lang, a.j + 1, a.p // 2, (a.n + 1) // 2, a.proof || coalesce(s.h, ''), sha256(CASE WHEN a.p % 2 = 1 THEN s.h || a.f ELSE a.f || coalesce(s.h, '') END)
  FROM a LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM a.lang AND s.j = a.j AND s.p = xor(a.p, 1) WHERE a.n > 1
), b AS (
  SELECT id, 0 AS j, subs.p, subs.n, proof, f FROM a JOIN subs ON a.lang IS NOT DISTINCT FROM subs.lang WHERE a.n = 1
  UNION ALL SELECT b.id, b.j + 1, b.p // 2, (b.n + 1) // 2, b.proof || coalesce(s.h, ''), sha256(CASE WHEN b.p % 2 = 1 THEN s.h || b.f ELSE b.f || coalesce(s.h, '') END)
  FROM b LEFT JOIN up s ON s.j = b.j AND s.p = xor(b.p, 1) WHERE b.n > 1
)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM b JOIN leaves USING (id) JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang, (SELECT h FROM up WHERE n = 1) r
WHERE b.n = 1
"""
