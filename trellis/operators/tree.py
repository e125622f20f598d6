"""Section trees held flat, one row a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = "0000"
MAX_LEVEL = 3


def node_id(ord_: Column) -> Column:
    return F.when(ord_.isNotNull(), F.format_string("%04d", ord_))


def strip_page_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("<!-- page_break -->"), F.lit("\n"))


def marked_lines(docs: DataFrame) -> DataFrame:
    """(tree_id, pos, line, is_header, ord) of the lines of (tree_id, text). A line of one to
    three # and a blank, outside ``` fences, is a header; ord numbers the sections."""
    lines = docs.select("tree_id", F.posexplode(F.split(strip_page_breaks(F.col("text")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("tree_id").orderBy("pos")
    fence = F.sum(F.col("line").startswith("```").cast("int")).over(w) % 2 == 1
    header = F.col("line").rlike("^#{1,3} ") & ~fence
    return lines.withColumn("is_header", header).withColumn("ord", F.sum(F.col("is_header").cast("int")).over(w).cast("int"))


def split_sections(docs: DataFrame) -> DataFrame:
    """(tree_id, ord, header_level, title, content) from (tree_id, text).

    A header starts a section that holds it and all lines up to the next one. Lines before
    the first header are section 0.
    """
    marked = marked_lines(docs)
    parts = marked.groupBy("tree_id", "ord").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("own"), F.max(F.when(F.col("is_header"), F.col("line"))).alias("head"))
    return parts.select(
        "tree_id",
        "ord",
        F.coalesce(F.length(F.regexp_extract("head", "^(#+)", 1)), F.lit(0)).cast("int").alias("header_level"),
        F.when(F.col("ord") == 0, "Document").otherwise(F.regexp_replace(F.regexp_replace("head", "^#+ ", ""), r"^\s+|\s+$", "")).alias("title"),
        F.array_join(F.col("own.line"), "\n").alias("content"),
    )


def with_parents(sections: DataFrame) -> DataFrame:
    """Add node_id and parent_id: the nearest earlier section of a smaller level, else the root."""
    w = Window.partitionBy("tree_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("header_level") == k, F.col("ord")), True).over(w).alias(f"_l{k}") for k in range(1, MAX_LEVEL)]
    seen = sections.select("*", *last)
    above = F.when(F.col("header_level") == 2, F.col("_l1")).when(F.col("header_level") >= 3, F.greatest("_l1", "_l2"))
    parent = F.coalesce(node_id(above), F.lit(ROOT))
    return seen.withColumn("node_id", node_id(F.col("ord"))).withColumn("parent_id", F.when(F.col("header_level") > 0, parent)).drop(*[f"_l{k}" for k in range(1, MAX_LEVEL)])


def with_depth(nodes: DataFrame) -> DataFrame:
    """Add depth. A node's level falls strictly towards the root, so depth is at most
    MAX_LEVEL and is found by looking up the parent's parent: levels skip, depths do not.
    The window form needs no join: an ancestor chain of at most three levels is the last
    node of each smaller level that still is open."""
    w = Window.partitionBy("tree_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("header_level") == k, F.col("ord")), True).over(w).alias(f"_d{k}") for k in (1, 2)]
    seen = nodes.select("*", *last)
    one, two = F.col("_d1"), F.col("_d2")
    second_open = two.isNotNull() & (one.isNull() | (two > one))
    depth = F.when(F.col("header_level") == 0, 0).when(F.col("header_level") == 1, 1).when(F.col("header_level") == 2, F.when(one.isNull(), 1).otherwise(2))
    depth = depth.otherwise(1 + F.when(one.isNotNull(), 1).otherwise(0) + F.when(second_open, 1).otherwise(0))
    return seen.withColumn("depth", depth.cast("int")).drop("_d1", "_d2")


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Children of the nodes ``of`` (tree_id, node_id)."""
    keys = of.select("tree_id", F.col("node_id").alias("parent_id")).distinct()
    return nodes.join(keys, ["tree_id", "parent_id"], "left_semi")


def image_nodes(images: DataFrame, start: Column) -> DataFrame:
    """Nodes for described images (doc_id, page, idx, source, image_type, image_path, width,
    height, description); numbered from ``start`` in page order, without empty descriptions."""
    # The title and the content of an image node.
    n = start + F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "idx")) - 1
    place = F.when(F.col("source") == "pdf", F.format_string("Page %d", F.col("page"))).otherwise("standalone")
    content = F.format_string("[IMAGE_PATH:%s]\nSource: %s\nPage: %d\nType: %s\nSize: %d×%dpx\n\n%s", "image_path", "source", "page", "image_type", "width", "height", "description")
    described = images.where(F.coalesce(F.col("description"), F.lit("")) != "")
    return described.select(F.col("doc_id").alias("tree_id"), n.cast("int").alias("ord"), node_id(n.cast("int")).alias("node_id"), F.lit(ROOT).alias("parent_id"), F.concat(F.lit("Image — "), place, F.lit(" ("), F.col("image_type"), F.lit(")")).alias("title"), content.alias("content"), F.col("description").alias("summary"))


#: Image types a description may name.
IMAGE_TYPES = ("chart", "diagram", "table", "photo", "screenshot", "map")


def parse_vision(raw: Column) -> tuple[Column, Column]:
    """(description, image_type) of a vision model's answer, which is kept as it came."""
    skip = F.upper(F.regexp_replace(raw, r"^\s+|\s+$", "")) == "SKIP"
    kind = F.lower(F.regexp_replace(F.regexp_extract(raw, r"(?im)^TYPE:(.*)$", 1), r"^\s+|\s+$", ""))
    return F.when(skip, "").otherwise(raw), F.when(~skip & kind.isin(*IMAGE_TYPES), kind).otherwise("image")
