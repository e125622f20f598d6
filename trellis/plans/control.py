"""Queries over ingestion, text functions, tasks, cache and access, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import fixtures as fx
from trellis.functions import scalar as sc
from trellis.operators import access, cache, index, tasks, tree
from trellis.plans import retrieval as rt
from trellis.schema import NO_DOCUMENTS
from trellis.sources import ingest, stages
from trellis.sources.scratch import folder
from trellis.streaming import progress, windows


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Upload metadata out of orders: name, type, size and first bytes."""
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return fx.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 13 == 0, "").otherwise(F.concat(pick("dir/a", "b", "x/y/c", "d.e"), k.cast("string"), pick(".pdf", ".PNG", ".txt", ".jpg", ".pdf"))).alias("filename"),
        pick("application/pdf", "image/png", "text/plain", "image/webp", "application/pdf", "image/gif", "application/octet-stream").alias("mime"),
        F.when(k % 11 == 0, 0).otherwise((F.col("o_totalprice") * 200).cast("long")).alias("size"),
        F.when(k % 3 == 0, "%PDF").otherwise("\x89PNG").alias("head"),
    )


UPLOADS = """u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE (['dir/a', 'b', 'x/y/c', 'd.e'])[o_orderkey % 4 + 1] || o_orderkey || (['.pdf', '.PNG', '.txt', '.jpg', '.pdf'])[o_orderkey % 5 + 1] END AS filename,
  (['application/pdf', 'image/png', 'text/plain', 'image/webp', 'application/pdf', 'image/gif', 'application/octet-stream'])[o_orderkey % 7 + 1] AS mime,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 200) AS BIGINT) END AS size, CASE WHEN o_orderkey % 3 = 0 THEN '%PDF' ELSE 'PNG' END AS head FROM orders),
v AS (SELECT *, CASE WHEN filename = '' THEN 'upload.pdf' ELSE string_split(filename, '/')[-1] END AS safe FROM u)"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """Extracted images out of lineitem."""
    return fx.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).cast("string").alias("doc_id"),
        F.col("l_partkey").alias("page"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("idx"),
        (F.col("l_quantity") * 8).cast("int").alias("width"),
        (F.col("l_quantity") * 6).cast("int").alias("height"),
        F.when(F.col("l_linenumber") == 1, "standalone").otherwise("pdf").alias("source"),
        F.concat(F.lit("/img/"), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("image_path"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("TYPE: Chart\nA chart of "), F.col("l_linestatus"), F.lit(" \n"))).when(F.col("l_returnflag") == "R", " skip ").otherwise("A scene\ntype: Painting\nTYPE: map").alias("raw"),
    )


IMAGES = """im AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS doc_id, l_partkey AS page, l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + CAST(floor(l_quantity) AS BIGINT) AS idx, CAST(floor(l_quantity * 8) AS INTEGER) AS width, CAST(floor(l_quantity * 6) AS INTEGER) AS height,
  CASE WHEN l_linenumber = 1 THEN 'standalone' ELSE 'pdf' END AS source, '/img/' || l_orderkey || '.png' AS image_path,
  CASE l_returnflag WHEN 'N' THEN 'TYPE: Chart' || chr(10) || 'A chart of ' || l_linestatus || ' ' || chr(10) WHEN 'R' THEN ' skip ' ELSE 'A scene' || chr(10) || 'type: Painting' || chr(10) || 'TYPE: map' END AS raw FROM lineitem),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, idx) AS n FROM im WHERE width >= 100 AND height >= 100) WHERE n <= 50),
ps AS (SELECT *, CASE WHEN upper(trim(raw)) = 'SKIP' THEN '' ELSE raw END AS description, CASE WHEN upper(trim(raw)) <> 'SKIP' AND starts_with(raw, 'TYPE: Chart') THEN 'chart' ELSE 'image' END AS image_type FROM cp)"""


def described(spark, d):
    text, kind = tree.parse_vision(F.col("raw"))
    return ingest.capped_images(images(spark, d)).withColumn("description", text).withColumn("image_type", kind)


def s06(spark: SparkSession, d: str) -> DataFrame:
    """All trees written as nested JSON, a file each, and read again."""
    n = fx.nodes(spark, d, content=False).select("tree_id", "node_id", "ord", "parent_id", "depth", "title", F.lit("").alias("summary"))
    roots = n.select("tree_id").distinct().select("tree_id", F.lit("0000").alias("node_id"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("Document").alias("title"), F.lit("").alias("summary"))
    path = folder(spark, "trees")
    ingest.write_trees(n.unionByName(roots), path, content=False)
    return ingest.read_trees(spark, path).select("tree_id", "node_id", "ord", "parent_id", "depth", "title")


def s07(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all embedded nodes written as an index and read again."""
    path = folder(spark, "index")
    index.write(rt.corpus(spark, d), path)
    return index.unpacked(index.read(spark, path)).groupBy("tree_id").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).cast("long").alias("floats"))


def s02(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown files and benchmark items as PDF ones, read as bytes, taken if
    their first bytes are right, and converted; the PDF converter is the caller's, here one
    for the bytes that are written."""
    path = folder(spark, "uploads")
    notes = fx.markdown(spark, d).select(F.concat("tree_id", F.lit(".md")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    items = fx.table(spark, d, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(".pdf")).alias("name"), F.encode(F.concat(F.when(F.col("item_id") % 10 != 9, "%PDF-1.4\n").otherwise("other"), F.col("text")), "UTF-8").alias("content"))
    ingest.write_files(notes.unionByName(items), path)
    files = ingest.read_binary(spark, path).withColumn("mime", F.lit("application/pdf"))
    taken = files.where(F.col("filename").endswith(".md") | sc.reject_reason(F.col("mime"), F.col("filename"), F.col("size"), F.col("head")).isNull())
    return ingest.convert(taken, {".pdf": lambda c: "# PDF\n" + c.removeprefix(b"%PDF-1.4\n").decode()}).select("filename", F.length("text").alias("n"), F.md5("text").alias("h"))


def s08(spark: SparkSession, d: str) -> DataFrame:
    """A metadata file for each source, and a broken one, read in path order, which is that
    of the sources."""
    path = folder(spark, "meta")
    name = F.concat(F.lit("doc-"), F.url_encode(F.coalesce("doc_id", F.lit(""))), F.lit(".meta.json"))
    files = rt.meta(spark, d).select(name.alias("name"), F.to_json(F.struct("doc_id", "filename", "nodes"), {"ignoreNullFields": "false"}).alias("content"))
    ingest.write_files(files.unionByName(spark.range(1).select(F.lit("broken.meta.json").alias("name"), F.lit('{"doc_id": ').alias("content"))), path)
    return ingest.read_meta(spark, path)


def s11(spark: SparkSession, d: str) -> DataFrame:
    """The whole log, appended in two halves and read again."""
    path = folder(spark, "audit")
    log = fx.audit(spark, d)
    even = F.coalesce(F.col("seq") % 2 == 0, F.lit(True))
    ingest.append_audit(log.where(even), path)
    ingest.append_audit(log.where(~even), path)
    return spark.read.schema("ts timestamp_ntz, user_id string, action string, detail string, seq long").json(path).groupBy("action").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.sum(F.length("detail")).alias("chars"))


def s01(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a file of its own, read by :func:`ingest.read_texts`."""
    path = folder(spark, "texts")
    ingest.write_files(fx.markdown(spark, d).select(F.concat("tree_id", F.lit(".md")).alias("name"), F.concat("text", F.lit("\n")).alias("content")), path)
    return ingest.read_texts(spark, path).select("tree_id", F.length("text").alias("n"), F.md5("text").alias("h"))


#: The first bytes of a PNG image, up to its size, as hex digits.
PNG_HEAD = "89504E470D0A1A0A0000000D49484452"


def png(width: Column, height: Column) -> Column:
    return F.concat(F.unhex(F.lit(PNG_HEAD)), F.unhex(F.lpad(F.hex(width), 8, "0")), F.unhex(F.lpad(F.hex(height), 8, "0")))


def s13(spark: SparkSession, d: str) -> DataFrame:
    """Images of each order's document as bytes, extracted and capped for each of 50 uploads."""
    found = images(spark, d).select("doc_id", "page", "idx", F.concat(F.col("page").cast("string"), F.lit(" "), F.col("idx").cast("string"), F.lit(" "), F.hex(png(F.col("width"), F.col("height")))).alias("line"), F.floor(F.col("idx") / 1_000_000).alias("part"))
    files = found.groupBy("doc_id", "part").agg(F.encode(F.array_join(F.collect_list("line"), "\n"), "UTF-8").alias("content"))

    def extractor(content: bytes) -> list[tuple[int, int, bytes]]:
        return [(int(a), int(b), bytes.fromhex(c)) for a, b, c in (x.split() for x in content.decode().split("\n"))]

    return ingest.capped_images(ingest.extract_images(files, extractor)).select("doc_id", "page", "idx", "width", "height")


def s14(spark: SparkSession, d: str) -> DataFrame:
    """Image files with readable and with broken first bytes."""
    k = F.col("o_orderkey")
    files = uploads(spark, d).select("o_orderkey", F.concat(F.lit("img/"), k.cast("string")).alias("path"), F.concat(k.cast("string"), F.lit(".png")).alias("filename"), F.when(k % 7 != 0, png(k % 900 + 1, k % 700 + 1)).otherwise(F.unhex(F.lit("00FF"))).alias("content"))
    says = lambda p: F.concat(F.lit("TYPE: "), F.when(p.endswith("3"), "Map").otherwise("photo"), F.lit("\n"), p)
    return ingest.standalone_images(files, says).select("doc_id", "page", "idx", "source", "image_type", "image_path", "width", "height", "description")


def m07(spark: SparkSession, d: str) -> DataFrame:
    """Missing embeddings of all nodes from an encoder, scaled to length one."""
    n = fx.nodes(spark, d, content=False).withColumn("embedding", F.when(F.col("ord") % 2 == 0, F.col("embedding")))
    done = ingest.seams.embed(n.select("tree_id", "node_id", "ord", "summary", "embedding"), encode=lambda texts: [[float(len(t)), 10.0] for t in texts])
    at = lambda i: F.round(F.try_element_at("embedding", F.lit(i)).cast("double"), 6)
    return done.select("tree_id", "node_id", F.size("embedding").alias("dim"), at(1).alias("v1"), at(2).alias("v2"))


def no_documents(spark: SparkSession, d: str) -> DataFrame:
    """What scopes with and without documents are told."""
    asked = fx.table(spark, d, "documents").select(F.col("source").alias("scope")).distinct().unionByName(spark.createDataFrame([("missing",), ("src",)], "scope string"))
    held = fx.table(spark, d, "documents").groupBy(F.col("source").alias("scope")).agg(F.count("*").alias("n"))
    return asked.join(held, "scope", "left").select("scope", F.when(F.coalesce("n", F.lit(0)) == 0, NO_DOCUMENTS).alias("answer"))


def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.md5(F.col("doc_id").cast("string"))).when(F.col("doc_id") % 4 == 1, F.upper(F.md5(F.col("doc_id").cast("string")))).when(F.col("doc_id") % 4 == 2, F.lpad(F.col("doc_id").cast("string"), 32, "0")).otherwise(F.lit("../etc/passwd")).alias("id"), "doc_id")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    n = rt.md_nodes(spark, d).withColumn("summary", F.lit(None).cast("string"))
    return ingest.summarise(n.select("tree_id", "node_id", "ord", "parent_id", "depth", "title", "content", "summary"), max_depth=3)


def stories(spark: SparkSession, d: str) -> DataFrame:
    """Summary inputs of all nodes, with their children's titles as summaries."""
    n = rt.md_nodes(spark, d)
    kids = n.where("depth > 0").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("ord", F.concat(F.lit("- "), F.col("title"), F.lit(": s"), F.col("ord").cast("string")).alias("l")))).alias("k"))
    return n.join(kids, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.left(sc.summary_input(F.col("content"), F.array_join("k.l", "\n")), F.lit(5000)).alias("input"))


def rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a rewritten form and variants, some of them bad."""
    b = fx.table(spark, d, "benchmark")
    q = F.left("text", F.lit(40))
    bad = F.when(F.col("item_id") % 4 == 0, " ok ").when(F.col("item_id") % 4 == 1, F.repeat("text", 40)).when(F.col("item_id") % 4 == 2, F.concat(F.lit("  "), F.left("text", F.lit(20)), F.lit(" "))).otherwise(None)
    return b.select("item_id", q.alias("query"), bad.alias("rewritten"), F.array(F.translate(q, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("  "), F.lit("what is it"), F.concat(F.lit(" "), F.left("text", F.lit(9)), F.lit(" ")), F.lit("what is it"), F.lit("one more")).alias("variants"))


REWRITES = """rw AS (SELECT item_id, left(text, 40) AS query, CASE item_id % 4 WHEN 0 THEN ' ok ' WHEN 1 THEN repeat(text, 40) WHEN 2 THEN '  ' || left(text, 20) || ' ' END AS rewritten, text FROM benchmark),
g AS (SELECT *, CASE WHEN length(trim(rewritten)) BETWEEN 5 AND 2000 THEN trim(rewritten) ELSE query END AS chosen, list_filter(list_transform([translate(query, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '  ', 'what is it', ' ' || left(text, 9) || ' ', 'what is it', 'one more'], lambda v: trim(v, ' ' || chr(10))), lambda v: v <> '' AND lower(v) <> lower(trim(query)))[1:3] AS variants FROM rw)"""


def tokens_table(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select(F.col("event_id").alias("jti"), F.col("user_id"), (F.col("event_id") % 3600).alias("exp"))


def new_users(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).otherwise(F.col("s_name")).alias("username"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit("@EXAMPLE.com"))).otherwise("new@example.com").alias("email"))


def eta_times(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.col("value").alias("seconds"))


def eta(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's task, of which only some have begun."""
    known = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("task_id"), (F.col("c_custkey") % 900 + 100).alias("total"))
    return tasks.eta(eta_times(spark, d), known).select("task_id", "done", F.round("ema", 6).alias("ema"), F.round("eta_seconds", 4).alias("eta"))


def p01(spark: SparkSession, d: str) -> DataFrame:
    """Progress as a watcher sees it: the events come in two halves, with a restart between them,
    then every customer asks for the task of their number. What is told for sure, whatever the
    clock: the end of each run, and the answers."""
    base = folder(spark, "progress")
    events = fx.task_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    early = F.coalesce(F.unix_micros("ts") <= ((lo or 0) + (hi or 0)) // 2, F.lit(True))
    asks = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("task_id"))
    asks.limit(0).write.parquet(f"{base}/asks")
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(f"{base}/{name}")
    for half, asked in ((early, asks.limit(0)), (~early, asks)):
        events.where(half).write.mode("append").parquet(f"{base}/events")
        asked.write.mode("append").parquet(f"{base}/asks")
        feed = progress.feed(read(events, "events"), read(asks, "asks"))
        progress.stop_when_idle(progress.start(feed, f"{base}/check", f"{base}/out", "append", processingTime="500 milliseconds"))
    told = spark.read.schema(progress.FEED).parquet(f"{base}/out").where("kind <> 'progress'")
    return told.select("task_id", "kind", "status", "stage", F.round("pct", 6).alias("pct"), "error", "seq")


def task_state(spark: SparkSession, d: str) -> DataFrame:
    return tasks.state(fx.task_events(spark, d))


STATE = """ev AS (SELECT CAST(user_id AS VARCHAR) AS task_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status, event_type AS stage,
  CASE WHEN event_type <> 'error' THEN value END AS pct, CASE WHEN event_type = 'error' THEN props END AS error FROM events),
state AS (SELECT task_id, arg_max(status, (ts, seq)) AS status, arg_max(stage, (ts, seq)) AS stage, arg_max(pct, (ts, seq)) FILTER (pct IS NOT NULL) AS pct, arg_max(error, (ts, seq)) FILTER (error IS NOT NULL) AS error, max(ts) AS updated_at FROM ev GROUP BY task_id)"""
LOG = """lg AS (SELECT event_type || '-' || (user_id % 10) AS cache_key, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id AS seq, [CAST(user_id % 7 AS VARCHAR), CAST(user_id % 5 + 10 AS VARCHAR)] AS doc_ids FROM events)"""
USERS = """us AS (SELECT c_custkey AS user_id, c_name AS username, lower(c_name) || '@example.com' AS email, 'Full ' || c_name AS full_name, (['admin', 'manager', 'analyst', 'viewer'])[c_custkey % 4 + 1] AS role, c_custkey % 10 <> 0 AS is_active, c_custkey % 97 AS created_at FROM customer)"""
PERMS = """perm(role, permission) AS (VALUES
  ('admin', 'ingest:create'), ('admin', 'ingest:view_progress'), ('admin', 'documents:list'), ('admin', 'documents:delete'), ('admin', 'query:execute'), ('admin', 'citations:view'), ('admin', 'tasks:cancel'), ('admin', 'tasks:view_all'), ('admin', 'cache:view'), ('admin', 'cache:manage'), ('admin', 'admin:users'), ('admin', 'admin:roles'), ('admin', 'admin:view_audit'),
  ('manager', 'ingest:create'), ('manager', 'ingest:view_progress'), ('manager', 'documents:list'), ('manager', 'documents:delete'), ('manager', 'query:execute'), ('manager', 'citations:view'), ('manager', 'tasks:cancel'), ('manager', 'tasks:view_all'), ('manager', 'cache:view'), ('manager', 'cache:manage'),
  ('analyst', 'ingest:view_progress'), ('analyst', 'documents:list'), ('analyst', 'query:execute'), ('analyst', 'citations:view'), ('analyst', 'cache:view'), ('viewer', 'query:execute'), ('viewer', 'citations:view'))"""


def p10(spark: SparkSession, d: str) -> DataFrame:
    out = tasks.merged(fx.client_tasks(spark, d), fx.client_updates(spark, d), ["status", "stage", "pct"])
    return out.orderBy(F.col("new_at").desc_nulls_last(), "position").select("task_id", "status", "stage", F.round("pct", 6).alias("pct"), "new_at", "position")


def g05(spark: SparkSession, d: str) -> DataFrame:
    return access.merge_users(fx.users(spark, d), fx.user_changes(spark, d), ["seq"]).select("user_id", "username", "full_name", "role", "is_active", "created_at")


def moves(spark: SparkSession, d: str) -> DataFrame:
    return tasks.lifecycle(fx.task_actions(spark, d), fx.restarts(spark, d))


def p05(spark: SparkSession, d: str) -> DataFrame:
    """Errors cancel a task, signups submit it again, all else is work."""
    e = fx.task_events(spark, d)
    controls = e.where("stage in ('error', 'signup')").select("task_id", "ts", F.when(F.col("stage") == "error", "cancel").otherwise("submit").alias("action"))
    work = e.where("stage not in ('error', 'signup')").select("task_id", "ts", "seq", "stage")
    return tasks.cancelled(work, controls).select("task_id", "seq", "stage", "dropped")


def p04(spark: SparkSession, d: str) -> DataFrame:
    """Summaries taken up again: first of every other tree, with some sections as they were
    before, then of all trees as they are. ``redone`` is what the second run worked on."""
    path = folder(spark, "stages")
    now = rt.md_nodes(spark, d).select("tree_id", "node_id", "ord", "parent_id", "depth", "title", "content")
    old = now.where(F.substring("tree_id", 2, 20).cast("long") % 2 == 0).withColumn("content", F.when(F.col("ord") % 3 == 2, F.concat("content", F.lit(" as it was"))).otherwise(F.col("content")))
    stages.summaries(spark, path, old, ingest.seams.extractive_summary)
    return stages.summaries(spark, path, now, ingest.seams.extractive_summary).select("tree_id", "node_id", "summary", "redone")


def s12(spark: SparkSession, d: str) -> DataFrame:
    """The log in three appends, broken lines among them, and its newest entries of a user."""
    path = folder(spark, "audit")
    log = fx.audit(spark, d)
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    third = F.floor((F.col("seq") - lo) * 3 / (hi - lo + 1))
    for i in range(3):
        ingest.append_audit(log.where(third == i), path)
        log.where(third == i).select(F.concat(F.lit('{"user_id": "7", "seq": '), F.col("seq").cast("string")).alias("value")).write.text(f"{path}/batch={i + 1:020d}")
    return ingest.audit_tail(spark, path, 100, "7").select("user_id", "action", "detail", "seq")


def s15(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document that has an id, under one of two suffixes or both, others a folder
    deeper, and all ids looked up."""
    path = folder(spark, "served")
    ids = doc_ids(spark, d)
    own = ids.where(sc.is_doc_id(F.col("id")) & (F.col("doc_id") % 8 == 0))
    name = lambda end: F.concat("id", F.lit(end)).alias("name")
    both = own.select(name(".pdf"), F.lit("x").alias("content")).unionByName(own.where("doc_id % 3 = 0").select(name(".md"), F.lit("y").alias("content")))
    ingest.write_files(both, path)
    ingest.write_files(ids.where(sc.is_doc_id(F.col("id")) & (F.col("doc_id") % 8 != 0)).select(name(".pdf"), F.lit("z").alias("content")), f"{path}/deeper")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = ingest.find_documents(ids, files, path)
    return ids.join(found, "id").select("doc_id", "id", F.element_at(F.split("path", "/"), -1).alias("file"))


def _delivered(spark: SparkSession, d: str, late: bool):
    """Events as a stream in two deliveries; with ``late``, a part of the old ones comes in the
    second. The result of a function of the stream, as it was emitted in both."""
    base = folder(spark, "windows")
    e = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), "event_id")
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    first = F.unix_micros("ts") <= (lo + hi) // 2
    if late:
        first = first & (F.col("action") != "error")

    def run(window) -> DataFrame:
        for half in (first, ~first):
            e.where(half).write.mode("append").parquet(f"{base}/in")
            out = window(spark.readStream.schema(e.schema).parquet(f"{base}/in"))
            progress.start(out, f"{base}/check", f"{base}/out", "append").awaitTermination()
        return spark.read.parquet(f"{base}/out").drop("batch")

    return run


def audit_hours(spark: SparkSession, d: str) -> DataFrame:
    """Entries an hour, user and action, all of the old errors delivered late."""
    out = _delivered(spark, d, True)(lambda e: windows.counts(e, ["user_id", "action"]))
    return out.select(F.unix_seconds("start").alias("start"), "user_id", "action", "n")


def task_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Spells of activity of each task that have ended."""
    out = _delivered(spark, d, False)(lambda e: windows.sessions(e, "user_id", "6 hours"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each prompt with its number of variables, and how often the tables' nodes, images and
    questions need it."""
    need = fx.nodes(spark, d).where("content <> ''").select(F.lit("node_summary").alias("key"))
    need = need.unionByName(fx.nodes(spark, d).where("content = ''").select(F.lit("node_summary_fallback").alias("key")))
    need = need.unionByName(ingest.capped_images(images(spark, d)).select(F.lit("image_description").alias("key")))
    for key in ("answer", "query_rewrite"):
        need = need.unionByName(fx.queries(spark, d).select(F.lit(key).alias("key")))
    used = need.groupBy("key").agg(F.count("*").alias("uses"))
    return ingest.prompts(spark).join(used, "key", "left").select("key", F.size("variables").alias("n"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))


def _val(spark, d):
    return fx.table(spark, d, "events").select("event_id", "value", "props", "event_type")


def _pw(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select("c_custkey", F.when(k % 6 == 0, F.repeat(F.lit("é"), 40)).when(k % 6 == 1, "Ab1!").when(k % 6 == 2, "abcdefg1!").when(k % 6 == 3, "ABCDEFG1!").when(k % 6 == 4, F.concat(F.lit("Abcdefg!"), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("Abcdefg"), F.when(k % 4 == 1, "1").otherwise("٣"), F.when(k % 7 == 0, "?").otherwise(""))).alias("pw"))


QUERIES = {
    "S01": s01,
    "S02": s02,
    "S03": lambda s, d: uploads(s, d).select("o_orderkey", sc.reject_reason(F.col("mime"), F.col("filename"), F.col("size"), F.col("head")).alias("reason")),
    "S04": lambda s, d: uploads(s, d).select("o_orderkey", sc.safe_filename(F.col("filename")).alias("filename")),
    "S05": lambda s, d: uploads(s, d).select("o_orderkey", sc.client_reject(F.col("mime"), F.col("size")).alias("reason")),
    "S06": s06,
    "S07": s07,
    "S08": s08,
    "S09": lambda s, d: ingest.titles(rt.meta(s, d)),
    "S10": lambda s, d: fx.nodes(s, d, content=False).select("tree_id").distinct().orderBy("tree_id"),
    "S11": s11,
    "S12": s12,
    "S13": s13,
    "S14": s14,
    "S15": s15,
    "S15_ids": lambda s, d: doc_ids(s, d).where(sc.is_doc_id(F.col("id"))).select("doc_id", "id"),
    "T11": lambda s, d: tree.image_nodes(described(s, d), F.lit(100)).select("tree_id", "ord", "node_id", "title", "content", "summary"),
    "T12": lambda s, d: described(s, d).select("doc_id", "idx", "description", "image_type"),
    "M01": lambda s, d: rt.md_nodes(s, d).select("tree_id", "node_id", sc.meaningful(F.col("content")).alias("m")),
    "M02": stories,
    "M03": lambda s, d: fx.table(s, d, "documents").select("doc_id", F.md5(F.left("text", F.lit(5000))).alias("h")),
    "M04": lambda s, d: summaries(s, d).select("tree_id", "node_id", "summary"),
    "M05": lambda s, d: fx.table(s, d, "benchmark").select("item_id", ingest.seams.extractive_summary(F.concat(F.lit("item "), F.col("item_id").cast("string")), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("# only a header")).alias("summary")),
    "M06": lambda s, d: fx.table(s, d, "benchmark").select("item_id", F.concat(F.lit("SCOPE: s"), F.col("item_id").cast("string"), F.lit("\nTOPICS: a, b\nENTITIES: "), F.left("text", F.lit(5)), F.lit("\nKEYWORDS: k")).alias("t")).select("item_id", *sc.summary_fields(F.col("t"))),
    "M07": m07,
    "M10": prompts,
    "F04": lambda s, d: fx.table(s, d, "documents").select("doc_id", sc.valid_query(F.when(F.col("doc_id") % 9 == 0, " \n ").otherwise(F.col("text"))).alias("ok")),
    "F05": lambda s, d: tasks.active(task_state(s, d)).select("task_id", "status"),
    "F06": lambda s, d: access.audit_search(fx.audit(s, d), "12").select("seq", "action"),
    "F07": lambda s, d: access.user_search(fx.users(s, d), "0012").select("user_id", "username"),
    "F08": lambda s, d: tasks.active(task_state(s, d)).agg(F.count("*").alias("n")),
    "J05": lambda s, d: (lambda n: n.join(n.select("tree_id", F.col("parent_id").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id"))(fx.nodes(s, d, content=False)),
    "J08": lambda s, d: access.has_permission(fx.users(s, d), access.role_permissions(s), "cache:manage").select("user_id", "role"),
    "J09": lambda s, d: tokens_table(s, d).join(s.range(0, 100000, 7).select(F.col("id").alias("jti")), "jti", "left_anti").select("jti", "user_id"),
    "J10": lambda s, d: access.live_tokens(tokens_table(s, d), s.range(0, 100000, 7).select(F.col("id").alias("jti")), fx.users(s, d), 1800).select("jti", "user_id", "role"),
    "Q01": lambda s, d: rewrites(s, d).select("item_id", sc.guarded_rewrite(F.col("query"), F.col("rewritten")).alias("chosen")),
    "Q02": lambda s, d: rewrites(s, d).select("item_id", F.array_join(sc.clean_variants(F.col("query"), F.col("variants")), "|").alias("variants")),
    "Q03": lambda s, d: rewrites(s, d).select("item_id", F.array_join(sc.query_set(sc.guarded_rewrite(F.col("query"), F.col("rewritten")), sc.clean_variants(F.col("query"), F.col("variants"))), "|").alias("queries")),
    "Q04": lambda s, d: fx.table(s, d, "benchmark").select("item_id", F.array_join(sc.json_list(F.concat(F.lit('```json\n["a'), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 0, "").otherwise('"'), F.lit(', "b"]\n```'))), "|").alias("v")),
    "Q05": lambda s, d: fx.table(s, d, "customer").select("c_custkey", sc.cache_key(F.concat(F.lit("  What's "), F.col("c_name"), F.lit("?! ("), F.col("c_mktsegment"), F.lit(")  ")), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("b"), F.lit("a")))).alias("key")),
    "Q06": lambda s, d: rewrites(s, d).select("item_id", sc.trace(F.col("query"), sc.guarded_rewrite(F.col("query"), F.col("rewritten")), sc.clean_variants(F.col("query"), F.col("variants"))).alias("trace")),
    "C07": no_documents,
    "A01": lambda s, d: fx.users(s, d).agg(F.count("*").alias("users"), F.count_if("is_active").alias("active")),
    "A02": lambda s, d: rt.meta(s, d).agg(F.sum("nodes").alias("nodes")),
    "A08": eta,
    "A09": lambda s, d: fx.nodes(s, d, content=False).groupBy("depth").agg(F.count("*").alias("n")),
    "O02": lambda s, d: task_state(s, d).orderBy(F.col("updated_at").desc(), "task_id").select("task_id", "updated_at"),
    "O02_users": lambda s, d: fx.users(s, d).orderBy("created_at", "user_id").select("user_id", "created_at"),
    "O03": lambda s, d: fx.audit(s, d).orderBy(F.col("seq").desc()).limit(50).orderBy("seq").select("seq", "action"),
    "U02": lambda s, d: fx.users(s, d).where("is_active").select("role").distinct().join(access.role_permissions(s), "role").select("permission").distinct().orderBy("permission"),
    "U03": lambda s, d: (lambda n: n.select("tree_id", "node_id").join(n.where("ord % 2 = 0").select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi"))(fx.nodes(s, d, content=False)),
    "X01": lambda s, d: _val(s, d).select("event_id", sc.format_duration(F.col("value") * 37).alias("t")),
    "X02": lambda s, d: _val(s, d).select("event_id", sc.format_eta(F.when(F.col("event_id") % 5 != 0, F.col("value") * 3 - 50)).alias("t")),
    "X03": lambda s, d: fx.table(s, d, "orders").select("o_orderkey", sc.format_bytes(F.when(F.col("o_orderkey") % 9 == 0, F.lit(0).cast("double")).otherwise(F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 6 - 2)) + 1)).alias("t")),
    "X04": lambda s, d: _val(s, d).select("event_id", sc.format_query_time(F.col("value") * 25).alias("t")),
    "X05": lambda s, d: fx.table(s, d, "benchmark").select("item_id", sc.truncate(F.col("text"), 150).alias("t")),
    "X06": lambda s, d: _val(s, d).select("event_id", sc.time_ago(1_700_000_000 - F.col("value") * F.col("value") * 10, F.lit(1_700_000_000)).alias("t")),
    "X07": lambda s, d: fx.table(s, d, "events").select("event_id", sc.format_timestamp(F.col("ts")).alias("t")),
    "X08": lambda s, d: fx.table(s, d, "benchmark").select("item_id", F.explode(sc.highlight(F.col("text"), F.slice(F.split("text", " "), 2, 3))).alias("s")).select("item_id", "s.text", "s.highlight"),
    "X09": lambda s, d: fx.table(s, d, "documents").select("doc_id", sc.first_words(F.col("text"), 7).alias("t")),
    "X10": lambda s, d: fx.table(s, d, "part").select("p_partkey", sc.slugify(F.concat(F.lit("?"), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("!"))).alias("t")),
    "X11": lambda s, d: fx.users(s, d).select("user_id", (access.role_rank(F.col("role")) >= access.role_rank(F.lit("analyst"))).alias("ok"), access.role_rank(F.lit("guest")).alias("none")),
    "X12": lambda s, d: _val(s, d).select("event_id", sc.stage_label(F.element_at(F.array(*[F.lit(x) for x in ("queued", "tree_built", "interrupted", "post_processing", "x")]), (F.col("event_id") % 5 + 1).cast("int"))).alias("t")),
    "X13": lambda s, d: _val(s, d).select("event_id", sc.stage_pct(F.element_at(F.array(*[F.lit(x) for x in ("summarising", "tree_built", "other")]), (F.col("event_id") % 3 + 1).cast("int")), F.col("event_id") % 47, F.lit(47)).alias("pct")),
    "X14": lambda s, d: _pw(s, d).select("c_custkey", sc.password_problem(F.col("pw")).alias("reason")),
    "X15": lambda s, d: fx.table(s, d, "customer").select("c_custkey", sc.env_bool(F.element_at(F.array(*[F.lit(x) for x in (" TRUE", "no", "1", "Yes ", "")]), (F.col("c_custkey") % 5 + 1).cast("int"))).alias("b"), F.array_join(sc.env_list(F.concat(F.col("c_mktsegment"), F.lit(" , a,,b "))), "|").alias("l")),
    "X16": lambda s, d: uploads(s, d).select("o_orderkey", sc.id_prefix(F.md5(F.col("filename"))).alias("p"), sc.extension(F.col("filename")).alias("e")),
    "X17": lambda s, d: fx.table(s, d, "customer").select("c_custkey", sc.valid_username(F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("#"), F.lit("."))).when(F.col("c_custkey") % 3 == 1, "ab").otherwise(F.col("c_name"))).alias("ok")),
    "X18": lambda s, d: fx.table(s, d, "documents").select("doc_id", F.left("text", F.lit(60)).alias("node"), F.length(F.left("text", F.lit(500))).alias("n")),
    "P01": p01,
    "P02": lambda s, d: task_state(s, d).select("task_id", "status", "stage", F.round("pct", 6).alias("pct"), "error"),
    "P03": lambda s, d: moves(s, d).select("task_id", "seq", "action", "before", "after", "legal"),
    "P03_now": lambda s, d: tasks.now(moves(s, d), fx.restarts(s, d)),
    "P03_restart": lambda s, d: tasks.after_restart(task_state(s, d)).select("task_id", "status", "resumable"),
    "P03_pct": lambda s, d: tasks.monotone_pct(fx.task_events(s, d)),
    "P04": p04,
    "P04_open": lambda s, d: (lambda n: tasks.unfinished(n, n.where("ord % 3 = 0")).select("tree_id", "node_id"))(fx.nodes(s, d, content=False)),
    "P05": p05,
    "P06": lambda s, d: cache.replay_lru(fx.query_log(s, d), size=20, ttl=36000).select("seq", "hit"),
    "P06_ttl": lambda s, d: cache.replay_ttl(fx.query_log(s, d), ttl=36000),
    "P07": lambda s, d: cache.without(cache.entries(fx.query_log(s, d)), "3").select("cache_key", "at"),
    "P08": lambda s, d: cache.stats(cache.entries(fx.query_log(s, d))),
    "P09": lambda s, d: (lambda e: cache.younger(e, 1_706_000_000, 40 * 86400).select("cache_key", "at"))(cache.entries(fx.query_log(s, d))),
    "P10": p10,
    "P13_hours": audit_hours,
    "P13_sessions": task_sessions,
    "G01": lambda s, d: access.has_permission(fx.users(s, d).withColumn("role", F.when(F.col("user_id") % 3 == 0, "guest").otherwise(F.col("role"))), access.role_permissions(s), "documents:list").select("user_id"),
    "G02": lambda s, d: fx.users(s, d).groupBy("role").agg(F.count("*").alias("users")).join(access.role_matrix(access.role_permissions(s)), "role").select("role", "users", F.array_join("permissions", ",").alias("permissions")),
    "G03": lambda s, d: fx.users(s, d).join(access.role_matrix(access.role_permissions(s)), "role").select("user_id", access.can(F.col("permissions"), ["cache:view", "admin:users"], False).alias("some"), access.can(F.col("permissions"), ["cache:view", "admin:users"], True).alias("every")),
    "G04": lambda s, d: access.collisions(new_users(s, d), fx.users(s, d)).select("s_suppkey"),
    "G05": g05,
    "G06": lambda s, d: tokens_table(s, d).where("exp > 1800").agg(F.count("*").alias("live")),
    "G07": lambda s, d: fx.audit(s, d).groupBy("action").agg(F.count("*").alias("n"), F.max("seq").alias("last")),
}

DUR = "CASE WHEN {x} < 60 THEN CAST(floor({x} + 0.5) AS BIGINT) || 's' WHEN floor({x} / 3600) > 0 THEN CAST(floor({x} / 3600) AS BIGINT) || 'h ' || CAST(floor(({x} % 3600) / 60) AS BIGINT) || 'm' WHEN floor({x} % 60 + 0.5) > 0 THEN CAST(floor(({x} % 3600) / 60) AS BIGINT) || 'm ' || CAST(floor({x} % 60 + 0.5) AS BIGINT) || 's' ELSE CAST(floor(({x} % 3600) / 60) AS BIGINT) || 'm' END"
AGO = "CAST(floor(value * value * 10) AS BIGINT)"
W_U, W_N = f"WITH {UPLOADS} ", f"WITH {rt.NODES} "
W_MD, W_I, W_R, W_S, W_L, W_US = f"WITH {rt.MARKDOWN} ", f"WITH {IMAGES} ", f"WITH {REWRITES} ", f"WITH {STATE} ", f"WITH {LOG} ", f"WITH {USERS} "
DECENT = "length(trim(regexp_replace(coalesce(content, ''), '(?m)^#+\\s+.*$', '', 'g'), ' ' || chr(10) || chr(9) || chr(13))) > 20"
SUMMARY = "trim(left(regexp_replace(regexp_replace(%s, '(?m)^#+\\s+.*$', ' ', 'g'), '\\s+', ' ', 'g'), 300))"


def _fold(tag: str = "", content: str = "content", where: str = "true") -> str:
    """Inputs and summaries level by level, s0 to s3; each level takes the lines of the one below."""
    decent = DECENT.replace("content", "body")
    out = f", tn{tag} AS (SELECT *, {content} AS body FROM mdnodes JOIN dp USING (tree_id, node_id) WHERE {where}), s4{tag} AS (SELECT *, '' AS input, '' AS summary FROM tn{tag} WHERE false)"
    for k in (3, 2, 1, 0):
        out += f""", k{k}{tag} AS (SELECT tree_id, parent_id AS node_id, string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY ord) AS l FROM s{k + 1}{tag} WHERE summary <> '' GROUP BY 1, 2),
        i{k}{tag} AS (SELECT tn{tag}.*, left(CASE WHEN {decent} AND l IS NOT NULL THEN body || chr(10) || chr(10) || 'Child sections:' || chr(10) || l WHEN l IS NOT NULL THEN l WHEN {decent} THEN body END, 5000) AS input FROM tn{tag} LEFT JOIN k{k}{tag} USING (tree_id, node_id) WHERE depth = {k}),
        s{k}{tag} AS (SELECT *, CASE WHEN input IS NOT NULL THEN coalesce(nullif({SUMMARY % "input"}, ''), 'Summary unavailable for section: ' || title) END AS summary FROM i{k}{tag})"""
    return out + f", folded{tag} AS (FROM s0{tag} UNION ALL FROM s1{tag} UNION ALL FROM s2{tag} UNION ALL FROM s3{tag})"


def _fold_sql() -> str:
    return W_MD + _fold() + " SELECT tree_id, node_id, summary FROM folded"


#: What an action makes of a state, as a plain table.
MOVE = """CASE WHEN {s} = '' AND {a} = 'create' THEN 'queued' WHEN {s} = 'queued' AND {a} = 'start' THEN 'running' WHEN {s} = 'running' AND {a} = 'finish' THEN 'done' WHEN {s} = 'running' AND {a} = 'fail' THEN 'failed'
  WHEN {s} IN ('queued', 'running', 'interrupted') AND {a} = 'cancel' THEN 'cancelled' WHEN {s} IN ('interrupted', 'failed') AND {a} = 'requeue' THEN 'queued' END"""
_S = "CASE WHEN w.after = 'running' AND ac.day > w.day THEN 'interrupted' ELSE w.after END"
MOVES = f"""WITH RECURSIVE ac AS (SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(ts AS DATE) AS day, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'start' WHEN 'view' THEN 'requeue' WHEN 'error' THEN 'fail' ELSE CASE WHEN value > 80 THEN 'cancel' ELSE 'finish' END END AS action FROM events),
w AS (SELECT DISTINCT task_id, 0 :: BIGINT AS i, DATE '1900-01-01' AS day, 0 :: BIGINT AS seq, '' AS action, '' AS before, '' AS after, false AS legal FROM ac
  UNION ALL SELECT ac.task_id, ac.i, ac.day, ac.seq, ac.action, {_S}, coalesce({MOVE.format(s=f"({_S})", a="ac.action")}, {_S}), {MOVE.format(s=f"({_S})", a="ac.action")} IS NOT NULL FROM w JOIN ac ON ac.task_id = w.task_id AND ac.i = w.i + 1)"""
RUNS = """, rn AS (SELECT *, coalesce(sum(CAST(status IN ('done', 'failed', 'cancelled') AS INTEGER)) OVER (PARTITION BY task_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM ev),
fr AS (SELECT task_id, run, arg_max(status, (ts, seq)) AS status, arg_max(stage, (ts, seq)) AS stage, arg_max(pct, (ts, seq)) FILTER (pct IS NOT NULL) AS pct, arg_max(error, (ts, seq)) FILTER (error IS NOT NULL) AS error, arg_max(seq, (ts, seq)) AS seq FROM rn GROUP BY 1, 2)"""

SQL = {
    "S01": W_MD + "SELECT tree_id, CAST(length(text) + 1 AS INTEGER) AS n, md5(text || chr(10)) AS h FROM md",
    "M04": _fold_sql(),
    "M05": f"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN {SUMMARY % 'text'} ELSE 'Summary unavailable for section: item ' || item_id END AS summary FROM benchmark",
    "M07": W_N + ", v AS (SELECT tree_id, node_id, CASE WHEN ord % 2 = 0 AND embedding IS NOT NULL THEN embedding WHEN summary <> '' THEN [CAST(CAST(length(summary) / sqrt(length(summary) * length(summary) + 100.0 :: DOUBLE) AS FLOAT) AS DOUBLE), CAST(CAST(10 / sqrt(length(summary) * length(summary) + 100.0 :: DOUBLE) AS FLOAT) AS DOUBLE)] END AS e FROM nodes) SELECT tree_id, node_id, CAST(len(e) AS INTEGER) AS dim, round(e[1], 6) AS v1, round(e[2], 6) AS v2 FROM v",
    "X07": "SELECT event_id, strftime(ts, '%-d %b %Y, %I:%M %p') AS t FROM events",
    "S02": W_MD + "SELECT tree_id || '.md' AS filename, CAST(length(text) AS INTEGER) AS n, md5(text) AS h FROM md UNION ALL SELECT 'item' || item_id || '.pdf', CAST(length(text) + 6 AS INTEGER), md5('# PDF' || chr(10) || text) FROM benchmark WHERE item_id % 10 <> 9",
    "S03": W_U + "SELECT o_orderkey, CASE WHEN mime = 'text/plain' THEN 'type' WHEN lower(regexp_extract(safe, '[^.](\\.[^.]+)$', 1)) NOT IN ('.pdf', '.png', '.jpg') THEN 'extension' WHEN size > 52428800 THEN 'size' WHEN lower(safe) LIKE '%.pdf' AND head <> '%PDF' THEN 'magic' END AS reason FROM v",
    "S04": W_U + "SELECT o_orderkey, safe AS filename FROM v",
    "S05": W_U + "SELECT o_orderkey, CASE WHEN mime NOT IN ('application/pdf', 'image/png', 'image/webp') THEN 'Only PDF and image files (PNG, JPG, JPEG, WEBP) are supported.' WHEN size > 52428800 THEN 'File is too large. Maximum size is 50.0 MB.' WHEN size = 0 THEN 'File is empty.' END AS reason FROM v",
    "S06": W_N + ", roots AS (SELECT DISTINCT tree_id, '0000' AS node_id, 0 AS ord, NULL AS parent_id, 0 AS depth, 'Document' AS title FROM nodes) SELECT tree_id, node_id, CAST(ord AS INTEGER) AS ord, parent_id, CAST(header_level AS INTEGER) AS depth, title FROM nodes UNION ALL SELECT * FROM roots",
    "S07": W_N + "SELECT tree_id, count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS floats FROM nodes WHERE embedding IS NOT NULL GROUP BY tree_id",
    "S08": f"WITH {rt.META} SELECT * FROM meta ORDER BY doc_id",
    "S09": f"WITH {rt.META} SELECT doc_id, filename FROM meta WHERE filename <> '' ORDER BY doc_id",
    "S10": "SELECT DISTINCT source AS tree_id FROM documents ORDER BY 1",
    "S11": "SELECT event_type AS action, count(*) AS n, max(ts) AS last, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY 1",
    "S12": "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS action, props AS detail, event_id AS seq FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 100",
    "S13": W_I + "SELECT doc_id, page, idx, width, height FROM cp",
    "S14": "SELECT o_orderkey || '.png' AS doc_id, 1 AS page, 0 AS idx, 'standalone' AS source, CASE WHEN o_orderkey % 10 = 3 THEN 'map' ELSE 'photo' END AS image_type, 'img/' || o_orderkey AS image_path, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 900 + 1 ELSE 0 END AS INTEGER) AS width, CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 700 + 1 ELSE 0 END AS INTEGER) AS height, 'TYPE: ' || CASE WHEN o_orderkey % 10 = 3 THEN 'Map' ELSE 'photo' END || chr(10) || 'img/' || o_orderkey AS description FROM orders",
    "S15": "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS id, md5(CAST(doc_id AS VARCHAR)) || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.pdf' END AS file FROM documents WHERE doc_id % 8 = 0",
    "S15_ids": "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS id FROM documents WHERE doc_id % 4 = 0",
    "T11": W_I + "SELECT doc_id AS tree_id, CAST(o AS INTEGER) AS ord, printf('%04d', o) AS node_id, 'Image — ' || CASE WHEN source = 'pdf' THEN 'Page ' || page ELSE 'standalone' END || ' (' || image_type || ')' AS title, '[IMAGE_PATH:' || image_path || ']' || chr(10) || 'Source: ' || source || chr(10) || 'Page: ' || page || chr(10) || 'Type: ' || image_type || chr(10) || 'Size: ' || width || '×' || height || 'px' || chr(10) || chr(10) || description AS content, description AS summary FROM (SELECT *, 99 + row_number() OVER (PARTITION BY doc_id ORDER BY page, idx) AS o FROM ps WHERE description <> '')",
    "T12": W_I + "SELECT doc_id, idx, description, image_type FROM ps",
    "M01": W_MD + f"SELECT tree_id, node_id, {DECENT} AS m FROM mdnodes",
    "M02": W_MD + f", k AS (SELECT n.tree_id, n.parent_id AS node_id, string_agg('- ' || n.title || ': s' || n.ord, chr(10) ORDER BY n.ord) AS l FROM mdnodes n JOIN dp USING (tree_id, node_id) WHERE depth > 0 GROUP BY 1, 2) SELECT tree_id, node_id, left(CASE WHEN {DECENT} AND l IS NOT NULL THEN content || chr(10) || chr(10) || 'Child sections:' || chr(10) || l WHEN l IS NOT NULL THEN l WHEN {DECENT} THEN content END, 5000) AS input FROM mdnodes LEFT JOIN k USING (tree_id, node_id)",
    "M03": "SELECT doc_id, md5(left(text, 5000)) AS h FROM documents",
    "M06": "SELECT item_id, 's' || item_id AS scope, 'a, b' AS topics, left(text, 5) AS entities, 'k' AS keywords FROM benchmark",
    "M10": f"WITH {rt.NODES}, {IMAGES}, u AS (SELECT 'node_summary' AS key, count(*) AS uses FROM nodes WHERE content <> '' UNION ALL SELECT 'node_summary_fallback', count(*) FROM nodes WHERE content = '' UNION ALL SELECT 'image_description', count(*) FROM cp UNION ALL SELECT 'answer', count(*) FROM queries UNION ALL SELECT 'query_rewrite', count(*) FROM queries) SELECT key, n, uses FROM (VALUES ('answer', 2), ('image_description', 1), ('node_summary', 2), ('node_summary_fallback', 2), ('query_rewrite', 2)) t(key, n) JOIN u USING (key)",
    "F04": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN false ELSE length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) BETWEEN 1 AND 2000 END AS ok FROM documents",
    "F05": W_S + "SELECT task_id, status FROM state WHERE status NOT IN ('done', 'failed', 'cancelled')",
    "F06": "SELECT event_id AS seq, event_type AS action FROM events WHERE contains(event_type, '12') OR contains(lower(props), '12') OR contains(CAST(user_id AS VARCHAR), '12')",
    "F07": W_US + "SELECT user_id, username FROM us WHERE contains(lower(username), '0012') OR contains(email, '0012') OR contains(lower(full_name), '0012')",
    "F08": W_S + "SELECT count(*) AS n FROM state WHERE status NOT IN ('done', 'failed', 'cancelled')",
    "J05": W_N + "SELECT tree_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id)",
    "J08": W_US + "SELECT user_id, role FROM us WHERE role IN ('admin', 'manager')",
    "J09": "SELECT event_id AS jti, user_id FROM events WHERE event_id % 7 <> 0 OR event_id >= 100000",
    "J10": W_US + "SELECT event_id AS jti, user_id, role FROM events JOIN us USING (user_id) WHERE event_id % 3600 > 1800 AND (event_id % 7 <> 0 OR event_id >= 100000) AND is_active",
    "Q01": W_R + "SELECT item_id, chosen FROM g",
    "Q02": W_R + "SELECT item_id, array_to_string(variants, '|') AS variants FROM g",
    "Q03": W_R + "SELECT item_id, (SELECT string_agg(q, '|' ORDER BY p) FROM (SELECT q, min(i) AS p FROM (SELECT unnest([trim(chosen, ' ' || chr(10))] || variants) AS q, unnest(range(1 + len(variants))) AS i) GROUP BY q HAVING q <> '')) AS queries FROM g",
    "Q04": "SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN 'a' || item_id || '|b' END AS v FROM benchmark",
    "Q05": "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower('  What''s ' || c_name || '?! (' || c_mktsegment || ')  '), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) || CASE WHEN c_custkey % 2 = 0 THEN '||a,b' ELSE '' END AS key FROM customer",
    "Q06": W_R + "SELECT item_id, 'Original: ' || query || chr(10) || 'Rewritten: ' || chosen || chr(10) || 'Variants (' || len(variants) || '): ' || array_to_string(variants, ' | ') AS trace FROM g",
    "C07": "SELECT DISTINCT source AS scope, CAST(NULL AS VARCHAR) AS answer FROM documents UNION ALL SELECT s, 'No documents have been ingested yet. Please upload a document first.' FROM (VALUES ('missing'), ('src')) t(s)",
    "A01": W_US + "SELECT count(*) AS users, count(*) FILTER (is_active) AS active FROM us",
    "A02": "SELECT count(*) + count(DISTINCT source) AS nodes FROM documents",
    "A08": "WITH RECURSIVE t AS (SELECT CAST(user_id AS VARCHAR) AS task_id, value AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), e AS (SELECT task_id, i, s AS ema FROM t WHERE i = 1 UNION ALL SELECT t.task_id, t.i, 0.3 * t.s + 0.7 * e.ema FROM e JOIN t ON t.task_id = e.task_id AND t.i = e.i + 1), x AS (SELECT task_id, max(i) AS n, arg_max(ema, i) AS ema FROM e GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS task_id, CAST(coalesce(n, 0) AS INTEGER) AS done, round(coalesce(ema, 15.0), 6) AS ema, round(greatest(c_custkey % 900 + 100 - coalesce(n, 0), 0) * coalesce(ema, 15.0), 4) AS eta FROM customer LEFT JOIN x ON x.task_id = CAST(c_custkey AS VARCHAR)",
    "A09": W_N + "SELECT header_level AS depth, count(*) AS n FROM nodes GROUP BY 1",
    "O02": W_S + "SELECT task_id, updated_at FROM state ORDER BY updated_at DESC, task_id",
    "O02_users": W_US + "SELECT user_id, created_at FROM us ORDER BY created_at, user_id",
    "O03": "SELECT seq, action FROM (SELECT event_id AS seq, event_type AS action FROM events ORDER BY 1 DESC LIMIT 50) ORDER BY seq",
    "U02": f"WITH {USERS}, {PERMS} SELECT DISTINCT permission FROM us JOIN perm USING (role) WHERE is_active ORDER BY 1",
    "U03": W_N + "SELECT tree_id, node_id FROM nodes WHERE ord % 2 = 0",
    "X01": f"SELECT event_id, {DUR.format(x='(value * 37)')} AS t FROM events",
    "X02": f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Estimating…' WHEN value * 3 - 50 <= 0 THEN 'Almost done…' ELSE '~' || {DUR.format(x='(value * 3 - 50)')} || ' remaining' END AS t FROM events",
    "X03": "WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE floor(o_totalprice * pow(10.0, o_orderkey % 6 - 2)) + 1 END AS n FROM orders), s AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS i FROM b) SELECT o_orderkey, CASE WHEN n = 0 THEN '0 B' ELSE printf('%.1f', floor(n / pow(1024.0, i) * 10 + 0.5) / 10) || ' ' || (['B', 'KB', 'MB', 'GB'])[i + 1] END AS t FROM s",
    "X04": "SELECT event_id, CASE WHEN value * 25 < 1000 THEN CAST(floor(value * 25 + 0.5) AS BIGINT) || 'ms' ELSE printf('%.1f', floor(value * 25 / 1000 * 10 + 0.5) / 10) || 's' END AS t FROM events",
    "X05": "SELECT item_id, CASE WHEN length(text) <= 150 THEN text ELSE left(text, 149) || '…' END AS t FROM benchmark",
    "X06": f"SELECT event_id, CASE WHEN {AGO} < 60 THEN 'just now' WHEN {AGO} < 3600 THEN ({AGO} // 60) || 'm ago' WHEN {AGO} < 86400 THEN ({AGO} // 3600) || 'h ago' ELSE ({AGO} // 86400) || 'd ago' END AS t FROM events",
    "X09": "SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:7], ' ') AS t FROM documents",
    "X10": "SELECT p_partkey, regexp_replace(regexp_replace(lower('?' || p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS t FROM part",
    "X11": W_US + "SELECT user_id, role IN ('admin', 'manager', 'analyst') AS ok, CAST(0 AS INTEGER) AS none FROM us",
    "X12": "SELECT event_id, (['Queued', 'Structure ready', 'Interrupted — will resume', 'Post processing', 'X'])[event_id % 5 + 1] AS t FROM events",
    "X13": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN round(20 + (event_id % 47) / 47 * 50, 1) WHEN 1 THEN 20.0 END :: DOUBLE AS pct FROM events",
    "X14": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Password must be at most 72 bytes long for bcrypt.' WHEN 1 THEN 'Password must be at least 8 characters long.' WHEN 2 THEN 'Password must contain at least one uppercase letter.' WHEN 3 THEN 'Password must contain at least one lowercase letter.' WHEN 4 THEN 'Password must contain at least one digit.' ELSE CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Password must contain at least one special character.' END END AS reason FROM customer",
    "X15": "SELECT c_custkey, c_custkey % 5 IN (0, 2, 3) AS b, c_mktsegment || '|a|b' AS l FROM customer",
    "X16": W_U + "SELECT o_orderkey, left(md5(filename), 8) AS p, CASE WHEN contains(filename, '.') THEN upper(string_split(filename, '.')[-1]) ELSE 'PDF' END AS e FROM u",
    "X17": "SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM customer",
    "X18": "SELECT doc_id, left(text, 60) AS node, CAST(least(500, length(text)) AS INTEGER) AS n FROM documents",
    "P01": W_S + RUNS + " SELECT task_id, 'closed' AS kind, status, stage, round(pct, 6) AS pct, error, seq FROM fr WHERE status IN ('done', 'failed', 'cancelled') UNION ALL SELECT CAST(c_custkey AS VARCHAR), CASE WHEN l.task_id IS NULL THEN 'error' ELSE 'answer' END, status, stage, round(pct, 6), CASE WHEN l.task_id IS NULL THEN 'task not found' ELSE error END, seq FROM customer LEFT JOIN (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY run DESC) = 1) l ON l.task_id = CAST(c_custkey AS VARCHAR)",
    "P02": W_S + "SELECT task_id, status, stage, round(pct, 6) AS pct, error FROM state",
    "P03": MOVES + " SELECT task_id, seq, action, before, after, legal FROM w WHERE i > 0",
    "P03_now": MOVES + ", l AS (SELECT task_id, arg_max(after, i) AS after, max(day) AS day FROM w WHERE i > 0 GROUP BY 1), f AS (SELECT task_id, CASE WHEN after = 'running' AND day < (SELECT max(CAST(ts AS DATE)) FROM events) THEN 'interrupted' ELSE after END AS status FROM l) SELECT task_id, status, status IN ('queued', 'interrupted', 'failed') AS resumable FROM f",
    "P03_restart": W_S + "SELECT task_id, CASE status WHEN 'running' THEN 'interrupted' ELSE status END AS status, status IN ('queued', 'running', 'failed') AS resumable FROM state",
    "P03_pct": W_S + "SELECT task_id, max(pct) AS pct FROM ev GROUP BY task_id",
    "P04": W_MD + _fold() + _fold("_old", "CASE WHEN ord % 3 = 2 THEN content || ' as it was' ELSE content END", "CAST(substr(tree_id, 2) AS BIGINT) % 2 = 0") + " SELECT a.tree_id, a.node_id, a.summary, b.node_id IS NULL OR a.input IS DISTINCT FROM b.input AS redone FROM folded a LEFT JOIN folded_old b ON a.tree_id = b.tree_id AND a.node_id = b.node_id",
    "P04_open": W_N + "SELECT tree_id, node_id FROM nodes WHERE ord % 3 <> 0",
    "P05": W_S + ", ct AS (SELECT task_id, ts, max(CASE stage WHEN 'error' THEN 'cancel' ELSE 'submit' END) AS action FROM ev WHERE stage IN ('error', 'signup') GROUP BY 1, 2) SELECT w.task_id, w.seq, w.stage, coalesce(ct.action = 'cancel', false) AS dropped FROM ev w ASOF LEFT JOIN ct ON w.task_id = ct.task_id AND w.ts >= ct.ts WHERE w.stage NOT IN ('error', 'signup')",
    "P06_ttl": "WITH RECURSIVE " + LOG + ", o AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY \"at\", seq) AS i FROM lg), r AS (SELECT cache_key, i, seq, \"at\" AS stored, false AS hit FROM o WHERE i = 1 UNION ALL SELECT o.cache_key, o.i, o.seq, CASE WHEN o.\"at\" - r.stored < 36000 THEN r.stored ELSE o.\"at\" END, o.\"at\" - r.stored < 36000 FROM r JOIN o ON o.cache_key = r.cache_key AND o.i = r.i + 1) SELECT cache_key, seq, hit FROM r",
    "P07": W_L + "SELECT cache_key, \"at\" FROM (SELECT cache_key, max(\"at\") AS \"at\", arg_max(doc_ids, (\"at\", seq)) AS doc_ids FROM lg GROUP BY 1) WHERE NOT list_contains(doc_ids, '3')",
    "P08": W_L + "SELECT count(DISTINCT cache_key) AS entries, CAST(1000 AS INTEGER) AS max_entries, CAST(604800 AS INTEGER) AS ttl_seconds, true AS enabled FROM lg",
    "P09": W_L + "SELECT cache_key, max(\"at\") AS \"at\" FROM lg GROUP BY 1 HAVING 1706000000 - max(\"at\") < 40 * 86400",
    "P10": """WITH RECURSIVE ch AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'purchase' THEN 'cancel' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, event_type AS stage, CASE WHEN event_id % 3 <> 0 THEN value END AS pct FROM events),
        st AS (SELECT DISTINCT task_id, 0 :: BIGINT AS i, CAST(task_id AS BIGINT) % 2 = 0 AS there, 'queued' AS status, 'known' AS stage, 0.0 :: DOUBLE AS pct, NULL :: BIGINT AS new_at, CAST(task_id AS BIGINT) AS position FROM ch
          UNION ALL SELECT ch.task_id, ch.i, CASE op WHEN 'delete' THEN false WHEN 'upsert' THEN true ELSE there END,
            CASE WHEN op = 'upsert' OR op = 'update' AND there THEN 'running' WHEN op = 'cancel' AND there THEN 'cancelled' ELSE st.status END,
            CASE WHEN op = 'upsert' OR op = 'update' AND there THEN ch.stage ELSE st.stage END, CASE WHEN op = 'upsert' OR op = 'update' AND there THEN ch.pct ELSE st.pct END,
            CASE WHEN op = 'upsert' AND NOT there THEN ch.seq ELSE new_at END, CASE WHEN op = 'upsert' AND NOT there THEN NULL ELSE position END
          FROM st JOIN ch ON ch.task_id = st.task_id AND ch.i = st.i + 1)
        SELECT task_id, status, stage, round(pct, 6) AS pct, new_at, position FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY i DESC) = 1) WHERE there ORDER BY new_at DESC NULLS LAST, position""",
    "P13_hours": """WITH e AS (SELECT epoch_us(ts) AS t, epoch_us(date_trunc('hour', ts)) AS s, CAST(user_id AS VARCHAR) AS user_id, event_type AS action FROM events), m AS (SELECT (min(t) + max(t)) // 2 AS mid, max(t) AS last FROM e),
        f AS (SELECT max(t) - 3600000000 AS mark FROM e, m WHERE t <= mid AND action <> 'error')
        SELECT s // 1000000 AS start, user_id, action, count(*) AS n FROM e, m, f WHERE (t <= mid AND action <> 'error' OR s + 3600000000 > (mark // 1000) * 1000) AND s + 3600000000 <= ((last - 3600000000) // 1000) * 1000 GROUP BY ALL""",
    "P13_sessions": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS new FROM e),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b)
        SELECT user_id, min(t) AS start, max(t) + 21600000000 AS "end", count(*) AS n FROM g GROUP BY user_id, k HAVING max(t) + 21600000000 <= (SELECT (max(t) - 3600000000) // 1000 * 1000 FROM e)""",
    "G01": W_US + "SELECT user_id FROM us WHERE user_id % 3 <> 0 AND role IN ('admin', 'manager', 'analyst')",
    "G02": f"WITH {USERS}, {PERMS}, p AS (SELECT role, string_agg(permission, ',' ORDER BY permission) AS permissions FROM perm GROUP BY role) SELECT role, count(*) AS users, permissions FROM us JOIN p USING (role) GROUP BY role, permissions",
    "G03": f"WITH {USERS}, {PERMS} SELECT user_id, bool_or(permission IN ('cache:view', 'admin:users')) AS some, count(*) FILTER (permission IN ('cache:view', 'admin:users')) = 2 AS every FROM us JOIN perm USING (role) GROUP BY user_id",
    "G04": W_US + ", nu AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE lower(s_name) END AS n, CASE WHEN s_suppkey % 5 = 0 THEN 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '@example.com' ELSE 'new@example.com' END AS m FROM supplier) SELECT s_suppkey FROM nu WHERE n IN (SELECT lower(username) FROM us) OR m IN (SELECT email FROM us)",
    "G05": "WITH RECURSIVE " + USERS + """, ch AS (SELECT user_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1000000 END AS user_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, 'u' || event_id AS username,
          CASE WHEN event_type <> 'click' THEN (['admin', 'manager', 'analyst', 'viewer'])[event_id % 4 + 1] END AS role, CASE WHEN event_type = 'view' THEN value > 50 END AS is_active, event_id AS created_at FROM events),
        co AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i FROM ch),
        st AS (SELECT k.user_id, 0 :: BIGINT AS i, us.user_id IS NOT NULL AS there, us.username, us.full_name, us.role, us.is_active, us.created_at FROM (SELECT user_id FROM us UNION SELECT user_id FROM ch) k LEFT JOIN us USING (user_id)
          UNION ALL SELECT st.user_id, co.i, CASE op WHEN 'delete' THEN false WHEN 'create' THEN true ELSE there END,
            CASE WHEN op = 'create' AND NOT there THEN co.username WHEN op = 'update' AND there THEN coalesce(co.username, st.username) ELSE st.username END,
            CASE WHEN op = 'create' AND NOT there THEN NULL ELSE st.full_name END,
            CASE WHEN op = 'create' AND NOT there THEN co.role WHEN op = 'update' AND there THEN coalesce(co.role, st.role) ELSE st.role END,
            CASE WHEN op = 'create' AND NOT there THEN co.is_active WHEN op = 'update' AND there THEN coalesce(co.is_active, st.is_active) ELSE st.is_active END,
            CASE WHEN op = 'create' AND NOT there THEN co.created_at ELSE st.created_at END
          FROM st JOIN co ON co.user_id = st.user_id AND co.i = st.i + 1)
        SELECT user_id, username, full_name, role, is_active, created_at FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1) WHERE there""",
    "G06": "SELECT count(*) AS live FROM events WHERE event_id % 3600 > 1800",
    "G07": "SELECT event_type AS action, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "X08": r"""WITH t AS (SELECT item_id, text, list_distinct(list_filter(string_split(text, ' ')[2:4], lambda x: x <> '')) AS terms FROM benchmark),
        q AS (SELECT item_id, text, '(?i)(?:' || array_to_string(list_transform(list_sort(list_transform(terms, lambda x: {'n': -length(x), 't': x})), lambda x: regexp_replace(x.t, '([^\p{L}\p{N}\s])', '\\\1', 'g')), '|') || ')' AS p, len(terms) AS k FROM t),
        p AS (SELECT item_id, text, k, string_split(regexp_replace(text, p, chr(1), 'g'), chr(1)) AS b, regexp_extract_all(text, p) AS f FROM q),
        i AS (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM p WHERE k > 0)
        SELECT item_id, b[j] AS text, false AS highlight FROM i UNION ALL SELECT item_id, f[j], true FROM i WHERE f[j] IS NOT NULL UNION ALL SELECT item_id, text, false FROM p WHERE k = 0""",
    # in the cache: at most 20 keys since, its own among them; then the time to live, key by key
    "P06": "WITH RECURSIVE " + LOG + """, o AS (SELECT *, row_number() OVER (ORDER BY "at", seq) AS rn FROM lg),
        w AS (SELECT *, lag(rn) OVER (PARTITION BY cache_key ORDER BY rn) AS prev, row_number() OVER (PARTITION BY cache_key ORDER BY rn) AS i FROM o),
        held AS (SELECT w.rn, count(DISTINCT x.cache_key) <= 20 AS held FROM w JOIN o x ON x.rn >= w.prev AND x.rn < w.rn AND (x.cache_key <> w.cache_key OR x.rn = w.prev) GROUP BY w.rn),
        k AS (SELECT w.*, coalesce(held, false) AS held FROM w LEFT JOIN held USING (rn)),
        r AS (SELECT cache_key, i, seq, "at" AS stored, false AS hit FROM k WHERE i = 1
              UNION ALL SELECT k.cache_key, k.i, k.seq, CASE WHEN k.held AND k."at" - r.stored < 36000 THEN r.stored ELSE k."at" END, k.held AND k."at" - r.stored < 36000 FROM r JOIN k ON k.cache_key = r.cache_key AND k.i = r.i + 1)
        SELECT seq, hit FROM r""",
}
