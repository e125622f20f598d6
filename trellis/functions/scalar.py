"""Column functions: formatting, text clean-up, validation and query preparation.

White space is trimmed as any white space, not blanks alone; all are pure column
expressions, so they stay inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.schema import CONFIG


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + 0.5)


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)


def text(c: Column) -> Column:
    return c.cast("long").cast("string")


def format_duration(s: Column) -> Column:
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), rounded(s % 60)
    long = F.when(h > 0, F.concat(text(h), F.lit("h "), text(m), F.lit("m"))).when(sec > 0, F.concat(text(m), F.lit("m "), text(sec), F.lit("s"))).otherwise(F.concat(text(m), F.lit("m")))
    return F.when(s < 60, F.concat(text(rounded(s)), F.lit("s"))).otherwise(long)


def format_eta(s: Column) -> Column:
    return F.when(s.isNull(), "Estimating…").when(s <= 0, "Almost done…").otherwise(F.concat(F.lit("~"), format_duration(s), F.lit(" remaining")))


def format_bytes(n: Column) -> Column:
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), (step + 1).cast("int"))
    return F.when(n == 0, "0 B").otherwise(F.concat(one_decimal(n / F.pow(F.lit(1024.0), step)), F.lit(" "), unit))


def format_query_time(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(text(rounded(ms)), F.lit("ms"))).otherwise(F.concat(one_decimal(ms / 1000), F.lit("s")))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 1)), F.lit("…")))


def time_ago(at: Column, now: Column) -> Column:
    s = F.floor(now - at)
    ago = lambda k, unit: F.concat(text(F.floor(s / k)), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "d MMM yyyy, hh:mm a")


def highlight(c: Column, terms: Column | list[str]) -> Column:
    """Segments (text, highlight) of a text around any of the terms, whatever their case, in any
    alphabet; i has the case I only, not dotless or dotted ones. ``terms`` is a list or a column of
    arrays, so each row may have its own. Where two terms could start,
    the longer is taken. Null and empty terms are none, without terms the text is one segment;
    null for a null text."""
    own = F.array(*[F.lit(t) for t in terms]).cast("array<string>") if isinstance(terms, list) else terms
    plain = F.filter(F.array_distinct(F.coalesce(own, F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != ""))
    longest = F.array_sort(plain, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    plainly = lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}\s])", r"\\$1")
    # where Java knows more cases of a letter than Unicode's simple ones, or fewer
    escaped = lambda t: reduce(lambda x, r: F.regexp_replace(x, *r), (("[iI]", "(?-i:[iI])"), ("([\u0130\u0131])", "(?-i:$1)"), ("[\u00df\u1e9e]", "(?-i:[\u00df\u1e9e])")), plainly(t))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(longest, escaped), "|"), F.lit(")"))
    mark = F.lit("\x00")  # stands in no text
    found = F.transform(F.regexp_extract_all(c, pattern, F.lit(1)), lambda t: F.struct(t.alias("text"), F.lit(True).alias("highlight")))
    between = F.transform(F.split(F.regexp_replace(c, pattern, mark), mark), lambda t: F.struct(t.alias("text"), F.lit(False).alias("highlight")))
    pairs = F.flatten(F.transform(F.arrays_zip(between.alias("b"), found.alias("f")), lambda p: F.array(p["b"], p["f"])))
    whole = F.array(F.struct(c.alias("text"), F.lit(False).alias("highlight")))
    return F.when(c.isNotNull(), F.when(F.size(plain) == 0, whole).otherwise(F.filter(pairs, lambda x: x.isNotNull())))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, r"\s+"), 1, n), " ")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


#: Labels of the stages of a task.
STAGE_LABELS = {
    "queued": "Queued",
    "uploaded": "File uploaded",
    "markdown": "Converting PDF",
    "building_tree": "Building structure",
    "tree_built": "Structure ready",
    "summarising": "Summarising sections",
    "summarised": "Sections summarised",
    "embedding": "Generating embeddings",
    "embedded": "Embeddings ready",
    "indexing": "Building search index",
    "indexed": "Index ready",
    "saving": "Saving to disk",
    "done": "Complete",
    "failed": "Failed",
    "cancelled": "Cancelled",
    "interrupted": "Interrupted — will resume",
}

#: Percentage at the end of each stage.
STAGE_PCT = {"queued": 0.0, "uploaded": 5.0, "markdown": 10.0, "tree_built": 20.0, "summarised": 70.0, "embedded": 80.0, "indexed": 90.0, "done": 100.0}


def _lookup(values: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def stage_label(stage: Column) -> Column:
    words = F.replace(stage, F.lit("_"), F.lit(" "))
    return F.coalesce(_lookup(STAGE_LABELS, stage), F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substring(words, 2, 1000))))


def stage_pct(stage: Column, done: Column, total: Column) -> Column:
    """While sections are summarised, from 20 to 70 with the share done."""
    return F.when(stage == "summarising", F.round(20 + done / total * 50, 1)).otherwise(_lookup(STAGE_PCT, stage))


#: What a password that breaks a rule is told, in the order of the rules.
PASSWORD_TOO_LONG = "Password must be at most 72 bytes long for bcrypt."
PASSWORD_TOO_SHORT = "Password must be at least 8 characters long."
PASSWORD_NO_UPPER = "Password must contain at least one uppercase letter."
PASSWORD_NO_LOWER = "Password must contain at least one lowercase letter."
PASSWORD_NO_DIGIT = "Password must contain at least one digit."
PASSWORD_NO_SPECIAL = "Password must contain at least one special character."


def password_problem(c: Column) -> Column:
    """The first rule that a password breaks; empty if none. Digits of any script count."""
    return (
        F.when(F.octet_length(c) > 72, PASSWORD_TOO_LONG)
        .when(F.length(c) < 8, PASSWORD_TOO_SHORT)
        .when(~c.rlike("[A-Z]"), PASSWORD_NO_UPPER)
        .when(~c.rlike("[a-z]"), PASSWORD_NO_LOWER)
        .when(~c.rlike(r"(?U)\d"), PASSWORD_NO_DIGIT)
        .when(~c.rlike(r"""[!@#$%^&*()_+\-=\[\]{};':"\\|,.<>/?]"""), PASSWORD_NO_SPECIAL)
        .otherwise("")
    )


def env_bool(c: Column) -> Column:
    return F.lower(strip(c)).isin("true", "1", "t", "yes", "y")


def env_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def id_prefix(c: Column) -> Column:
    return F.left(c, F.lit(8))


def extension(filename: Column) -> Column:
    return F.when(filename.contains("."), F.upper(F.element_at(F.split(filename, r"\."), -1))).otherwise("PDF")


def valid_username(c: Column) -> Column:
    return c.rlike("^[a-zA-Z0-9._-]+$") & F.length(c).between(3, 40)


# Upload and file names


#: Sets of image suffixes and types that are taken; their order has no meaning.
IMAGE_SUFFIXES = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
UPLOAD_TYPES = ("application/octet-stream", "application/pdf", "image/bmp", "image/gif", "image/jpeg", "image/jpg", "image/png", "image/tiff", "image/webp")
CLIENT_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg", "image/webp")


def safe_filename(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "upload.pdf").otherwise(F.element_at(F.split(raw, "/"), -1))


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^.](\.[^.]+)$", 1))


def reject_reason(mime: Column, filename: Column, size: Column, head: Column) -> Column:
    """Why an upload is refused; null if it is taken. ``head``: its first bytes as text."""
    end = suffix(safe_filename(filename))
    return F.when(~mime.isin(*UPLOAD_TYPES), "type").when(~end.isin(".pdf", *IMAGE_SUFFIXES), "extension").when(size > CONFIG.max_upload_bytes, "size").when((end == ".pdf") & ~head.startswith("%PDF"), "magic")


def client_reject(mime: Column, size: Column) -> Column:
    # What the client says.
    limit = CONFIG.max_upload_bytes
    return F.when(~mime.isin(*CLIENT_TYPES), "Only PDF and image files (PNG, JPG, JPEG, WEBP) are supported.").when(size > limit, "File is too large. Maximum size is 50.0 MB.").when(size == 0, "File is empty.")


def is_doc_id(c: Column) -> Column:
    return c.rlike("^(?=.*[a-z])[a-z0-9]{32}$")


# Summaries


def meaningful(content: Column) -> Column:
    body = strip(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?md)^#+\s+.*$", ""))
    return F.length(body) > CONFIG.meaningful_chars


def summary_input(content: Column, child_lines: Column) -> Column:
    """What is summarised: own content, child summaries, both, or nothing (null)."""
    own, kids = meaningful(content), F.coalesce(child_lines, F.lit("")) != ""
    return F.when(own & kids, F.concat(content, F.lit("\n\nChild sections:\n"), child_lines)).when(kids, child_lines).when(own, content)


def summary_fields(summary: Column) -> list[Column]:
    return [F.regexp_extract(summary, f"(?m)^{k}: (.*)$", 1).alias(k.lower()) for k in ("SCOPE", "TOPICS", "ENTITIES", "KEYWORDS")]


# Queries


def valid_query(c: Column) -> Column:
    return F.length(strip(c)).between(1, CONFIG.max_query)


def guarded_rewrite(original: Column, rewritten: Column, enabled: bool = True) -> Column:
    """The rewritten query if it is of a sensible length, else the original."""
    if not enabled:
        return original
    r = strip(rewritten)
    good = (strip(original) != "") & F.length(r).between(CONFIG.min_rewrite, CONFIG.max_query)
    return F.when(F.coalesce(good, F.lit(False)), r).otherwise(original)


def clean_variants(query: Column, variants: Column) -> Column:
    kept = F.filter(F.transform(variants, strip), lambda v: (v != "") & (F.lower(v) != F.lower(strip(query))))
    return F.coalesce(F.slice(kept, 1, CONFIG.variants), F.array().cast("array<string>"))


def query_set(rewritten: Column, variants: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(rewritten), variants), strip), lambda v: v != ""))


def json_list(raw: Column) -> Column:
    """A JSON array of strings out of a model's answer, code fences and all; null if broken."""
    bare = F.regexp_replace(strip(F.regexp_replace(raw, r"```(?:json)?\s*", "")), "`+$", "")
    return F.from_json(strip(bare), "array<string>")


def normalised(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"\s+", " "))


def cache_key(query: Column, doc_ids: Column) -> Column:
    scope = F.array_join(F.sort_array(doc_ids), ",")
    return F.when(F.coalesce(F.size(doc_ids), F.lit(0)) > 0, F.concat(normalised(query), F.lit("||"), scope)).otherwise(normalised(query))


def trace(original: Column, rewritten: Column, variants: Column) -> Column:
    return F.concat(F.lit("Original: "), original, F.lit("\nRewritten: "), rewritten, F.lit("\nVariants ("), F.size(variants).cast("string"), F.lit("): "), F.array_join(variants, " | "))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A prompt template with its {names} filled in, and {{ and }} as single braces; null if a
    name or its value is missing. The template is cut once, so braces in values stay."""
    mark = r"\{\{|\}\}|\{[a-z_]+\}"
    known = {"{{": F.lit("{"), "}}": F.lit("}")} | {"{" + k + "}": v for k, v in values.items()}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    filled = F.transform(F.regexp_extract_all(template, F.lit(mark), F.lit(0)), lambda m: F.try_element_at(table, m))
    both = F.arrays_zip(F.split(template, mark).alias("plain"), filled.alias("value"))
    text = F.array_join(F.transform(both, lambda x: F.concat(x["plain"], F.coalesce(x["value"], F.lit("")))), "")
    return F.when(~F.exists(filled, lambda v: v.isNull()), text)
