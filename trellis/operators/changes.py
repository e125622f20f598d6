"""Tables kept up to date from a feed of changes: create, update, delete and upsert, in any number
for a key.

What the feed does to a key is folded to one row before it meets the table: the last delete, the
first create after it, and of each field the last value that an update sets. Maxima and minima
are combined before the shuffle, so a key with a third of all changes is one row from each map
task. Only keys that were created both before and after their last delete need a second look,
at their creates alone.

Rules: changes count in the order of ``order``. A null field of an update leaves the old value. An
update or delete of a key that is not there is ignored, and so is a create of a key that is
there. An upsert creates what is not there and updates what is. Protected fields are set by
the create only. Changes without a key are ignored; of changes equal in ``order`` the one with the
larger value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREATES, UPDATES = ("create", "upsert"), ("update", "upsert")


def folded(changes: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, _gone, _made, _from struct<fields>, _f_<field> struct<at, value>): when the key was
    last deleted; when it was first created since, and with what; the last update of each field."""
    at = F.struct(*[F.col(c) for c in order])
    rows = changes.where(F.col(key).isNotNull()).select(key, "op", at.alias("_at"), *fields)
    own = F.struct(*fields)
    is_new, is_update = F.col("op").isin(*CREATES), F.col("op").isin(*UPDATES)
    first = F.min(F.when(is_new, F.struct(F.col("_at").alias("at"), own.alias("own"))))
    last = [F.max(F.when(is_update & F.col(f).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(f).alias("value")))).alias(f"_f_{f}") for f in fields]
    once = rows.groupBy(key).agg(F.max(F.when(F.col("op") == "delete", F.col("_at"))).alias("_gone"), first.alias("_first"), *last)
    twice = once.where(F.col("_first.at") < F.col("_gone")).select(key, "_gone")
    since = rows.where(is_new).join(twice, key).where(F.col("_at") > F.col("_gone")).groupBy(key).agg(first.alias("_since"))
    alive = F.col("_gone").isNull() | (F.col("_first.at") > F.col("_gone"))
    start = F.when(alive, F.col("_first")).otherwise(F.col("_since"))
    return once.join(since, key, "left").select(key, "_gone", start["at"].alias("_made"), start["own"].alias("_from"), *[f"_f_{f}" for f in fields])


def applied(table: DataFrame, changes: DataFrame, key: str, order: list[str], fields: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """``table`` (key and fields) after the changes, with ``made``: when a key that was not there
    before was created, null for one that was."""
    fold = folded(changes, key, order, fields)
    both = table.select(key, F.struct(*fields).alias("_old")).join(fold, key, "full_outer")
    kept = F.col("_old").isNotNull() & F.col("_gone").isNull()

    def value(f: str) -> Column:
        new = F.col(f"_f_{f}")
        if f in protected:
            return F.when(kept, F.col(f"_old.{f}")).otherwise(F.col(f"_from.{f}"))
        since = F.when(new["at"] >= F.col("_made"), new["value"])
        return F.when(kept, F.coalesce(new["value"], F.col(f"_old.{f}"))).otherwise(F.coalesce(since, F.col(f"_from.{f}")))

    out = both.where(kept | F.col("_made").isNotNull())
    return out.select(key, *[value(f).alias(f) for f in fields], F.when(~kept, F.col("_made")).alias("made"))
