"""Roles, permissions, users, tokens and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import changes

#: Roles from most to least privileged, and the permissions of each.
ROLES = ("admin", "manager", "analyst", "viewer")
PERMISSIONS = {
    "admin": (
        "ingest:create",
        "ingest:view_progress",
        "documents:list",
        "documents:delete",
        "query:execute",
        "citations:view",
        "tasks:cancel",
        "tasks:view_all",
        "cache:view",
        "cache:manage",
        "admin:users",
        "admin:roles",
        "admin:view_audit",
    ),
    "manager": (
        "ingest:create",
        "ingest:view_progress",
        "documents:list",
        "documents:delete",
        "query:execute",
        "citations:view",
        "tasks:cancel",
        "tasks:view_all",
        "cache:view",
        "cache:manage",
    ),
    "analyst": ("ingest:view_progress", "documents:list", "query:execute", "citations:view", "cache:view"),
    "viewer": ("query:execute", "citations:view"),
}


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, own in PERMISSIONS.items() for p in own], "role string, permission string")


def has_permission(users: DataFrame, permissions: DataFrame, permission: str) -> DataFrame:
    """Users whose role has the permission; unknown roles have none."""
    return users.join(permissions.where(F.col("permission") == permission), "role", "left_semi")


def role_matrix(permissions: DataFrame) -> DataFrame:
    return permissions.groupBy("role").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))


def can(permissions: Column, wanted: list[str], every: bool) -> Column:
    """Whether the array holds all, or any, of ``wanted``."""
    test = F.forall if every else F.exists
    return test(F.array(*[F.lit(p) for p in wanted]), lambda p: F.array_contains(permissions, p))


def role_rank(role: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, 4 - i)])
    return F.coalesce(F.try_element_at(ranks, role), F.lit(0))


def live_tokens(tokens: DataFrame, revoked: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Tokens that are not expired or revoked and belong to an active user."""
    fresh = tokens.where(F.col("exp") > now).join(revoked, "jti", "left_anti")
    return fresh.join(users.where("is_active").select("user_id", "username", "role"), "user_id")


def collisions(new: DataFrame, users: DataFrame) -> DataFrame:
    """New users whose name or address is taken, whatever the case."""
    names = users.select(F.lower("username").alias("_n")).distinct()
    mails = users.select(F.lower("email").alias("_m")).distinct()
    found = new.join(names, F.lower("username") == names["_n"], "left").join(mails, F.lower("email") == mails["_m"], "left")
    return found.where(F.col("_n").isNotNull() | F.col("_m").isNotNull()).drop("_n", "_m")


#: Fields of a user that an update may not change.
PROTECTED = ("user_id", "created_at", "created_by", "login_count")


def merge_users(users: DataFrame, feed: DataFrame, order: list[str]) -> DataFrame:
    """Users after a feed of changes (user_id, ``op``: create, update or delete, the columns of
    ``order``, and fields), any number a user; null leaves a field, protected ones stay."""
    own = [c for c in users.columns if c != "user_id"]
    ch = feed.select("user_id", "op", *order, *[(F.col(c) if c in feed.columns else F.lit(None)).cast(users.schema[c].dataType).alias(c) for c in own if c not in order])
    return changes.applied(users, ch, "user_id", order, own, PROTECTED).drop("made")


def audit_search(log: DataFrame, text: str) -> DataFrame:
    """Entries with the text in action (as typed), detail (any case) or user (as typed)."""
    if not text:
        return log
    low = text.lower()
    return log.where(F.col("action").contains(low) | F.lower("detail").contains(low) | F.col("user_id").contains(text))


def user_search(users: DataFrame, text: str) -> DataFrame:
    low = text.lower()
    return users.where(F.lower("username").contains(low) | F.lower("email").contains(low) | F.lower("full_name").contains(low))
