"""Users, service accounts and keys as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.access import expanded_scopes, key_valid


def accounts_of(accounts: DataFrame, user: str) -> DataFrame:
    return accounts.where(F.col("parent_user") == user)


def delete_user(users: DataFrame, accounts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the users gone and their accounts; the root user stays."""
    gone = gone.join(users.where("is_root"), "username", "left_anti")
    return users.join(gone, "username", "left_anti"), accounts.join(gone, accounts.parent_user == gone.username, "left_anti")


def key_owner(key_hashes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Hash of a key to its account."""
    return key_hashes.join(accounts.select("key_hash", "key_id", "parent_user"), "key_hash")


def rotate(accounts: DataFrame, new_hashes: DataFrame) -> DataFrame:
    """accounts with new key hashes (key_id, new_hash); the old ones are known no more."""
    return accounts.join(new_hashes, "key_id", "left").withColumn("key_hash", F.coalesce("new_hash", "key_hash")).drop("new_hash")


def touch(accounts: DataFrame, uses: DataFrame) -> DataFrame:
    """accounts with the time of each key's last use (uses: key_id, at; many a key); it never goes back."""
    last = uses.groupBy("key_id").agg(F.max("at").alias("_at"))
    return accounts.join(last, "key_id", "left").withColumn("last_used", F.greatest("last_used", "_at")).drop("_at")


def save_users(users: DataFrame, rows: DataFrame) -> DataFrame:
    """users with rows inserted or replaced by name; a root user stays root and enabled whatever a row says."""
    kept = users.where("is_root").select("username", F.lit(True).alias("_root"))
    rows = rows.join(kept, "username", "left").withColumn("is_root", F.coalesce("_root", "is_root")).withColumn("enabled", F.coalesce("_root", "enabled")).drop("_root")
    return users.join(rows, "username", "left_anti").unionByName(rows)


def effective(users: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """What each account may really do now: its scopes and its user's, while both are enabled and it has not expired."""
    u = users.select(F.col("username").alias("parent_user"), F.col("scopes").alias("_user_scopes"), F.col("enabled").alias("_user_enabled"))
    joined = accounts.join(u, "parent_user", "left")
    active = key_valid(F.col("enabled"), F.col("expires_at"), now) & F.coalesce("_user_enabled", F.lit(False))
    scopes = F.array_sort(F.array_intersect(expanded_scopes(F.col("scopes")), expanded_scopes(F.col("_user_scopes"))))
    return joined.select("key_id", "parent_user", active.alias("active"), F.when(active, scopes).otherwise(F.array().cast("array<string>")).alias("effective"))


def last_admin(accounts: DataFrame) -> DataFrame:
    """Whether exactly one key has the scope admin."""
    n = F.count_if(F.array_contains("scopes", "admin"))
    return accounts.agg(n.alias("admins"), (n == 1).alias("last"))
