"""Scopes, partitions and keys: who may do what."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_scope(scopes: Column, wanted: str) -> Column:
    """The exact scope; admin stands for read and write too."""
    exact = F.array_contains(scopes, wanted)
    return exact | F.array_contains(scopes, "admin") if wanted in ("read", "write") else exact


def expanded_scopes(scopes: Column) -> Column:
    """Roles as scopes (operator: read and write, viewer: read), sorted, each once."""
    one = lambda s: F.when(s == "operator", F.array(F.lit("read"), F.lit("write"))).when(s == "viewer", F.array(F.lit("read"))).otherwise(F.array(s))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(scopes, one))))


def scopes_within(requested: Column, parent: Column) -> Column:
    """Whether each requested scope is the parent's; admins and operators may grant read and write."""
    elevated = F.array_contains(parent, "admin") | F.array_contains(parent, "operator")
    return F.forall(requested, lambda s: F.array_contains(parent, s) | (s.isin("read", "write") & elevated))


def partition_allowed(allowed: Column, partition: Column) -> Column:
    """No list: all partitions; an empty list: none; else those listed, as text."""
    return allowed.isNull() | F.coalesce(F.array_contains(allowed, partition.cast("string")), F.lit(False))


def granted_partitions(requested: Column, parent: Column) -> Column:
    """struct(partitions, allowed): what a new key gets. No request inherits; without a parent's list, all go."""
    inside = F.size(F.array_intersect(requested, parent)) == F.size(F.array_distinct(requested))
    partitions = F.when(requested.isNull(), parent).when(parent.isNull() | inside, requested)
    return F.struct(partitions.alias("partitions"), (requested.isNull() | parent.isNull() | inside).alias("allowed"))


def key_valid(enabled: Column, expires_at: Column, now: Column) -> Column:
    """Enabled and not yet expired; no time of expiry means never."""
    return enabled & (expires_at.isNull() | (now < expires_at))


def owns(scopes: Column, parent_user: Column, target: Column) -> Column:
    return F.array_contains(scopes, "admin") | ((parent_user == target) & (target != ""))


def password_hash(password: Column, salt: Column) -> Column:
    return F.sha2(F.concat(password.cast("binary"), salt.cast("binary")), 256)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    """What a listing shows of a key: its first ten characters."""
    return F.concat(F.left(key, F.lit(10)), F.lit("..."))


def name_valid(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_.-]{2,64}$")


def password_valid(password: Column) -> Column:
    return (F.char_length(password) >= 8) & ~password.rlike(r"\p{Cc}")


def scopes_valid(scopes: Column) -> Column:
    return (F.size(scopes) > 0) & F.forall(scopes, lambda s: s.isin("admin", "read", "write", "operator", "viewer"))
