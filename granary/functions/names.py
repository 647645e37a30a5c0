"""File ids, byte-range headers, download names, paths and the small parsers of requests."""

from __future__ import annotations

import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_ID = 1024


def normalised_id(file_id: Column) -> Column:
    """NFC form. Spark has no built-in for it; ASCII ids (the usual case) do not reach Python."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return F.when(F.octet_length(file_id) == F.char_length(file_id), file_id).otherwise(nfc(file_id))


def id_problem(file_id: Column) -> Column:
    """Why a normalised id is not allowed; null if it is."""
    size = F.octet_length(file_id)
    parts = F.split(file_id, "/")
    return (
        F.when(file_id.isNull() | (size == 0), "empty")
        .when(size > LONGEST_ID, "too long")
        .when(file_id.rlike(r"\p{Cc}"), "control character")
        .when(file_id.startswith("/") | file_id.endswith("/"), "slash at an end")
        .when(file_id.contains("//"), "empty segment")
        .when(F.exists(parts, lambda p: p.isin(".", "..")), "dot segment")
    )


def byte_range(header: Column, size: Column) -> Column:
    """struct(status, start, end) of a single byte range: ok, multi, unsatisfiable or malformed. end is inclusive.

    Forms: "bytes=a-b", "bytes=a-" and "bytes=-n"; an end beyond the object is cut.
    """
    spec = F.regexp_extract(F.trim(header), r"^bytes=(.*)$", 1)
    known = F.trim(header).startswith("bytes=")
    a, b = F.regexp_extract(spec, r"^\s*(\d*)-(\d*)\s*$", 1), F.regexp_extract(spec, r"^\s*(\d*)-(\d*)\s*$", 2)
    shaped = spec.rlike(r"^\s*(\d+-\d*|-\d+)\s*$")
    first, last = a.try_cast("long"), b.try_cast("long")
    suffix = a == ""
    status = (
        F.when(header.isNull() | ~known, "malformed")
        .when(spec.contains(","), "multi")
        .when(~spec.contains("-"), "malformed")
        .when(size == 0, "unsatisfiable")
        .when(~shaped, "malformed")
        .when(suffix & (last == 0), "unsatisfiable")
        .when(suffix, "ok")
        .when(first >= size, "unsatisfiable")
        .when((b != "") & (last < first), "unsatisfiable")
        .otherwise("ok")
    )
    start = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    end = F.when(suffix | (b == ""), size - 1).otherwise(F.least(last, size - 1))
    ok = status == "ok"
    return F.struct(status.alias("status"), F.when(ok, start).cast("long").alias("start"), F.when(ok, end).cast("long").alias("end"))


def download_header(name: Column) -> Column:
    """An attachment header with an ASCII name and the percent-encoded UTF-8 name."""

    @F.pandas_udf("string")
    def header(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            plain = "".join(c if " " <= c <= "~" and c not in '"\\' else "_" for c in v.encode().decode("latin-1")) or "download"
            return f"attachment; filename=\"{plain}\"; filename*=UTF-8''{quote(v, safe='!#$&+^`|~')}"

        return values.map(one)

    return header(name)


def container_path(block_id: Column) -> Column:
    """aa/bb/<id>.blk: two levels of folders from the id's first digits."""
    return F.concat_ws("/", F.substring(block_id, 1, 2), F.substring(block_id, 3, 2), F.concat(block_id, F.lit(".blk")))


def new_id(seed: Column | None = None) -> Column:
    """32 hex digits: random, or from a seed."""
    return F.replace(F.uuid(), F.lit("-"), F.lit("")) if seed is None else F.substring(F.sha2(seed.cast("string"), 256), 1, 32)


def conflict_policy(value: Column) -> Column:
    """error, skip or overwrite; empty means error, anything unknown is null."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v == "", "error").when(v.isin("error", "skip", "overwrite"), v)


def client_address(forwarded: Column, peer: Column) -> Column:
    """The first forwarded-for address, or the peer's."""
    return F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), peer)


def audit_outcome(status: Column) -> Column:
    return F.when(status < 400, "ok").when(status < 500, "denied").otherwise("error")


def partition_id(epoch_seconds: Column, hours: int = 24) -> Column:
    """The time partition: whole periods since the epoch."""
    return F.floor(epoch_seconds / F.lit(hours * 3600)).cast("long")


def backoff(attempt: Column, initial: float, factor: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt), F.lit(most))


def retryable(kind: Column) -> Column:
    """Whether an error may pass by itself: input and output, a timeout, or someone else's change at the same time."""
    return F.coalesce(kind.isin("Io", "Timeout", "ConcurrentModification"), F.lit(False))


def time_ago(at: Column, now: Column) -> Column:
    """never (no time or zero), just now, 5 minutes ago, 3 hours ago, 2 days ago."""
    past = now - at
    ago = lambda n, unit: F.format_string(f"%d {unit} ago", F.floor(past / n).cast("long"))
    return F.when(at.isNull() | (at == 0), "never").when(past < 60, "just now").when(past < 3600, ago(60, "minutes")).when(past < 86400, ago(3600, "hours")).otherwise(ago(86400, "days"))


def use_level(utilisation: Column) -> Column:
    """none, low (under a half), fair (under four fifths) or good."""
    return F.when(utilisation.isNull(), "none").when(utilisation < 0.5, "low").when(utilisation < 0.8, "fair").otherwise("good")


def duration_text(seconds: Column) -> Column:
    """45s, 3m 5s, 2h 1m, 4d 3h 2m."""
    s = seconds.cast("long")
    whole = lambda n: F.floor(s / n).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", whole(60), s % 60))
        .when(s < 86400, F.format_string("%dh %dm", whole(3600), whole(60) % 60))
        .otherwise(F.format_string("%dd %dh %dm", whole(86400), whole(3600) % 24, whole(60) % 60))
    )
