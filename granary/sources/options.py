"""Options of a collection, with their defaults, checks and templates."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace

from ..functions.content import ALGORITHMS

#: Keys of older configurations, and what takes their place now.
RETIRED = {"auto_compact_min_size_bytes": "undersize_ratio", "auto_compact_min_benefit_bytes": "compaction_threshold"}


@dataclass(frozen=True)
class Options:
    chunk_size: int = 4 << 20
    block_size: int = 1 << 30
    hash_algorithm: str = "sha256"
    codec: str = "zstd"
    codec_level: int = 1
    time_partition_hours: int = 24
    compaction_threshold: float = 0.5
    undersize_ratio: float = 0.0
    min_blocks_saved: int = 2
    audit_retention_days: int = 90

    def checked(self) -> Options:
        problems = [
            text
            for bad, text in (
                (not 1 << 9 <= self.chunk_size <= 1 << 30, "chunk_size must be from 512 bytes to 1 GiB"),
                (self.block_size < self.chunk_size, "block_size must be at least chunk_size"),
                (self.hash_algorithm not in ALGORITHMS, f"hash_algorithm must be one of {', '.join(ALGORITHMS)}"),
                (self.codec not in ("none", "lz4", "zstd"), "codec must be none, lz4 or zstd"),
                (not 0 <= self.codec_level <= 22, "codec_level must be from 0 to 22"),
                (self.time_partition_hours < 1, "time_partition_hours must be positive"),
                (not 0 <= self.compaction_threshold <= 1, "compaction_threshold must be from 0 to 1"),
                (not 0 <= self.undersize_ratio <= 1, "undersize_ratio must be from 0 to 1"),
            )
            if bad
        ]
        if problems:
            raise ValueError("; ".join(problems))
        return self


#: Sizes for common kinds of collections.
TEMPLATES = {
    "general": Options(),
    "small_files": Options(chunk_size=64 << 10, block_size=256 << 20),
    "large_files": Options(chunk_size=16 << 20, block_size=4 << 30),
    "archive": Options(codec_level=9, compaction_threshold=0.3),
    "fast": Options(codec="lz4", hash_algorithm="sha1"),
}


def from_toml(text: str, template: str = "general") -> Options:
    """Options from TOML (all at the top level or in [storage]); unknown and retired keys are errors."""
    found = tomllib.loads(text)
    found = found.get("storage", found)
    known = {f.name for f in fields(Options)}
    for k in found:
        if k in RETIRED:
            raise ValueError(f"{k} is no longer an option; {RETIRED[k]} decides what it did")
        if k not in known:
            raise ValueError(f"unknown option {k}")
    return replace(TEMPLATES[template], **found).checked()
