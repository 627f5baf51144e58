"""Segment hashes of keys and the arithmetic of hash trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trees have 256 leaves a branch and so many branches.
WIDTHS = {"xxsmall": 16, "xsmall": 64, "small": 256, "medium": 1024, "large": 4096, "xlarge": 16384}
LEAVES = 256


def _hex(digest: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digest, start, n), 16, 10).cast("bigint")


def segment48(canonical: Column) -> Column:
    """(seg, extra, alt): 16, 32 and 32 bits of the MD5 of a key."""
    d = F.md5(canonical)
    return F.struct(_hex(d, 1, 4).alias("seg"), _hex(d, 5, 8).alias("extra"), _hex(d, 13, 8).alias("alt"))


def segment32(seg: Column, extra: Column) -> Column:
    return F.shiftleft(extra.bitwiseAND(65535), 16) + seg


def tree_segment(hash32: Column, size: str) -> Column:
    return hash32.bitwiseAND(WIDTHS[size] * LEAVES - 1)


def match_segment(a: Column, size_a: str, b: Column, size_b: str) -> Column:
    """Whether segments of two tree sizes can be of one key: equal in the smaller tree."""
    mask = min(WIDTHS[size_a], WIDTHS[size_b]) * LEAVES - 1
    return a.bitwiseAND(mask) == b.bitwiseAND(mask)


def valid_size(size: str) -> bool:
    return size in WIDTHS


def join_segment(branch: int, leaf: int) -> int:
    """The segment of a leaf of a branch."""
    return branch * LEAVES + leaf


def adjust_segments(segments: list[int], size: str, to: str) -> list[int]:
    """All segments of tree ``to`` that hold keys of ``segments`` of the tree ``size``."""
    if WIDTHS[to] <= WIDTHS[size]:
        return sorted({s & (WIDTHS[to] * LEAVES - 1) for s in segments})
    step = WIDTHS[size] * LEAVES
    return sorted(s + step * k for s in segments for k in range(WIDTHS[to] // WIDTHS[size]))


def segment_filter(segments: list[int], size: str) -> list[int] | None:
    """Segments to filter a fold by, or None where that isn't worth it: the smallest tree
    never, the next only for up to four segments."""
    if size == "xxsmall":
        return None
    if size == "xsmall":
        return adjust_segments(segments, "xsmall", "small") if len(segments) <= 4 else None
    return sorted(segments)
