"""String and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_display_name(raw: Column, index: Column) -> Column:
    """Class name without its ``(digits)`` prefix; an absent name becomes ``class_<index>``."""
    named = F.coalesce(F.nullif(raw, F.lit("")), F.concat(F.lit("class_"), index.cast("string")))
    stripped = F.regexp_extract(named, r"^\(\d+\)(.+)$", 1)
    return F.coalesce(F.nullif(stripped, F.lit("")), named)


def search_text(path: Column, label: Column, suggestion: Column) -> Column:
    return F.lower(F.concat_ws(" ", path, label, F.coalesce(suggestion, F.lit(""))))


def matches_search(path: Column, label: Column, suggestion: Column, needle: str) -> Column:
    """Literal, case-insensitive containment; a blank needle matches everything."""
    wanted = needle.strip().lower()
    return F.lit(True) if not wanted else F.contains(search_text(path, label, suggestion), F.lit(wanted))


def _fnv_step(state: Column, unit: Column) -> Column:
    return (state.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of ``text``; characters beyond 16 bits count as two units."""

    def step(state: Column, char: Column) -> Column:
        point = F.ascii(char).cast("long")
        high = F.shiftright(point - 0x10000, 10) + 0xD800
        low = (point - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        pair = _fnv_step(_fnv_step(state, high), low)
        return F.when(point < 0x10000, _fnv_step(state, point)).otherwise(pair)

    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda state, char: F.when(
        char == "", state).otherwise(step(state, char)))


def item_hash(item_id: Column, path: Column) -> Column:
    """Stable sampling hash of an item: FNV-1a of id, a NUL and the path."""
    return fnv1a_32(F.concat(item_id, F.lit("\0"), F.coalesce(path, F.lit(""))))


def session_key(path: Column, source_hash: Column, fold_case: bool = False) -> Column:
    place = F.lower(path) if fold_case else path
    return F.sha2(F.concat(place, F.lit("\0"), F.coalesce(source_hash, F.lit("missing-source-hash"))), 256)


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def seeded_digest(item_id: Column, seed: Column) -> Column:
    """Hex digest that orders ids pseudo-randomly, differently for each seed."""
    return F.md5(F.concat_ws(":", item_id.cast("string"), seed.cast("string")))
