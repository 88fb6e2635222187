"""Canonical JSON and the ids and names derived from content."""

from __future__ import annotations

import hashlib
import json
import math
import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value, allow_nan: bool = False) -> str:
    """Sorted keys, no spaces, text as it stands; NaN and infinities are refused unless allowed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=allow_nan)


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_map(entries: Column) -> Column:
    """JSON of a map with its keys in order; null for null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def canonical_text(text: Column, schema: str = "map<string,string>") -> Column:
    """JSON text of a flat object with its keys in order, expression only (nested: ``canonical_json``)."""
    return canonical_map(F.from_json(text, schema))


def list_hash(values: Column) -> Column:
    """SHA-256 of an array of strings as canonical JSON."""
    return F.sha2(F.to_json(values).cast("binary"), 256)


def edit_id(item: Column, name: Column, seed: Column | int, target: Column) -> Column:
    """item:name:s<seed>:<16 digits of the target's digest>."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.concat_ws(":", item, name, F.concat(F.lit("s"), seed.cast("string")), F.substring(F.sha2(target.cast("binary"), 256), 1, 16))


def artifact_name(item: Column, edit: Column, suffix: str = ".parquet") -> Column:
    """Portable fixed-width file name of an item's artifact."""
    return F.concat(F.sha2(F.concat(item, F.lit("\0"), edit).cast("binary"), 256), F.lit(suffix))


def layer_index(index: Column, layers: Column) -> Column:
    """Layer number with negative ones counted from the end; null out of range."""
    at = F.when(index < 0, index + layers).otherwise(index)
    return F.when((at >= 0) & (at < layers), at)


def parse_object(text: Column) -> tuple[Column, Column]:
    """(map, bad) of a JSON object: null is an empty map; anything that is no object is bad."""
    found = F.from_json(text, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return F.when(text.isNull(), empty).otherwise(found), text.isNotNull() & found.isNull()


def parse_strings(text: Column) -> tuple[Column, Column]:
    """(array, bad) of a JSON list of strings: null is an empty list."""
    found = F.from_json(text, "array<string>")
    bad = text.isNotNull() & (found.isNull() | F.exists(found, lambda x: x.isNull()))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(~bad, found), bad


def literal_boolean(text: Column) -> tuple[Column, Column]:
    """(boolean, bad) of a JSON literal: only true and false count."""
    value = F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    return value, value.isNull()


def deep_merge(*mappings: dict) -> dict:
    """Recursive merge of configuration mappings; later ones win, inputs stay as they are."""
    out: dict = {}
    for mapping in mappings:
        for key, value in mapping.items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = deep_merge(out[key], value) if both else deep_merge(value) if isinstance(value, dict) else value
    return out


def command_words(text: str) -> list[str]:
    words = shlex.split(text)
    if not words:
        raise ValueError("empty command")
    return words


def command_text(words: list[str]) -> str:
    return shlex.join(words)


def finite(value: float) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
