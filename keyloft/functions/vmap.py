"""The map value of a schemaless row and the scalar functions on it.

A vmap is an array of (key, value, is_map), sorted by key without regard to ASCII
case, pairs of equal keys in the order they came.  Duplicate keys are kept, all
scalars are text, and a null value differs from a missing key.  A nested map is
stored in ``value`` as JSON text of its pairs, ``[[key, value, is_map], ...]``,
with ``is_map`` true.

Everything here but :func:`maptostring` is made of built-in expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import ascii_lower

VMAP = "array<struct<key:string,value:string,is_map:boolean>>"
ARROW_VMAP = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string()), ("is_map", pa.bool_())]))

#: A pair in plain Python: key, text or None, whether the text is a nested map.
Pair = tuple[str, str | None, bool]


def _fold(key: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def sorted_pairs(pairs: Iterable[Pair]) -> list[Pair]:
    """Pairs in the order of a vmap, by the bytes of their folded keys."""
    return sorted(pairs, key=lambda p: _fold(p[0]).encode("utf-8", "surrogatepass"))


def nest(pairs: Iterable[Pair]) -> str:
    """A nested map's text."""
    return json.dumps([[k, v, int(m)] for k, v, m in sorted_pairs(pairs)], ensure_ascii=False, separators=(",", ":"))


def unnest(value: str) -> list[Pair]:
    return [(k, v, bool(m)) for k, v, m in json.loads(value)]


def to_arrow(maps: Iterable[list[Pair] | None]) -> pa.Array:
    rows = [None if m is None else [{"key": k, "value": v, "is_map": b} for k, v, b in m] for m in maps]
    return pa.array(rows, ARROW_VMAP)


def from_rows(pairs) -> list[Pair] | None:
    """A vmap as Spark or Arrow hands it over."""
    return None if pairs is None else [(p["key"], p["value"], bool(p["is_map"])) for p in pairs]


def pair(key: Column, value: Column, is_map: Column | None = None) -> Column:
    return F.struct(
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
        (F.lit(False) if is_map is None else is_map).alias("is_map"),
    )


def normalize_vmap(pairs: Column) -> Column:
    """Pairs in any order as a vmap; pairs without a key are left out."""
    keyed = F.filter(pairs, lambda p: p["key"].isNotNull())
    tagged = F.transform(
        keyed, lambda p, i: F.struct(ascii_lower(p["key"]).alias("k"), i.alias("i"), p["key"], p["value"], p["is_map"])
    )
    return F.transform(F.array_sort(tagged), lambda p: F.struct(p["key"], p["value"], p["is_map"])).cast(VMAP)


def vmap_of(**columns: Column) -> Column:
    """A vmap of named columns; nulls become keys with a null value."""
    return normalize_vmap(F.array(*[pair(F.lit(k), c) for k, c in columns.items()]))


def vmap_of_present(**columns: Column) -> Column:
    """As :func:`vmap_of`, but without the keys whose value is null."""
    return F.filter(vmap_of(**columns), lambda p: p["value"].isNotNull())


def emptymap() -> Column:
    """The map without pairs."""
    return F.array().cast(VMAP)


def maplookup(vm: Column, key: Column | str, *, case_sensitive: bool = False, buffer_size: int = 0) -> Column:
    """The first value of a key; null for a missing key, a null value, map or key.

    A value of more than ``buffer_size`` bytes is null; 0 sets no bound.
    """
    key = F.lit(key) if isinstance(key, str) else key
    same = (lambda p: p["key"] == key) if case_sensitive else (lambda p: ascii_lower(p["key"]) == ascii_lower(key))
    value = F.get(F.filter(vm, same), F.lit(0))["value"]
    return F.when(F.octet_length(value) <= buffer_size, value) if buffer_size else value


def mapcontainskey(vm: Column, key: Column | str) -> Column:
    """Whether a key is there, in any case, even with a null value; null for a null map."""
    key = F.lit(key) if isinstance(key, str) else key
    found = F.exists(vm, lambda p: ascii_lower(p["key"]) == ascii_lower(key))
    return F.when(vm.isNotNull() & key.isNull(), F.lit(False)).otherwise(found)


def mapcontainsvalue(vm: Column, value: Column | str) -> Column:
    """Whether a value is there, exactly; null values never are."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.exists(vm, lambda p: p["value"].isNotNull() & p["value"].eqNullSafe(value))


def mapversion(vm: Column) -> Column:
    """1 for a map, -1 for null."""
    return F.when(vm.isNull(), -1).otherwise(1).cast("long")


def mapsize(vm: Column) -> Column:
    """Number of pairs, duplicates included; -1 for null."""
    return F.coalesce(F.size(vm).cast("long"), F.lit(-1).cast("long"))


def setmapkeys(*keys: str) -> list[str]:
    """The keys that :func:`mapput` sets; at least one, none null, none twice."""
    if not keys:
        raise ValueError("at least one key is needed")
    if any(not isinstance(k, str) for k in keys):
        raise ValueError("keys must be strings and not null")
    if len(set(keys)) < len(keys):
        raise ValueError("a key is given twice")
    return list(keys)


def value_text(c: Column, kind: str = "") -> Column:
    """The text under which a value of some SQL type is put into a map."""
    if kind == "boolean":
        return F.when(c, "t").otherwise(F.when(~c, "f"))
    if kind in ("double", "float"):
        short = F.regexp_replace(F.format_string("%.15g", c.cast("double")), r"(\.[0-9]*?)0+(e|$)", "$1$2")
        return F.when(c.isNotNull(), F.regexp_replace(short, r"\.(e|$)", "$1"))
    if kind.startswith(("array", "map", "struct")):
        return F.lit(None).cast("string")
    return c.cast("string")


def mapput(vm: Column, keys: list[str], *values: Column) -> Column:
    """Set keys to values: equal keys (in the same case) are replaced, others are added."""
    keys = setmapkeys(*keys)
    if len(keys) != len(values):
        raise ValueError("as many values as keys are needed")
    new = F.array(*[pair(F.lit(k), v) for k, v in zip(keys, values, strict=True)])
    old = F.filter(vm, lambda p: ~p["key"].isin(keys))
    return F.when(vm.isNotNull(), normalize_vmap(F.concat(new, old)))


def _styled(pairs: list[Pair], depth: int) -> str:
    first: dict[str, tuple[str | None, bool]] = {}
    for k, v, m in pairs:
        first.setdefault(k, (v, m))
    if not first:
        return "{}"
    pad, rows = "   " * (depth + 1), []
    for k in sorted(first, key=lambda k: k.encode("utf-8", "surrogatepass")):
        v, m = first[k]
        if v is None:
            text = "null"
        elif m:
            inner = _styled(unnest(v), depth + 1)
            text = inner if inner == "{}" else "\n" + pad + inner
        else:
            text = json.dumps(v, ensure_ascii=False)
        rows.append(f"{pad}{json.dumps(k, ensure_ascii=False)} : {text}")
    return "{\n" + ",\n".join(rows) + "\n" + "   " * depth + "}"


def _plain(pairs: list[Pair], depth: int) -> str:
    rows = []
    for k, v, m in pairs:
        text = "null" if v is None else "\n" + _plain(unnest(v), depth + 1) if m else f'"{v}"'
        rows.append("\t" * (depth + 1) + f'"{k}":\t{text}')
    start = "\t" * depth + (" {\n" if depth else "{\n")
    return start + ",\n".join(rows) + "\n" + "\t" * depth + " }"


def text_of(pairs: list[Pair], canonical: bool = True) -> str:
    """A map as JSON text: styled and without repeated keys, or as it is and unescaped."""
    return _styled(pairs, 0) + "\n" if canonical else _plain(pairs, 0)


def maptostring(vm: Column, *, canonical_json: bool = True) -> Column:
    """The text of :func:`text_of`; null for null."""

    @F.arrow_udf("string")
    def show(maps: pa.Array) -> pa.Array:
        return pa.array([None if m is None else text_of(from_rows(m), canonical_json) for m in maps.to_pylist()], pa.string())

    return show(vm)


def maptojson(vm: Column) -> Column:
    """A flat map as compact JSON text, by built-in expressions; of equal keys the first counts."""
    first = F.filter(vm, lambda p, i: ~F.exists(F.slice(vm, 1, i), lambda q: q["key"] == p["key"]))
    return F.to_json(F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"]))), {"ignoreNullFields": "false"})
