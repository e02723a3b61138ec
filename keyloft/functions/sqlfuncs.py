"""The map functions under their SQL names.

Those made of built-in expressions are SQL functions, which the analyzer inlines:
no call is left in the plan.  Those that give rows are table functions, for use
after ``LATERAL``.  The others are Arrow functions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from .vmap import VMAP, from_rows, sorted_pairs, text_of, to_arrow

_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SAME = f"if(case_sensitive, p.key = k, {_SMALL.format('p.key')} = {_SMALL.format('k')})"
_FOUND = f"get(filter(vm, p -> {_SAME}), 0).value"
_SPACES = r"[ \\t\\n\\x0B\\f\\r]+"


def _normal(pairs: str) -> str:
    """Pairs in any order as a vmap."""
    tagged = f"transform(filter({pairs}, p -> p.key IS NOT NULL), (p, i) -> struct({_SMALL.format('p.key')} AS f, i, p.key, p.value, p.is_map))"
    return f"CAST(transform(array_sort({tagged}), p -> struct(p.key, p.value, p.is_map)) AS {VMAP})"


def _pair(key: str, value: str) -> str:
    return f"struct({key} AS key, {value} AS value, false AS is_map)"


_CELL = "if(trim_cells, btrim({0}, ' \\t\\n\\u000b\\f\\r'), {0})"
_CELLS = f"transform(split(text, '\\\\Q' || delimiter || '\\\\E', -1), c -> {_CELL.format('c')})"
_NAMES = f"transform(split(header_names, '\\\\Q' || delimiter || '\\\\E', -1), c -> {_CELL.format('c')})"
_NAME = f"coalesce(if(header_names = '', NULL, get({_NAMES}, i)), 'ucol' || i)"
_VALUE = "if(treat_empty_val_as_null AND c = '', NULL, c)"
_TOKENS = f"filter(split(p.value, if(tokenize_type = 'SPECIAL_CHARACTERS', '[^A-Za-z]+', '{_SPACES}'), -1), t -> t <> '')"

#: Name, parameters, result, body.
SQL = [
    ("maplookup", f"vm {VMAP}, k STRING, case_sensitive BOOLEAN DEFAULT false, buffer_size INT DEFAULT 0", "STRING", f"if(buffer_size > 0 AND octet_length({_FOUND}) > buffer_size, NULL, {_FOUND})"),
    ("mapcontainskey", f"vm {VMAP}, k STRING, case_sensitive BOOLEAN DEFAULT false", "BOOLEAN", f"if(vm IS NOT NULL AND k IS NULL, false, exists(vm, p -> {_SAME}))"),
    ("mapcontainsvalue", f"vm {VMAP}, v STRING", "BOOLEAN", "exists(vm, p -> p.value IS NOT NULL AND p.value <=> v)"),
    ("mapversion", f"vm {VMAP}", "BIGINT", "if(vm IS NULL, -1L, 1L)"),
    ("mapsize", f"vm {VMAP}", "BIGINT", "coalesce(CAST(size(vm) AS BIGINT), -1L)"),
    ("emptymap", "", VMAP, f"CAST(array() AS {VMAP})"),
    ("setmapkeys", "ks ARRAY<STRING>", "ARRAY<STRING>", "if(size(ks) = 0 OR exists(ks, k -> k IS NULL) OR size(array_distinct(ks)) < size(ks), raise_error('keys must be given, not null and not twice'), ks)"),
    ("mapput", f"vm {VMAP}, ks ARRAY<STRING>, vs ARRAY<STRING>", VMAP, f"CASE WHEN size(ks) <> size(vs) THEN raise_error('as many values as keys are needed') WHEN vm IS NOT NULL THEN {_normal('concat(zip_with(ks, vs, (k, v) -> ' + _pair('k', 'v') + '), filter(vm, p -> NOT array_contains(ks, p.key)))')} END"),
    ("mapaggregate", "pairs ARRAY<STRUCT<key: STRING, value: STRING>>", VMAP, _normal(f"transform(array_sort(filter(pairs, p -> p.key <> '')), p -> {_pair('p.key', 'p.value')})")),
    ("mapdelimitedextractor", "text STRING, delimiter STRING DEFAULT '|', header_names STRING DEFAULT '', trim_cells BOOLEAN DEFAULT true, treat_empty_val_as_null BOOLEAN DEFAULT true", VMAP, f"if(text = '', NULL, {_normal(f'transform({_CELLS}, (c, i) -> {_pair(_NAME, _VALUE)})')})"),
]

#: Name, parameters, columns, query.
TABLES = [
    ("mapkeys", f"vm {VMAP}", "keys STRING", "SELECT p.key FROM explode(vm) AS t(p)"),
    ("mapvalues", f"vm {VMAP}", "values STRING", "SELECT p.value FROM explode(vm) AS t(p)"),
    ("mapitems", f"vm {VMAP}", "keys STRING, values STRING", "SELECT p.key, p.value FROM explode(vm) AS t(p)"),
    ("mapkeysinfo", f"vm {VMAP}", "keys STRING, length BIGINT, type_oid STRING, field_num BIGINT", "SELECT p.key, CAST(octet_length(p.value) AS BIGINT), if(p.is_map, 'map', 'long varbinary'), CAST(i AS BIGINT) FROM posexplode(vm) AS t(i, p)"),
    ("mapvaluesorfield", f"vm {VMAP}, field STRING", "values STRING", "SELECT v FROM explode(if(vm IS NULL, array(field), transform(vm, p -> p.value))) AS t(v)"),
    ("flextokenizer", f"vm {VMAP}, tokenize_type STRING DEFAULT 'SPACES'", "token STRING", f"SELECT k FROM explode(flatten(transform(mapleaves(vm), p -> if(coalesce(p.value, '') = '', array(CAST(NULL AS STRING)), {_TOKENS})))) AS t(k)"),
]


def register(spark: SparkSession) -> None:
    """Define the functions for this session, in place of earlier ones.

    ``mapput`` takes its keys and values as arrays, ``mapaggregate`` what
    ``collect_list(struct(key, value))`` has gathered; ``mapkeysinfo`` numbers fields only.
    """
    from ..operators.extract import JsonOptions, java_pattern, json_records, json_row
    from ..operators.inference import merged_type
    from ..operators.tablefuncs import leaf_pairs

    @F.arrow_udf("string")
    def maptostring(maps: pa.Array) -> pa.Array:
        return pa.array([None if m is None else text_of(from_rows(m)) for m in maps.to_pylist()], pa.string())

    @F.arrow_udf(VMAP)
    def mapleaves(maps: pa.Array) -> pa.Array:
        return to_arrow(None if m is None else leaf_pairs(from_rows(m)) for m in maps.to_pylist())

    @F.arrow_udf(VMAP)
    def mapjsonextractor(texts: pa.Array) -> pa.Array:
        o, out = JsonOptions(), []
        for raw in texts.to_pylist():
            found = list(json_records(raw, o)) if raw else []
            if raw and len(found) != 1:
                raise ValueError(f"one object is needed, not {len(found)}")
            out.append(json_row(found[0], o) if found else None)
        return to_arrow(out)

    @F.arrow_udf(VMAP)
    def mapregexextractor(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        known, out = {}, []
        for text, pattern in zip(texts.to_pylist(), patterns.to_pylist(), strict=True):
            if text is None or pattern is None:
                out.append(None)
                continue
            if pattern not in known:
                java, names = java_pattern(pattern)
                known[pattern] = re.compile(java.replace("(?<g", "(?P<g")), names
            engine, names = known[pattern]
            m = engine.search(text)
            out.append(sorted_pairs((n, v, False) for n, v in zip(names, m.groups()) if v) if m else None)
        return to_arrow(out)

    @F.arrow_udf("string")
    def pickbesttypemerge(o: pa.Array, of: pa.Array, n: pa.Array, nf: pa.Array) -> pa.Array:
        return pa.array([merged_type(*row) for row in zip(*(x.to_pylist() for x in (o, of, n, nf)), strict=True)], pa.string())

    for name, function in (
        ("maptostring", maptostring), ("mapleaves", mapleaves), ("mapjsonextractor", mapjsonextractor),
        ("mapregexextractor", mapregexextractor), ("pickbesttypemerge", pickbesttypemerge),
    ):
        spark.udf.register(name, function)
    for name, parameters, result, body in SQL:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, result, query in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({result}) RETURN {query}")
