"""Table functions over a vmap column: one row per pair, without a shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import SPACE_CLASS
from ..functions.vmap import Pair, from_rows, unnest


def mapkeys(df: DataFrame, vm: str, *keep: str) -> DataFrame:
    """The keys of each map; no row for a null map."""
    return df.select(*keep, F.explode(vm).alias("_p")).select(*keep, F.col("_p.key").alias("keys"))


def mapvalues(df: DataFrame, vm: str, *keep: str) -> DataFrame:
    """The values of each map, null values too; no row for a null map."""
    return df.select(*keep, F.explode(vm).alias("_p")).select(*keep, F.col("_p.value").alias("values"))


def mapitems(df: DataFrame, vm: str, *keep: str | Column) -> DataFrame:
    """Keys and values with passed-through columns; unnamed expressions are ``col<N>``."""
    passed = [F.col(k) if isinstance(k, str) else k.alias(f"col{i}") for i, k in enumerate(keep, 1)]
    exploded = df.select(F.explode(vm).alias("_p"), *passed)
    return exploded.select(F.col("_p.key").alias("keys"), F.col("_p.value").alias("values"), *[c for c in exploded.columns if c != "_p"])


def mapkeysinfo(df: DataFrame, vm: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Keys with the bytes of their values, their kind, and row and field numbers.

    ``row_num`` counts from 1 in ``order`` within ``partition``, null maps too;
    ``field_num`` counts from 0 within the map.  Without ``partition`` each task
    numbers its own rows as they come, without a shuffle, as the function does
    where the host picks the partitions; ``order`` then names columns to keep.
    """
    keep = list(dict.fromkeys([*(partition or []), *order]))
    if partition:
        number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long")
    else:
        number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = df.withColumn("row_num", number)
    each = numbered.select(*keep, "row_num", F.posexplode(vm).alias("field_num", "_p"))
    return each.select(
        *keep,
        F.col("_p.key").alias("keys"),
        F.octet_length("_p.value").cast("long").alias("length"),
        F.when(F.col("_p.is_map"), "map").otherwise("long varbinary").alias("type_oid"),
        "row_num",
        F.col("field_num").cast("long").alias("field_num"),
    )


def mapvaluesorfield(df: DataFrame, vm: str, field: str, *keep: str) -> DataFrame:
    """The map's values; where there is no map, the field itself, once, even if null."""
    values = F.when(F.col(vm).isNotNull(), F.transform(vm, lambda p: p["value"])).otherwise(F.array(F.col(field)))
    return df.select(*keep, F.explode(values).alias("values"))


#: How a tokenizer splits: at white space, or at what is no ASCII letter.
TOKENIZE = {"SPACES": SPACE_CLASS + "+", "SPECIAL_CHARACTERS": "[^A-Za-z]+"}


def leaf_pairs(pairs: list[Pair]) -> list[Pair]:
    """The pairs of a map whose values are no maps, at any depth."""
    out: list[Pair] = []
    for key, value, nested in pairs:
        out += leaf_pairs(unnest(value)) if nested and value is not None else [(key, value, False)]
    return out


def flextokenizer(df: DataFrame, vm: str, *keep: str, tokenize_type: str = "SPACES") -> DataFrame:
    """The tokens of all values, those of nested maps too.

    A null or empty value gives one null token, one of white space only none.
    """
    if tokenize_type not in TOKENIZE:
        raise ValueError(f"tokenizer type {tokenize_type!r} is not supported")

    @F.arrow_udf("array<string>")
    def leaves(maps: pa.Array) -> pa.Array:
        return pa.array([None if m is None else [v for _, v, _ in leaf_pairs(from_rows(m))] for m in maps.to_pylist()], pa.list_(pa.string()))

    flat = F.transform(vm, lambda p: p["value"])
    values = F.when(F.exists(vm, lambda p: p["is_map"]), leaves(F.col(vm))).otherwise(flat)
    return tokens(df.withColumn("_v", F.explode(values)), "_v", *keep, tokenize_type=tokenize_type)


def tokens(df: DataFrame, text: str, *keep: str, tokenize_type: str = "SPACES") -> DataFrame:
    """The tokens of a text column, by built-in expressions."""
    parts = F.filter(F.split(text, TOKENIZE[tokenize_type], -1), lambda t: t != "")
    none = F.array(F.lit(None).cast("string"))
    value = F.col(text)
    return df.select(*keep, F.explode(F.when(value.isNull() | (value == ""), none).otherwise(parts)).alias("token"))
