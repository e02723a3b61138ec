"""Type inference: what type fits all values of a key.

Every value is classed by itself, in a fixed order of types, and classes are
counted by ordinary aggregation, so the guess does not depend on the order of
rows and partial counts combine.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, LongType, StringType, TimestampNTZType, TimestampType

from ..functions.text import ascii_trim, may_have_timezone

#: Types in the order in which equal counts are decided.
TYPES = ["Int8", "Timestamp", "TimestampTz", "Bool", "Time", "TimeTz", "Float8", "Date", "Interval", "Varchar", "Numeric", "VMap"]
#: Counts of the first type also count for the second where both occur.
WIDENS = [
    ("Int8", "Numeric"), ("Int8", "Float8"), ("Numeric", "Float8"), ("Date", "Timestamp"),
    ("Date", "TimestampTz"), ("Timestamp", "TimestampTz"), ("Time", "TimeTz"),
]
#: Lengths, margins and thresholds of the guess.
LONG_VALUE, MIN_STRING, MAX_SHORT_STRING = 50, 20, 65_000
MORE_PRECISION, MORE_SCALE, NUMERIC_DIGITS = 3, 1, 15
KEPT_SHARE, ERROR_SHARE, INT_PRECISION = 0.8, 0.20, 18

_NUMERIC = r"\A[+-]?\$?[+-]?([0-9]*)\.?([0-9]*)\z"
_CLOCK = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?( ?[AaPp][Mm])?"
_DAY = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"


def class_of(value: Column, is_map: Column | None = None) -> Column:
    """The type that a value is taken for; null for null, empty and blank values.

    The first character tells most types apart, so a value meets few patterns.
    """
    return _class(value, ascii_trim(value), F.lit(False) if is_map is None else is_map)


def _class(value: Column, v: Column, nested: Column) -> Column:
    """:func:`class_of` of a value that is ``v`` without white space around it."""
    digits = F.length(F.regexp_extract(v, _NUMERIC, 1)) + F.length(F.regexp_extract(v, _NUMERIC, 2))
    zoned = may_have_timezone(v)
    stamp = F.try_to_timestamp(F.when(v.rlike(rf"\A{_DAY}"), v))
    midnight = ~v.rlike(":") | v.rlike(r"[T ]0{1,2}:00(:00(\.0+)?)?\z")
    no_zone = (
        F.when(v.rlike(rf"\A{_DAY}([T ]{_CLOCK})?\z") & stamp.isNotNull(), F.when(midnight, "Date").otherwise("Timestamp"))
    )
    with_zone = F.when(v.rlike(rf"\A{_DAY}[T ]{_CLOCK}") & stamp.isNotNull(), "TimestampTz")
    truth = F.lower(v).isin("t", "f", "true", "false", "y", "n", "yes", "no")
    special = v.rlike(r"(?i)\A[+-]?(inf(inity)?|nan)\z") & v.try_cast(DoubleType()).isNotNull()
    letters = F.when(truth, "Bool").when(special, "Float8").otherwise("Varchar")
    numbers = (
        F.when(v.rlike(r"\A[+-]?[0-9]{1,19}\z") & v.try_cast(LongType()).isNotNull(), "Int8")
        .when(v.rlike(_NUMERIC) & v.rlike("[0-9]") & (digits <= NUMERIC_DIGITS), "Numeric")
        .when(~v.rlike("[:dDfF]") & v.try_cast(DoubleType()).isNotNull(), "Float8")
        .when(special, "Float8")
    )
    dated = (
        F.when(~zoned & no_zone.isNotNull(), no_zone)
        .when(zoned & with_zone.isNotNull(), with_zone)
        .when(v.rlike(rf"\A{_CLOCK}\z"), "Time")
        .when(v.rlike(rf"\A{_CLOCK} ?([+-][0-9]{{1,2}}(:?[0-9]{{2}})?|Z|[A-Z]{{3,4}})\z"), "TimeTz")
        .when(v.rlike(r"(?i)\A-?[0-9]+ (days?( [0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?|hours?|minutes?|seconds?)\z"), "Interval")
    )
    # Nothing but a plain number lacks a space, a colon and an inner minus.
    shaped = v.rlike(r"[: ]|[0-9]-")
    return (
        F.when(value.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(nested, "VMap")
        .when(F.octet_length(v) > LONG_VALUE, "Varchar")
        .when(v.rlike(r"\A[A-Za-z]"), letters)
        .when(~v.rlike(r"\A[0-9+$.-]"), "Varchar")
        .otherwise(F.coalesce(F.when(~shaped, numbers), F.when(shaped, dated), F.lit("Varchar")))
    )


def classed(df: DataFrame, value: Column, *by: Column, is_map: Column | None = None) -> DataFrame:
    """Counts of the values of each group: its columns, and ``_c`` for :func:`pickbesttyperesult`.

    Values are classed once, as they are grouped, and few rows of a group are left when
    its classes are put side by side.
    """
    nested = F.lit(False) if is_map is None else is_map
    keyed = df.select(*by, value.alias("_value"), nested.alias("_nested"))
    names = keyed.columns[: len(by)]
    # A column of its own is trimmed once, not again in each pattern.
    keyed = keyed.withColumn("_v", ascii_trim(F.col("_value")))
    v = F.col("_v")
    scale = F.length(F.regexp_extract(v, _NUMERIC, 2))
    whole = F.length(F.regexp_replace(F.regexp_extract(v, _NUMERIC, 1), "^0+", ""))
    first = keyed.groupBy(*[F.col(f"`{c}`") for c in names], _class(F.col("_value"), v, F.col("_nested")).alias("_kind")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.max(F.octet_length("_value")), F.lit(0)).alias("_len"),
        F.coalesce(F.max(whole), F.lit(0)).alias("_whole"),
        F.coalesce(F.max(scale), F.lit(0)).alias("_scale"),
    )
    kind, n = F.col("_kind"), F.col("_n")
    number = kind.isin("Numeric", "Int8")
    none = F.lit(0).cast("long")
    return first.groupBy(*[F.col(f"`{c}`") for c in names]).agg(
        F.struct(
            *[F.coalesce(F.sum(F.when(kind == t, n)), none).alias(t) for t in TYPES],
            F.coalesce(F.max("_len"), F.lit(0)).alias("len"),
            F.coalesce(F.max(F.when(number, F.col("_whole"))), F.lit(0)).alias("whole"),
            F.coalesce(F.max(F.when(number, F.col("_scale"))), F.lit(0)).alias("scale"),
            F.coalesce(F.sum(F.when(kind.isNull(), n)), none).alias("nulls"),
            F.coalesce(F.sum(n), none).alias("rows"),
        ).alias("_c")
    )


def _widened(c: Column) -> dict[str, Column]:
    out = {t: c[t] for t in TYPES}
    for low, high in WIDENS:
        out[high] = F.when(c[high] > 0, out[high] + c[low]).otherwise(out[high])
    return out


def pickbesttyperesult(c: Column, *, enforce_error_threshold: bool = False, error_max: int | None = None) -> Column:
    """Counters as (type, len, prec, scale, errcnt, rowcnt).

    A group with more than ``error_max`` values that are nothing but text is text.

    The most frequent type wins, ties go to the one listed first in ``TYPES``; a
    group without values is text.  Under the threshold a type that fits fewer than
    ``KEPT_SHARE`` of the rows gives way to text, or to maps where there are any.
    """
    n = _widened(c)
    order = F.array(*[F.struct(n[t].alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)])
    best = F.array_max(order)
    kind = F.when(best["n"] > 0, best["t"]).otherwise("Varchar")
    if enforce_error_threshold:
        few = (best["n"] + c["nulls"]) / c["rows"] < KEPT_SHARE
        kind = F.when(few, F.when(c["VMap"] > 0, "VMap").otherwise("Varchar")).otherwise(kind)
    if error_max is not None:
        kind = F.when(c["Varchar"] > error_max, "Varchar").otherwise(kind)
    numeric = kind == "Numeric"
    return F.struct(
        kind.alias("type"),
        F.greatest(F.lit(MIN_STRING), 2 * c["len"]).cast("long").alias("len"),
        F.when(numeric, c["whole"] + c["scale"] + MORE_PRECISION).otherwise(0).cast("long").alias("prec"),
        F.when(numeric, c["scale"] + MORE_SCALE).otherwise(0).cast("long").alias("scale"),
        F.when(kind == "Varchar", F.lit(0)).otherwise(c["rows"] - c["nulls"] - best["n"]).cast("long").alias("errcnt"),
        c["rows"].alias("rowcnt"),
    )


def pickbesttype(df: DataFrame, value: str, *by: str, **options) -> DataFrame:
    """The best type of each group's values, as columns."""
    grouped = classed(df, F.col(value), *[F.col(c) for c in by])
    return grouped.withColumn("_r", pickbesttyperesult(F.col("_c"), **options)).select(*by, "_r.*")


def type_name(r: Column) -> Column:
    """A result as the text under which a keys table lists it."""
    size = F.concat(F.when(r["len"] > MAX_SHORT_STRING, "Long Varchar(").otherwise("Varchar("), r["len"].cast("string"), F.lit(")"))
    number = F.concat(F.lit("Numeric("), r["prec"].cast("string"), F.lit(","), r["scale"].cast("string"), F.lit(")"))
    plain = {"Int8": "Integer", "Float8": "Float", "Bool": "Boolean", "VMap": "Long Varbinary", "Interval": "Interval Day to Second"}
    out = F.when(r["type"] == "Varchar", size).when(r["type"] == "Numeric", number)
    for t, name in plain.items():
        out = out.when(r["type"] == t, name)
    return out.otherwise(r["type"])


_TYPE = re.compile(r"\s*([A-Za-z][A-Za-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*$")
#: Names that mean the same type.
_SAME = {"integer": "int8", "int": "int8", "bigint": "int8", "float": "float8", "double precision": "float8", "boolean": "bool", "interval day to second": "interval"}
_STRINGS = {"varchar", "char", "varbinary", "binary", "long varchar", "long varbinary"}
_KNOWN = {"int8", "float8", "bool", "date", "timestamp", "timestamptz", "time", "timetz", "interval", "numeric"} | _STRINGS
#: What parses to what without loss, besides itself and text.
_SAFE = {("date", "timestamp"), ("date", "timestamptz"), ("timestamp", "timestamptz"), ("time", "timetz"), ("int8", "numeric"), ("int8", "float8"), ("numeric", "float8")}
_SHOWN = {"int8": "Integer", "float8": "Float", "bool": "Boolean", "timestamptz": "TimestampTz", "timetz": "TimeTz"}


def _parsed(name: str) -> tuple[str, int, int]:
    m = _TYPE.match(name)
    base = m.group(1).lower() if m else ""
    base = _SAME.get(base, base)
    return (base if base in _KNOWN else "varchar"), int(m.group(2) or 0) if m else 0, int(m.group(3) or 0) if m else 0


def merged_type(old: str | None, old_freq: int | None, new: str | None, new_freq: int | None) -> str | None:
    """The type for the values behind both; a null side gives way to the other."""
    if old is None or new is None:
        return new if old is None else old
    if old == new:
        return old
    a, b = _parsed(old), _parsed(new)
    total = (old_freq or 0) + (new_freq or 0)
    for x, y, freq in ((a, b, new_freq or 0), (b, a, old_freq or 0)):
        if x[0] not in _STRINGS and (y[0] == x[0] or (y[0], x[0]) in _SAFE or (total and freq / total <= ERROR_SHARE)):
            if x[0] == "numeric":
                digits = max(x[1], y[1] if y[0] == "numeric" else 0, INT_PRECISION if y[0] == "int8" else 0)
                return f"Numeric({digits},{x[2]})"
            if x[0] == "interval":
                return "Interval Day to Second"
            return _SHOWN.get(x[0], x[0].capitalize())
    size = max(MIN_STRING, *(t[1] for t in (a, b) if t[0] in _STRINGS), 0)
    long = size > MAX_SHORT_STRING or any(t[0].startswith("long") for t in (a, b))
    binary = any(t[0] in ("varbinary", "long varbinary") for t in (a, b))
    return f"{'Long ' * long}{'Varbinary' if binary else 'Varchar'}({size})"


def pickbesttypemerge(old: Column, old_freq: Column, new: Column, new_freq: Column, new_errors: Column | None = None) -> Column:
    """:func:`merged_type` as a column; its input is one row for each key."""

    @F.arrow_udf("string")
    def merge(o: pa.Array, of: pa.Array, n: pa.Array, nf: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (o, of, n, nf)), strict=True)
        return pa.array([merged_type(*row) for row in rows], pa.string())

    return merge(old, old_freq, new, new_freq)


def merge_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two keys tables as one: frequencies add up, types are merged."""
    o = old.select("key_name", F.col("frequency").alias("of"), F.col("data_type_guess").alias("ot"))
    n = new.select("key_name", F.col("frequency").alias("nf"), F.col("data_type_guess").alias("nt"))
    both = o.join(n, "key_name", "full_outer")
    return both.select(
        "key_name",
        (F.coalesce("of", F.lit(0)) + F.coalesce("nf", F.lit(0))).alias("frequency"),
        pickbesttypemerge(F.col("ot"), F.col("of"), F.col("nt"), F.col("nf")).alias("data_type_guess"),
    )


#: How a time may be written.
_CLOCKS = ["H:mm:ss.SSSSSS", "H:mm:ss.SSS", "H:mm:ss", "H:mm", "h:mm:ss a", "h:mm a"]
_SPAN = r"(?i)\A(-?)([0-9]+) (day|hour|minute|second)s?(?: ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]{1,6})?))?)?\z"


def has_time_type() -> bool:
    """Whether the session reads times of day as such; otherwise they stay text."""
    spark = SparkSession.getActiveSession()
    return bool(spark) and spark.conf.get("spark.sql.timeType.enabled", "false") == "true"


def interval_of(v: Column) -> Column:
    """A text such as ``3 days 04:05:06`` as an interval of days to seconds; null for other text."""
    part = lambda i: F.regexp_extract(v, _SPAN, i)
    number = lambda i: F.coalesce(part(i).try_cast("decimal(18,6)"), F.lit(0))
    unit = F.lower(part(3))
    seconds = number(2) * F.when(unit == "day", 86400).when(unit == "hour", 3600).when(unit == "minute", 60).otherwise(1)
    seconds = (seconds + number(4) * 3600 + number(5) * 60 + number(6)) * F.when(part(1) == "-", -1).otherwise(1)
    return F.when(v.rlike(_SPAN), F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def cast_to(value: Column, guess: str) -> Column:
    """A text as a column of the guessed type; null where it does not parse, text cut to its length.

    A time with a zone stays text, for want of such a type, and so does a time where the
    session has no type for it.
    """
    base, size, scale = _parsed(guess)
    v = ascii_trim(value)
    if base == "int8":
        return v.try_cast(LongType())
    if base == "float8":
        return v.try_cast(DoubleType())
    if base == "bool":
        return v.try_cast(BooleanType())
    if base == "date":
        return v.try_cast(DateType())
    if base == "timestamp":
        return v.try_cast(TimestampNTZType())
    if base == "timestamptz":
        return v.try_cast(TimestampType())
    if base == "time" and has_time_type():
        return F.coalesce(*[F.try_to_time(v, F.lit(p)) for p in _CLOCKS])
    if base == "interval":
        return interval_of(v)
    if base == "numeric" and 0 < size <= 38:
        return F.replace(v, F.lit("$"), F.lit("")).try_cast(DecimalType(size, min(scale, size)))
    if base in ("varchar", "char") and size:
        return F.when(F.octet_length(value) <= size, value).otherwise(F.left(value, F.lit(size)))
    return value.cast(StringType())
