"""The map value and its scalar functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyloft.functions import sqlfuncs, text, vmap as V
from keyloft.operators import extract as X


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def vm(*pairs):
    return V.normalize_vmap(F.array(*[V.pair(F.lit(k), F.lit(v).cast("string")) for k, v in pairs]))


def test_order_duplicates_and_null_keys(spark):
    made = vm(("b", "1"), ("A", "2"), ("a", "3"), ("ab", None), ("Ä", "4"), (None, "5"))
    row = one(spark, made.alias("m"))["m"]
    assert [(p.key, p.value) for p in row] == [("A", "2"), ("a", "3"), ("ab", None), ("b", "1"), ("Ä", "4")]


def test_lookup(spark):
    m, none = vm(("Key", "v1"), ("key", "v2"), ("n", None)), F.lit(None).cast(V.VMAP)
    row = one(
        spark,
        V.maplookup(m, "KEY"), V.maplookup(m, "key", case_sensitive=True), V.maplookup(m, "x"), V.maplookup(m, "n"),
        V.maplookup(none, "k"), V.maplookup(m, F.lit(None).cast("string")), V.maplookup(m, "key", buffer_size=1), V.maplookup(m, "key", buffer_size=2),
    )
    assert list(row) == ["v1", "v2", None, None, None, None, None, "v1"]


def test_contains_size_version(spark):
    m, none = vm(("a", "x"), ("N", None)), F.lit(None).cast(V.VMAP)
    row = one(
        spark,
        V.mapcontainskey(m, "n"), V.mapcontainskey(m, "z"), V.mapcontainskey(none, "a"), V.mapcontainskey(m, F.lit(None).cast("string")),
        V.mapcontainsvalue(m, "x"), V.mapcontainsvalue(m, "X"), V.mapcontainsvalue(m, F.lit(None).cast("string")),
        V.mapsize(m), V.mapsize(none), V.mapsize(V.emptymap()), V.mapversion(m), V.mapversion(none),
    )
    assert list(row) == [True, False, None, False, True, False, False, 2, -1, 0, 1, -1]


def test_put(spark):
    m = vm(("a", "1"), ("B", "2"), ("e", ""))
    row = one(spark, V.mapput(m, ["b", "a"], F.lit(10), F.lit(None)).alias("m"), V.mapput(F.lit(None).cast(V.VMAP), ["a"], F.lit(1)).alias("n"))
    assert [(p.key, p.value) for p in row["m"]] == [("a", None), ("b", "10"), ("B", "2"), ("e", "")]
    assert row["n"] is None
    for bad in ([], ["a", "a"], ["a", None]):
        with pytest.raises(ValueError):
            V.setmapkeys(*bad)
    with pytest.raises(ValueError):
        V.mapput(m, ["a"], F.lit(1), F.lit(2))


def test_value_text(spark):
    row = one(spark, V.value_text(F.lit(True), "boolean"), V.value_text(F.lit(10.0), "double"), V.value_text(F.lit(0.1), "double"), V.value_text(F.lit(1e20), "double"), V.value_text(F.array(F.lit(1)), "array<int>"))
    assert row[0] == "t" and row[1] == "10" and row[2] == "0.1" and float(row[3]) == 1e20 and row[4] is None


def test_text_of_nested_and_duplicates():
    inner = V.nest([("y", None, False), ("x", 'q"', False)])
    pairs = V.sorted_pairs([("b", "1", False), ("b", "2", False), ("a", inner, True)])
    assert V.text_of(pairs) == '{\n   "a" : \n   {\n      "x" : "q\\"",\n      "y" : null\n   },\n   "b" : "1"\n}\n'
    assert V.text_of(pairs, canonical=False).count('"b"') == 2
    assert V.text_of([]) == "{}\n"


def test_helpers(spark):
    values = ["2020-01-02", "2020-01-02 10:00:00+02", "2020-01-02 10:00:00-05", "10:00 PM", "10:00 EST", "12", "a-1", "1-2-3-4"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(text.may_have_timezone(F.col("v"))).collect()]
    assert got == [False, True, True, False, True, False, True, True]
    row = one(spark, text.ascii_trim(F.lit("\t\x0b a b \n")), text.ascii_lower(F.lit("ÄB")), text.fits(F.lit("äb"), 2))
    assert list(row) == ["a b", "Äb", None]


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    spark.range(1).select(vm(("Key", "v")).alias("m")).createOrReplaceTempView("maps")
    row = spark.sql("SELECT maplookup(m, 'kEY'), mapcontainskey(m, 'x'), mapsize(m), mapversion(NULL), mapsize(emptymap()), maptostring(m) FROM maps").first()
    assert list(row) == ["v", False, 1, -1, 0, '{\n   "Key" : "v"\n}\n']
    plan = spark.sql("SELECT maplookup(m, 'k') FROM maps")._jdf.queryExecution().optimizedPlan().toString()
    assert "python" not in plan.lower()


def _model(value, prefix=None):
    """A slow flattening to hold the extractor against."""
    out = []
    for k, v in value:
        name = k if prefix is None else f"{prefix}.{k}"
        if isinstance(v, list) and v and v[0] == "object":
            out += _model(v[1], name)
        else:
            out.append((name, v))
    return out


def test_random_json_against_a_model(spark):
    rng = random.Random(5)

    def make(depth):
        rows = []
        for _ in range(rng.randint(0, 4)):
            key = rng.choice(["a", "B", "b", "", "é", "k k"])
            rows.append((key, ["object", make(depth - 1)] if depth and rng.random() < 0.4 else rng.choice(["x", "1.50", "1e3", "tRue"])))
        return rows

    def show(rows):
        def text_(v):
            return show(v[1]) if isinstance(v, list) else v if v[0].isdigit() else json.dumps(v)

        return "{" + ", ".join(f"{json.dumps(k)}: {text_(v)}" for k, v in rows) + "}"

    cases = [make(3) for _ in range(200)]
    df = spark.createDataFrame([(i, show(c)) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", X.mapjsonextractor(F.col("t")).alias("m")).orderBy("i").collect()
    for row, case in zip(got, cases, strict=True):
        want = V.sorted_pairs([(k, v, False) for k, v in _model(case)])
        assert [(p.key, p.value) for p in row["m"]] == [(k, v) for k, v, _ in want]
