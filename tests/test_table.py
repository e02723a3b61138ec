"""The golden script of three mountains, inference, table functions, streams."""

import json

from pyspark.sql import functions as F

from keyloft.functions import vmap as V
from keyloft.operators import aggregate, extract as X, inference, tablefuncs as T
from keyloft.operators.table import RAW, LooseTable
from keyloft.sources import load
from keyloft.streaming import stream


def mountains(spark):
    table = LooseTable.empty(spark, "mountains")
    table = table.insert(spark.createDataFrame([("Mt St Helens", "volcano", 15.4)], "name string, type string, hike_safety double"))
    text = '{ "name": "Everest", "type":"mountain", "height": 29029, "hike_safety": 34.1 }'
    table = table.append(load.load_json(spark, spark.createDataFrame([(text,)], "value string")).rows)
    lines = spark.createDataFrame([("name|type|height",), ("Matterhorn|mountain|4478",)], "value string").coalesce(1)
    return table.append(load.load_delimited(spark, lines).rows)


def test_mountains(spark):
    table = mountains(spark)
    rows = table.select("name", "type", "height", "hike_safety").collect()
    assert [tuple(r) for r in rows] == [("Mt St Helens", "volcano", None, "15.4"), ("Everest", "mountain", "29029", "34.1"), ("Matterhorn", "mountain", "4478", None)]
    shown = table.df.select(V.maptostring(F.col(RAW)).alias("s")).first()["s"]
    assert shown == '{\n   "hike_safety" : "15.4",\n   "name" : "Mt St Helens",\n   "type" : "volcano"\n}\n'
    assert [r[0] for r in table.df.select(V.mapcontainskey(F.col(RAW), "height")).collect()] == [False, True, True]
    assert [r["keys"] for r in T.mapkeys(table.df, RAW).collect()][:3] == ["hike_safety", "name", "type"]
    assert [r["values"] for r in T.mapvalues(table.df, RAW).collect()][-3:] == ["4478", "Matterhorn", "mountain"]
    keys = {tuple(r) for r in table.keys().collect()}
    assert keys == {("height", 2, "Integer"), ("hike_safety", 2, "Numeric(6,2)"), ("name", 3, "Varchar(24)"), ("type", 3, "Varchar(20)")}
    view = table.view()
    assert view.columns == ["name", "type", "height", "hike_safety"]
    assert [str(r["hike_safety"]) for r in view.collect()] == ["15.40", "34.10", "None"]
    assert spark.table("mountains_view").count() == 3
    real, told = table.materialize(2)
    assert [tuple(r) for r in told.collect()] == [("name", "ADDED", "Added successfully"), ("type", "ADDED", "Added successfully")]
    assert real.df.columns == [RAW, "name", "type"] and [r["name"] for r in real.select("NAME").toDF("name").collect()][1] == "Everest"
    assert real.materialize(2)[1].first()["status"] == "EXISTS"


def test_table_functions(spark):
    nested = X.mapjsonextractor(F.col("t"))
    df = spark.createDataFrame([(1, '{"b":"a  b","l":["x y",null]}'), (2, None), (3, '{"e":"","s":"  "}')], "i int, t string").coalesce(1).select("i", "t", nested.alias("m"))
    assert [(r["i"], r["token"]) for r in T.flextokenizer(df, "m", "i").collect()] == [(1, "a"), (1, "b"), (1, "x"), (1, "y"), (1, None), (3, None)]
    info = [(r["i"], r["keys"], r["length"], r["row_num"], r["field_num"]) for r in T.mapkeysinfo(df, "m", ["i"]).orderBy("i", "field_num").collect()]
    assert [x[:2] + x[3:] for x in info] == [(1, "b", 1, 0), (1, "l", 1, 1), (3, "e", 3, 0), (3, "s", 3, 1)]
    assert [r["values"] for r in T.mapvaluesorfield(df, "m", "t").collect()][2] is None
    items = T.mapitems(df, "m", "i", F.col("i") * 2)
    assert items.columns == ["keys", "values", "i", "col2"]
    assert [r["token"] for r in T.flextokenizer(df.filter("i = 1"), "m", tokenize_type="SPECIAL_CHARACTERS").collect()] == ["a", "b", "x", "y", None]
    try:
        T.flextokenizer(df, "m", tokenize_type="SPACES_AND_SPECIAL_CHARACTERS")
        raise AssertionError
    except ValueError:
        pass


def test_mapaggregate(spark):
    rows = [(1, "b", "2"), (1, "b", None), (1, "a", "1"), (1, None, "x"), (2, "", "y")]
    df = spark.createDataFrame(rows, "g int, k string, v string")
    got = {r["g"]: [(p.key, p.value) for p in r["raw_map"]] for r in aggregate.mapaggregate(df, "k", "v", "g").collect()}
    assert got == {1: [("a", "1"), ("b", None), ("b", "2")], 2: []}


def kind(spark, *values, **options):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return inference.pickbesttype(df, "v", **options).first()


def test_inference(spark):
    assert kind(spark, "1", "22")["type"] == "Int8"
    numeric = kind(spark, "15.4", "34.1", "7")
    assert (numeric["type"], numeric["prec"], numeric["scale"], numeric["errcnt"]) == ("Numeric", 6, 2, 0)
    assert kind(spark, "$5")["type"] == "Numeric"
    assert kind(spark, None, " ")["type"] == "Varchar"
    assert kind(spark, "x" * 60)["type"] == "Varchar"
    assert kind(spark, "2020-01-02", "2020-01-02 10:00:00")["type"] == "Timestamp"
    assert kind(spark, "2020-01-02 10:00:00+02")["type"] == "TimestampTz"
    assert kind(spark, "10:00", "10:00:00+02")["type"] == "TimeTz"
    assert kind(spark, "true", "f")["type"] == "Bool"
    assert kind(spark, "1", "2", "x")["errcnt"] == 1
    assert kind(spark, "1", "2", "x", enforce_error_threshold=True)["type"] == "Varchar"


def test_merge():
    m = inference.merged_type
    assert m("Integer", 1000, "Varchar(20)", 20) == "Integer"
    assert m("Date", 1000, "Boolean", 700) == "Varchar(20)"
    assert m("Integer", 1, "Numeric(10,4)", 1) == "Numeric(18,4)"
    assert m("Time", 1, "TimeTz", 1) == "TimeTz"
    assert m(None, None, "Float", 1) == "Float"
    assert m("Varbinary(10)", 1, "Varchar(30)", 1) == "Varbinary(30)"
    assert m("Nonsense", 1, "Varchar(30)", 1) == "Varchar(30)"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [json.dumps({"at": f"2024-01-01 00:0{i}:00", "k": "ab"[i % 2]}) for i in range(6)]
    (tmp_path / "in" / "x.json").write_text("\n".join(rows))
    source = stream.read_records(spark, str(tmp_path / "in"))
    made = stream.parsed(source, X.mapjsonextractor)
    counts = stream.windowed_counts(made, V.maplookup(F.col(RAW), "AT").try_cast("timestamp"), V.maplookup(F.col(RAW), "k"), width="10 minutes", late="1 minute")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["key"], r["n"]) for r in spark.table("counted").collect()) == [("a", 3), ("b", 3)]
