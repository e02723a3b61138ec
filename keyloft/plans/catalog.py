"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

import atexit
import io
import json
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sqlfuncs, text, vmap as V
from ..operators import aggregate, extract as X, inference, tablefuncs as T
from ..operators.table import RAW, LooseTable
from ..sources import avro, load

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _REGISTRY[f.__name__.removeprefix("q_")] = (f, sql)
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share; one of this machine in a local session that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="keyloft-files-")
        atexit.register(shutil.rmtree, named, True)
    return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame, terminator: str = "\n", then: str | None = None) -> str:
    """Text files of the records, each followed by the terminator, and ``then`` as the last one of each file."""
    if then is not None:

        def more(batches):
            yield from batches
            yield pa.RecordBatch.from_arrays([pa.array([then])], ["value"])

        lines = lines.toDF("value").mapInArrow(more, "value string")
    at = _folder(spark)
    lines.write.option("lineSep", terminator).text(at)
    return at


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn(RAW, X.mapjsonextractor(F.col("props")))


def _supplier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = V.vmap_of_present(
        S_NAME=F.col("s_name"), nation=F.col("s_nationkey"), odd=F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey"))
    )
    return _table(spark, sf_dir, "supplier").withColumn(RAW, made)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse JSON, look a key up in any case, aggregate."""
    k = V.maplookup(F.col(RAW), "K").try_cast("bigint")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@_query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top FROM events GROUP BY 1")
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query("SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def q_maplookup(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", V.maplookup(F.col(RAW), "K").alias("v"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")
def q_maplookup_fast(spark, sf_dir):
    made = X.fast_json_vmap(F.col("props"))
    return _table(spark, sf_dir, "events").select("event_id", V.maplookup(made, "K").alias("v"))


@_query("SELECT event_id, CAST(NULL AS VARCHAR) AS upper_key, json_extract_string(props, '$.k') AS lower_key, CASE WHEN length(json_extract_string(props, '$.k')) <= 1 THEN json_extract_string(props, '$.k') END AS short FROM events")
def q_maplookup_options(spark, sf_dir):
    vm = F.col(RAW)
    return _events(spark, sf_dir).select(
        "event_id",
        V.maplookup(vm, "K", case_sensitive=True).alias("upper_key"),
        V.maplookup(vm, "k", case_sensitive=True).alias("lower_key"),
        V.maplookup(vm, "k", buffer_size=1).alias("short"),
    )


@_query("SELECT s_suppkey, true AS has_name, s_suppkey % 2 = 1 AS has_odd, CAST(s_nationkey AS VARCHAR) = '3' OR (s_suppkey % 2 = 1 AND s_suppkey = 3) AS has_three FROM supplier")
def q_mapcontains(spark, sf_dir):
    vm = F.col(RAW)
    return _supplier_map(spark, sf_dir).select(
        "s_suppkey",
        V.mapcontainskey(vm, "s_name").alias("has_name"),
        V.mapcontainskey(vm, "ODD").alias("has_odd"),
        V.mapcontainsvalue(vm, "3").alias("has_three"),
    )


@_query("SELECT s_suppkey, CAST(2 + s_suppkey % 2 AS BIGINT) AS size, CAST(1 AS BIGINT) AS version, CAST(-1 AS BIGINT) AS no_size, CAST(-1 AS BIGINT) AS no_version, CAST(0 AS BIGINT) AS empty_size FROM supplier")
def q_mapsize_mapversion_emptymap(spark, sf_dir):
    vm, none = F.col(RAW), F.lit(None).cast(V.VMAP)
    return _supplier_map(spark, sf_dir).select(
        "s_suppkey",
        V.mapsize(vm).alias("size"),
        V.mapversion(vm).alias("version"),
        V.mapsize(none).alias("no_size"),
        V.mapversion(none).alias("no_version"),
        V.mapsize(V.emptymap()).alias("empty_size"),
    )


_ITEMS = """SELECT s_suppkey, 'nation' AS keys, CAST(s_nationkey AS VARCHAR) AS values FROM supplier
UNION ALL SELECT s_suppkey, 'odd', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_suppkey, 'S_NAME', s_name FROM supplier"""


@_query(f"SELECT s_suppkey, keys FROM ({_ITEMS})")
def q_mapkeys(spark, sf_dir):
    return T.mapkeys(_supplier_map(spark, sf_dir), RAW, "s_suppkey")


@_query(f"SELECT s_suppkey, values FROM ({_ITEMS})")
def q_mapvalues(spark, sf_dir):
    return T.mapvalues(_supplier_map(spark, sf_dir), RAW, "s_suppkey")


@_query(_ITEMS)
def q_mapitems(spark, sf_dir):
    return T.mapitems(_supplier_map(spark, sf_dir), RAW, "s_suppkey")


@_query(f"""SELECT i.s_suppkey, s_nationkey, keys, CAST(octet_length(encode(values)) AS BIGINT) AS length, 'long varbinary' AS type_oid,
row_num, row_number() OVER (PARTITION BY i.s_suppkey ORDER BY lower(keys)) - 1 AS field_num
FROM ({_ITEMS}) i JOIN (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row_num FROM supplier) r USING (s_suppkey)""")
def q_mapkeysinfo(spark, sf_dir):
    return T.mapkeysinfo(_supplier_map(spark, sf_dir), RAW, ["s_suppkey"], ["s_nationkey"])


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS values FROM events")
def q_mapvaluesorfield(spark, sf_dir):
    df = _events(spark, sf_dir).withColumn(RAW, F.when(F.col("event_id") % 3 != 0, F.col(RAW)))
    return T.mapvaluesorfield(df, RAW, "event_type", "event_id")


@_query("""SELECT event_id, 'k' AS keys, json_extract_string(props, '$.k') AS values FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 'k', 'c' FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'k2', event_type FROM events""")
def q_mapput(spark, sf_dir):
    put = V.mapput(F.col(RAW), ["k", "k2"], F.when(F.col("event_type") == "click", "c").otherwise(V.maplookup(F.col(RAW), "k")), F.col("event_type"))
    return T.mapitems(_events(spark, sf_dir).withColumn(RAW, put), RAW, "event_id")


@_query("SELECT s_suppkey, concat('{\"nation\":\"', s_nationkey, '\"', CASE WHEN s_suppkey % 2 = 1 THEN concat(',\"odd\":\"', s_suppkey, '\"') ELSE '' END, ',\"S_NAME\":\"', s_name, '\"}') AS j FROM supplier")
def q_maptojson(spark, sf_dir):
    return _supplier_map(spark, sf_dir).select("s_suppkey", V.maptojson(F.col(RAW)).alias("j"))


@_query("SELECT event_id, concat('{', chr(10), '   \"k\" : \"', json_extract_string(props, '$.k'), '\"', chr(10), '}', chr(10)) AS canonical, concat('{', chr(10), chr(9), '\"k\":', chr(9), '\"', json_extract_string(props, '$.k'), '\"', chr(10), ' }') AS plain FROM events")
def q_maptostring(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id", V.maptostring(F.col(RAW)).alias("canonical"), V.maptostring(F.col(RAW), canonical_json=False).alias("plain")
    )


@_query("SELECT c_nationkey, c_name AS keys, c_mktsegment AS values FROM customer")
def q_mapaggregate(spark, sf_dir):
    made = aggregate.mapaggregate(_table(spark, sf_dir, "customer"), "c_name", "c_mktsegment", "c_nationkey")
    return T.mapitems(made, "raw_map", "c_nationkey")


def _part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.concat(F.lit(" "), "p_name"), "p_brand", F.lit(""), "p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@_query("SELECT p_partkey, trim(p_name) AS name, p_brand AS brand, CAST(NULL AS VARCHAR) AS none, CAST(p_size AS VARCHAR) AS extra, CAST(4 AS BIGINT) AS n, 'ucol0,ucol1,ucol2,ucol3' AS generic FROM part")
def q_mapdelimitedextractor(spark, sf_dir):
    made = X.mapdelimitedextractor(F.col("line"), header_names="name|brand|none")
    bare = X.mapdelimitedextractor(F.col("line"))
    return _part_text(spark, sf_dir).select(
        "p_partkey",
        V.maplookup(made, "name").alias("name"),
        V.maplookup(made, "BRAND").alias("brand"),
        V.maplookup(made, "none").alias("none"),
        V.maplookup(made, "ucol3").alias("extra"),
        V.mapsize(made).alias("n"),
        F.array_join(F.transform(bare, lambda p: p["key"]), ",").alias("generic"),
    )


@_query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 2) AS host FROM pages")
def q_mapregexextractor(spark, sf_dir):
    made = X.mapregexextractor(F.col("url"), pattern=r"^(?P<url_scheme>[a-z]+)://(?<host>[^/?#]+)")
    return _table(spark, sf_dir, "pages").select(
        "page_id", V.maplookup(made, "url_scheme").alias("scheme"), V.maplookup(made, "host").alias("host")
    )


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("o_custkey").alias("b"), F.array(F.struct(F.col("o_orderstatus").alias("s")), F.struct(F.col("o_orderpriority").alias("s"))).alias("l"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(inner.alias("a"))).alias("j"))


@_query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS b, concat('[[\"0.s\",\"', o_orderstatus, '\",0],[\"1.s\",\"', o_orderpriority, '\",0]]') AS nested FROM orders")
def q_json_flatten_maps(spark, sf_dir):
    made = X.mapjsonextractor(F.col("j"))
    return _nested(spark, sf_dir).select("o_orderkey", V.maplookup(made, "a.b").alias("b"), V.maplookup(made, "a.l").alias("nested"))


@_query("""SELECT o_orderkey, 'a_b' AS keys, CAST(o_custkey AS VARCHAR) AS values FROM orders UNION ALL SELECT o_orderkey, 'a_l_0_s', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 'a_l_1_s', o_orderpriority FROM orders""")
def q_json_flatten_arrays(spark, sf_dir):
    made = X.mapjsonextractor(F.col("j"), flatten_arrays=True, key_separator="_")
    return T.mapitems(_nested(spark, sf_dir).withColumn(RAW, made), RAW, "o_orderkey")


@_query("SELECT o_orderkey, CAST(1 AS BIGINT) AS n FROM orders")
def q_json_nested_maps(spark, sf_dir):
    made = X.mapjsonextractor(F.col("j"), flatten_maps=False)
    return _nested(spark, sf_dir).select("o_orderkey", V.mapsize(made).alias("n"))


@_query("SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) AS kept, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS refused, count(*) AS all_kept, sum(CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 1 END)::BIGINT AS pairs FROM orders")
def q_json_reject_on_duplicate(spark, sf_dir):
    doubled = F.when(F.col("o_orderkey") % 2 == 1, F.format_string('{"A": %d, "a": 2}', "o_orderkey")).otherwise(F.format_string('{"A": %d}', "o_orderkey"))
    df = _table(spark, sf_dir, "orders").select(doubled.alias("value"))
    strict = load.load_json(spark, df, record_terminator="\n", reject_on_duplicate=True)
    loose = load.load_json(spark, df, record_terminator="\n").rows
    parts = [strict.rows.select(F.lit("kept").alias("k")), strict.rejects.select(F.lit("refused").alias("k"))]
    parts = [p.withColumn("n", F.lit(1).cast("long")) for p in parts] + [loose.select(F.lit("loose").alias("k"), V.mapsize(F.col(RAW)).alias("n"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = [F.count_if(F.col("k") == k).alias(name) for k, name in (("kept", "kept"), ("refused", "refused"), ("loose", "all_kept"))]
    return every.agg(*counts, F.sum(F.when(F.col("k") == "loose", F.col("n"))).alias("pairs"))


@_query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def q_json_start_point(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name"))), ",").alias("l")
    )
    df = rows.select(F.concat(F.lit('{"meta": {"rows": 5}, "data": {"rows": ['), "l", F.lit("]}, /* end */ \"x\": 1}")).alias("value"))
    loaded = load.load_json(spark, df, {"n_nationkey": "int", "n_name": "string"}, start_point="rows")
    return loaded.rows.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@_query("SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS kept, count(*) FILTER (WHERE event_id % 10 = 0) AS refused FROM events")
def q_json_bad_records(spark, sf_dir):
    text_ = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{bad "), "props")).otherwise(F.col("props"))
    loaded = load.load_json(spark, _table(spark, sf_dir, "events").select(text_.alias("value")), record_terminator="\n")
    both = loaded.rows.select(F.lit(1).alias("ok")).unionByName(loaded.rejects.select(F.lit(0).alias("ok")))
    return both.agg(F.count_if(F.col("ok") == 1).alias("kept"), F.count_if(F.col("ok") == 0).alias("refused"))


@_query("SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_load_json(spark, sf_dir):
    line = F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "inner": '), "props", F.lit("}"))
    df = _table(spark, sf_dir, "events").select(line.alias("value"))
    loaded = load.load_json(spark, df, {"event_id": "bigint", "inner.k": "bigint"}, record_terminator="\n")
    return loaded.rows.select("event_id", F.col("`inner.k`").alias("k"))


@_query("SELECT p_partkey, p_name AS name, p_size AS size, 'x' AS extra FROM part")
def q_load_delimited(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    line = F.concat_ws("|", F.concat(F.lit(" "), "p_partkey", F.lit(" ")), "p_name", "p_size", F.lit("x")).alias("value")
    loaded = load.load_delimited(
        spark, part.select(line), {"p_partkey": "bigint", "name": "string", "size": "int"}, header=["p_partkey", "Name", "size"]
    )
    return loaded.rows.select("p_partkey", "name", "size", V.maplookup(F.col(RAW), "UCOL3").alias("extra"))


@_query("SELECT p_partkey AS id, concat(p_name, ', ', chr(34), p_brand, chr(34), chr(10), 'end') AS name FROM part")
def q_load_csv_rfc4180(spark, sf_dir):
    cell = F.concat(F.lit('"'), "p_name", F.lit(', ""'), "p_brand", F.lit('""\nend"'))
    df = _table(spark, sf_dir, "part").select(F.concat(F.lit("id,name\n"), "p_partkey", F.lit(","), cell, F.lit("\n")).alias("value"))
    return load.load_csv(spark, df, {"id": "bigint", "name": "string"}).rows.select("id", "name")


@_query("SELECT p_partkey AS id, concat(p_name, ';', p_brand) AS name, CAST(NULL AS VARCHAR) AS gone FROM part")
def q_load_csv_traditional(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select(F.concat(F.lit("id;name;gone\n"), "p_partkey", F.lit(";"), "p_name", F.lit("\\;"), "p_brand", F.lit(";NIL")).alias("value"))
    return load.load_csv(spark, df, {"id": "bigint", "name": "string", "gone": "string"}, type="traditional", delimiter=";", null="NIL").rows.select("id", "name", "gone")


@_query("SELECT p_partkey, p_name AS p_name, CAST(p_size AS VARCHAR) AS size, concat(p_brand, '=x') AS brand, CAST(4 AS BIGINT) AS n FROM part")
def q_load_pairs(spark, sf_dir):
    line = F.concat(F.lit("Key="), "p_partkey", F.lit(", P_NAME = "), "p_name", F.lit(",junk,p_size="), "p_size", F.lit(",brand="), "p_brand", F.lit("=x"))
    rows = load.load_pairs(spark, _table(spark, sf_dir, "part").select(line.alias("value")), {"key": "bigint"}).rows
    vm = F.col(RAW)
    return rows.select(
        F.col("key").alias("p_partkey"), V.maplookup(vm, "p_name").alias("p_name"), V.maplookup(vm, "p_size").alias("size"), V.maplookup(vm, "brand").alias("brand"), V.mapsize(vm).alias("n")
    )


@_query("SELECT s_suppkey AS id, '0' AS version, concat(s_name, '|x') AS name, '5' AS severity, concat('hello ', s_name) AS msg, 'a=b' AS eq FROM supplier")
def q_load_cef(spark, sf_dir):
    line = F.concat(F.lit("CEF:0|V|P|1|sig|"), "s_name", F.lit("\\|x|5|id="), "s_suppkey", F.lit(" MSG=hello "), "s_name", F.lit(" eq=a\\=b"))
    rows = load.load_cef(spark, _table(spark, sf_dir, "supplier").select(line.alias("value")), {"id": "bigint"}).rows
    vm = F.col(RAW)
    return rows.select("id", *[V.maplookup(vm, k).alias(k) for k in ("version", "name", "severity", "msg", "eq")])


@_query("SELECT CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number, regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS lang, url FROM pages WHERE regexp_matches(url, '/[a-z]+/[0-9]+')")
def q_load_regex(spark, sf_dir):
    df = _table(spark, sf_dir, "pages").select(F.col("url").alias("value"))
    rows = load.load_regex(
        spark, df, {"number": "bigint", "lang": "string", "url": "string"}, pattern=r"/(?<lang>[a-z]+)/(?<number>[0-9]+)", loglinecolumn="url"
    ).rows
    return rows.select("number", "lang", "url")


@_query("SELECT c_custkey AS id, c_mktsegment AS field, concat(c_name, chr(10), 'second line') AS content FROM customer")
def q_load_idx(spark, sf_dir):
    doc = F.concat(F.lit("\n#DREREFERENCE "), "c_custkey", F.lit('\n#DRETYPE x\n#DREFIELD Seg="'), "c_mktsegment", F.lit('"\n#DRECONTENT\n'), "c_name", F.lit("\nsecond line\n"))
    rows = load.load_idx(spark, _table(spark, sf_dir, "customer").select(doc.alias("value")), {"drereference": "bigint"}).rows
    vm = F.col(RAW)
    return rows.select(F.col("drereference").alias("id"), V.maplookup(vm, "SEG").alias("field"), V.maplookup(vm, "drecontent").alias("content"))


@_query("SELECT n_nationkey AS k, concat(n_name, ':x') AS name FROM nation")
def q_load_dc(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select(F.concat(F.lit("key:"), "n_nationkey", F.lit("\nname:"), "n_name", F.lit(":x\n")).alias("value"))
    rows = load.load_dc(spark, df, {"key": "int"}).rows
    return rows.select(F.col("key").alias("k"), V.maplookup(F.col(RAW), "name").alias("name"))


def _avro_long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _avro_text(s: str) -> bytes:
    raw = s.encode()
    return _avro_long(len(raw)) + raw


def _avro_file(rows: list[dict], names: list[str], kinds: list[str]) -> bytes:
    """A small container with one record type and one block, as a source for the loader."""
    long, text_ = _avro_long, _avro_text
    schema = {"type": "record", "name": "Row", "fields": [{"name": n, "type": k} for n, k in zip(names, kinds, strict=True)]}
    body = io.BytesIO()
    for row in rows:
        for n, k in zip(names, kinds, strict=True):
            body.write(long(row[n]) if k == "long" else struct.pack("<d", row[n]) if k == "double" else text_(row[n]))
    block, sync = body.getvalue(), b"keyloft-sync-16b"
    meta = {"avro.schema": json.dumps(schema), "avro.codec": "null"}
    head = b"Obj\x01" + long(len(meta)) + b"".join(text_(k) + text_(v) for k, v in meta.items()) + long(0) + sync
    return head + long(len(rows)) + long(len(block)) + block + sync


@_query("SELECT s_suppkey AS id, s_name AS name, 'Row' AS kind FROM supplier")
def q_load_avro(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    def files(batches):
        for batch in batches:
            made = [_avro_file(batch.to_pylist(), ["s_suppkey", "s_name"], ["long", "string"])] if len(batch) else []
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["content"])

    rows = load.load_avro(spark, df.mapInArrow(files, "content binary"), {"s_suppkey": "bigint", "s_name": "string"}).rows
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), V.maplookup(F.col(RAW), "__name__").alias("kind"))


@_query("SELECT doc_id, count(*) AS n, count(DISTINCT token) AS kinds FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY doc_id")
def q_flextokenizer(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", V.vmap_of(text=F.col("text")).alias(RAW))
    made = T.flextokenizer(df, RAW, "doc_id")
    return made.filter("token IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("token").alias("kinds"))


@_query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS token FROM documents) WHERE token <> '' GROUP BY doc_id")
def q_flextokenizer_letters(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", V.vmap_of(text=F.col("text")).alias(RAW))
    return T.flextokenizer(df, RAW, "doc_id", tokenize_type="SPECIAL_CHARACTERS").groupBy("doc_id").agg(F.count("*").alias("n"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several kinds from orders and lineitem columns."""
    o = _table(spark, sf_dir, "orders")
    stamp = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss")
    return o.select(
        F.posexplode(
            F.array(
                F.col("o_orderkey").cast("string"),
                F.format_string("%.2f", F.col("o_totalprice")),
                F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("f"),
                F.date_format("o_orderdate", "yyyy-MM-dd"),
                stamp,
                F.concat(stamp, F.lit("+02")),
                F.lit("12:30:00"),
                F.col("o_orderpriority"),
                F.when(F.col("o_orderkey") % 4 == 0, F.lit("1.5")).otherwise(F.col("o_orderkey").cast("string")),
                F.lit(None).cast("string"),
                F.lit("1e10"),
                F.lit("3 days"),
            )
        ).alias("kind", "v")
    )


_CLASSED = r"""
WITH o AS (SELECT *, strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS s FROM orders), v AS (
  SELECT unnest(range(12)) AS kind, unnest([CAST(o_orderkey AS VARCHAR), format('{:.2f}', o_totalprice), CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'f' END,
    strftime(o_orderdate, '%Y-%m-%d'), s, s || '+02', '12:30:00', o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN '1.5' ELSE CAST(o_orderkey AS VARCHAR) END,
    NULL, '1e10', '3 days']) AS v FROM o
), c AS (
  SELECT kind, CASE WHEN v IS NULL THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]{1,19}') THEN 'Int8' WHEN v IN ('t', 'f', 'true', 'false', 'y', 'n', 'yes', 'no') THEN 'Bool'
    WHEN regexp_full_match(v, '[+-]?[0-9]*\.?[0-9]*') THEN 'Numeric' WHEN NOT regexp_matches(v, '[:dDfF ]') AND try_cast(v AS DOUBLE) IS NOT NULL THEN 'Float8'
    WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'Date' WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}') THEN 'Timestamp'
    WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}[+][0-9]{2}') THEN 'TimestampTz' WHEN regexp_full_match(v, '[0-9]{1,2}:[0-9]{2}:[0-9]{2}') THEN 'Time'
    WHEN regexp_full_match(v, '[0-9]+ days?') THEN 'Interval' ELSE 'Varchar' END AS t, count(*) AS n FROM v GROUP BY ALL
), w AS (
  SELECT kind, t, n + coalesce(CASE WHEN t = 'Numeric' THEN (SELECT sum(n) FROM c d WHERE d.kind = c.kind AND d.t = 'Int8') END, 0) AS m FROM c WHERE t IS NOT NULL
), r AS (SELECT kind, sum(n) AS rows, sum(n) FILTER (WHERE t IS NOT NULL) AS valued FROM c GROUP BY 1)
SELECT CAST(r.kind AS INTEGER) AS kind, coalesce(arg_max(t, m), 'Varchar') AS type, CAST(any_value(rows) AS BIGINT) AS rowcnt,
  CAST(CASE WHEN coalesce(arg_max(t, m), 'Varchar') = 'Varchar' THEN 0 ELSE any_value(valued) - max(m) END AS BIGINT) AS errcnt
FROM r LEFT JOIN w ON r.kind = w.kind GROUP BY 1"""


@_query(_CLASSED)
def q_pickbesttype(spark, sf_dir):
    return inference.pickbesttype(_typed(spark, sf_dir), "v", "kind").select("kind", "type", "rowcnt", "errcnt")


@_query("SELECT CASE WHEN count(*) FILTER (WHERE o_orderkey % 3 = 0) > 10 THEN 'Varchar' ELSE 'Int8' END AS few, CASE WHEN 3 * count(*) FILTER (WHERE o_orderkey % 3 <> 0) < 2.4 * count(*) THEN 'Varchar' ELSE 'Int8' END AS share FROM orders")
def q_pickbesttype_thresholds(spark, sf_dir):
    text_ = F.when(F.col("o_orderkey") % 3 == 0, F.lit("none")).otherwise(F.col("o_orderkey").cast("string"))
    df = _table(spark, sf_dir, "orders").select(text_.alias("v"))
    few = inference.pickbesttype(df, "v", error_max=10).select(F.lit("few").alias("k"), "type")
    share = inference.pickbesttype(df, "v", enforce_error_threshold=True).select(F.lit("share").alias("k"), "type")
    both = few.unionByName(share)
    return both.agg(*[F.max(F.when(F.col("k") == k, F.col("type"))).alias(k) for k in ("few", "share")])


_MERGES = [("Integer", "Varchar(20)", 1000, 20, "Integer"), ("Date", "Boolean", 1000, 700, "Varchar(20)"), ("Integer", "Numeric(10,4)", 10, 10, "Numeric(18,4)"), ("Date", "Timestamp", 5, 5, "Timestamp"), (None, "Float", 0, 3, "Float"), ("Varchar(30)", "Varchar(70000)", 1, 1, "Long Varchar(70000)")]


@_query(
    "SELECT o_orderkey, old, new, f1 AS f1, f2, merged FROM orders JOIN (VALUES "
    + ", ".join(f"({i}, {'NULL' if o is None else repr(o)}, {n!r}, {f}, {g}, {m!r})" for i, (o, n, f, g, m) in enumerate(_MERGES))
    + ") m(i, old, new, f1, f2, merged) ON o_orderkey % 6 = i"
)
def q_pickbesttypemerge(spark, sf_dir):
    pick = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in _MERGES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", *[pick(i).alias(c) for i, c in enumerate(("old", "new", "f1", "f2"))])
    return df.withColumn("merged", inference.pickbesttypemerge(*[F.col(c) for c in ("old", "f1", "new", "f2")]))


def _parts(spark: SparkSession, sf_dir: str) -> LooseTable:
    p = _table(spark, sf_dir, "part")
    made = V.vmap_of_present(
        name=F.col("p_name"), size=F.col("p_size"), price=F.format_string("%.2f", "p_retailprice"), big=F.when(F.col("p_size") > 25, F.col("p_brand"))
    )
    return LooseTable(p.select(made.alias(RAW)), "parts")


@_query("""SELECT 'name' AS key_name, count(*) AS frequency, concat('Varchar(', greatest(20, 2 * max(octet_length(encode(p_name)))), ')') AS data_type_guess FROM part
UNION ALL SELECT 'size', count(*), 'Integer' FROM part
UNION ALL SELECT 'price', count(*), concat('Numeric(', max(length(CAST(CAST(trunc(p_retailprice) AS BIGINT) AS VARCHAR))) + 5, ',3)') FROM part
UNION ALL SELECT 'big', count(*), concat('Varchar(', greatest(20, 2 * max(length(p_brand))), ')') FROM part WHERE p_size > 25""")
def q_compute_keys(spark, sf_dir):
    return _parts(spark, sf_dir).keys()


@_query("SELECT p_name AS name, CAST(p_size AS BIGINT) AS size, CASE WHEN p_size > 25 THEN p_brand END AS big FROM part")
def q_build_view(spark, sf_dir):
    return _parts(spark, sf_dir).view().select("name", "size", "big")


@_query("SELECT 'name' AS key_name, 'ADDED' AS status, 'Added successfully' AS message UNION ALL SELECT 'price', 'ADDED', 'Added successfully'")
def q_materialize_status(spark, sf_dir):
    return _parts(spark, sf_dir).materialize(2)[1]


@_query("SELECT p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS unknown FROM part WHERE p_size > 10")
def q_materialized_select(spark, sf_dir):
    table = _parts(spark, sf_dir).materialize(2)[0]
    return table.where(table.col("size").try_cast("int") > 10).select("name", "size", "unknown")


@_query("SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_name, CAST(c_nationkey AS VARCHAR), NULL FROM customer")
def q_insert(spark, sf_dir):
    table = LooseTable.empty(spark)
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return table.insert(suppliers).insert(customers).select("name", "nation", "kind")


@_query("""WITH o AS (SELECT n_name AS k, count(*) AS n FROM nation GROUP BY 1)
SELECT k AS key_name, n + CASE WHEN n_nationkey < 10 THEN 1 ELSE 0 END AS frequency, 'Varchar(20)' AS data_type_guess FROM o JOIN nation ON k = n_name""")
def q_merge_keys(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")

    def keys(df):
        made = V.normalize_vmap(F.array(V.pair(F.col("n_name"), F.lit("x"))))
        return LooseTable(df.select(made.alias(RAW))).keys()

    return inference.merge_keys(keys(nation), keys(nation.filter("n_nationkey < 10")))


@_query("SELECT s_suppkey, s_name AS v, true AS has, CAST(2 + s_suppkey % 2 AS BIGINT) AS n, CAST(1 AS BIGINT) AS ver, false AS valued, CAST(0 AS BIGINT) AS none FROM supplier")
def q_sql_functions(spark, sf_dir):
    sqlfuncs.register(spark)
    _supplier_map(spark, sf_dir).createOrReplaceTempView("_loose_supplier")
    return spark.sql(f"""SELECT s_suppkey, maplookup({RAW}, 's_NAME') AS v, mapcontainskey({RAW}, 'NATION') AS has, mapsize({RAW}) AS n,
        mapversion({RAW}) AS ver, mapcontainsvalue({RAW}, 'nothing') AS valued, mapsize(emptymap()) AS none FROM _loose_supplier""")


@_query("SELECT n_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n DESC, n_nationkey LIMIT 10")
def q_loose_join_topk(spark, sf_dir):
    """Host operations on looked-up keys: filter, join, aggregation, top-k."""
    c = _table(spark, sf_dir, "customer").select(V.vmap_of(nation=F.col("c_nationkey"), seg=F.col("c_mktsegment"), bal=F.col("c_acctbal")).alias(RAW))
    table = LooseTable(c)
    rows = table.where(table.col("bal").try_cast("double") > 0).select("nation", "seg")
    joined = rows.join(_table(spark, sf_dir, "nation"), F.col("nation").try_cast("int") == F.col("n_nationkey"))
    return joined.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.countDistinct("seg").alias("segments")).orderBy(F.desc("n"), "n_nationkey").limit(10)


@_query("SELECT o_orderkey, o_orderpriority AS trimmed, lower(o_orderpriority) AS low, CASE WHEN octet_length(encode(o_orderpriority)) <= 6 THEN o_orderpriority END AS short FROM orders")
def q_text_helpers(spark, sf_dir):
    padded = F.concat(F.lit("\t \n"), "o_orderpriority", F.lit("\x0b\f\r "))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", text.ascii_trim(padded).alias("trimmed"), text.ascii_lower(F.col("o_orderpriority")).alias("low"), text.fits(F.col("o_orderpriority"), 6).alias("short")
    )


@_query("SELECT CAST(count(*) FILTER (WHERE event_id % 4 > 1) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE event_id % 4 = 1) AS BIGINT) AS refused, CAST(count(*) FILTER (WHERE event_id % 4 = 0) AS BIGINT) AS halves, CAST(sum(CASE WHEN event_id % 4 > 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS total FROM events")
def q_load_json_files(spark, sf_dir):
    """Files of records: nested beyond any depth, with half a surrogate pair, with columns called as the loader's own."""
    k = F.col("event_id") % 4
    line = F.when(k == 1, F.repeat(F.lit("["), 3000)).when(k == 0, F.lit('{"half": "\\ud800"}')).otherwise(F.concat(F.lit('{"reason": "r", "value": "v", "vmap": "m", "in": '), "props", F.lit("}")))
    at = _written(spark, _table(spark, sf_dir, "events").select(line))
    columns = {"reason": "string", "value": "string", "vmap": "string", "in.k": "bigint", "half": "string"}
    loaded = load.load_json(spark, at, columns, record_terminator="\n")
    named = (F.col("reason") == "r") & (F.col("value") == "v") & (F.col("vmap") == "m")
    rows = loaded.rows.select(F.when(named, 1).when(F.col("half") == "\ufffd", 2).alias("k"), F.col("`in.k`").alias("v"))
    both = rows.unionByName(loaded.rejects.select(F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("v")))
    return both.agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("refused"), F.count_if(F.col("k") == 2).alias("halves"), F.sum("v").alias("total"))


@_query("SELECT p_partkey AS key, p_name AS name, p_size AS size FROM part")
def q_load_delimited_files(spark, sf_dir):
    """Files with headers of their own, in different orders."""
    part, at = _table(spark, sf_dir, "part").repartition(3, "p_partkey"), _folder(spark)
    named = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    for odd, order in ((0, ["key", "name", "size"]), (1, ["size", "key", "name"])):
        named.filter(F.col("key") % 2 == odd).select(order).write.mode("append").option("header", True).option("sep", "|").csv(at)
    return load.load_delimited(spark, at, {"key": "bigint", "name": "string", "size": "int"}).rows.select("key", "name", "size")


@_query("SELECT p_partkey AS id, p_name || ' \"' || p_brand || '\"' || chr(10) || 'end' AS name, CAST(CASE WHEN p_partkey % 50 = 0 THEN 140000 ELSE 1 END AS INTEGER) AS n FROM part")
def q_load_csv_files(spark, sf_dir):
    """Quoted line breaks and quotes, and cells longer than a reader's usual limit."""
    name = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('"\nend'))
    long = F.when(F.col("p_partkey") % 50 == 0, F.repeat(F.lit("x"), 140_000)).otherwise("x")
    at = _folder(spark)
    _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), long.alias("long")).write.option("header", True).option("escape", '"').csv(at)
    rows = load.load_csv(spark, at, {"id": "bigint", "name": "string", "long": "string"}).rows
    return rows.select("id", "name", F.length("long").alias("n"))


@_query("SELECT p_partkey AS id, p_name || chr(10) || ';' || p_brand || '|' AS name FROM part WHERE p_partkey % 5 <> 0")
def q_load_csv_terminator(spark, sf_dir):
    """Records that end in a bar, with line breaks, escaped and quoted borders in cells; too many cells are refused."""
    many = F.when(F.col("p_partkey") % 5 == 0, F.lit(";more")).otherwise("")
    line = F.concat("p_partkey", F.lit(";"), "p_name", F.lit('\n\\;'), "p_brand", F.lit("\\|"), many)
    at = _written(spark, _table(spark, sf_dir, "part").select(line), "|")
    return load.load_csv(spark, at, {"id": "bigint", "name": "string"}, type="traditional", delimiter=";", record_terminator="|", header=False, plain=True).rows.select("id", "name")


@_query("SELECT c_custkey AS id, c_name AS name FROM customer")
def q_load_idx_files(spark, sf_dir):
    """Nothing after the end of the data counts."""
    doc = F.concat(F.lit("#DREREFERENCE "), "c_custkey", F.lit("\n#DRETITLE\n"), "c_name", F.lit("\n"))
    at = _written(spark, _table(spark, sf_dir, "customer").repartition(3, "c_custkey").select(doc), "#DREENDDOC\n", "#DREENDDATANOREFERENCE\n\n#DREREFERENCE 1\n#DREENDDOC\n#DREREFERENCE 2\n")
    return load.load_idx(spark, at, {"drereference": "bigint", "dretitle": "string"}).rows.select(F.col("drereference").alias("id"), F.col("dretitle").alias("name"))


@_query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def q_load_dc_files(spark, sf_dir):
    line = F.concat(F.lit("key:"), "n_nationkey", F.lit("\nname:"), "n_name")
    at = _written(spark, _table(spark, sf_dir, "nation").repartition(2, "n_nationkey").select(line), "\n.\n")
    return load.load_dc(spark, at, {"key": "int", "name": "string"}).rows.select(F.col("key").alias("k"), "name")


@_query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def q_load_pairs_files(spark, sf_dir):
    line = F.concat(F.lit("id="), "s_suppkey", F.lit(", name = "), "s_name")
    at = _written(spark, _table(spark, sf_dir, "supplier").repartition(2, "s_suppkey").select(line))
    return load.load_pairs(spark, at, {"id": "bigint", "name": "string"}).rows.select("id", "name")


@_query("SELECT CAST(count(*) FILTER (WHERE s_suppkey % 2 = 0 AND length(s_name) <= 18) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE s_suppkey % 2 = 1) AS BIGINT) AS wrong_type, CAST(count(*) FILTER (WHERE s_suppkey % 2 = 0 AND length(s_name) > 18) AS BIGINT) AS too_long FROM supplier")
def q_load_avro_options(spark, sf_dir):
    """Fields by place; wrong types and long texts refuse their records."""
    code = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("none")
    df = _table(spark, sf_dir, "supplier").select(code.alias("a"), F.col("s_name").alias("b"))

    def files(batches):
        for batch in batches:
            made = [_avro_file(batch.to_pylist(), ["a", "b"], ["string", "string"])] if len(batch) else []
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["content"])

    loaded = load.load_avro(
        spark, df.mapInArrow(files, "content binary"), {"id": "bigint", "name": "varchar(18)"}, plain=True, reject_on_materialized_type_error=True, enforce_length=True
    )
    both = loaded.rows.select(F.lit("ok").alias("k")).unionByName(loaded.rejects.select(F.col("reason").alias("k")))
    return both.agg(F.count_if(F.col("k") == "ok").alias("kept"), F.count_if(F.col("k") == "wrong type: id").alias("wrong_type"), F.count_if(F.col("k") == "too long: name").alias("too_long"))


_MESSAGE = {"type": "record", "name": "Part", "fields": [{"name": "key", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "price", "type": "double"}, {"name": "big", "type": "boolean"}, {"name": "tags", "type": {"type": "array", "items": "string"}}]}


@_query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, p_retailprice AS price, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS big, p_brand AS tag FROM part")
def q_avro_messages(spark, sf_dir):
    """Messages without a container, datum by datum."""

    def messages(batches):
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                name = b"\0" if r["p_partkey"] % 3 == 0 else b"\x02" + _avro_text(r["p_name"])
                tags = b"\x04" + _avro_text("x") + _avro_text(r["p_brand"]) + b"\0"
                made.append(_avro_long(r["p_partkey"]) + name + struct.pack("<d", r["p_retailprice"]) + (b"\1" if r["p_size"] > 25 else b"\0") + tags)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["m"])

    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size", "p_brand")
    vm = avro.avro_vmap(F.col("m"), json.dumps(_MESSAGE), flatten_arrays=True)
    made = part.mapInArrow(messages, "m binary").select(vm.alias(RAW))
    tag = V.maplookup(F.col(RAW), "1.tags")
    return made.select(
        V.maplookup(F.col(RAW), "key").try_cast("bigint").alias("key"), V.maplookup(F.col(RAW), "name").alias("name"),
        V.maplookup(F.col(RAW), "price").try_cast("double").alias("price"), V.maplookup(F.col(RAW), "big").alias("big"), tag.alias("tag"),
    )


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS BIGINT) END AS whole, left(o_orderpriority, 4) AS cut, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey * 86400 AS BIGINT) END AS seconds FROM orders")
def q_cast_with_truncation(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    text_ = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("none")
    span = inference.cast_to(F.concat(text_, F.lit(" days")), "Interval Day to Second")
    return o.select("o_orderkey", inference.cast_to(text_, "Integer").alias("whole"), inference.cast_to(F.col("o_orderpriority"), "Varchar(4)").alias("cut"), span.cast("interval second").cast("bigint").alias("seconds"))


@_query("SELECT o_orderkey, k, k IN (1, 2, 4, 5) AS zoned FROM orders CROSS JOIN (SELECT unnest(range(7)) AS k)")
def q_timezone_suffix(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    ends = ["", "+02", " EST", " PM", "-05", "Z", ".5"]
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*[F.concat(stamp, F.lit(e)) for e in ends])).alias("k", "v"))
    return df.select("o_orderkey", F.col("k").cast("long").alias("k"), text.may_have_timezone(F.col("v")).alias("zoned"))


@_query("SELECT event_id, CASE WHEN event_id % 5 > 1 THEN json_extract_string(props, '$.k') END AS k FROM events")
def q_extractor_actions(spark, sf_dir):
    """What is malformed or too much gives null under the actions that only log."""
    bad = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 5 == 1, F.concat("props", "props")).otherwise(F.col("props"))
    vm = X.mapjsonextractor(bad, reject_action="logdebug", error_action="LogAlways")
    return _table(spark, sf_dir, "events").select("event_id", V.maplookup(vm, "k").alias("k"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def q_materialized_dotted(spark, sf_dir):
    """Keys with dots, as nesting gives them, are read as real columns too."""
    line = F.concat(F.lit('{"in": '), "props", F.lit(', "type.name": "'), "event_type", F.lit('"}'))
    df = _table(spark, sf_dir, "events").select("event_id", X.mapjsonextractor(line).alias(RAW))
    table = LooseTable(df, "dotted").materialize(2)[0]
    return table.select("event_id", "in.k", "TYPE.name").toDF("event_id", "k", "kind")


@_query(f"""SELECT i.s_suppkey, keys, values, CAST(octet_length(encode(values)) AS BIGINT) AS length,
CAST(row_number() OVER (PARTITION BY i.s_suppkey ORDER BY lower(keys)) - 1 AS BIGINT) AS field_num FROM ({_ITEMS}) i""")
def q_sql_table_functions(spark, sf_dir):
    sqlfuncs.register(spark)
    _supplier_map(spark, sf_dir).createOrReplaceTempView("_loose_rows")
    return spark.sql(f"""SELECT s.s_suppkey, i.keys, i.values, n.length, n.field_num FROM _loose_rows s, LATERAL mapitems({RAW}) i, LATERAL mapkeysinfo({RAW}) n
        WHERE i.keys = n.keys AND i.keys IN (SELECT k.keys FROM _loose_rows, LATERAL mapkeys({RAW}) k) AND n.type_oid = 'long varbinary'""")


@_query("SELECT p_partkey, p_name AS name, CAST(NULL AS VARCHAR) AS lower_brand, p_brand AS brand, '9' AS put, CAST(4 AS BIGINT) AS n, CAST(p_size AS VARCHAR) AS size FROM part")
def q_sql_extractors(spark, sf_dir):
    sqlfuncs.register(spark)
    line = F.concat_ws("|", "p_name", "p_brand", F.lit(""))
    _table(spark, sf_dir, "part").select("*", line.alias("line"), F.concat(F.lit('{"s": {"size": '), "p_size", F.lit("}}")).alias("j")).createOrReplaceTempView("_loose_parts")
    return spark.sql("""SELECT p_partkey, maplookup(m, 'NAME') AS name, maplookup(m, 'brand', case_sensitive => true) AS lower_brand,
        maplookup(mapregexextractor(line, '[|](?<brand>[^|]*)'), 'BRAND') AS brand, maplookup(m, 'put') AS put, mapsize(m) AS n, maplookup(mapjsonextractor(j), 's.size') AS size
        FROM (SELECT *, mapput(mapdelimitedextractor(line, header_names => 'name|Brand'), setmapkeys(array('put')), array('9')) AS m FROM _loose_parts)""")


@_query("SELECT c_nationkey, count(*) AS n, min(c_name) AS first, max(c_mktsegment) AS top FROM customer GROUP BY 1")
def q_sql_mapaggregate(spark, sf_dir):
    sqlfuncs.register(spark)
    _table(spark, sf_dir, "customer").createOrReplaceTempView("_loose_customers")
    return spark.sql("""WITH m AS (SELECT c_nationkey, mapaggregate(collect_list(struct(c_name AS key, c_mktsegment AS value))) AS m FROM _loose_customers GROUP BY 1)
        SELECT c_nationkey, count(*) AS n, min(i.keys) AS first, max(i.values) AS top FROM m, LATERAL mapitems(m) i GROUP BY 1""")


@_query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\v\f\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY doc_id")
def q_sql_flextokenizer(spark, sf_dir):
    sqlfuncs.register(spark)
    _table(spark, sf_dir, "documents").select("doc_id", V.vmap_of(text=F.col("text")).alias(RAW)).createOrReplaceTempView("_loose_docs")
    return spark.sql(f"SELECT doc_id, count(*) AS n FROM _loose_docs, LATERAL flextokenizer({RAW}) t WHERE token IS NOT NULL GROUP BY doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
