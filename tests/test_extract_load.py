"""Extractors and loaders, one test per format and option."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloft.functions import vmap as V
from keyloft.operators import extract as X
from keyloft.operators.table import RAW
from keyloft.plans.catalog import _avro_file
from keyloft.sources import avro, load


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)


def maps(loaded):
    return [[(p.key, p.value) for p in r[RAW]] for r in loaded.rows.collect()]


def of(spark, column_of, text):
    row = values(spark, text).select(column_of(F.col("value")).alias("m")).first()["m"]
    return None if row is None else [(p.key, p.value) for p in row]


NESTED = '{"a":{"b":1.50},"l":[10,{"x":true}],"n":null}'


def test_json_flattening(spark):
    assert of(spark, X.mapjsonextractor, NESTED) == [("a.b", "1.50"), ("l", '[["0","10",0],["1.x","T",0]]'), ("n", None)]
    flat = of(spark, lambda c: X.mapjsonextractor(c, flatten_arrays=True), NESTED)
    assert flat == [("a.b", "1.50"), ("l.0", "10"), ("l.1.x", "T"), ("n", None)]
    assert of(spark, lambda c: X.mapjsonextractor(c, flatten_maps=False), NESTED)[0] == ("a", '[["b","1.50",0]]')
    assert of(spark, X.mapjsonextractor, '{"":{"b":1}}') == [(".b", "1")]
    assert of(spark, lambda c: X.mapjsonextractor(c, omit_empty_keys=True), '{"":1,"a":{"":2},"b":3}') == [("b", "3")]
    assert of(spark, lambda c: X.mapjsonextractor(c, suppress_nonalphanumeric_key_chars=True), '{"a-b":1}') == [("a_b", "1")]
    assert of(spark, X.mapjsonextractor, "") is None


def test_json_actions(spark):
    quiet = {"reject_action": "None", "error_action": "None"}
    assert of(spark, lambda c: X.mapjsonextractor(c, **quiet), '{"a":1}{"b":2}') is None
    assert of(spark, lambda c: X.mapjsonextractor(c, **quiet), "{bad") is None
    assert of(spark, lambda c: X.mapjsonextractor(c, reject_on_duplicate=True, **quiet), '{"a":1,"A":2}') is None
    assert of(spark, lambda c: X.mapjsonextractor(c, reject_on_empty_key=True, **quiet), '{"":1}') is None
    with pytest.raises(Exception):
        of(spark, X.mapjsonextractor, "{bad")
    with pytest.raises(ValueError):
        X.mapjsonextractor(F.col("value"), reject_action="Nothing")


def test_load_json(spark):
    whole = load.load_json(spark, values(spark, '[{"a":1}, {"a":2}] // more\n{"a":3}'), {"a": "int"})
    assert sorted(r["a"] for r in whole.rows.collect()) == [1, 2, 3]
    started = load.load_json(spark, values(spark, '{"w":{"rows":[{"a":1},{"a":2}]}}'), start_point="rows")
    assert maps(started) == [[("a", "1")], [("a", "2")]]
    second = load.load_json(spark, values(spark, '{"r":{"a":1},"s":{"r":{"a":2}}}'), start_point="r", start_point_occurrence=2)
    assert maps(second) == [[("a", "2")]]
    bad = load.load_json(spark, values(spark, '{"a":1}', "{bad", '{"a":2}', '"bare"'), record_terminator="\n")
    assert len(maps(bad)) == 2 and bad.rejects.count() == 2
    with pytest.raises(Exception):
        load.load_json(spark, values(spark, "{bad")).rows.collect()


def test_real_columns(spark):
    df = values(spark, '{"a":"x","A":"7"}', '{"a":""}', '{"s":"long text"}')
    loaded = load.load_json(spark, df, {"a": "int", "s": "varchar(4)"}, record_terminator="\n")
    assert [(r["a"], r["s"]) for r in loaded.rows.collect()] == [(7, None), (None, None), (None, "long")]
    strict = load.load_json(spark, df, {"s": "varchar(4)"}, record_terminator="\n", enforce_length=True)
    assert strict.rows.count() == 2 and strict.rejects.first()["reason"] == "too long: s"
    typed = load.load_json(spark, values(spark, '{"a":"x"}'), {"a": "int"}, record_terminator="\n", reject_on_materialized_type_error=True)
    assert typed.rows.count() == 0 and typed.rejects.count() == 1


def test_delimited(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a|b\n1|2|3\n|x\nlast")
    assert maps(load.load_delimited(spark, str(tmp_path / "f.txt"))) == [[("a", "1"), ("b", "2"), ("ucol2", "3")], [("a", None), ("b", "x")], [("a", "last")]]
    kept = load.load_delimited(spark, values(spark, "1||3"), header=False, treat_empty_val_as_null=False)
    assert maps(kept) == [[("ucol0", "1"), ("ucol1", ""), ("ucol2", "3")]]
    none = load.load_delimited(spark, values(spark, "1|2"), {"ucol0": "int"}, header=False)
    assert none.rows.first()["ucol0"] is None
    assert maps(load.load_delimited(spark, values(spark, "a||c", "1|2|3"), omit_empty_keys=True)) == [[("a", "1"), ("c", "3")]]
    assert maps(load.load_delimited(spark, values(spark, "a|A", "1|2"), reject_on_duplicate=True)) == []
    with pytest.raises(ValueError):
        load.load_delimited(spark, values(spark, "x"), delimiter="||")
    made = of(spark, lambda c: X.mapdelimitedextractor(c, header_names="x|y"), " 1 |2|")
    assert made == [("ucol2", None), ("x", "1"), ("y", "2")]
    assert of(spark, X.mapdelimitedextractor, "") is None


def test_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('h1,h2\n"x ""q""","1,2"\n"two\nlines",b,c\n')
    got = maps(load.load_csv(spark, str(tmp_path / "f.csv")))
    assert got == [[("h1", 'x "q"'), ("h2", "1,2")], [("h1", "two\nlines"), ("h2", "b"), ("ucol2", "c")]]
    trad = load.load_csv(spark, values(spark, 'a\\,b,"c\\"d",NIL\n'), {"ucol2": "string"}, type="traditional", header=False, null="NIL")
    assert maps(trad) == [[("ucol0", "a,b"), ("ucol1", 'c"d'), ("ucol2", "")]] and trad.rows.first()["ucol2"] is None
    ignored = load.load_csv(spark, values(spark, "a,b\n1,2\n"), delimiter=";")
    assert maps(ignored) == [[("a", "1"), ("b", "2")]]
    with pytest.raises(ValueError):
        load.load_csv(spark, values(spark, "x"), type="traditional", delimiter='"')


def test_pairs(spark):
    assert maps(load.load_pairs(spark, values(spark, "A=1, b = 2,zzz,c=x=y"))) == [[("a", "1"), ("b", "2"), ("c", "x=y")]]
    assert maps(load.load_pairs(spark, values(spark, "k=1,K=2"))) == [[("k", "1"), ("k", "2")]]


def test_cef(spark):
    line = r"CEF:0|V|P|1|sig|N\|x|5|src=1.1.1.1 msg=hello big world eq=a\=b"
    got = dict(maps(load.load_cef(spark, values(spark, line)))[0])
    assert got == {"version": "0", "devicevendor": "V", "deviceproduct": "P", "deviceversion": "1", "signatureid": "sig", "name": "N|x", "severity": "5", "src": "1.1.1.1", "msg": "hello big world", "eq": "a=b"}
    few = load.load_cef(spark, values(spark, "CEF:0|V|P", "a=1 B=2"))
    assert maps(few) == [[("a", "1"), ("b", "2")]] and few.rejects.count() == 1
    strict = load.load_cef(spark, values(spark, "msg=a b c=1"), reject_on_unescaped_delimiter=True)
    assert strict.rejects.count() == 1


def test_regex(spark):
    pattern = "(?<w>[a-z]+)(?P<n_1>[0-9]*)"
    assert maps(load.load_regex(spark, values(spark, "ab", "12", "x7"), pattern=pattern)) == [[("w", "ab")], [("n_1", "7"), ("w", "x")]]
    lined = load.load_regex(spark, values(spark, "ab 1"), {"w": "string", "line": "string"}, pattern="(?<w>[a-z]+)", loglinecolumn="line")
    assert lined.rows.first()["line"] == "ab 1"
    with pytest.raises(ValueError):
        X.java_pattern("(a)(?<b>c)")
    with pytest.raises(ValueError):
        load.load_regex(spark, values(spark, "a"), pattern="(?<w>a)", loglinecolumn="nowhere")
    assert of(spark, lambda c: X.mapregexextractor(c, pattern=pattern), "12") is None


def test_idx_and_dc(spark):
    text = '#DREREFERENCE r1 \n#DREFIELD f="v\nw"\n#DRETYPE t\n#DRECONTENT\nline 1\nline 2\n#DREENDDOC\n#DREREFERENCE r2\n#DREENDDATA x'
    df = values(spark, *text.split("#DREENDDOC"))
    assert maps(load.load_idx(spark, df)) == [[("drecontent", "line 1\nline 2"), ("drereference", "r1"), ("f", "v\nw")], [("drereference", "r2")]]
    assert all(k != "drecontent" for m in maps(load.load_idx(spark, df, store_content=False)) for k, _ in m)
    assert maps(load.load_dc(spark, values(spark, "k:v\nq:a:b"))) == [[("k", "v"), ("q", "a:b")]]


def test_idx_and_dc_files(spark, tmp_path):
    (tmp_path / "a.idx").write_text("#DREREFERENCE 1\n#DREENDDOC\n#DREREFERENCE 2\n#DREENDDOC\n")
    assert load.load_idx(spark, str(tmp_path / "a.idx")).rows.count() == 2
    (tmp_path / "a.dc").write_text("k:1\n.\nk:2\n.\n")
    assert maps(load.load_dc(spark, str(tmp_path / "a.dc"))) == [[("k", "1")], [("k", "2")]]


AVRO = {
    "type": "record", "name": "R", "namespace": "n", "fields": [
        {"name": "a", "type": {"type": "record", "name": "In", "fields": [{"name": "b", "type": "int"}, {"name": "arr", "type": {"type": "array", "items": "string"}}]}},
        {"name": "m", "type": {"type": "map", "values": "boolean"}},
        {"name": "e", "type": {"type": "enum", "name": "Color", "symbols": ["RED", "BLUE"]}},
        {"name": "u", "type": ["null", "double"]},
        {"name": "x", "type": {"type": "fixed", "name": "F2", "size": 2}},
    ],
}


def _long(n):
    n, out = n << 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _datum():
    text = lambda s: _long(len(s)) + s
    return _long(7) + _long(2) + text(b"p") + text(b"q") + _long(0) + _long(1) + text(b"k") + b"\x01" + _long(0) + _long(1) + _long(0) + b"zz"


def test_avro(spark):
    got = dict((k, v) for k, v, _ in avro.message_row(_datum(), json.dumps(AVRO), avro.AvroOptions(flatten_arrays=True)))
    assert got == {"__name__": "R", "a.__name__": "In", "a.b": "7", "a.0.arr": "p", "a.1.arr": "q", "m.k": "true", "Color": "BLUE", "u": "", "x": "zz"}
    nested = dict((k, m) for k, _, m in avro.message_row(_datum(), json.dumps(AVRO), avro.AvroOptions(False, False, False)))
    assert nested["a"] and nested["m"] and not nested["u"]
    messages = spark.createDataFrame([(bytearray(_datum()),), (None,)], "m binary").select(avro.avro_vmap(F.col("m"), json.dumps(AVRO)).alias("v")).collect()
    assert len(messages[0]["v"]) == 8 and messages[1]["v"] is None
    assert avro.row_of(("text", "", "5"), avro.AvroOptions(), 3) == [("ucol3", "5", False)]
    data = _avro_file([{"n": 1, "s": "ä"}, {"n": 2, "s": ""}], ["n", "s"], ["long", "string"])
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert [r["n"] for r in load.load_avro(spark, df, {"n": "int"}).rows.collect()] == [1, 2]
    plain = b"some block of data"
    import binascii
    import struct

    assert avro._snappy(pa.compress(plain, codec="snappy", asbytes=True) + struct.pack(">I", binascii.crc32(plain))) == plain
    with pytest.raises(ValueError):
        avro._snappy(pa.compress(plain, codec="snappy", asbytes=True) + b"\0\0\0\0")


def test_headers_of_many_files(spark, tmp_path, monkeypatch):
    """Each file has its own header; a record equal to one is a record; many files are joined, not sent along."""
    (tmp_path / "a.txt").write_text("x|y\n1|2\nx|y\n")
    (tmp_path / "b.txt").write_text("\ny|x\n3|4\n")
    for few in (10_000, 0):
        monkeypatch.setattr(load, "FEW_FILES", few)
        rows = load.load_delimited(spark, str(tmp_path), {"x": "string", "y": "string"}).rows
        assert sorted((r["x"], r["y"]) for r in rows.collect()) == [("1", "2"), ("4", "3"), ("x", "y")]
    bad = load.load_delimited(spark, str(tmp_path / "a.txt"), {"x": "string"}, reject_on_duplicate=True, delimiter="z")
    assert bad.rows.count() == 2


def test_own_names(spark):
    """Columns may be called as the loader's own."""
    df = spark.createDataFrame([('{"reason": "r", "value": 1, "vmap": "m", "a.b": 2}',), ("{bad",)], "value string")
    loaded = load.load_json(spark, df, {"reason": "string", "value": "int", "vmap": "string", "a.b": "int"}, record_terminator="\n")
    assert [tuple(r)[1:] for r in loaded.rows.collect()] == [("r", 1, "m", 2)]
    assert [r["record"] for r in loaded.rejects.collect()] == ["{bad"]


def test_json_depth_and_halves(spark):
    df = spark.createDataFrame([("[" * 5000,), ('{"k\\udc00": "\\ud83d\\ude00 \\ud83d"}',), ('{"a": 1}',)], "value string")
    loaded = load.load_json(spark, df, record_terminator="\n")
    assert sorted(maps(loaded)) == [[("a", "1")], [("k�", "\U0001f600 �")]]
    assert loaded.rejects.count() == 1
    quiet = spark.createDataFrame([("[" * 5000,)], "t string").select(X.mapjsonextractor(F.col("t"), error_action="None").alias("m"))
    assert quiet.first()["m"] is None


@pytest.mark.parametrize("text", ['{"a":1.50, "b" : "x y","c":null,"d":true,"e":-0.0e3}', "{}", ' { "k" : "v" } ', '{"":1,"B":2,"b":"3"}', '{"a":"x\\"y"}', '{"a":[1]}', '{"a":1}{"a":2}', '{"a":01}', "[]", '{"a" 1}'])
@pytest.mark.parametrize("omit", [False, True])
def test_flat_objects(spark, text, omit, monkeypatch):
    """Built-in expressions and the scanner agree."""
    df, got = spark.createDataFrame([(text,)], "t string"), []
    for size in (2000, -1):
        monkeypatch.setattr(X, "FLAT_SIZE", size)
        made = X.mapjsonextractor(F.col("t"), reject_action="None", error_action="None", omit_empty_keys=omit)
        got.append(df.select(made.alias("m")).first()["m"])
    assert got[0] == got[1]


def test_escaped_cells():
    cells = lambda t: list(load.escaped_cells(t, ";", "|", '"', "\\"))
    assert cells('a;"b;|""c|x\\;y;\n\\||;|') == [["a", 'b;|"c'], ["x;y", "\n|"], ["", ""]]
    assert cells("||a\\") == [["a"]] and cells("") == []


def test_csv_long_cell(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n" + "x" * 200_000 + ",2\n3\n")
    plain = load.load_csv(spark, str(tmp_path / "f.csv"), {"a": "string", "b": "int"}, plain=True)
    assert [(len(r["a"]), r["b"]) for r in plain.rows.collect()] == [(200_000, 2)]
    assert [tuple(r) for r in plain.rejects.collect()] == [("1 cells for 2 columns", "3")]


@pytest.mark.parametrize(
    "options",
    [
        {}, {"trim": False}, {"header": False, "plain": True}, {"null": "x", "omit_empty_keys": True, "reject_on_duplicate": True},
        {"type": "traditional", "delimiter": ";", "record_terminator": "|", "trim": False}, {"type": "traditional", "header": ["p", "q"]},
    ],
)
def test_csv_blocks(spark, tmp_path, options):
    """Files read by many tasks give what their texts give when read at once."""
    d, end = options.get("delimiter", ","), options.get("record_terminator", "\n")
    rows = [f'{i}{d}"a{end}""{i}{d}"{d}b\\{end}{d} x' for i in range(40)] + [f'7{d}"{"long" * 60}{end}"', f"1{d}x", f'"{end}"{end}', f"2\r{d}y"]
    texts = [end * 60 + end.join([f'"h{end}{"e" * 90}"{d}a{d}', *rows, f'8{d}"open{end}']), end.join([f"A{d}a", *rows, f"9{d}last\\"]) + end, f'x{d}"', "\n", ""]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    columns = {"a": "string", "ucol1": "int"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        found = [load.load_csv(spark, source, columns, **options) for source in (str(tmp_path), values(spark, *texts))]
        got, want = ([sorted(map(str, df.collect())) for df in (loaded.rows, loaded.rejects)] for loaded in found)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(want[0]) + len(want[1]) > 40


def test_csv_file_of_many_tasks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n" + "".join(f'{i},"x\n""{i}"""\n' for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = load.load_csv(spark, str(tmp_path / "f.csv"), {"a": "int", "b": "string"}).rows.select("a", "b", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r[:2] for r in rows) == [(i, f'x\n"{i}"') for i in range(200)]
    assert len({r[2] for r in rows}) > 5


def test_plain_regex(spark):
    df = spark.createDataFrame([("a1",)], "value string")
    with pytest.raises(ValueError, match="no columns"):
        load.load_regex(spark, df, {"w": "string"}, pattern="(?<w>[a-z])(?<n>[0-9])", plain=True)


@pytest.mark.parametrize(
    "line",
    [
        "CEF:0|V|P|1|sig|N\\|x|5|src=1.1.1.1 msg=hello big world", " CEF:0| V |P|1|s\\\\|n|5|", "CEF:0|V|P|1|s|n|5|a=b\\=c d\\nx K=  v ",
        "CEF:0|V|P|1|s|n|5|a=1 b=2=3", "CEF:0|V|P|1|s|n", "a=1 b=x y", "CEF:0|V|P|1|s|n|5|k y=1", "CEF:0|V|P|1|s|n|High", "CEF:0|V|P|1|s|n|5|a=\\\\ b=é",
    ],
)
def test_plain_cef(spark, line, monkeypatch):
    """Built-in expressions and the scanner agree."""
    df, got = spark.createDataFrame([(line,)], "value string"), []
    for size in (2000, -1):
        monkeypatch.setattr(X, "FLAT_SIZE", size)
        loaded = load.load_cef(spark, df)
        got.append((maps(loaded), [tuple(r) for r in loaded.rejects.collect()]))
    assert got[0] == got[1]
