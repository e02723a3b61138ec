"""Loaders: files of some format become rows with a vmap, refused records go aside.

Each loader takes a path, or a DataFrame whose column ``value`` holds the records
(whole files where the format has no record border), so the same parsing serves
batch and streaming input.  It returns a :class:`Loaded`.  A last record without
its terminator counts.

While a record is parsed its columns have names of their own (``_VMAP`` and so on),
so real columns may be called anything.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import SPACE, ascii_lower
from ..functions.vmap import ARROW_VMAP, VMAP, Pair, normalize_vmap, sorted_pairs
from ..operators import extract as X
from ..operators.table import RAW

_VMAP, _REASON, _RECORD, _FILE, _AT = "__kl_vmap", "__kl_reason", "__kl_record", "__kl_file", "__kl_at"
_PARSED = f"{_VMAP} {VMAP}, {_REASON} string, {_RECORD} string"
_ARROW = pa.schema([(_VMAP, ARROW_VMAP), (_REASON, pa.string()), (_RECORD, pa.string())])


@dataclass
class Loaded:
    """``rows`` have ``__raw__`` and the real columns; ``rejects`` have ``reason`` and ``record``."""

    rows: DataFrame
    rejects: DataFrame


def records(spark: SparkSession, source: str | DataFrame, terminator: str | None, *, placed: bool = False) -> DataFrame:
    """Records of files; whole files without a terminator.

    With ``placed`` each has its file, and its place in the file, by which it can be
    compared with others of the same file.
    """
    if isinstance(source, DataFrame):
        df = source.select(F.col("value").alias(_RECORD))
        return df.withColumns({_FILE: F.lit(None).cast("string"), _AT: F.lit(None).cast("struct<block:bigint,row:bigint>")}) if placed else df
    text = spark.read.text(source, wholetext=True) if terminator is None else spark.read.text(source, lineSep=terminator)
    if not placed:
        return text.select(F.col("value").alias(_RECORD))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select(F.col("value").alias(_RECORD), F.col("_metadata.file_path").alias(_FILE), at.alias(_AT))


#: Loads of at most so many files have one row for each file sent along to the records.
FEW_FILES = 10_000


def _by_file(df: DataFrame, facts: DataFrame, how: str = "inner", files: DataFrame | None = None) -> DataFrame:
    """Records with what is known about their files (``__kl_f`` and more, a row for each file).

    ``files`` reads the files where ``df`` does not tell which they are.
    """
    few = len((df if files is None else files).inputFiles()) <= FEW_FILES
    return df.join(F.broadcast(facts) if few else facts, F.col(_FILE) == F.col("__kl_f"), how)


def _last(vm: Column, key: str) -> Column:
    """The last value of a key: of repeated ones, that is the one that fills a real column."""
    return F.try_element_at(F.filter(vm, lambda p: ascii_lower(p["key"]) == ascii_lower(F.lit(key))), F.lit(-1))["value"]


def typed(text: Column, kind: str, *, reject_type_errors: bool = False, enforce_length: bool = False) -> tuple[Column, Column]:
    """A text as a value of a real column, and why the record is refused, or null."""
    text = F.when(text != "", text)
    sized = re.fullmatch(r"(?i)\s*(?:var)?char\s*\((\d+)\)\s*", kind)
    if sized:
        size = int(sized.group(1))
        bad = F.octet_length(text) > size if enforce_length else F.lit(False)
        return F.when(F.octet_length(text) <= size, text).otherwise(F.left(text, F.lit(size))), F.when(F.coalesce(bad, F.lit(False)), "too long")
    value = text.try_cast(kind)
    bad = value.isNull() & text.isNotNull() if reject_type_errors else F.lit(False)
    return value, F.when(bad, "wrong type")


def finish(
    parsed: DataFrame,
    columns: dict[str, str] | None = None,
    *,
    reject_type_errors: bool = False,
    enforce_length: bool = False,
    given: dict[str, Column] | None = None,
) -> Loaded:
    """Fill real columns from parsed records and part rows from rejects.

    ``columns`` maps names to types.  A value that does not parse gives null, or
    with ``reject_type_errors`` refuses the record; a text beyond its ``varchar(n)``
    is cut, or with ``enforce_length`` refuses the record.  Empty values are null.
    ``given`` are real columns that do not come from the map.
    """
    told, made = F.col(_REASON), []
    for i, (name, kind) in enumerate((columns or {}).items()):
        if given and name in given:
            made.append(given[name].alias(f"__kl_{i}"))
            continue
        value, why = typed(_last(F.col(_VMAP), name), kind, reject_type_errors=reject_type_errors, enforce_length=enforce_length)
        made.append(value.alias(f"__kl_{i}"))
        told = F.coalesce(told, F.concat(why, F.lit(f": {name}")))
    out = parsed.select(F.col(_VMAP), told.alias(_REASON), F.col(_RECORD), *made)
    kept = out.filter(F.col(_REASON).isNull() & F.col(_VMAP).isNotNull())
    rejects = out.filter(F.col(_REASON).isNotNull()).select(F.col(_REASON).alias("reason"), F.col(_RECORD).alias("record"))
    return Loaded(kept.select(F.col(_VMAP).alias(RAW), *[F.col(f"__kl_{i}").alias(c) for i, c in enumerate(columns or {})]), rejects)


def _parsed(df: DataFrame, vmap: Column, reason: Column | None = None) -> DataFrame:
    why = F.lit(None).cast("string") if reason is None else reason
    return df.select(vmap.alias(_VMAP), why.alias(_REASON), _RECORD)


def _checked(df: DataFrame, parse: Callable[[str], list[Pair]]) -> DataFrame:
    made = df.withColumn("__kl_r", X.checked(parse)(F.col(_RECORD)))
    return made.select(F.col("__kl_r.vmap").alias(_VMAP), F.col("__kl_r.reason").alias(_REASON), _RECORD)


def _handed(rows: Iterator[tuple[list[Pair] | None, str | None, str | None]]) -> Iterator[pa.RecordBatch]:
    """Parsed records, a batch at a time."""
    held = []
    for pairs, reason, record in rows:
        vmap = None if pairs is None else [{"key": k, "value": v, "is_map": m} for k, v, m in pairs]
        held.append({_VMAP: vmap, _REASON: reason, _RECORD: record})
        if len(held) >= 2000:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _many(df: DataFrame, parse: Callable[[str], Iterator[tuple[list[Pair] | None, str | None, str | None]]]) -> DataFrame:
    """Parse each record text into any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text for batch in batches for text in batch.column(0).to_pylist() if text is not None)
        return _handed(row for text in texts for row in parse(text))

    return df.select(_RECORD).mapInArrow(run, _PARSED)


def load_json(
    spark: SparkSession,
    source: str | DataFrame,
    columns: dict[str, str] | None = None,
    *,
    record_terminator: str | None = None,
    reject_on_materialized_type_error: bool = False,
    enforce_length: bool = False,
    **options,
) -> Loaded:
    """JSON objects.  Malformed text fails the load, or with a terminator only its record.

    So does text that is nested too deeply.  Without a terminator a file is one record,
    read by one task.  Halves of surrogate pairs become U+FFFD.
    """
    o = X.JsonOptions(**options)

    def parse(text: str):
        try:
            for members in X.json_records(text, o):
                try:
                    yield X.json_row(members, o), None, None
                except X.Rejected as e:
                    yield None, str(e), text if record_terminator else None
        except (ValueError, RecursionError) as e:
            if record_terminator is None:
                raise
            if text.strip(SPACE):
                yield None, f"malformed: {e}", text

    parsed = _many(records(spark, source, record_terminator), parse)
    return finish(parsed, columns, reject_type_errors=reject_on_materialized_type_error, enforce_length=enforce_length)


def load_delimited(
    spark: SparkSession,
    source: str | DataFrame,
    columns: dict[str, str] | None = None,
    *,
    delimiter: str = "|",
    record_terminator: str = "\n",
    header: bool | list[str] = True,
    trim: bool = True,
    omit_empty_keys: bool = False,
    reject_on_duplicate: bool = False,
    reject_on_empty_key: bool = False,
    reject_on_materialized_type_error: bool = False,
    treat_empty_val_as_null: bool = True,
    enforce_length: bool = False,
    format: str = "",
) -> Loaded:
    """Delimited text without quotes or escapes, by built-in expressions.

    With ``header`` true the first record of each file names that file's cells; of a
    DataFrame, whose rows have no order, the first row does, and equal ones are
    dropped.  A header with an empty or repeated name, where that is refused, ends its
    file without rows.  Without a header real columns stay null.
    """
    if len(delimiter) != 1 or len(record_terminator) != 1:
        raise ValueError("delimiter and terminator are one character each")
    df = records(spark, source, record_terminator, placed=header is True).filter(F.col(_RECORD) != "")

    def named(names: Column) -> Column:
        return F.transform(names, X.ascii_trim) if trim else names

    if header is True and isinstance(source, DataFrame):
        row = df.first()
        df = df.filter(F.col(_RECORD) != row[_RECORD]) if row else df
        head = named(F.split(F.lit(row[_RECORD] if row else ""), re.escape(delimiter), -1))
    elif header is True:
        tops = df.groupBy(F.col(_FILE).alias("__kl_f")).agg(F.min(F.struct(F.col(_AT), F.col(_RECORD))).alias("__kl_top"))
        df = _by_file(df, tops).filter(F.col(_AT) > F.col("__kl_top")[_AT])
        head = named(F.split(F.col("__kl_top")[_RECORD], re.escape(delimiter), -1))
    else:
        head = named(F.array(*[F.lit(n) for n in header])) if isinstance(header, list) and header else None
    bad = F.lit(False)
    if head is not None:
        folded = F.transform(head, ascii_lower)
        if reject_on_empty_key:
            bad = bad | F.array_contains(folded, F.lit(""))
        if reject_on_duplicate:
            bad = bad | (F.size(F.array_distinct(folded)) < F.size(folded))
    made = X.delimited_pairs(X._cells(F.col(_RECORD), delimiter, trim), head, empty_null=treat_empty_val_as_null, omit_empty=omit_empty_keys)
    parsed = _parsed(df.filter(~bad), normalize_vmap(made))
    given = None
    if header is False and columns:
        given = {c: F.lit(None).cast("string").try_cast("string" if "char" in t.lower() else t) for c, t in columns.items()}
    return finish(parsed, columns, reject_type_errors=reject_on_materialized_type_error, enforce_length=enforce_length, given=given)


#: Reads records from a file's lines, ends included, and returns what a text must begin with to go on where
#: they end: nothing after a whole record.
Cells = Callable[[Iterable[str]], Generator[list[str], None, str]]


def escaped_cells(text: str | Iterable[str], delimiter: str, terminator: str, quote: str, escape: str) -> Generator[list[str], None, str]:
    """The records of a text, or of its lines, whose cells are quoted and escaped by one character each.

    A quote opens a quoted cell at its beginning only; in it delimiter and terminator
    are text.  The character after an escape is text anywhere.
    """
    four = re.escape(delimiter + terminator + quote + escape)
    token = re.compile(f"[^{four}]+|{re.escape(escape)}.?|.", re.S)
    cells: list[str] = []
    cell: list[str] = []
    quoted = touched = False
    for m in (m for line in ([text] if isinstance(text, str) else text) for m in token.finditer(line)):
        t = m.group()
        if t[0] == escape:
            cell.append(t[1:])
            touched = True
        elif quoted:
            if t == quote:
                quoted = False
            else:
                cell.append(t)
        elif t == quote and not touched:
            quoted = touched = True
        elif t == delimiter:
            cells.append("".join(cell))
            cell, touched = [], False
        elif t == terminator:
            if cells or touched:
                yield [*cells, "".join(cell)]
            cells, cell, touched = [], [], False
        else:
            cell.append(t)
            touched = True
    if not cells and not touched:
        return ""
    yield [*cells, "".join(cell)]
    return quote if quoted else f"{escape}x"


def quoted_cells(lines: Iterable[str]) -> Generator[list[str], None, str]:
    """The records of lines whose quotes are doubled; empty lines are empty records."""
    over = False

    def fed() -> Iterator[str]:
        nonlocal over
        yield from lines
        over = True

    csv.field_size_limit(sys.maxsize)
    for cells in csv.reader(fed(), strict=False):
        yield cells
        if over:  # the reader asked for more
            return '"'
    return ""


def _left_open(cells: Cells, line: str) -> str:
    rows = cells([line])
    while True:
        try:
            next(rows)
        except StopIteration as e:
            return e.value


#: Rows of one batch, and characters of its rows together.
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 22

#: A block's record, or a text of it: what reaches over its borders.  Its last row has the block's bytes and, for
#: each way to begin the block, how the next one then begins.
_PIECE = {
    _FILE: ("string", pa.string()), "__kl_block": ("bigint", pa.int64()), "__kl_size": ("bigint", pa.int64()), "__kl_n": ("bigint", pa.int64()),
    "__kl_text": ("string", pa.string()), "__kl_cells": ("array<string>", pa.list_(pa.string())), "__kl_bytes": ("bigint", pa.int64()), "__kl_ends": ("array<string>", pa.list_(pa.string())),
}
_BEGUN = {_FILE: ("string", pa.string()), "__kl_block": ("bigint", pa.int64()), "__kl_begun": ("string", pa.string())}
_JOINED = {_FILE: ("string", pa.string()), "__kl_cells": ("array<string>", pa.list_(pa.string())), "__kl_first": ("boolean", pa.bool_())}
_LAST = 1 << 62


def _over_rows(df: DataFrame, made: Callable[[Iterator[tuple]], Iterator[tuple]], schema: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Each task's rows, in order, become rows of the schema; batches have bounded size."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), schema.values(), strict=True)], list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in made(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            held.append(row)
            chars += sum(len(v) if isinstance(v, str) else sum(map(len, v)) if isinstance(v, list) else 0 for v in row)
            if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield batch(held)
                held, chars = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, (t, _) in schema.items()))


def _cut_block(lines: Iterator[str], begun: list[str], cells: Cells, blank: set[str]) -> Generator[tuple[str | None, list[str] | None], None, list[str]]:
    """A block's records, and as texts, first and last, what may belong to records that reach over its borders.

    ``begun`` are the ways in which the block may begin, such as within a quoted cell.
    It is read in all of them until a record ends in each: what comes before is handed
    on as text.  So is a file's first record, which may be its header.  Returns how the
    next block begins, for each way.
    """
    held: list[str] = []
    chars, ways = 0, list(begun)
    for line in lines:
        if chars >= BATCH_CHARS:
            yield "".join(held), None
            held, chars = [], 0
        held.append(line)
        chars += len(line)
        after = {way: _left_open(cells, way + line) for way in set(ways)}
        ways = [after[way] for way in ways]
        if line not in blank and not any(ways):
            break
    yield "".join(held), None
    if not held or any(ways):
        return ways
    held, over = [], False

    def fed() -> Iterator[str]:
        nonlocal over
        for line in lines:
            if held or line not in blank:
                held.append(line)
                yield line
        over = True

    rows = cells(fed())
    while True:
        try:
            made = next(rows)
        except StopIteration as e:
            yield "".join(held), None
            return [e.value] * len(begun)
        if not over:
            held.clear()
            yield None, made


def _file_cells(spark: SparkSession, path: str, terminator: str, cells: Cells, lines_of: Callable[[str], Iterable[str]], ways: list[str], blank: set[str]) -> DataFrame:
    """Files' records as ``__kl_cells`` with ``__kl_file``, and whether each is its file's ``__kl_first``.

    Files are read by blocks, and cut where a record ends however the block began.  How
    the blocks began follows from all before them; then what comes before the cuts is
    read block by block too.  Only records over borders, and files' first ones, go to
    one task a file, in order.
    """
    text = spark.read.text(path, lineSep=terminator)
    lines = text.select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size", F.octet_length("value") + 1)

    def cut(found: Iterator[tuple]) -> Iterator[tuple]:
        for (file, block, size), own in groupby(found, itemgetter(1, 2, 3)):
            total = 0

            def split(own=own) -> Iterator[str]:
                nonlocal total
                for line, *_, n in own:
                    total += n
                    yield from lines_of(line + terminator)

            made, n, heads = _cut_block(split(), [""] if block == 0 else ways, cells, blank), 0, True
            while True:
                try:
                    text, row = next(made)
                except StopIteration as e:
                    yield file, block, size, _LAST + 1, None, None, total, e.value * len(ways) if block == 0 else e.value
                    break
                heads = heads and row is None
                yield file, block, size, n if heads or row else _LAST, text, row, None, None
                n += 1

    def begin(found: Iterator[tuple]) -> Iterator[tuple]:
        for file, own in groupby(found, itemgetter(0)):
            way = ""
            for _, block, ends in own:
                yield file, block, way
                way = ends[ways.index(way)]

    def cut_again(found: Iterator[tuple]) -> Iterator[tuple]:
        for (file, block, size, way), own in groupby(found, itemgetter(0, 1, 2, 3)):
            parts = (line for *_, text in own for line in lines_of(text))
            for n, (text, row) in enumerate(_cut_block(parts, [way], cells, blank)):
                yield file, block, size, n, text, row, None, None

    def join(found: Iterator[tuple]) -> Iterator[tuple]:
        for file, own in groupby(found, itemgetter(0)):

            def texts(own=own) -> Iterator[str]:
                total, size, last = 0, 0, ""
                for _, size, text, n in own:
                    total += n or 0
                    if text:
                        yield from lines_of(last)
                        last = text
                ended = total in (size, size - 3)  # three bytes: the mark of the byte order, which the reader drops
                yield from lines_of(last if ended else last[:-1])

            for i, row in enumerate(filter(None, cells(texts()))):
                yield file, row, i == 0

    def kept(df: DataFrame) -> DataFrame:
        return df.localCheckpoint(eager=False, storageLevel=StorageLevel.DISK_ONLY)

    place, whole, edge = [_FILE, "__kl_block"], F.col("__kl_cells").isNotNull(), F.col("__kl_cells").isNull()
    # All uses must see the same blocks, which Spark lays out anew for each reading as cores come and go.
    pieces = kept(_over_rows(lines, cut, _PIECE))
    texts = kept(pieces.filter(edge))  # few, and read often
    ends = texts.filter(F.col("__kl_ends").isNotNull()).select(*place, "__kl_ends").repartition(F.col(_FILE)).sortWithinPartitions(*place)
    heads = texts.filter(F.col("__kl_n") < _LAST).join(_over_rows(ends, begin, _BEGUN), place)
    heads = heads.select(*place, "__kl_size", "__kl_begun", "__kl_n", "__kl_text").repartition(*map(F.col, place)).sortWithinPartitions(*place, "__kl_n")
    again = _over_rows(heads.drop("__kl_n"), cut_again, _PIECE)
    edges = texts.filter(F.col("__kl_n") >= _LAST).unionByName(again.filter(edge)).select(*place, "__kl_n", "__kl_size", "__kl_text", "__kl_bytes")
    edges = edges.repartition(F.col(_FILE)).sortWithinPartitions(*place, "__kl_n").select(_FILE, "__kl_size", "__kl_text", "__kl_bytes")
    inner = pieces.filter(whole).unionByName(again.filter(whole)).select(_FILE, "__kl_cells", F.lit(False).alias("__kl_first"))
    return inner.unionByName(_over_rows(edges, join, _JOINED))


def load_csv(
    spark: SparkSession,
    source: str | DataFrame,
    columns: dict[str, str] | None = None,
    *,
    type: str = "rfc4180",
    delimiter: str = ",",
    record_terminator: str = "\n",
    enclosed_by: str = '"',
    escape: str = "\\",
    header: bool | list[str] = True,
    trim: bool = True,
    omit_empty_keys: bool = False,
    reject_on_duplicate: bool = False,
    reject_on_empty_key: bool = False,
    reject_on_materialized_type_error: bool = False,
    enforce_length: bool = False,
    null: str | None = None,
    plain: bool = False,
    format: str = "",
) -> Loaded:
    """CSV: quotes doubled (``rfc4180``) or characters escaped (``traditional``).

    The four characters count for ``traditional`` only.  Quoted line breaks are
    allowed; a file is read by many tasks all the same, and only a record must fit in
    memory.  What was read is kept on the executors' disks while the result is in use.
    ``null`` turns equal cells into empty ones.  With ``plain`` the table has
    ``columns`` only: cells fill them by place, and a record with more or fewer cells
    is refused.
    """
    if type not in ("rfc4180", "traditional"):
        raise ValueError("type is rfc4180 or traditional")
    if type == "rfc4180":
        delimiter, record_terminator, enclosed_by, escape = ",", "\n", '"', '"'
    else:
        four = [delimiter, record_terminator, enclosed_by, escape]
        if len(set(four)) < 4 or not all(len(c) == 1 and c.isascii() for c in four):
            raise ValueError("delimiter, terminator, quote and escape are four different ASCII characters")

    if type == "traditional":
        end = re.escape(record_terminator)
        cells_of, lines_of = lambda lines: escaped_cells(lines, delimiter, record_terminator, enclosed_by, escape), re.compile(f"[^{end}]*{end}|[^{end}]+").findall
        ways, blank = ["", enclosed_by, f"{escape}x"], {record_terminator}
    else:
        cells_of, lines_of = quoted_cells, lambda text: io.StringIO(text, newline="")
        ways, blank = ["", '"'], {"\n", "\r", "\r\n"}
    if not isinstance(source, DataFrame):
        df = _file_cells(spark, source, record_terminator, cells_of, lines_of, ways, blank)
        df = df.withColumn("__kl_cells", F.transform("__kl_cells", X.ascii_trim)) if trim else df
        joined, reason, head = F.array_join("__kl_cells", delimiter), F.lit(None).cast("string"), None
        if header is True:
            folded = F.transform("__kl_names", ascii_lower)
            bad = F.lit(False)
            if reject_on_empty_key:
                bad = bad | F.array_contains(folded, F.lit(""))
            if reject_on_duplicate:
                bad = bad | (F.size(F.array_distinct(folded)) < F.size(folded))
            names = df.filter("__kl_first").select(F.col(_FILE).alias("__kl_f"), F.col("__kl_cells").alias("__kl_names"))
            df = _by_file(df, names, files=spark.read.text(source)).filter(~bad | F.col("__kl_first")).filter(bad | ~F.col("__kl_first"))
            reason, head = F.when(F.col("__kl_first"), "bad header"), F.col("__kl_names")
        elif isinstance(header, list) and header:
            head = F.array(*[F.lit(n) for n in header])
        if plain:
            n, head = len(columns or {}), F.array(*[F.lit(c) for c in columns or {}]).cast("array<string>")
            reason = F.coalesce(reason, F.when(F.size("__kl_cells") != n, F.concat(F.size("__kl_cells").cast("string"), F.lit(f" cells for {n} columns"))))
        values = F.col("__kl_cells") if null is None else F.transform("__kl_cells", lambda c: F.when(c == null, "").otherwise(c))
        made = normalize_vmap(X.delimited_pairs(values, head, empty_null=False, omit_empty=omit_empty_keys))
        parsed = df.select(F.when(reason.isNull(), made).alias(_VMAP), reason.alias(_REASON), joined.alias(_RECORD))
        return finish(parsed, columns, reject_type_errors=reject_on_materialized_type_error, enforce_length=enforce_length)

    def parse(text: str):
        names = list(header) if isinstance(header, list) else None
        rows = cells_of(lines_of(text))
        while True:
            try:
                cells = next(rows, None)
            except csv.Error as e:  # such as a NUL byte: what follows cannot be told apart
                yield None, f"malformed: {e}", None
                return
            if cells is None:
                return
            if not cells:
                continue
            cells = [c.strip(SPACE) for c in cells] if trim else cells
            if header is True and names is None:
                names = cells
                folded = [X._fold(n) for n in names]
                if (reject_on_empty_key and "" in folded) or (reject_on_duplicate and len(set(folded)) < len(folded)):
                    yield None, "bad header", delimiter.join(cells)
                    return
                continue
            if plain and len(cells) != len(columns or {}):
                yield None, f"{len(cells)} cells for {len(columns or {})} columns", delimiter.join(cells)
                continue
            pairs = []
            for i, cell in enumerate(cells):
                name = list(columns)[i] if plain else names[i] if names and i < len(names) else f"ucol{i}"
                if not (omit_empty_keys and name == ""):
                    pairs.append((name, "" if cell == null else cell, False))
            yield sorted_pairs(pairs), None, delimiter.join(cells)

    parsed = _many(records(spark, source, None), parse)  # a row's text is in memory as it is
    return finish(parsed, columns, reject_type_errors=reject_on_materialized_type_error, enforce_length=enforce_length)


def load_pairs(
    spark: SparkSession, source: str | DataFrame, columns: dict[str, str] | None = None, *, delimiter: str = ",", record_terminator: str = "\n", trim: bool = True, format: str = ""
) -> Loaded:
    """Records of ``key=value`` cells."""
    df = records(spark, source, record_terminator).filter(F.col(_RECORD) != "")
    return finish(_parsed(df, X.pairs_vmap(F.col(_RECORD), delimiter=delimiter, trim=trim)), columns)


def load_cef(
    spark: SparkSession,
    source: str | DataFrame,
    columns: dict[str, str] | None = None,
    *,
    delimiter: str = " ",
    record_terminator: str = "\n",
    trim: bool = True,
    reject_on_unescaped_delimiter: bool = False,
    format: str = "",
) -> Loaded:
    """Common event format; records of a plain shape are taken apart by built-in expressions."""
    df = records(spark, source, record_terminator).filter(F.col(_RECORD) != "")
    plain = X.plain_cef(F.col(_RECORD)) if delimiter == " " and trim and not reject_on_unescaped_delimiter else F.lit(False)
    parse = lambda t: X.cef_pairs(t, delimiter=delimiter, trim=trim, reject_on_unescaped_delimiter=reject_on_unescaped_delimiter)
    made = df.withColumn("__kl_p", plain).withColumn("__kl_r", X.checked(parse)(F.when(~F.col("__kl_p"), F.col(_RECORD))))
    vmap = F.when(F.col("__kl_p"), X.plain_cef_vmap(F.col(_RECORD))).otherwise(F.col("__kl_r.vmap"))
    return finish(_parsed(made, vmap, F.col("__kl_r.reason")), columns)


def load_regex(
    spark: SparkSession,
    source: str | DataFrame,
    columns: dict[str, str] | None = None,
    *,
    pattern: str,
    record_terminator: str = "\n",
    loglinecolumn: str = "",
    use_jit: bool = True,
    plain: bool = False,
) -> Loaded:
    """The named groups of a pattern; lines without a match are dropped, not refused.

    With ``plain`` the table has ``columns`` only, and every group must be one of them.
    """
    if loglinecolumn and loglinecolumn not in (columns or {}):
        raise ValueError(f"no column {loglinecolumn}")
    if plain:
        known = {c.lower() for c in columns or {}}
        lost = [n for n in X.java_pattern(pattern)[1] if n.lower() not in known]
        if lost:
            raise ValueError(f"groups that are no columns: {lost}")
    parsed = _parsed(records(spark, source, record_terminator), X.mapregexextractor(F.col(_RECORD), pattern=pattern))
    parsed = parsed.filter(F.col(_VMAP).isNotNull())
    return finish(parsed, columns, given={loglinecolumn: F.col(_RECORD)} if loglinecolumn else None)


def load_idx(spark: SparkSession, source: str | DataFrame, columns: dict[str, str] | None = None, *, store_content: bool = True) -> Loaded:
    """IDX documents, each ended by ``#DREENDDOC``.

    What follows ``#DREENDDATA`` in a file, or in a row of a DataFrame, is dropped.
    """
    df = records(spark, source, "#DREENDDOC", placed=True)
    ended = F.col(_RECORD).contains("#DREENDDATA")
    if not isinstance(source, DataFrame):
        ends = df.filter(ended).groupBy(F.col(_FILE).alias("__kl_f")).agg(F.min(_AT).alias("__kl_end"))
        df = _by_file(df, ends, "left").filter(F.col("__kl_end").isNull() | (F.col(_AT) <= F.col("__kl_end")))
    df = df.select(F.regexp_replace(_RECORD, r"(?s)#DREENDDATA.*\z", "").alias(_RECORD)).filter(F.col(_RECORD).contains("#DRE"))
    return finish(_checked(df, lambda t: X.idx_pairs(t, store_content=store_content)), columns)


def load_dc(spark: SparkSession, source: str | DataFrame, columns: dict[str, str] | None = None, *, format: str = "") -> Loaded:
    """Data-collector records of ``key:value`` lines, each ended by a line with a dot."""
    df = records(spark, source, "\n.\n").filter(F.col(_RECORD).rlike(r"[^\s]"))
    return finish(_parsed(df, X.dc_vmap(F.col(_RECORD))), columns)


def load_avro(
    spark: SparkSession,
    source: str | DataFrame,
    columns: dict[str, str] | None = None,
    *,
    reject_on_materialized_type_error: bool = False,
    enforce_length: bool = False,
    plain: bool = False,
    **options,
) -> Loaded:
    """Avro container files, or a binary column ``content`` of such.

    With ``plain`` the table has ``columns`` only, and a record's fields fill them by place.
    A file is one task.
    """
    from .avro import AvroOptions, container_rows

    o, by_place = AvroOptions(**options), list(columns or {}) if plain else None
    df = source.select("content") if isinstance(source, DataFrame) else spark.read.format("binaryFile").load(source).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (data for batch in batches for data in batch.column(0).to_pylist() if data is not None)
        return _handed((pairs, None, None) for data in files for pairs in container_rows(data, o, by_place))

    return finish(df.mapInArrow(run, _PARSED), columns, reject_type_errors=reject_on_materialized_type_error, enforce_length=enforce_length)
