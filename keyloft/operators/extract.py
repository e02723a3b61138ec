"""Inline extractors and record parsers: a text becomes a vmap, or is rejected.

Delimited, paired, pattern and data-collector records are parsed by built-in
expressions.  JSON with exact number text, CEF and IDX records need a scanner and
go through Arrow, a batch at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..functions.text import SPACE, ascii_lower, ascii_trim
from ..functions.vmap import ARROW_VMAP, VMAP, Pair, _fold, nest, normalize_vmap, pair, sorted_pairs, to_arrow


class Rejected(ValueError):
    """A record that a parser refuses; the message is the reason."""


class Action(Enum):
    """What an extractor does with a value it refuses."""

    NONE = "None"
    LOG_DEBUG = "LogDebug"
    LOG_ALWAYS = "LogAlways"
    WARN = "Warn"
    ABORT = "Abort"

    @classmethod
    def of(cls, name: str) -> Action:
        for action in cls:
            if action.value.lower() == name.lower():
                return action
        raise ValueError(f"unknown action {name!r}")


@dataclass(frozen=True)
class JsonOptions:
    flatten_maps: bool = True
    flatten_arrays: bool = False
    start_point: str = ""
    start_point_occurrence: int = 1
    omit_empty_keys: bool = False
    reject_on_duplicate: bool = False
    reject_on_empty_key: bool = False
    suppress_nonalphanumeric_key_chars: bool = False
    key_separator: str = "."

    @property
    def separator(self) -> str:
        return self.key_separator if len(self.key_separator) == 1 else "."


class Members(list):
    """An object's members in the order of the text, repeated ones too."""


class ExactDecoder(json.JSONDecoder):
    """Keeps repeated members and the text of numbers."""

    def __init__(self) -> None:
        super().__init__(object_pairs_hook=Members, parse_float=str, parse_int=str, parse_constant=str, strict=False)

    def __reduce__(self):
        return ExactDecoder, ()


_DECODER = ExactDecoder()
#: Halves of surrogate pairs, as they are escaped.
_HALF = re.compile(r"\\u[dD][89a-fA-F]")
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_BLANK = re.compile(r"[ \t\n\r]*")


def _whole(value):
    """A value without halves of surrogate pairs."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, Members):
        return Members((_whole(k), _whole(v)) for k, v in value)
    return [_whole(v) for v in value] if isinstance(value, list) else value


def json_values(text: str) -> Iterator:
    """The concatenated JSON values of a text; raises ``ValueError`` at what is none."""
    if "//" in text or "/*" in text:
        text = _COMMENT.sub(lambda m: m.group(1) or " ", text)
    at = _BLANK.match(text, 0).end()
    half = bool(_HALF.search(text))
    while at < len(text):
        value, at = _DECODER.raw_decode(text, at)
        yield _whole(value) if half else value
        at = _BLANK.match(text, at).end()


def _members(value) -> Members:
    return value if isinstance(value, Members) else Members((str(i), v) for i, v in enumerate(value))


def _scalar(value) -> str | None:
    return None if value is None else "T" if value is True else "F" if value is False else value


def _flatten(members: Members, o: JsonOptions, prefix: str | None, out: list[Pair]) -> list[Pair]:
    for key, value in members:
        if key == "" and o.reject_on_empty_key:
            raise Rejected("empty key")
        if o.suppress_nonalphanumeric_key_chars and len(key.encode()) <= 1024:
            key = "".join(c if c.isascii() and c.isalnum() else "_" * len(c.encode()) for c in key)
        name = key if prefix is None else prefix + o.separator + key
        inner = isinstance(value, list)
        if inner and (o.flatten_maps if isinstance(value, Members) else o.flatten_arrays):
            _flatten(_members(value), o, name, out)
        elif not (key == "" and o.omit_empty_keys):
            if inner:
                out.append((name, nest(_flatten(_members(value), o, None, [])), True))
            else:
                out.append((name, _scalar(value), False))
    return out


def json_row(members: Members, o: JsonOptions) -> list[Pair]:
    """One object as sorted pairs."""
    pairs = _flatten(members, o, None, [])
    if o.reject_on_duplicate:
        seen = [_fold(k) for k, _, _ in pairs]
        if len(set(seen)) < len(seen):
            raise Rejected("duplicate key")
    return sorted_pairs(pairs)


def _start(value, o: JsonOptions, left: list[int]):
    """The start point's n-th map or array below ``value``, in the order of the text."""
    named = isinstance(value, Members)
    for key, inner in _members(value):
        if isinstance(inner, list):
            if named and key == o.start_point:
                left[0] -= 1
                if not left[0]:
                    return inner
            found = _start(inner, o, left)
            if found is not None:
                return found
    return None


def _objects(value) -> Iterator[Members]:
    """Arrays at the top are transparent."""
    if isinstance(value, Members):
        yield value
    elif isinstance(value, list):
        for inner in value:
            yield from _objects(inner)
    else:
        raise ValueError("a bare value is no record")


def json_records(text: str, o: JsonOptions) -> Iterator[Members]:
    """The objects of a text that become rows."""
    if not o.start_point:
        for value in json_values(text):
            yield from _objects(value)
        return
    left = [o.start_point_occurrence]
    for value in json_values(text):
        root = _start(value, o, left) if isinstance(value, list) else None
        if root is not None:
            yield from _objects(root)
            return
    raise ValueError("start point not found")


def mapjsonextractor(text: Column, *, reject_action: str = "Warn", error_action: str = "Abort", **options) -> Column:
    """One JSON object as a vmap; null for null, empty or refused text.

    More or less than one object is refused under ``reject_action``, malformed
    text, also text that is nested too deeply, under ``error_action``.  Abort raises, and
    so does Warn, which is how such a statement ends; the others give null.

    Flat objects of unescaped names and values, of ``FLAT_SIZE`` characters at most, are
    taken apart by built-in expressions with the same result; the rest go through Arrow.
    """
    o = JsonOptions(**options)
    reject, error = Action.of(reject_action), Action.of(error_action)
    raising = (Action.ABORT, Action.WARN)

    @F.arrow_udf(VMAP)
    def extract(texts: pa.Array) -> pa.Array:
        out = []
        for raw in texts.to_pylist():
            row = None
            if raw:
                try:
                    found = list(json_records(raw, o))
                    if len(found) != 1:
                        raise Rejected(f"one object is needed, not {len(found)}")
                    row = json_row(found[0], o)
                except Rejected:
                    if reject in raising:
                        raise
                except RecursionError as e:
                    if error in raising:
                        raise ValueError("nested too deeply") from e
                except ValueError:
                    if error in raising:
                        raise
            out.append(row)
        return to_arrow(out)

    if o.start_point or o.reject_on_duplicate or o.reject_on_empty_key or o.suppress_nonalphanumeric_key_chars:
        return extract(text)
    flat = F.when(F.length(text) <= FLAT_SIZE, text.rlike(_FLAT))
    simple = F.coalesce(flat, F.lit(False))
    return F.when(simple, _flat_vmap(text, o)).otherwise(extract(F.when(~simple, text)))


#: Longer texts are not tried by the pattern of flat objects.
FLAT_SIZE = 2000
_WORD = r'"[^"\\]*"'
_PLAIN = rf"{_WORD}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null"
_MEMBER = rf"[ \t\n\r]*{_WORD}[ \t\n\r]*:[ \t\n\r]*(?:{_PLAIN})[ \t\n\r]*"
_FLAT = rf"\A[ \t\n\r]*\{{(?:[ \t\n\r]*|{_MEMBER}(?:,{_MEMBER})*+)\}}[ \t\n\r]*\z"


def _flat_vmap(text: Column, o: JsonOptions) -> Column:
    """A text that ``_FLAT`` matches as a vmap."""
    member = rf"({_WORD})[ \t\n\r]*:[ \t\n\r]*({_PLAIN})"
    keys, values = (F.regexp_extract_all(text, F.lit(member), F.lit(i)) for i in (1, 2))

    def bare(t: Column) -> Column:
        return F.substring(t, F.lit(2), F.length(t) - 2)

    def made(k: Column, v: Column) -> Column:
        value = F.when(F.startswith(v, F.lit('"')), bare(v)).when(v == "true", "T").when(v == "false", "F").when(v != "null", v)
        return pair(bare(k), value)

    pairs = normalize_vmap(F.zip_with(keys, values, made))
    return F.filter(pairs, lambda p: p["key"] != "") if o.omit_empty_keys else pairs


def fast_json_vmap(text: Column) -> Column:
    """A flat JSON object as a vmap by built-in expressions.

    For texts with unique keys whose number texts need not be kept as written;
    malformed text gives null.
    """
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.when(text != "", normalize_vmap(F.transform(entries, lambda e: pair(e["key"], e["value"]))))


def _cells(text: Column, delimiter: str, trim: bool) -> Column:
    parts = F.split(text, re.escape(delimiter), -1)
    return F.transform(parts, ascii_trim) if trim else parts


def delimited_pairs(cells: Column, header: Column | None, *, empty_null: bool = True, omit_empty: bool = False) -> Column:
    """Cells under their header's names; cells without one are ``ucol<N>``, counted from 0."""

    def named(cell: Column, i: Column) -> Column:
        generic = F.concat(F.lit("ucol"), i.cast("string"))
        name = generic if header is None else F.coalesce(F.get(header, i), generic)
        return pair(name, F.when(cell != "", cell) if empty_null else cell)

    made = F.transform(cells, named)
    return F.filter(made, lambda p: p["key"] != "") if omit_empty else made


def mapdelimitedextractor(
    text: Column, *, delimiter: str = "|", trim: bool = True, header_names: str = "", treat_empty_val_as_null: bool = True
) -> Column:
    """A delimited record as a vmap, by built-in expressions; no quotes, no escapes."""
    header = None
    if header_names:
        names = [n.strip(SPACE) if trim else n for n in header_names.split(delimiter)]
        header = F.array(*[F.lit(n) for n in names])
    made = delimited_pairs(_cells(text, delimiter, trim), header, empty_null=treat_empty_val_as_null)
    return F.when(text != "", normalize_vmap(made))


def java_pattern(pattern: str) -> tuple[str, list[str]]:
    """A pattern with named groups for Spark's engine, and the groups' names in order.

    ``(?P<n>`` becomes ``(?<n>``; underscores, which Java refuses in names, are
    dropped from the pattern but kept in the names.  Unnamed groups are an error.
    """
    names: list[str] = []
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        if c == "(" and not in_class:
            m = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>|\(\?P?'([A-Za-z_]\w*)'").match(pattern, i)
            if m:
                names.append(m.group(1) or m.group(2))
                out.append(f"(?<g{len(names)}>")
                i = m.end()
                continue
            if not pattern.startswith("(?", i):
                raise ValueError("every group must have a name")
        out.append(c)
        i += 1
    return "".join(out), names


def mapregexextractor(text: Column, *, pattern: str) -> Column:
    """The named groups of the first match, by built-in expressions; null without one.

    Groups that match nothing, or the empty string, give no key.
    """
    java, names = java_pattern(pattern)
    groups = F.array(*[pair(F.lit(n), F.regexp_extract(text, java, i + 1)) for i, n in enumerate(names)])
    return F.when(text.rlike(java), normalize_vmap(F.filter(groups, lambda p: p["value"] != "")))


def pairs_vmap(text: Column, *, delimiter: str = ",", trim: bool = True) -> Column:
    """A record of ``key=value`` cells: small keys, split at the first ``=``, other cells ignored."""
    clean = ascii_trim if trim else (lambda c: c)
    cells = F.filter(F.split(text, re.escape(delimiter), -1), lambda c: F.contains(c, F.lit("=")))

    def made(c: Column) -> Column:
        return pair(
            ascii_lower(clean(F.regexp_extract(c, r"(?s)\A([^=]*)=", 1))), clean(F.regexp_extract(c, r"(?s)\A[^=]*=(.*)\z", 1))
        )

    return normalize_vmap(F.transform(cells, made))


def dc_vmap(text: Column) -> Column:
    """A data-collector record: lines of ``key:value``, split at the first colon, nothing trimmed."""
    lines = F.filter(F.split(text, "\n", -1), lambda c: F.contains(c, F.lit(":")))
    return normalize_vmap(
        F.transform(lines, lambda c: pair(F.regexp_extract(c, r"\A([^:]*):", 1), F.regexp_extract(c, r"(?s)\A[^:]*:(.*)\z", 1)))
    )


#: The fields of a CEF header.
CEF_HEADER = ["version", "devicevendor", "deviceproduct", "deviceversion", "signatureid", "name", "severity"]
_CEF_FIELD = re.compile(r"((?:\\.|[^\\|])*)\|", re.S)


def _unescaped(text: str) -> str:
    """Backslashes go, doubled ones become one; before n and r they stay."""
    return re.sub(r"\\(.)", lambda m: m.group(0) if m.group(1) in "nr" else m.group(1), text, flags=re.S)


def cef_pairs(record: str, *, delimiter: str = " ", trim: bool = True, reject_on_unescaped_delimiter: bool = False) -> list[Pair]:
    """A CEF record; without the ``CEF:`` prefix only pairs are read."""
    clean = (lambda s: s.strip(SPACE)) if trim else (lambda s: s)
    pairs: list[Pair] = []
    at = 0
    head = record.lstrip(SPACE)
    if head.startswith("CEF:"):
        record, at = head, 4
        for name in CEF_HEADER:
            m = _CEF_FIELD.match(record, at)
            if not m and name == CEF_HEADER[-1] and at < len(record):  # the last field may end the record
                m = re.compile(r"(.*)", re.S).match(record, at)
            if not m:
                raise Rejected("header has too few fields")
            pairs.append((name, _unescaped(clean(m.group(1))), False))
            at = m.end()
    rest = record[at:]
    signs = [m.start() for m in re.finditer(r"\\.|=", rest, re.S) if m.group() == "="]
    start = 0
    for i, sign in enumerate(signs):
        key = rest[start:sign]
        if i + 1 < len(signs):
            cut = rest.rfind(delimiter, sign + 1, signs[i + 1])
            end = cut if cut >= 0 else signs[i + 1]
        else:
            end = len(rest)
        value = rest[sign + 1 : end]
        if reject_on_unescaped_delimiter and re.search(r"(?<!\\)" + re.escape(delimiter), value.strip(SPACE)):
            raise Rejected("delimiter in a value")
        pairs.append((_fold(clean(key)), _unescaped(clean(value)), False))
        start = end + len(delimiter)
    return sorted_pairs(pairs)


_CEF_PART = r"((?:\\.|[^\\|])*+)"
_CEF_KEY, _CEF_VALUE = r"[^ =\\]+", r"(?:\\.|[^\\=])*?"
_CEF_NEXT = rf"(?: (?={_CEF_KEY}=)|\z)"
_CEF_PLAIN = rf"(?s)\A[ \t\n\x0B\f\r]*CEF:(?:{_CEF_PART[1:-1]}\|){{7}}(?:[ \t]*|(?:{_CEF_KEY}={_CEF_VALUE}{_CEF_NEXT})+)\z"


def plain_cef(text: Column) -> Column:
    """Whether a record, parted by spaces, is of a plain shape: a whole header, then keys without spaces or escapes."""
    return F.coalesce(F.when(F.length(text) <= FLAT_SIZE, text.rlike(_CEF_PLAIN)), F.lit(False))


def plain_cef_vmap(text: Column) -> Column:
    """A record that :func:`plain_cef` allows as a vmap, as :func:`cef_pairs` has it."""
    head = r"(?s)\A[ \t\n\x0B\f\r]*CEF:" + r"\|".join([_CEF_PART] * 7) + r"\|"
    clean = lambda c: F.regexp_replace(ascii_trim(c), r"(?s)\\([^nr])", "$1")
    fields = F.array(*[pair(F.lit(n), clean(F.regexp_extract(text, head, i + 1))) for i, n in enumerate(CEF_HEADER)])
    rest = F.regexp_replace(text, head, "")
    member = rf"(?s)({_CEF_KEY})=({_CEF_VALUE}){_CEF_NEXT}"
    keys, values = (F.regexp_extract_all(rest, F.lit(member), F.lit(i)) for i in (1, 2))
    return normalize_vmap(F.concat(fields, F.zip_with(keys, values, lambda k, v: pair(ascii_lower(ascii_trim(k)), clean(v)))))


_IDX_TAG = re.compile(r"^#(DRE[A-Z]+)[ \t]?", re.M)
_IDX_FIELD = re.compile(r'\s*([^\s="]+)\s*=\s*"([^"]*)"')


def idx_pairs(record: str, *, store_content: bool = True) -> list[Pair]:
    """An IDX document, from its first tag to before ``#DREENDDOC``."""
    tags = list(_IDX_TAG.finditer(record))
    pairs: list[Pair] = []
    for m, after in zip(tags, [*tags[1:], None], strict=True):
        body = record[m.end() : after.start() if after else len(record)]
        tag = m.group(1)
        if tag == "DREFIELD":
            f = _IDX_FIELD.match(body)
            if f and len(f.group(1).encode()) < 256:
                pairs.append((_fold(f.group(1)), f.group(2), False))
        elif tag in ("DREREFERENCE", "DREDATE", "DREDBNAME"):
            pairs.append((_fold(tag), body.split("\n", 1)[0].strip(SPACE), False))
        elif tag == "DRETITLE" or (tag == "DRECONTENT" and store_content):
            pairs.append((_fold(tag), body.strip(SPACE), False))
    return sorted_pairs(pairs)


def checked(parse: Callable[[str], list[Pair]]) -> Callable[[Column], Column]:
    """A Python record parser as a column of (vmap, reason); a refused record has the reason only."""
    kind = pa.struct([("vmap", ARROW_VMAP), ("reason", pa.string())])

    @F.arrow_udf(f"struct<vmap:{VMAP},reason:string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            pairs, reason = None, None
            if text is not None:
                try:
                    pairs = [{"key": k, "value": v, "is_map": m} for k, v, m in parse(text)]
                except ValueError as e:
                    reason = str(e) or "refused"
            out.append({"vmap": pairs, "reason": reason})
        return pa.array(out, kind)

    return run
