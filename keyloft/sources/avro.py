"""Avro containers and messages as vmaps, in plain Python."""

from __future__ import annotations

import binascii
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..functions.vmap import VMAP, Pair, nest, sorted_pairs, to_arrow


@dataclass(frozen=True)
class AvroOptions:
    flatten_maps: bool = True
    flatten_arrays: bool = False
    flatten_records: bool = True


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def blob(self) -> bytes:
        return self.take(self.long())

    def blocks(self) -> Iterator[None]:
        """One turn for each item of an array or map."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            for _ in range(n):
                yield


def _names(schema, known: dict, space: str = "") -> dict:
    """Named types below a schema, under their full and simple names."""
    if isinstance(schema, list):
        for s in schema:
            _names(s, known, space)
    elif isinstance(schema, dict):
        space = schema.get("namespace", space)
        if "name" in schema:
            known[schema["name"]] = known[f"{space}.{schema['name']}" if space else schema["name"]] = schema
        for part in ("items", "values"):
            if part in schema:
                _names(schema[part], known, space)
        for field in schema.get("fields", ()):
            _names(field["type"], known, space)
        if isinstance(schema.get("type"), (dict, list)):
            _names(schema["type"], known, space)
    return known


def _number(x: float) -> str:
    return repr(x)


def decode(schema, r: Reader, known: dict):
    """A datum as (kind, type name, content)."""
    if isinstance(schema, str) and schema in known:
        schema = known[schema]
    if isinstance(schema, list):
        return decode(schema[r.long()], r, known)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return decode(kind, r, known)
    if kind == "record":
        return "record", schema["name"], [(f["name"], decode(f["type"], r, known)) for f in schema["fields"]]
    if kind == "enum":
        return "enum", schema["name"], schema["symbols"][r.long()]
    if kind == "array":
        return "array", "", [decode(schema["items"], r, known) for _ in r.blocks()]
    if kind == "map":
        return "map", "", [(r.blob().decode(), decode(schema["values"], r, known)) for _ in r.blocks()]
    if kind == "fixed":
        return "text", "", r.take(schema["size"]).decode("utf-8", "replace")
    plain = {
        "null": lambda: "",
        "boolean": lambda: "true" if r.take(1)[0] else "false",
        "int": lambda: str(r.long()),
        "long": lambda: str(r.long()),
        "float": lambda: _number(struct.unpack("<f", r.take(4))[0]),
        "double": lambda: _number(struct.unpack("<d", r.take(8))[0]),
        "bytes": lambda: r.blob().decode("utf-8", "replace"),
        "string": lambda: r.blob().decode("utf-8", "replace"),
    }
    if kind not in plain:
        raise ValueError(f"unknown type {kind!r}")
    return "text", "", plain[kind]()


def _join(path: list[str], last: str) -> str:
    return ".".join([*path, last])


def _put(datum, path: list[str], name: str, o: AvroOptions, out: list[Pair]) -> None:
    """Add a datum that is called ``name`` below ``path``."""
    kind, type_name, content = datum
    if kind == "text":
        out.append((_join(path, name), content, False))
    elif kind == "enum":
        out.append((_join(path, type_name), content, False))
    elif kind == "record":
        if o.flatten_records:
            _members(datum, [*path, name], o, out)
        else:
            out.append((_join(path, name), nest(_members(datum, [], o, [])), True))
    elif kind == "map":
        if o.flatten_maps:
            for k, v in content:
                _put(v, [*path, name], k, o, out)
        else:
            inner: list[Pair] = []
            for k, v in content:
                _put(v, [], k, o, inner)
            out.append((_join(path, name), nest(inner), True))
    elif o.flatten_arrays:
        for i, v in enumerate(content):
            _put(v, [*path, str(i)], name, o, out)
    else:
        inner = []
        for i, v in enumerate(content):
            _put(v, [], str(i), o, inner)
        out.append((_join(path, name), nest(inner), True))


def _members(datum, path: list[str], o: AvroOptions, out: list[Pair]) -> list[Pair]:
    out.append((_join(path, "__name__"), datum[1], False))
    for name, inner in datum[2]:
        _put(inner, path, name, o, out)
    return out


def row_of(datum, o: AvroOptions, number: int = 0) -> list[Pair]:
    """A top-level datum as sorted pairs; one without names is ``ucol<number>``."""
    out: list[Pair] = []
    if datum[0] == "record":
        _members(datum, [], o, out)
    elif datum[0] == "map":
        for k, v in datum[2]:
            _put(v, [], k, o, out)
    else:
        _put(datum, [], f"ucol{number}", o, out)
    return sorted_pairs(out)


def message_row(data: bytes, schema: str, o: AvroOptions | None = None) -> list[Pair]:
    """One message without a container, of a known schema."""
    parsed = json.loads(schema)
    return row_of(decode(parsed, Reader(data), _names(parsed, {})), o or AvroOptions())


def avro_vmap(message: Column, schema: str, **options) -> Column:
    """Messages of a known schema, such as a queue delivers, as vmaps; null for null."""
    o = AvroOptions(**options)

    @F.arrow_udf(VMAP)
    def run(messages: pa.Array) -> pa.Array:
        return to_arrow(None if m is None else message_row(m, schema, o) for m in messages.to_pylist())

    return run(message)


def _snappy(block: bytes) -> bytes:
    body, crc = block[:-4], struct.unpack(">I", block[-4:])[0]
    size, shift = 0, 0
    for b in body:
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    data = pa.decompress(body, size, codec="snappy", asbytes=True)
    if binascii.crc32(data) != crc:
        raise ValueError("a block's checksum is wrong")
    return data


def _placed(datum, names: list[str], o: AvroOptions) -> list[Pair]:
    """A record's fields under other names, by place; those beyond the names are left out."""
    if datum[0] != "record":
        raise ValueError("fields are filled by place from records only")
    out: list[Pair] = []
    for name, (_, inner) in zip(names, datum[2]):
        made: list[Pair] = []
        _put(inner, [], name, o, made)
        out.append((name, made[0][1] if len(made) == 1 else nest(made), len(made) != 1 or made[0][2]))
    return sorted_pairs(out)


def container_rows(data: bytes, o: AvroOptions, names: list[str] | None = None) -> Iterator[list[Pair]]:
    """The rows of a container file, or its records' fields under ``names``; codecs null and snappy."""
    r = Reader(data)
    if r.take(4) != b"Obj\x01":
        raise ValueError("not an Avro container")
    meta = {r.blob().decode(): r.blob() for _ in r.blocks()}
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "snappy"):
        raise ValueError(f"codec {codec} is not supported")
    schema = json.loads(meta["avro.schema"])
    known = _names(schema, {})
    sync, number = r.take(16), 0
    while r.at < len(data):
        n = r.long()
        block = r.blob()
        inner = Reader(_snappy(block) if codec == "snappy" else block)
        for _ in range(n):
            datum = decode(schema, inner, known)
            yield row_of(datum, o, number) if names is None else _placed(datum, names, o)
            number += 1
        if r.take(16) != sync:
            raise ValueError("a sync marker is wrong")
