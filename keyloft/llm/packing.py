"""Packing by power-of-two decomposition.

Every document is split into pieces whose lengths are powers of two, the
largest first, so a sequence holds one piece of one document and needs no
padding.  Pieces of equal length share a bucket: the bucket's exponent is the
leading part of ``sequence_id``, so a sort or a range partition by that id
gathers batches of one shape.

The work is one narrow pass over the documents: no shuffle, no state between
tasks, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import FOLD, raw_texts, release_memory

#: Texts are encoded about this many bytes at a time.
TEXT_BYTES = 2_000_000
#: Distinct words whose ids a worker remembers; the store is emptied when full.
CACHE_WORDS = 800_000
#: Longer words are encoded each time, so the store stays small.
CACHE_WORD_BYTES = 200
#: A control character that stands between words encoded together, and how many are.
BORDER = b"\x01"
JOINED = 500
#: Marks that the tokenizer splits off after a letter or digit; no apostrophe, which opens endings.
MARKS = re.compile(rb"""(?<=[a-z0-9])([,.;:!?|)"]+)(?=[\x20\x09-\x0D]|\Z)""")
#: The module in which a worker keeps its encoder.
STATE = "keyloft_packing_state"
#: Output rows are handed over in batches of about this many bytes of ids.
BATCH_BYTES = 4_000_000


class WordEncoder:
    """Ids of whole texts for a tokenizer that never joins across ASCII white space.

    The tokenizer's normalizer and splitter treat white space as a border, so a
    text's ids are its words' ids in a row.  A mark at the end of a word, after a
    letter or digit, is split off by it as well, and case is folded; so texts are
    folded and marks parted from words before any word is looked up.  Only new words
    are encoded, many in one text with a control character between them.  Ids are
    little-endian uint32.
    """

    def __init__(self, definition: str, special_as_text: bool = False, remembered: int = CACHE_WORDS):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_as_text
        self.known: dict[bytes, bytes] = {}
        border = self._ids(BORDER)
        self.border = int(border[0]) if len(border) == 1 else None

    def _ids(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(found, dtype="<u4")

    def _encode(self, words: list[bytes]) -> list[bytes]:
        joined = [w for w in words if self.border is not None and BORDER not in w and b"<|" not in w]
        out = {}
        for lo in range(0, len(joined), JOINED):
            part = joined[lo : lo + JOINED]
            ids = self._ids((b" " + BORDER + b" ").join(part))
            ends = [*np.flatnonzero(ids == self.border).tolist(), len(ids)]
            if len(ends) == len(part):
                start = 0
                for w, end in zip(part, ends, strict=True):
                    out[w] = ids[start:end].tobytes()
                    start = end + 1
        return [out[w] if w in out else self._ids(w).tobytes() for w in words]

    def words(self, raw: bytes | None) -> list[bytes]:
        """Pieces of a text whose ids in a row are the text's: words, and marks at their ends."""
        if not raw:
            return []
        if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw:  # special strings; marks that join with letters
            return raw.split()
        return MARKS.sub(rb" \1", raw.translate(FOLD)).split()

    def encode(self, raws: list[bytes | None]) -> list[bytes]:
        """Ids of each text.  Take texts of a few MB at a time: their new words are encoded together."""
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        texts = [self.words(raw) for raw in raws]
        new = [w for w in set().union(*texts) if w not in known]
        known.update(zip(new, self._encode(new), strict=True))
        out = [b"".join(map(known.__getitem__, ws)) for ws in texts]
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                del known[w]
        return out


def encoder_of(definition: str, special_as_text: bool, remembered: int = CACHE_WORDS) -> WordEncoder:
    """This process's encoder: what it has learnt serves later tasks of the same worker.

    Functions come to workers by value, without their modules, so it is kept in one of its own.
    """
    held = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__.setdefault("encoders", {})
    key = (hashlib.sha256(definition.encode()).digest(), special_as_text, remembered)
    if key not in held:
        held.clear()
        held[key] = WordEncoder(definition, special_as_text, remembered)
    return held[key]


def _encoded(encoder: WordEncoder, raws: list[bytes | None]) -> Iterator[bytes]:
    held, size = [], 0
    for raw in raws:
        held.append(raw)
        size += len(raw or b"")
        if size >= TEXT_BYTES:
            yield from encoder.encode(held)
            held, size = [], 0
    yield from encoder.encode(held)


def binary_lengths(n: int, limit: int) -> list[int]:
    """``n`` as full pieces of ``limit`` and then the powers of two of the rest, falling."""
    out = [limit] * (n // limit)
    rest = n % limit
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        out.append(piece)
        rest -= piece
    return out


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    end_id: int = 1,
    special_as_text: bool = False,
    remembered: int = CACHE_WORDS,
) -> DataFrame:
    """Pack ``docs`` into sequences of power-of-two length.

    Returns a row per piece: the id column, ``start``, ``length``, ``ids``
    (little-endian uint32 bytes), ``doc_tokens``, ``sequence_id`` and ``offset``.
    ``limit`` must be a power of two.  The tokenizer's file is read once on the
    driver and sent along; its size is that of the file.  A worker remembers the ids of
    about ``remembered`` words from task to task, a quarter of a kilobyte each.

    A null or empty text gives one piece that holds ``end_id`` alone.  Repeated
    rows and repeated ids are packed each for itself; a null id is kept.  An
    empty table gives an empty result.  A very long text is encoded whole, its words
    at a time, so a task needs about twenty times its bytes.  Other columns are
    ignored, whatever their names.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    narrow = docs.select(docs[id_col].alias("k"), docs[text_col].cast("string").alias("t"))
    id_field = narrow.schema["k"].dataType.simpleString()
    last = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value, special_as_text, remembered)
        part = TaskContext.get().partitionId()
        counts = [0] * 64

        def made(keys, cols):
            rows, start, length, ids, total, seq = cols
            key = keys.take(pa.array(rows, pa.int64()))
            arrays = [key, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            arrays += [pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array([0] * len(rows), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["k", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            cols, size = tuple([] for _ in range(6)), 0
            for row, ids in enumerate(_encoded(encoder, raw_texts(batch.column(1)))):
                ids += last
                n = len(ids) // 4
                at = 0
                for piece in binary_lengths(n, limit):
                    power = piece.bit_length() - 1
                    seq = (power << 58) | (part << 36) | counts[power]
                    counts[power] += 1
                    for c, v in zip(cols, (row, at, piece, ids[4 * at : 4 * (at + piece)], n, seq), strict=True):
                        c.append(v)
                    at += piece
                    size += 4 * piece + 48
                    if size >= BATCH_BYTES:
                        yield made(batch.column(0), cols)
                        cols, size = tuple([] for _ in range(6)), 0
            if cols[0]:
                yield made(batch.column(0), cols)
            release_memory()

    schema = f"k {id_field}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return narrow.mapInArrow(run, schema).withColumnRenamed("k", id_col)
