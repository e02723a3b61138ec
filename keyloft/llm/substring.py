"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``width`` consecutive words of one document.  Its fingerprint has 128
bits: 64 of a polynomial in its words' hashes, by which windows are sorted, and 64
of the words' own bytes, which are taken only where the first ones agree and
verify them.  Documents are dealt into blocks by rising id, fingerprints into
parts; both follow the size of the input.  Each part takes the blocks one after
the other as batches: a batch is a sorted list that is merge-joined with the
sorted immutable runs of all earlier ones, then becomes a run itself, and runs of
like size are compacted into one.

Two rounds keep the traffic small.  The first sends only as many bits of each
fingerprint as tell most windows apart, and learns which of them lie in more
than one batch.  The second verifies these, and these alone, by all 128 bits and
marks each batch's windows that an earlier batch has.  Repeats inside a batch are
found there.  A text that stands in thousands of documents is one entry a block.

:class:`SubstringIndex` keeps the runs as Parquet for later batches.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import _SPACE, mixed, pack_sorted, raw_texts, release_memory, sorted_unique, unpack_planes, unpack_sorted, word_hashes, word_spans

WIDTH = 20
#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
#: Bytes of text, about, whose windows a part answers for, where there are more than ``FEW_PARTS``.
PART_BYTES, FEW_PARTS = 64_000_000, 64
#: Stored fingerprints of a part of an index, about.
PART_ENTRIES = 8_000_000
#: Documents weigh one more for each so many bytes when blocks are cut.
WEIGHT_BYTES = 8192
#: Bits of the first round beyond those that number all windows: 1 in 2**12 is sent on in vain.
SPARE_BITS = 12
MULTIPLIER = 0xD6E8FEB86659FD93
#: So many runs of like size of a stored index are compacted into one.
FANOUT = 4


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial fingerprints of each ``width`` consecutive word hashes, well mixed."""
    wrap = (1 << 64) - 1
    have, out = 0, None
    single, size, step = words, 1, MULTIPLIER
    while True:
        if width & size:
            if out is None:
                out, have = single, size
            else:  # ``single`` comes before what is there
                n = len(words) - have - size + 1
                out = single[:n] * np.uint64(pow(MULTIPLIER, have, 1 << 64)) + out[size : size + n]
                have += size
        if size * 2 > width:
            break
        n = len(words) - 2 * size + 1
        single = single[:n] * np.uint64(step) + single[size : size + n]
        step = step * step & wrap
        size *= 2
    return mixed(out)


class Block:
    """Words and windows of some documents, by id, nulls last, then by a hash of the text."""

    def __init__(self, table: pa.Table, width: int):
        ids, raws = table.column("id").to_pylist(), raw_texts(table.column("t"))
        keys = [xxhash.xxh3_64_intdigest(raw or b"") for raw in raws]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, keys[i], raws[i] or b""))
        self.ids, self.width = [ids[i] for i in order], width
        raw = b" ".join([*((raws[i] or b"") for i in order), b""])
        buf = np.frombuffer(raw, np.uint8)
        starts, ends = word_spans(buf)
        sizes = np.fromiter((len(raws[i] or b"") + 1 for i in order), np.int64, len(order))
        self.doc = np.searchsorted(np.cumsum(sizes), starts, "right")
        self.sizes = np.bincount(self.doc, minlength=len(order))
        self.starts = np.cumsum(self.sizes) - self.sizes
        # Words in a row with one space after each: the bytes that windows are verified by and texts are kept as.
        space = _SPACE[buf]
        keep = ~space | np.r_[False, ~space[:-1]]
        self.bytes = np.where(space, np.uint8(32), buf)[keep]
        at = np.cumsum(ends - starts + 1)
        self.begin, self.end = at - (ends - starts + 1), at - 1
        n = len(starts) - width + 1
        if n <= 0:
            self.at, self.h1, self.h2 = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        self.at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        self.h1 = _rolled(word_hashes(buf, starts, ends), width)[self.at]
        self.h2, self.known = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), bool)

    def verified(self, windows: np.ndarray) -> np.ndarray:
        """The second fingerprints of some windows, of their bytes."""
        new = windows[~self.known[windows]] if len(windows) else windows
        if len(new):
            view, at = memoryview(self.bytes), self.at[new]
            spans = zip(self.begin[at].tolist(), self.end[at + self.width - 1].tolist(), strict=True)
            self.h2[new] = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(new))
            self.known[new] = True
        return self.h2[windows]

    def short_keys(self, bits: int) -> np.ndarray:
        return sorted_unique(self.h1 >> np.uint64(64 - bits))

    def pairs_in(self, short: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose short keys are listed: places, and the two hashes, in order of these."""
        own = np.flatnonzero(_held(short, self.h1 >> np.uint64(64 - bits)))
        own = own[np.argsort(self.h1[own], kind="stable")]
        h1, h2 = self.h1[own], self.verified(own)
        if ((h1[1:] == h1[:-1]) & (h2[1:] != h2[:-1])).any():
            order = np.lexsort((h2, h1))
            own, h1, h2 = own[order], h1[order], h2[order]
        return own, h1, h2

    def repeats(self) -> np.ndarray:
        """For each window: whether the block has it earlier."""
        later = np.zeros(len(self.at), bool)
        order = np.argsort(self.h1)
        same = self.h1[order][1:] == self.h1[order][:-1]
        group = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        h1, h2 = self.h1[group], self.verified(group)
        by = np.lexsort((group, h2, h1))
        group, h1, h2 = group[by], h1[by], h2[by]
        later[group[1:][(h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]] = True
        return later

    def removed(self, windows: np.ndarray) -> np.ndarray:
        """For each word of the block: whether a marked window covers it."""
        edge = np.zeros(int(self.sizes.sum()) + 1, np.int64)
        at = self.at[windows]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.width, -1)
        return np.cumsum(edge[:-1]) > 0

    def kept(self, gone: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The texts without the words that are gone, and how many those are."""
        size = self.end - self.begin + 1
        left = np.bincount(self.doc, weights=np.where(gone, 0, size), minlength=len(self.sizes)).astype(np.int64)
        raw = self.bytes[np.repeat(~gone, size)].tobytes()
        ends = np.cumsum(left)
        texts = [raw[b - n : b - 1] if n else b"" for b, n in zip(ends.tolist(), left.tolist(), strict=True)]
        return texts, np.bincount(self.doc, weights=gone, minlength=len(self.sizes)).astype(np.int64)


def _held(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def _first_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Of sorted pairs: where each distinct one begins."""
    if not len(h1):
        return np.zeros(0, bool)
    return np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]


class Runs:
    """Sorted immutable runs of one part, newest last."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def seen(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Merge join of a sorted batch with every run."""
        found = np.zeros(len(h1), bool)
        for r1, r2 in self.runs:
            lo, hi = np.searchsorted(r1, h1, "left"), np.searchsorted(r1, h1, "right")
            left = np.flatnonzero((hi > lo) & ~found)
            step = 0
            while len(left):  # more than once only where first hashes collide
                found[left] |= r2[lo[left] + step] == h2[left]
                step += 1
                left = left[(lo[left] + step < hi[left]) & ~found[left]]
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        if not len(h1):
            return
        self.runs.append((h1, h2))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            (a1, a2), (b1, b2) = self.runs.pop(), self.runs.pop()
            h1, h2 = np.concatenate([b1, a1]), np.concatenate([b2, a2])
            order = np.lexsort((h2, h1)) if h2.any() else np.argsort(h1, kind="stable")
            self.runs.append((h1[order], h2[order]))


def _cuts(h1: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where sorted numbers of ``bits`` bits are cut into parts of equal ranges."""
    inner = [((p << bits) + parts - 1) // parts for p in range(1, parts)]
    return np.r_[0, np.searchsorted(h1, np.array(inner, np.uint64)), len(h1)].astype(np.int64)


_SENT = "block long, part long, n long, h1 binary, h2 binary"
_SENT_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary())])
_TOLD_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("marks", pa.binary())])


def _sent(block: int, h1: np.ndarray, h2: np.ndarray | None, bits: int, parts: int) -> pa.Table:
    cuts = _cuts(h1, bits, parts)
    rows = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[p], cuts[p + 1]
        second = b"" if h2 is None else h2[lo:hi].tobytes()
        rows.append({"block": block, "part": p, "n": hi - lo, "h1": pack_sorted(h1[lo:hi]), "h2": second})
    return pa.Table.from_pylist(rows, schema=_SENT_SCHEMA)


def _opened(table: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Batches in the order of their blocks; those of the stored index come first."""
    out = []
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        h2 = np.frombuffer(r["h2"], np.uint64) if r["h2"] else np.zeros(r["n"], np.uint64)
        out.append((r["block"], r["part"], unpack_sorted(r["h1"], r["n"]), h2))
    return out


def _marks(told: pa.Table) -> np.ndarray:
    """The marks of all parts in a row, as the block's sorted keys lie."""
    parts = [np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=r["n"]) for r in sorted(told.to_pylist(), key=lambda r: r["part"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _told(rows: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    return pa.Table.from_pylist(
        [{"block": b, "part": p, "n": len(m), "marks": np.packbits(m).tobytes()} for b, p, m in rows if b >= 0], schema=_TOLD_SCHEMA
    )


def _shared(table: pa.Table) -> pa.Table:
    """First round: mark the short keys that more than one batch has."""
    batches, runs, twice = _opened(table), Runs(), []
    for _, _, h1, h2 in batches:
        old = runs.seen(h1, h2)
        twice.append(h1[old])
        runs.add(h1[~old], h2[~old])
    twice = sorted_unique(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)
    return _told([(b, p, _held(twice, h1)) for b, p, h1, _ in batches])


def _earlier(table: pa.Table) -> pa.Table:
    """Second round: mark the fingerprints that an earlier batch has."""
    runs, rows = Runs(), []
    for b, p, h1, h2 in _opened(table):
        old = runs.seen(h1, h2)
        rows.append((b, p, old))
        runs.add(h1[~old], h2[~old])
    return _told(rows)


def _blocked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Rows with their block, the number of blocks, and the bytes of all texts.

    Blocks are ranges of ids of about equal bytes.  An id, or the lack of one, that
    fills more than a block is split by a hash of the text, in which rows of one id
    are in order anyway.
    """
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    length = F.coalesce(F.octet_length("t"), F.lit(0))
    row = base.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id").isNull(), length)), F.lit(0))).first()
    size, unnamed = row
    blocks = max(1, math.ceil((size - unnamed) / BLOCK_BYTES))
    found = np.zeros(0, np.int64)
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        weighed = base.filter("id IS NOT NULL").select("id", F.explode(F.sequence(F.lit(0), (length / WEIGHT_BYTES).cast("int"))))
        found = np.array(weighed.agg(F.percentile_approx("id", shares, max(10_000, 20 * blocks))).first()[0] or [], np.int64)
    bounds, times = np.unique(found, return_counts=True)
    # A bound that is met more than once is an id of so many blocks: they follow the range that ends there.
    more = np.where(times > 1, times, 0)
    first = np.arange(len(bounds) + 1) + np.r_[0, np.cumsum(more)]
    lacking = max(1, math.ceil(unnamed / BLOCK_BYTES))
    last = int(first[-1]) + 1

    @F.arrow_udf("long")
    def block(ids: pa.Array, texts: pa.Array) -> pa.Array:
        lost = ids.is_null().to_numpy(zero_copy_only=False)
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, own, "left")
        out = np.where(lost, last, first[at])
        here = np.minimum(at, max(0, len(bounds) - 1))
        heavy = ~lost & (at < len(bounds)) & (bounds[here] == own) & (more[here] > 0) if more.any() else np.zeros(len(own), bool)
        split = np.flatnonzero(heavy | (lost if lacking > 1 else False))
        if len(split):
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw or b"") for raw in raw_texts(texts.take(pa.array(split)))), np.uint64, len(split))
            share = (hashes >> np.uint64(32)).astype(np.float64) / 2.0**32
            many = np.where(lost[split], lacking, more[here[split]] if len(more) else lacking)
            out[split] += heavy[split] + (share * many).astype(np.int64)
        return pa.array(out.astype(np.int64))

    return base.withColumn("block", block("id", "t")), last + lacking, size


def _parts(size: int, entries: int = 0) -> int:
    """Parts for so many bytes of text and so many stored fingerprints."""
    return max(1, math.ceil(size / PART_BYTES), min(FEW_PARTS, math.ceil(size / BLOCK_BYTES)), math.ceil(entries / PART_ENTRIES))


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    history: DataFrame | None = None,
) -> DataFrame:
    """Remove the words of every window whose words also start earlier.

    Earlier is a smaller id, or the same document further to the front, or any
    run of ``history`` (see :func:`window_run`).  Windows are judged on the input.
    Returns a row per input row: the id, ``n_words``, ``n_removed`` and ``kept``, the
    words left, joined by single spaces.

    Null and empty texts have no words.  Rows that share an id are taken in the
    order of a hash of their texts, so of equal rows the first keeps its words; null
    ids come last.  An empty table gives an empty result.  A very long text is
    compared whole, in one block, so a task needs about forty times its bytes.  Other
    columns are ignored, whatever their names.
    """
    blocked, _, size = _blocked(docs, id_col, text_col)
    entries = 0
    if history is not None:
        entries = history.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = _parts(size, entries)
    bits = min(64, math.ceil(math.log2(max(2, size / 4 + entries))) + SPARE_BITS)

    def short(key: tuple, table: pa.Table) -> pa.Table:
        out = _sent(key[0].as_py(), Block(table, width).short_keys(bits), None, bits, parts)
        release_memory()
        return out

    def full(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        own = Block(table, width)
        keys = own.short_keys(bits)
        _, h1, h2 = own.pairs_in(keys[_marks(told)], bits)
        first = _first_of(h1, h2)
        out = _sent(key[0].as_py(), h1[first], h2[first], 64, parts)
        release_memory()
        return out

    def finish(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        own = Block(table, width)
        old = own.repeats()
        which = told.column("round").to_numpy()
        one, two = told.filter(pa.array(which == 1)), told.filter(pa.array(which == 2))
        if len(one):
            at, h1, h2 = own.pairs_in(own.short_keys(bits)[_marks(one)], bits)
            marks = _marks(two)
            if marks.any():
                old[at[marks[np.cumsum(_first_of(h1, h2)) - 1]]] = True
        kept, lost = own.kept(own.removed(old))
        out = pa.table({
            "id": pa.array(own.ids, pa.int64()),
            "n_words": pa.array(own.sizes, pa.int64()),
            "n_removed": pa.array(lost, pa.int64()),
            "kept": pa.array(kept, pa.binary()).view(pa.string()),
        })
        release_memory()
        return out

    told = "block long, part long, n long, marks binary"
    sent = blocked.groupBy("block").applyInArrow(short, _SENT)
    if history is not None:
        sent = sent.unionByName(_recut(history, parts, bits))
    one = sent.groupBy("part").applyInArrow(_shared, told)
    sent = blocked.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(full, _SENT)
    if history is not None:
        sent = sent.unionByName(_recut(history, parts))
    two = sent.groupBy("part").applyInArrow(_earlier, told)
    both = one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
    done = blocked.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        finish, "id long, n_words long, n_removed long, kept string"
    )
    return done.withColumnRenamed("id", id_col)


def _recut(history: DataFrame, parts: int, bits: int = 64) -> DataFrame:
    """Stored runs cut into other parts; with fewer ``bits``, as the first round sends them."""

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h1, h2 = unpack_sorted(r["h1"], r["n"]), np.frombuffer(r["h2"], np.uint64)
                if bits < 64:
                    h1, h2 = sorted_unique(h1 >> np.uint64(64 - bits)), None
                yield from _sent(-1, h1, h2, bits, parts).to_batches()

    return history.select("n", "h1", "h2").mapInArrow(cut, _SENT)


def window_run(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A sorted immutable run of every window of ``docs``: ``part``, ``n``, ``h1``, ``h2``."""
    blocked, _, size = _blocked(docs, id_col, text_col)
    parts = _parts(size)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        own = Block(table, width)
        h1, h2 = own.h1, own.verified(np.arange(len(own.at)))
        order = np.lexsort((h2, h1))
        first = _first_of(h1[order], h2[order])
        return _sent(key[0].as_py(), h1[order][first], h2[order][first], 64, parts)

    return _merged(blocked.groupBy("block").applyInArrow(send, _SENT))


def compacted(runs: DataFrame) -> DataFrame:
    """One run of the entries of many."""
    entries = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _merged(_recut(runs, _parts(0, entries)))


def _merged(sent: DataFrame) -> DataFrame:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h1 = np.concatenate([unpack_sorted(r["h1"], r["n"]) for r in rows])
        h2 = np.concatenate([np.frombuffer(r["h2"], np.uint64) for r in rows])
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        first = _first_of(h1, h2)
        h1, h2 = h1[first], h2[first]
        return pa.Table.from_pylist(
            [{"part": key[0].as_py(), "n": len(h1), "h1": pack_sorted(h1), "h2": h2.tobytes()}], schema=pa.schema(list(_SENT_SCHEMA)[1:])
        )

    return sent.groupBy("part").applyInArrow(merge, "part long, n long, h1 binary, h2 binary")


class SubstringIndex:
    """Runs stored under ``path``, a folder that all executors share.

    A run's folder is named by the numbers of the first and the last batch in it, so
    runs that a compaction has made needless are known by their names, whenever it was
    cut off.  A batch counts as taken in once its run is finished, which is after its
    rows are; taking it in again then only reads them.
    """

    def __init__(self, spark: SparkSession, path: str, *, width: int = WIDTH, fanout: int = FANOUT):
        self.spark, self.path, self.width, self.fanout = spark, path.rstrip("/"), width, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _finished(self) -> dict[str, tuple[int, int]]:
        found = self._fs.globStatus(self._path(f"{self.path}/run-*/_SUCCESS"))
        runs = [str(f.getPath().getParent()) for f in found or []]
        return {run: tuple(map(int, run.rsplit("/run-", 1)[1].split("-")[:2])) for run in runs}

    def runs(self) -> list[str]:
        """Paths of the runs in force, oldest first."""
        spans = self._finished()
        inside = {r for r, (a, b) in spans.items() for c, d in spans.values() if c <= a and b <= d and (c, d) != (a, b)}
        return sorted((r for r in spans if r not in inside), key=spans.get)

    def _taken(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/batches/{name}")) or any(run.endswith(f"-{name}") for run in self._finished())

    def add(self, docs: DataFrame, out: str, *, batch: str | None = None, **columns: str) -> DataFrame:
        """Deduplicate a batch against all earlier ones, write the rows to ``out``, index it.

        ``batch`` names it, by default after ``out``.  A batch that has been taken in is
        not compared again, so an ``add`` that was cut off anywhere can be repeated.
        """
        name = hashlib.sha256((batch or out).encode()).hexdigest()[:32]
        if not self._taken(name):
            old = self.runs()
            history = self.spark.read.parquet(*old) if old else None
            found = dedup_substrings(docs, width=self.width, history=history, **columns)
            found.write.mode("overwrite").parquet(out)
            number = max((b for _, b in self._finished().values()), default=-1) + 1
            run = window_run(docs, width=self.width, **columns)
            run.write.mode("overwrite").parquet(f"{self.path}/run-{number:08d}-{number:08d}-{name}")
        self.compact()
        return self.spark.read.parquet(out)

    def compact(self) -> None:
        """Unite the newest runs while ``fanout`` of them are of like size; drop those that are needless."""
        while True:
            runs = self.runs()
            for run in set(self._finished()) - set(runs):
                name = run.rsplit("-", 1)[1]
                if len(name) == 32:  # a batch's own run, whose name would be lost
                    self._fs.create(self._path(f"{self.path}/batches/{name}"), True).close()
                self._fs.delete(self._path(run), True)
            tiers = [self._tier(run) for run in runs]
            own = list(itertools.takewhile(lambda i: tiers[i] <= tiers[-1], reversed(range(len(runs)))))
            if len(own) < max(2, self.fanout):
                return
            own = [runs[i] for i in reversed(own)]
            spans = self._finished()
            at = f"{self.path}/run-{spans[own[0]][0]:08d}-{spans[own[-1]][1]:08d}-all"
            compacted(self.spark.read.parquet(*own)).write.mode("overwrite").parquet(at)

    def _tier(self, run: str) -> int:
        size = self._fs.getContentSummary(self._path(run)).getLength()
        return int(math.log(max(1, size), max(2, self.fanout)))
