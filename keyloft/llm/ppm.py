"""Prediction by partial matching: byte contexts, escapes and symbol exclusion.

A text is read as its lower-cased words, one space between them and a newline
at the end, so it holds exactly its tokens.  A byte is predicted from the
longest context of at most ``order`` bytes that training has seen.  If the byte
never followed it, an escape is charged and the next shorter context is asked,
without the bytes that the longer one has already ruled out; at last all bytes
left are equally likely.  The escape has what method D takes from each byte's
count (there a half, here ``DISCOUNT``).  Orders two and more but the longest
count by update exclusion, once for each context of one more byte in which the
byte was seen; order one counts bytes as they come, order zero the distinct
pairs.  Contexts of a document begin with newlines.

The trie is never in one place.  Nodes are dealt by ranges of the three bytes
before the predicted one, so all contexts of order three and more that a
prediction may fall back to lie together.  Their number follows the corpus.
Where the ranges begin is told by the counts of byte pairs, so frequent pairs are
split by a third byte.  Order two is counted by an aggregation over distinct
four-byte strings and sent to the parts that ask for it; orders one and zero are
a table of 65,536 counts, which is all that is collected.

Documents are dealt into blocks of a few MB.  A block sends each distinct
(context, byte) it holds once, with its count in training documents; the part
that owns it sums the counts over all blocks, prices it, and sends the price
back.  Token counts for the baseline travel with them.  A block and a part never
exchange an empty row, so their rows never outnumber the nodes sent.  All counts
cover all training documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import (
    pack_planes,
    pack_sorted,
    raw_texts,
    release_memory,
    sort_order,
    sorted_unique,
    stored,
    unpack_planes,
    unpack_sorted,
    word_hashes,
    word_spans,
    words_of,
)

#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
#: Bytes of text, about, whose nodes a part answers for.
PART_BYTES = 16_000_000
#: Bytes of text whose byte strings are counted at once.
SLICE = 4_000_000
#: What each byte of a context gives to the escape.
DISCOUNT = 0.4
#: Of the unigram baseline.
SMOOTH = 0.1


def normal(raw: bytes | None) -> bytes:
    """The bytes that the model reads: lower-cased words, single spaces, a newline."""
    return b" ".join(words_of(raw, fold=True)) + b"\n"


def keys_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of ``texts``, and where each text's keys start.

    From the top: the byte before, the one before that, ..., and the byte itself
    at the bottom.
    """
    pad = b"\n" * order
    buf = np.frombuffer(pad + pad.join(texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + order) - sizes  # in buf, of each text's first byte
    n = len(buf) - order
    key = buf[order:].astype(np.uint64)
    for back in range(1, order + 1):
        key |= buf[order - back : order - back + n].astype(np.uint64) << np.uint64(8 * (order - back + 1))
    inner = np.ones(n, bool)
    for i in range(order):  # padding between texts predicts nothing
        inner[starts[1:] - order - order + i] = False
    return key[inner], np.cumsum(sizes) - sizes


def head_of(keys: np.ndarray, order: int) -> np.ndarray:
    """The three bytes by which nodes are dealt."""
    return (keys >> np.uint64(8 * (order - 2))).astype(np.int64)


class Ranked:
    """The distinct keys of some texts in order, and which of them stands at each byte."""

    def __init__(self, texts: list[bytes], order: int):
        pad = b"\n" * order
        buf = np.frombuffer(pad + pad.join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes) - sizes
        self.n = n = int(sizes.sum())
        if not n:
            self.keys, self.place, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
            return
        # Bytes become their places among those that occur, so that a key and its position mostly fit one word.
        used = np.flatnonzero(np.bincount(buf, minlength=256))
        place_bits = max(1, (len(buf) - 1).bit_length())
        if (len(used) ** (order + 1) - 1).bit_length() + place_bits <= 64:
            small = np.zeros(256, np.uint64)
            small[used] = np.arange(len(used))
            digits = small[buf]
            packed = digits[order:].copy()
            for back in range(1, order + 1):
                packed += digits[order - back : len(buf) - back] * np.uint64(len(used) ** (order - back + 1))
            del digits
            packed <<= np.uint64(place_bits)
            packed |= np.arange(order, len(buf), dtype=np.uint64)
            packed = self._own(packed, sizes, order)
            packed.sort()
            at = (packed & np.uint64((1 << place_bits) - 1)).astype(np.int32)
            packed >>= np.uint64(place_bits)
            new = np.r_[True, packed[1:] != packed[:-1]]
            del packed
        else:
            keys, _ = keys_of(texts, order)
            by = sort_order(keys, 8 * (order + 1))
            new = np.r_[True, keys[by][1:] != keys[by][:-1]]
            at = self._own(np.arange(order, len(buf), dtype=np.int32), sizes, order)[by]
        self.first = np.flatnonzero(new)  # of each key's bytes, in the order of keys
        head = at[self.first].astype(np.int64)
        self.keys = buf[head].astype(np.uint64)
        for back in range(1, order + 1):
            self.keys |= buf[head - back].astype(np.uint64) << np.uint64(8 * (order - back + 1))
        own = np.zeros(len(buf), np.int32)  # from a byte of the padded text to one of the texts alone
        own[self._own(np.arange(order, len(buf), dtype=np.int32), sizes, order)] = np.arange(n, dtype=np.int32)
        self.place = own[at]

    @staticmethod
    def _own(values: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
        """Values of the padded text without those of the padding between texts."""
        keep = np.ones(len(values), bool)
        ends = np.cumsum(sizes + order)[:-1] - order
        for i in range(order):
            keep[ends + i] = False
        return values[keep]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """For each key: the sum of the weights of its bytes."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.add.reduceat(weight[self.place], self.first, dtype=np.int64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Each key's value at all its bytes."""
        out = np.empty(self.n, values.dtype)
        out[self.place] = np.repeat(values, np.diff(np.r_[self.first, self.n]))
        return out


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


class Level:
    """Contexts of one order: what followed them and how often."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        ctx = keys >> np.uint64(8)
        self.at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.ctx = ctx[self.at]
        self.total = np.add.reduceat(self.counts, self.at) if len(keys) else np.zeros(0)
        self.kinds = np.diff(np.r_[self.at, len(keys)]).astype(np.float64)

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the contexts that are one byte shorter, and how many keys here end in each."""
        short = (self.keys >> np.uint64(16) << np.uint64(8)) | (self.keys & np.uint64(255))
        return _sum_by(short, np.ones(len(short)))

    def covered(self, below: Level) -> np.ndarray:
        """For each context: the counts, one order down, of the bytes seen here."""
        keys = (self.keys >> np.uint64(16) << np.uint64(8)) | (self.keys & np.uint64(255))
        counts = below.counts[np.searchsorted(below.keys, keys)]
        return np.add.reduceat(counts, self.at) if len(keys) else np.zeros(0)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def price(
    wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, second: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, order: int
) -> np.ndarray:
    """Log10 probability of each wanted key's byte after its context.

    ``keys`` and ``counts`` are the part's training nodes of the full order,
    ``second`` the nodes of order two that they may fall back to, ``pairs`` the
    65,536 counts of (byte before, byte), both over all training text.
    """
    low = np.flatnonzero(pairs)
    levels: list[Level] = [Level(keys, counts)]
    while len(levels) < order - 2:
        levels.append(Level(*levels[-1].shorter()))
    levels.append(Level(*second))
    levels.append(Level(low.astype(np.uint64), pairs[low]))
    levels.append(Level(*levels[-1].shorter()))
    logp = np.zeros(len(wanted))
    todo = np.arange(len(wanted))
    ruled = np.full(len(wanted), -1)
    key = wanted
    covered = kinds = np.zeros(0)
    for i, level in enumerate(levels):
        at, known = _find(level.ctx, key >> np.uint64(8))
        total, q = level.total[at] if len(level.ctx) else np.zeros(len(at)), level.kinds[at] if len(level.ctx) else np.zeros(len(at))
        out = ruled >= 0
        total[out] -= covered[ruled[out]]
        q[out] -= kinds[ruled[out]]
        node, seen = _find(level.keys, key)
        seen &= known
        logp[todo[seen]] += np.log10((level.counts[node[seen]] - DISCOUNT) / total[seen])
        escape = known & ~seen & (q > 0)
        logp[todo[escape]] += np.log10(DISCOUNT * q[escape] / total[escape])
        ruled = np.where(known, at, -1)[~seen]
        todo, key = todo[~seen], key[~seen]
        key = (key >> np.uint64(16) << np.uint64(8)) | (key & np.uint64(255))
        if i + 1 < len(levels):
            covered, kinds = level.covered(levels[i + 1]), level.kinds
    left = 256 - (levels[-1].kinds[0] if len(levels[-1].kinds) else 0)
    logp[todo] -= math.log10(max(left, 1))
    return logp


def _bounds(pairs: np.ndarray, parts: int) -> np.ndarray:
    """First heads of the parts but the first, so that parts get about equally many nodes.

    ``pairs`` counts (byte before, byte); a head has the byte before on top.  A head
    of two bytes that weighs much is split by the third, as the pairs let expect.
    """
    if parts < 2:
        return np.zeros(0, np.int64)
    table = pairs.reshape(256, 256)  # earlier byte, later byte
    weight = np.sqrt(table.T.ravel())
    heads, weights = [], []
    for head in np.flatnonzero(weight):
        before = np.sqrt(table[:, head & 255])  # of the third byte, by the second
        own = np.flatnonzero(before)
        if weight[head] * 8 * parts > weight.sum() and len(own):
            heads.append((head << 8) + own)
            weights.append(weight[head] * before[own] / before[own].sum())
        else:
            heads.append(np.array([head << 8]))
            weights.append(weight[head : head + 1])
    if not heads:
        return np.zeros(0, np.int64)
    heads, weights = np.concatenate(heads), np.concatenate(weights)
    at = np.searchsorted(np.cumsum(weights) / weights.sum(), np.arange(1, parts) / parts)
    return np.unique(heads[np.minimum(at + 1, len(heads) - 1)])


def _pieces(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The texts, a few MB at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


class Tokens:
    """Words and ends of some texts: the distinct ones, the end first, and which of them stands where.

    Words of a block are told apart by 64-bit hashes; between blocks, by themselves.
    """

    def __init__(self, texts: list[bytes], parts: int):
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        starts, ends = word_spans(buf)
        hashes = word_hashes(buf, starts, ends)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.searchsorted(np.cumsum(lengths), starts, "right")
        self.sizes = np.bincount(text, minlength=len(texts)) + 1
        order = np.argsort(hashes)
        rising = hashes[order]
        first = np.flatnonzero(np.r_[True, rising[1:] != rising[:-1]][: len(rising)])
        self.at = np.zeros(len(starts) + len(texts), np.int64)
        self.at[order + text[order]] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)])) + 1
        own = order[first]
        self.words = [b"", *(raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True))]
        part = ((rising[first] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        self.cuts = np.searchsorted(np.r_[np.uint64(0), part], np.arange(parts + 1))

    def counts(self, learn: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=np.repeat(learn, self.sizes), minlength=len(self.words)).astype(np.int64)


def score_corpus(
    docs: DataFrame, train: str, *, id_col: str = "doc_id", text_col: str = "text", order: int = 5
) -> DataFrame:
    """Score every document by a model of those whose boolean column ``train`` holds.

    Returns the id, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (smoothed unigrams) and ``score`` (this model), both log10
    probabilities of the whole text, and ``bits_per_byte`` of the latter.

    A null or empty text holds the end alone.  A null in ``train`` counts as false,
    a null id is kept, repeated rows are scored and learnt from each for itself.
    With nothing to learn from, all bytes are equally likely.  An empty table
    gives an empty result.  A very long text is scored whole, in one block, so a
    task needs about fifty times its bytes.  Other columns are ignored, whatever
    their names.
    """
    if not 3 <= order <= 7:
        raise ValueError("order must lie from 3 to 7")
    flag = F.coalesce(docs[train], F.lit(False))
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"), flag.alias("train"))

    def scan(batches):
        pairs, size, grams = np.zeros(65536, np.int64), 0, np.zeros(0, np.uint32)
        for batch in batches:
            raws, learn = raw_texts(batch.column(0)), batch.column(1).to_pylist()
            size += sum(len(r) + 1 for r in raws if r) + len(raws)
            for texts in _pieces(normal(r) for r, use in zip(raws, learn, strict=True) if use):
                keys = keys_of(texts, 3)[0].astype(np.uint32)
                pairs += np.bincount((keys >> np.uint32(24) << np.uint32(8)) | (keys & np.uint32(255)), minlength=65536)
                keys.sort()
                grams = np.concatenate([grams, keys[np.r_[True, keys[1:] != keys[:-1]]]])
                grams.sort()
                grams = grams[np.r_[True, grams[1:] != grams[:-1]]]
        release_memory()
        seen = np.flatnonzero(pairs)
        for kind, keys, counts in ((0, np.zeros(1), np.array([size])), (1, seen, pairs[seen]), (2, grams, np.ones(len(grams)))):
            for lo in range(0, len(keys), 100_000):
                own = slice(lo, lo + 100_000)
                columns = [np.full(len(keys[own]), kind, np.int8), keys[own].astype(np.int64), counts[own].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "n"])

    scanned = stored(base.select("t", "train").mapInArrow(scan, "kind byte, key long, n long"))
    # At most 65,537 rows, whatever the corpus.
    rows = scanned.filter("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    pairs, size = np.zeros(65536), 0
    for row in rows:
        if row["kind"]:
            pairs[row["key"]] = row["n"]
        else:
            size = row["n"]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    bounds = _bounds(pairs, max(1, math.ceil(size / PART_BYTES)))
    parts = len(bounds) + 1
    blocked = base.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)).cast("long"))
    gram = F.col("key")
    second = scanned.filter("kind = 2").select("key").distinct()
    second = second.groupBy((F.shiftleft(F.shiftright(gram, 16), 8) + gram.bitwiseAND(255)).alias("key")).agg(F.count("*").alias("n"))

    def deal(batches):
        for batch in batches:
            head = batch.column(0).to_numpy() >> 8 << 8
            lo, hi = np.searchsorted(bounds, head, "right"), np.searchsorted(bounds, head + 255, "right")
            who = np.repeat(np.arange(len(head)), hi - lo + 1)
            part = np.arange(len(who)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[who]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(c.take(pa.array(who)) for c in batch.columns)], ["part", "key", "n"])

    second = second.mapInArrow(deal, "part long, key long, n long")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        texts = [normal(raw) for raw in raw_texts(table.column("t"))]
        learn = np.array(table.column("train").to_pylist(), bool)
        tokens, own = Tokens(texts, parts), Ranked(texts, order)
        uses, counts = tokens.counts(learn), own.counts(np.repeat(learn, [len(t) for t in texts]))
        cuts = np.r_[0, np.searchsorted(head_of(own.keys, order), bounds), len(own.keys)]
        out = {k: [] for k in ("block", "part", "n", "keys", "counts", "words", "uses")}
        for p in np.flatnonzero(np.diff(cuts) + np.diff(tokens.cuts)).tolist():
            lo, hi, a, b = cuts[p], cuts[p + 1], tokens.cuts[p], tokens.cuts[p + 1]
            values = (key[0].as_py(), p, hi - lo, pack_sorted(own.keys[lo:hi]), pack_planes(counts[lo:hi]))
            values += (b"\n".join([*tokens.words[a:b], b"."]), pack_planes(uses[a:b]))
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        release_memory()
        return pa.table(out, schema=pa.schema([(k, pa.binary() if k in ("keys", "counts", "words", "uses") else pa.int64()) for k in out]))

    def answer(key: tuple, table: pa.Table, lower: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack_sorted(r["keys"], r["n"]) for r in rows]
        counts = [unpack_planes(r["counts"], r["n"]).astype(np.int64) for r in rows]
        by = np.argsort(lower.column("key").to_numpy())
        second = lower.column("key").to_numpy()[by].astype(np.uint64), lower.column("n").to_numpy()[by]
        every = np.concatenate([np.zeros(0, np.uint64), *keys])
        sums = np.concatenate([np.zeros(0, np.int64), *counts])
        nodes, sums = _sum_by(every[sums > 0], sums[sums > 0])
        wanted = sorted_unique(every)
        prices = price(wanted, nodes, sums, second, pairs, order).astype(np.float32)
        words: Counter = Counter()
        held = []
        for r in rows:
            own = r["words"].split(b"\n")[:-1]
            uses = unpack_planes(r["uses"], len(own)).astype(np.int64).tolist()
            held.append(own)
            for w, n in zip(own, uses, strict=True):
                if n:
                    words[w] += n
        first = [sum(words.values()), *[0] * len(rows)], [len(words), *[0] * len(rows)]
        out = {
            "block": [r["block"] for r in rows],
            "part": [r["part"] for r in rows],
            "prices": [prices[np.searchsorted(wanted, k)].tobytes() for k in keys],
            "uses": [pack_planes(np.array([words[w] for w in own], np.int64)) for own in held],
            "tokens": first[0][: len(rows)],
            "kinds": first[1][: len(rows)],
        }
        release_memory()
        return pa.table(out, schema=pa.schema([(k, pa.binary() if k in ("prices", "uses") else pa.int64()) for k in out]))

    sent = blocked.groupBy("block").applyInArrow(
        send, "block long, part long, n long, keys binary, counts binary, words binary, uses binary"
    )
    priced = sent.groupBy("part").cogroup(second.groupBy("part")).applyInArrow(
        answer, "block long, part long, prices binary, uses binary, tokens long, kinds long"
    )
    sums = F.struct(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    totals = priced.agg(sums.alias("s")).scalar()  # reads what has been shuffled for the prices anyway

    def finish(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        texts = [normal(raw) for raw in raw_texts(table.column("t"))]
        tokens, own = Tokens(texts, parts), Ranked(texts, order)
        rows = sorted(told.select(["part", "prices", "uses"]).to_pylist(), key=lambda r: r["part"])
        prices = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["prices"], np.float32) for r in rows)])
        score = np.add.reduceat(own.spread(prices), own.starts, dtype=np.float64) if texts else np.zeros(0)
        sizes = np.diff(tokens.cuts)
        uses = [unpack_planes(r["uses"], sizes[r["part"]]) for r in rows]
        uses = np.concatenate([np.zeros(0, np.uint64), *uses]).astype(np.int64)[tokens.at]
        starts = np.cumsum(tokens.sizes) - tokens.sizes
        known = np.add.reduceat(np.log10(uses + SMOOTH), starts) if texts else np.zeros(0)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        release_memory()
        return pa.table({
            "id": table.column("id"),
            "train": table.column("train"),
            "n_tokens": pa.array(tokens.sizes),
            "n_known": pa.array(np.add.reduceat((uses > 0).astype(np.int64), starts) if texts else np.zeros(0, np.int64)),
            "known": pa.array(known),
            "score": pa.array(score),
            "bits_per_byte": pa.array(-score / math.log10(2) / length),
        })

    kind = base.schema["id"].dataType.simpleString()
    done = blocked.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(
        finish,
        f"id {kind}, train boolean, n_tokens long, n_known long, known double, score double, bits_per_byte double",
    ).withColumn("totals", totals)
    every = F.col("totals.tokens") + F.lit(SMOOTH) * (F.col("totals.kinds") + 1)
    return done.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        "n_known",
        F.col("totals.tokens").alias("train_tokens"),
        (F.col("known") - F.col("n_tokens") * F.log10(every)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
