"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``r`` bits have a word between them
that is at most ``ceil(r/2)`` flips from the one and ``floor(r/2)`` from the
other.  So every fingerprint emits all its variants within those radii, the
variants are shuffled, and equal ones bring their fingerprints together.

A variant need not be written out to be shuffled: all variants of a fingerprint
that begin with the same few bits go to the same place, so the fingerprint is
sent there once and unfolds into them on arrival.  The number of leading bits
follows the number of fingerprints, so a place holds about as many variants at
every size.

Copies have one fingerprint and travel once.  Where many fingerprints meet at a
variant, they are hung on the least of them rather than paired with each other,
and each place hands on a spanning forest of the links it has verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, raw_texts, release_memory, words_of
from .components import connected_components, local_labels

SEED = 42
#: Words of a text are hashed and their bits counted in slices of this many.
SLICE = 1 << 16
#: Variants that one place unfolds, about.
PLACE_VARIANTS = 4_000_000
#: Variants compared at once.
CHUNK = 1 << 20
#: Fingerprints of a place that are unfolded together.
CROWDED = 200_000
#: So many rows are broadcast at most.
SMALL = 100_000


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """The 64 bits of one text; 0 where it has no words."""
    words = words_of(raw, fold=True)
    if not words:
        return 0
    if len(words) <= shingle:
        pieces: Iterator[bytes] = iter((b" ".join(words),))
        n = 1
    else:
        n = len(words) - shingle + 1
        pieces = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(shingle)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, pieces, itertools.repeat(SEED))
    counts = np.zeros(64, np.int64)
    while len(h := np.fromiter(itertools.islice(hashes, SLICE), np.uint64)):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with a 64-bit fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(raw, shingle) for raw in raw_texts(texts)), np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, fp(docs[text_col].cast("string")))


def masks(lo: int, hi: int, flips: int) -> np.ndarray:
    """Every word with exactly ``flips`` of the bits ``lo..hi-1`` set."""
    bits = [np.uint64(1 << i) for i in range(lo, hi)]
    sets = itertools.combinations(bits, flips)
    return np.array([np.bitwise_or.reduce(np.array(s, np.uint64)) if s else np.uint64(0) for s in sets], np.uint64)


def place_bits(n: int, radius: int) -> int:
    """Leading bits by which ``n`` fingerprints are dealt."""
    each = sum(math.comb(64, i) for i in range((radius + 1) // 2 + 1))
    return min(24, max(0, math.ceil(math.log2(max(1, n * each) / PLACE_VARIANTS))))


def meet(
    fps: np.ndarray, place: int, bits: int, radius: int, near_side: np.ndarray | None = None, far_side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` that meet at variants which begin with ``place``: index pairs, a forest.

    Only fingerprints of ``near_side`` unfold to the smaller radius, and only those of
    ``far_side`` to the larger one; without these, all do.
    """
    far, near = (radius + 1) // 2, radius // 2
    every = np.ones(len(fps), bool)
    low = 64 - bits
    head = (fps >> np.uint64(low)) if bits else np.zeros(len(fps), np.uint64)
    apart = np.bitwise_count(head ^ np.uint64(place)).astype(np.int64)
    tail_bits = np.uint64((1 << low) - 1) if bits else np.uint64(0xFFFFFFFFFFFFFFFF)
    tail = fps & tail_bits

    def unfold(reach: int, chunked: bool, side: np.ndarray | None):
        for d in range(reach + 1):
            own = np.flatnonzero((apart == d) & (every if side is None else side))
            for flips in range(reach - d + 1):
                mask = masks(0, low, flips)
                step = max(1, CHUNK // len(mask)) if chunked else max(1, len(own))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    yield (tail[part][:, None] ^ mask[None, :]).ravel(), np.repeat(part, len(mask))

    got = list(unfold(near, False, near_side))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, owners = (np.concatenate(x) for x in zip(*got, strict=True))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    words, owners = words[order], owners[order]
    first = np.r_[True, words[1:] != words[:-1]]
    heads = np.flatnonzero(first)
    lead = owners[heads][np.cumsum(first) - 1]
    words = words[heads]
    links = [(lead[~first], owners[~first])]  # all that share a variant hang on one of them
    lead = owners[heads]
    # A small table of bits tells most variants from every listed one.
    size = max(10, int(len(words)).bit_length() + 4)
    slot = lambda w: ((w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)).astype(np.int64)
    listed = np.zeros(1 << size, bool)
    listed[slot(words)] = True
    for variants, who in unfold(far, True, far_side):
        may = np.flatnonzero(listed[slot(variants)])
        variants, who = variants[may], who[may]
        at = np.minimum(np.searchsorted(words, variants), len(words) - 1)
        hit = words[at] == variants
        links.append((lead[at[hit]], who[hit]))
        if sum(len(x[0]) for x in links) > 4 * CHUNK:
            links = [_forest(len(fps), fps, links, radius)]
    return _forest(len(fps), fps, links, radius)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join all that the links join, none too many."""
    # Borůvka's rounds keep true links only: each component takes one that leads out.
    label, kept = np.arange(n), []
    left = np.arange(len(a))
    while len(left):
        la, lb = label[a[left]], label[b[left]]
        out = la != lb
        left, la, lb = left[out], la[out], lb[out]
        if not len(left):
            break
        hi, lo = np.maximum(la, lb), np.minimum(la, lb)
        _, pick = np.unique(hi, return_index=True)
        kept.append(left[pick])
        up = np.arange(n)
        up[hi[pick]] = lo[pick]
        while not np.array_equal(up[up], up):
            up = up[up]
        label = up[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _forest(n: int, fps: np.ndarray, links: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)  # verified, whatever brought them here
    a, b = _distinct(a[near], b[near], n)
    kept = _spanning(n, a, b)
    return a[kept], b[kept]


def near_links(fps: DataFrame, radius: int, col: str = "fp") -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints, enough to join all that are linked.

    ``fps`` holds each fingerprint once.
    """
    n = fps.count()
    bits = place_bits(n, radius)
    low = 64 - bits
    reach = [m >> np.uint64(low) if bits else m for m in (masks(low, 64, f) for f in range((radius + 1) // 2 + 1))]
    heads = np.concatenate([m for m in reach if len(m)]) if bits else np.zeros(1, np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            fp = np.concatenate(held)
            head = (fp >> np.uint64(low)) if bits else np.zeros(len(fp), np.uint64)
            place = (head[:, None] ^ heads[None, :]).ravel().astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, own = place[order], np.repeat(fp, len(heads))[order]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            parts = [x.tobytes() for x in np.split(own, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(place[starts]), pa.array(parts, pa.binary())], ["place", "fps"])

        held, size = [], 0
        for batch in batches:
            col = batch.column(0)
            if len(col):
                held.append(col.to_numpy(zero_copy_only=False).view(np.uint64))
                size += len(col)
            if size >= 100_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        sides = [np.frombuffer(b"".join(table.filter(pa.array(table.column("role").to_numpy() & r > 0)).column("fps").to_pylist()), np.uint64) for r in (1, 2)]
        fp = np.unique(np.concatenate(sides))
        a, b = meet(fp, key[0].as_py(), bits, radius, *(np.isin(fp, side) for side in sides))
        fp = fp.view(np.int64)
        return pa.table({"a": pa.array(fp[a]), "b": pa.array(fp[b])})

    places = fps.select(col).mapInArrow(deal, "place long, fps binary")
    # A place where very many begin alike is a grid: each block of near sides meets each of far sides.
    held = places.groupBy("place").agg(F.sum(F.octet_length("fps") / 8).alias("n"))
    crowded = cut(held.filter(F.col("n") > CROWDED).select("place", F.ceil(F.col("n") / CROWDED).cast("int").alias("blocks")))
    few = crowded.count() <= SMALL
    placed = places.join(F.broadcast(crowded) if few else crowded, "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, each = F.pmod(F.xxhash64("fps"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    whole = placed.filter("blocks = 1").select("place", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("role"), "fps")
    split = placed.filter("blocks > 1")
    near = split.select("place", own.alias("i"), each.alias("j"), F.lit(1).alias("role"), "fps")
    far = split.select("place", each.alias("i"), own.alias("j"), F.lit(2).alias("role"), "fps")
    return whole.unionByName(near).unionByName(far).groupBy("place", "i", "j").applyInArrow(join, "a long, b long")


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """Each row's id, ``fp`` (signed long) and ``component_id``, the least id that links reach.

    Linked are rows whose fingerprints differ in at most ``radius`` bits, copies
    among them.  Null and empty texts have fingerprint 0, linked like any other.
    Repeated ids each keep a row; a null id is passed over in the choice of the
    least, so a component without any id has a null ``component_id``.  An empty
    table gives an empty result.  Very long texts are hashed whole, in slices.  Ids are
    integers; other columns are ignored, whatever their names.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t"))
    rows = cut(with_fingerprints(narrow, text_col="t", shingle=shingle).select("id", "fp"))
    firsts = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    comps = connected_components(near_links(firsts, radius))
    joined = firsts.join(comps, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("c")
    )
    least = joined.groupBy("c").agg(F.min("first").alias("component_id"))
    to = joined.join(least, "c").select("fp", "component_id")
    return rows.join(to, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Groups by a similarity of shingle sets.
#
# A similarity J of two sets of like size is a cosine of 2J / (1 + J), and a
# fingerprint bit differs with the probability that the angle is of half a turn.
# A single 64-bit word with a small radius would miss most pairs at J = 0.8, so a
# fingerprint here has many words.  Each word is ball-hashed by itself, and enough
# of them are taken that a pair at the border meets in at least one.
#
# That probability does not hold for sets of few shingles, so those are joined by
# their rarest shingles, which misses none.
#
# Meeting is no link: every link is verified by the shingle sets themselves.  Work
# comes in two rounds.  In the first, a few words only are looked at, and in each, as
# few pairs are compared as join all that meet; so the members of a large group of
# copies are mostly joined by a few times as many comparisons as they are.  In the
# second, all that meet in any word and are not joined yet are compared: pair by pair in
# small buckets; the members of crowded ones make up a crowd, in which those outside
# its largest group are compared with everyone in bounded blocks.

WORD_RADIUS = 2
#: Chance that a pair at the border is missed.
MISSED = 0.005
#: Words of the first round.
FIRST_WORDS = 6
#: Pairs of buckets of at most so many are written out; larger ones make a crowd.
BUCKET = 8
#: Texts of at most so many shingles are joined by their rarest shingles.
FEW = 64
#: No two sets of any size at J = 0.8 or more differ in a bit with a greater chance.
MOST_CHANCE = 0.19
#: Chance that the bound on differing bits drops a pair at all.
DROPPED = 1e-9
#: Members and shingles of a block of a crowd, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19


def bit_chance(similarity: float) -> float:
    """Chance that a bit differs between sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a word and number of words for ``n`` fingerprints.

    Words grow with the logarithm of ``n``, so chance meetings stay in proportion to it.
    """
    bits = min(60, max(24, math.ceil(math.log2(max(2, n))) + 14))
    p = bit_chance(similarity)
    meet_ = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(WORD_RADIUS + 1))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meet_))


def most_differing(bits: int, similarity: float) -> float:
    """Of ``bits`` independent bits, more than this differ with a chance of ``DROPPED`` in a pair that is alike."""
    p = max(MOST_CHANCE, 1.25 * bit_chance(similarity))
    return bits * (p + math.sqrt(-math.log(DROPPED) / (2 * bits)))


def shingles_of(raw: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct shingles."""
    parts = words_of(raw, fold=True)
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= shingle:
        pieces = {b" ".join(parts)}
    else:
        pieces = set(map(b" ".join, zip(*(itertools.islice(parts, i, None) for i in range(shingle)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(SEED)), np.uint64, len(pieces))


def _wanted(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id``, ``s``: the sorted shingle sets of the texts that ``ids`` names."""

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        made = [np.sort(shingles_of(raw, shingle)).tobytes() for raw in raw_texts(texts)]
        release_memory()
        return pa.array(made, pa.binary())

    ids = cut(ids.distinct())
    wanted = F.broadcast(ids) if ids.count() <= SMALL else ids
    return cut(texts.join(wanted, "id", "left_semi").select("id", sets("t").alias("s")))


def _alike(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets of shingles are that similar."""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared / max(1, len(both) - shared))
        return pa.array(out, pa.float64())

    a, b = held.select(F.col("id").alias("a"), F.col("s").alias("sa")), held.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(a, "a").join(b, "b").filter(jaccard("sa", "sb") >= similarity).select("a", "b")


def _few_tokens(few: DataFrame, similarity: float) -> DataFrame:
    """``cls``, ``h``: the shingles by which small sets (``cls``, ``n``, ``s``) that are alike meet.

    Two sets that are alike share one of the rarest shingles of each: the
    first ``n - ceil(similarity * n) + 1`` of them in one order for all sets.
    """

    @F.arrow_udf("array<long>")
    def hashes(sets: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, np.int64) for x in sets.to_pylist()], pa.list_(pa.int64()))

    each = few.select("cls", "n", F.explode(hashes("s")).alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("k"))
    ranked = each.join(counts, "h").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("o"))
    keep = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    tokens = ranked.select("cls", F.explode(F.slice("o", F.lit(1), keep)["h"]).alias("h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("k"), F.min("cls").alias("hub")).filter("k > 1")
    return cut(tokens.join(shared, "h"))


def _few_pairs(tokens: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and crowd links between small sets that meet and have different labels."""
    known = tokens.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    apart = known.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("h")
    known = cut(known.join(apart, "h"))
    small = known.filter(F.col("k") <= BUCKET)
    a, b = (small.select("h", F.col("cls").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    pairs = a.join(b, "h").filter("a < b AND la <> lb").select("a", "b").distinct()
    return pairs, known.filter((F.col("k") > BUCKET) & (F.col("cls") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("cls").alias("b"))


def long_fingerprint(hashes: np.ndarray, bits: int, words: int) -> np.ndarray:
    """``words`` words of ``bits`` bits, by the majority over a text's distinct shingles."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    streams = -(-bits * words // 64)
    step = (np.arange(1, streams + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    counts = np.zeros(64 * streams, np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096, None] + step
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    on = (counts * 2 > len(hashes))[: bits * words].reshape(words, bits)
    padded = np.zeros((words, 64), np.uint8)
    padded[:, 64 - bits :] = on
    return np.packbits(padded, axis=1).view(">u8").astype(np.uint64).ravel()


def _buckets(words: np.ndarray, place: int, head: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that share a variant, one flip away at most, that begins with ``place``.

    Their places by bucket, where the buckets begin, and their sizes.
    """
    low = bits - head
    apart = (words >> np.uint64(low)) ^ np.uint64(place)
    here, beside = np.flatnonzero(apart == 0), np.flatnonzero(np.bitwise_count(apart) == 1)
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(low, dtype=np.uint64)]
    variants = np.concatenate([(words[here, None] ^ flips[None, :]).ravel(), words[beside] ^ (apart[beside] << np.uint64(low))])
    who = np.concatenate([np.repeat(here, len(flips)), beside])
    order = np.argsort(variants, kind="stable")
    variants, who = variants[order], who[order]
    same = variants[1:] == variants[:-1]
    met = np.r_[same, False] | np.r_[False, same] if len(who) else np.zeros(0, bool)
    variants, who = variants[met], who[met]
    first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]][: len(who)])
    return who, first, np.diff(np.r_[first, len(who)])


def _distinct(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    return key // max(n, 1), key % max(n, 1)


def _first_pairs(words: np.ndarray, place: int, head: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in buckets, as many as join all that meet."""
    who, first, size = _buckets(words, place, head, bits)
    inner = np.ones(len(who), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    a, b = _distinct(who[at - 1], who[at], len(words))
    kept = _spanning(len(words), a, b)
    return a[kept], b[kept]


def _later_pairs(words: np.ndarray, labels: np.ndarray, place: int, head: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of unlike label in small buckets, and with a flag the links that hold crowded ones together."""
    who, first, size = _buckets(words, place, head, bits)
    if len(who):  # buckets of one label have nothing left to join
        own = labels[who]
        mixed = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
        bucket = np.repeat(np.arange(len(first)), size)[mixed]
        who = who[mixed]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(who)])
        size = np.diff(np.r_[first, len(who)])
    lead, large = np.repeat(who[first], size), np.repeat(size > BUCKET, size)
    crowd = local_labels(len(words), lead[large], who[large])
    hung = np.flatnonzero(crowd != np.arange(len(words)))
    bucket, who = np.repeat(np.arange(len(first)), size)[~large], who[~large]
    pairs = [np.zeros((2, 0), np.int64)]
    for d in range(1, BUCKET):
        near = np.flatnonzero((bucket[d:] == bucket[:-d]) & (labels[who[d:]] != labels[who[:-d]]))
        pairs.append(np.stack([who[near], who[near + d]]))
    a, b = np.concatenate(pairs, axis=1)
    apart = crowd[a] != crowd[b]  # a crowd compares its own
    a, b = _distinct(a[apart], b[apart], len(words))
    return np.r_[a, crowd[hung]], np.r_[b, hung], np.r_[np.zeros(len(a), bool), np.ones(len(hung), bool)]


def _compare(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets that are alike and of different label, enough to join all that are linked.

    Each of ``rows`` is compared with every other set.
    """
    size = np.array([len(x) for x in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    start = np.r_[0, np.cumsum(size)]
    posting = who[np.argsort(token, kind="stable")]
    begin = np.r_[0, np.cumsum(count)]
    label = np.unique(label, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    for i in rows:
        own = token[start[i] : start[i + 1]]
        shared = np.bincount(np.concatenate([posting[begin[t] : begin[t + 1]] for t in own]), minlength=len(sets))
        near = np.flatnonzero((shared / np.maximum(1, size + size[i] - shared) >= similarity) & (label != label[i]))
        for part in np.unique(label[near]):
            links.append((i, near[label[near] == part][0]))
            label[label == part] = label[i]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return ids[a], ids[b]


def _crowd_links(crowds: DataFrame, classes: DataFrame, labels: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links within each crowd between members of different label that are alike, enough to join all that are linked.

    ``crowds`` (``node``, ``component``) are sets that met in crowded buckets.  Those
    outside the crowd's largest group meet all members in a grid of blocks.
    """
    of = crowds.select(F.col("node").alias("cls"), F.col("component").alias("crowd")).join(classes.select("cls", "n"), "cls")
    of = of.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    parts = of.groupBy("crowd", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    size = parts.groupBy("crowd").agg(
        F.max(F.struct("k", "label"))["label"].alias("main"), F.sum("k").alias("m"), F.sum("n").alias("all"), F.max("k").alias("top")
    )
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES))
    size = size.filter("m > top").withColumn("blocks", blocks.cast("int"))
    size = cut(size.select("crowd", "main", "blocks", F.ceil((F.col("m") - F.col("top")) * F.col("blocks") / F.col("m")).cast("int").alias("rows")))
    of = cut(of.join(F.broadcast(size) if size.count() <= SMALL else size, "crowd").join(held.withColumnRenamed("id", "cls"), "cls"))
    block, line = F.pmod(F.xxhash64("cls"), "blocks").cast("int"), F.pmod(F.xxhash64("cls", F.lit(2)), "rows").cast("int")
    fields = ["crowd", "cls", "label", "s"]
    strays = of.filter("label != main").select(*fields, line.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("stray"))
    others = of.filter("blocks > 1 OR label = main").select(*fields, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), block.alias("j"), F.lit(False).alias("stray"))

    def across(table: pa.Table) -> pa.Table:
        ids, stray = table.column("cls").to_numpy(), table.column("stray").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        a, b = _compare(ids, sets, table.column("label").to_numpy(), np.flatnonzero(stray), similarity)
        release_memory()
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return strays.unionByName(others).groupBy("crowd", "i", "j").applyInArrow(across, "a long, b long")


def similar_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """Each row's id and ``component_id``: groups of texts with like sets of shingles.

    Two texts are linked when their sets of shingles have at least that Jaccard
    similarity, which is computed for every pair that meets.  All pairs meet where
    one text has at most ``FEW`` shingles; of larger ones that are alike by just so
    much, a part of ``MISSED`` does not.  Texts of fewer words than a shingle are
    one shingle; texts without words are linked with each other.  Ids are integers
    and unique; a null id is a row of its own group, with a null ``component_id``.
    An empty table gives an empty result.  Very long texts are compared whole; a task
    needs memory for some of their shingle sets at once.  Other columns are ignored,
    whatever their names.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    bits, words = layout(narrow.count(), similarity)
    few = math.floor(FEW / similarity + 1e-9)

    @F.arrow_udf("struct<key:binary,n:long,fp:binary,s:binary>")
    def describe(texts: pa.Array) -> pa.Array:
        made = []
        for raw in raw_texts(texts):
            own = np.sort(shingles_of(raw, shingle))
            fp = long_fingerprint(own, bits, words).tobytes() if len(own) > FEW else None
            made.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), fp, own.tobytes() if len(own) <= few else None))
        release_memory()
        key, n, fp, s = zip(*made, strict=True) if made else ((), (), (), ())
        fields = [pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(s, pa.binary())]
        return pa.StructArray.from_arrays(fields, ["key", "n", "fp", "s"])

    rows = cut(narrow.withColumn("d", describe("t")).select("id", "d.*"))
    classes = cut(rows.filter("id IS NOT NULL").groupBy("key", "n", "fp", "s").agg(F.min("id").alias("cls")))
    many = classes.filter(F.col("n") > FEW)
    n = many.count()
    head = min(bits - 1, max(0, math.ceil(math.log2(max(1, n * (bits + 1)) / PLACE_VARIANTS)) + 1))
    heads = np.r_[0, 1 << np.arange(head)].astype(np.int64)
    fields = [("word", pa.int32()), ("place", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary())]

    def dealt(members: DataFrame, used: int) -> DataFrame:
        """The first ``used`` words of each member (``cls``, ``label``, ``fp``) at the places where its variants begin."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    part = batch.slice(at, 2000)
                    word = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint64).reshape(len(part), words)
                    ids, labels = part.column("cls").to_numpy(), part.column("label").to_numpy()
                    labels = np.where(labels == ids, 0, labels + 1)  # most are their own, and zeros compress
                    out = {name: [] for name, _ in fields}
                    for j in range(used):
                        own = (word[:, j] >> np.uint64(bits - head)).astype(np.int64)
                        place = (own[:, None] ^ heads[None, :]).ravel()
                        who = np.repeat(np.arange(len(part)), len(heads))
                        order = np.argsort(place, kind="stable")
                        place, who = place[order], who[order]
                        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                        for p, group in zip(place[starts], np.split(who, starts[1:]), strict=True):
                            for k, v in zip(out, (j, int(p), word[group, j].tobytes(), ids[group].tobytes(), labels[group].tobytes()), strict=True):
                                out[k].append(v)
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema(fields))

        return members.select("cls", "label", "fp").mapInArrow(deal, "word int, place long, words binary, ids binary, labels binary").groupBy("word", "place")

    def opened(table: pa.Table) -> list[np.ndarray]:
        kinds = (("words", np.uint64), ("ids", np.int64), ("labels", np.int64))
        word, ids, labels = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds)
        return word, ids, np.where(labels == 0, ids, labels - 1)

    def told(ids: np.ndarray, a: np.ndarray, b: np.ndarray, crowd: np.ndarray) -> pa.Table:
        a, b = ids[a], ids[b]
        release_memory()
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "crowd": pa.array(crowd)})

    def early(key: tuple, table: pa.Table) -> pa.Table:
        word, ids, _ = opened(table)
        a, b = _first_pairs(word, key[1].as_py(), head, bits)
        return told(ids, a, b, np.zeros(len(a), bool))

    def late(key: tuple, table: pa.Table) -> pa.Table:
        word, ids, labels = opened(table)
        return told(ids, *_later_pairs(word, labels, key[1].as_py(), head, bits))

    high = most_differing(bits * words, similarity)

    @F.arrow_udf("long")
    def differing(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, words) for c in (a, b))
        return pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64))

    left, right = many.select(F.col("cls").alias("a"), F.col("fp").alias("fa")), many.select(F.col("cls").alias("b"), F.col("fp").alias("fb"))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(left, "a").join(right, "b").filter(differing("fa", "fb") <= high).select("a", "b")

    met_as = "a long, b long, crowd boolean"
    tokens = _few_tokens(classes.filter((F.col("n") > 0) & (F.col("n") <= few)).select("cls", "n", "s"), similarity)
    # Round one: few pairs of each word.
    met = dealt(many.withColumn("label", F.col("cls")), min(FIRST_WORDS, words)).applyInArrow(early, met_as)
    hubs = tokens.filter("cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    pairs = cut(near(met.select("a", "b").distinct()).unionByName(hubs).distinct())
    held = _wanted(narrow, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), shingle)
    labels = cut(connected_components(_alike(pairs, held, similarity))).select(F.col("node").alias("cls"), F.col("component").alias("label"))
    # Round two: whatever meets and is not joined yet.
    known = many.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    met = cut(dealt(known, words).applyInArrow(late, met_as).distinct())
    few_pairs, few_crowds = _few_pairs(tokens, labels)
    pairs = cut(near(met.filter("NOT crowd").select("a", "b")).unionByName(few_pairs).distinct())
    crowds = cut(connected_components(met.filter("crowd").select("a", "b").unionByName(few_crowds)))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowds.select("node"))
    held = _wanted(narrow, ids, shingle)
    links = labels.select(F.col("cls").alias("a"), F.col("label").alias("b")).unionByName(_alike(pairs, held, similarity))
    links = links.unionByName(_crowd_links(crowds, classes, labels, held, similarity))
    comps = connected_components(links)
    to = classes.join(comps, F.col("cls") == F.col("node"), "left")
    to = to.select(F.col("key").alias("_key"), F.coalesce("component", "cls").alias("component_id"))
    return rows.join(to, (F.col("key") == F.col("_key")) & F.col("id").isNotNull(), "left").select(F.col("id").alias(id_col), "component_id")
