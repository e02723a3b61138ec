"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length 1 and dealt to coarse inverted lists by their
nearest centroid; what is left of each after its centroid is coded by subspace.
A vector probes every list that can hold a link of it: a linked vector lies
within ``r`` of it, so the list's cell must come within ``r`` of it too, which a
plane between two centroids tells.  In a list, distances come from a table of the
query's distances to all code words.  Each stored vector's own coding error is
kept with it, so a pair is passed over only when its table distance less that
error is beyond ``r``; all others are compared by exact cosine.  Probes and codes
therefore lose no link.

What travels to the probed lists are codes: of stored vectors the code words and
the coding error, of queries one byte a component and how far that is off, which
widens the bound.  So a first pass over bytes tells which queries have a candidate in
which lists, and only these are sent there whole, to be compared exactly.

Centroids and code words are fitted on at most ``FIT_ROWS`` vectors, those whose
hashes are least; every vector is indexed.  Equal vectors with equal labels are
one entry that knows its number.  A list that many vectors share or probe is cut
into a grid of blocks.  Links are counted in the tasks and only a spanning forest
of them is handed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .components import connected_components, local_labels
from .vectors import as_bytes, matrix

#: The bound of the sample on which centroids and code words are fitted.
FIT_ROWS = 10_000
MOST_LISTS = 1024
SUBSPACES = 8
WORDS = 256
#: What 32-bit sums of squares may be off by, under the root.
ROUNDING = 2e-3
#: Vectors dealt together.
DEALT = 4096
#: Stored and probing vectors of a task.
STORED, PROBING = 4096, 8192
#: Pairs compared at once.
PAIRS = 1 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced rows; an empty one keeps its place."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        to = (centers**2).sum(1)[None, :] - 2 * x @ centers.T
        to = to.argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, to, x)
        n = np.bincount(to, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


class Codebook:
    """Coarse centroids and, for each subspace, code words of residuals."""

    def __init__(self, centers: np.ndarray, words: list[np.ndarray]):
        self.centers, self.words = centers, words
        self.cuts = np.cumsum([0, *(w.shape[1] for w in words)])
        between = self.centers[:, None, :] - self.centers[None, :, :]
        self.apart = np.sqrt((between**2).sum(2))

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Codebook:
        centers = kmeans(sample, min(lists, len(sample)))
        d = sample.shape[1]
        cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(np.int64)
        left = sample - centers[Codebook(centers, []).near(sample)[0]]
        return Codebook(centers, [kmeans(left[:, a:b], min(WORDS, len(left))) for a, b in zip(cuts, cuts[1:], strict=False)])

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and squared distances to all."""
        d = (x**2).sum(1)[:, None] + (self.centers**2).sum(1)[None, :] - 2 * x @ self.centers.T
        return d.argmin(1), d

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code words and coding errors of rows in the lists ``at``."""
        left = x - self.centers[at]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        error = np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            d = (left[:, a:b] ** 2).sum(1)[:, None] + (self.words[m] ** 2).sum(1)[None, :] - 2 * left[:, a:b] @ self.words[m].T
            codes[:, m] = d.argmin(1)
            error += ((left[:, a:b] - self.words[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the lists whose cells come within ``radius`` of them."""
        own, d = self.near(x)
        reach = d - d[np.arange(len(x)), own][:, None] <= 2 * radius * self.apart[own] + 1e-9
        return np.nonzero(reach)

    def table(self, q: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances of the queries' residuals to every code word, by subspace."""
        left = q - self.centers[at]
        out = []
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            part = left[:, a:b]
            out.append((part**2).sum(1)[:, None] + (self.words[m] ** 2).sum(1)[None, :] - 2 * part @ self.words[m].T)
        return out


def unit_bytes(v: np.ndarray) -> bytes | None:
    top = np.abs(v).max()
    if not top:
        return None
    v = v / top  # no square overflows
    return (v / np.sqrt((v**2).sum())).astype("<f8").tobytes()


def compare(book: Codebook, at: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float):
    """Index pairs (query, stored) of cosine at least ``cosine``, in slices."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    step = max(1, PAIRS // max(1, len(x)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        near = np.zeros((len(part), len(x)))
        for m, table in enumerate(book.table(part, at)):
            near += table[:, codes[:, m]]
        a, b = np.nonzero(np.sqrt(np.maximum(near, 0)) - error[None, :] <= radius)
        hits = []
        for s in range(0, len(a), PAIRS // 8):
            i, j = a[s : s + PAIRS // 8], b[s : s + PAIRS // 8]
            hits.append(np.einsum("ij,ij->i", part[i], x[j]) >= cosine)
        ok = np.concatenate(hits) if hits else np.zeros(0, bool)
        yield a[ok] + lo, b[ok]


def _fit(classes: DataFrame, n: int) -> dict[int, tuple]:
    """A codebook's centroids and words for each length of vectors that the sample holds."""
    rows = classes.select("raw", F.octet_length("raw").alias("dim")).orderBy(F.xxhash64("raw"), "raw").limit(FIT_ROWS).collect()
    lists = int(min(MOST_LISTS, max(1, math.sqrt(n) / 4)))
    by: dict[int, list[bytes]] = {}
    for row in rows:
        by.setdefault(row["dim"], []).append(bytes(row["raw"]))
    fitted = {dim: Codebook.fit(matrix(raws, "<f8"), min(lists, max(1, len(raws) // 8))) for dim, raws in by.items()}
    return {dim: (book.centers, book.words) for dim, book in fitted.items()}


def near_vectors(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """Links of cosine at least ``cosine`` between vectors of the same label.

    Returns a row per input row: the id, ``n_links`` (other rows linked directly),
    ``component_id`` (least id reachable) and ``kept`` (whether that is the row's own).

    Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows without a label link with nothing; neither do vectors of different
    lengths.  Repeated rows link with each other.  A null id is passed over in the
    choice of the least; a component without any id has a null ``component_id``.
    An empty table gives an empty result.  Very long vectors are compared whole.  Other
    columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    narrow = df.select(df[id_col].cast("long").alias("id"), df[label_col].alias("label"), df[vector_col].alias("v"))
    rows = cut(as_bytes(narrow, "v", ["id", "label"], unit_bytes))
    able = F.col("raw").isNotNull() & F.col("label").isNotNull()
    classes = rows.filter(able).groupBy("label", "raw").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    if n:
        books = spark.sparkContext.broadcast(_fit(classes, n))  # bounded by FIT_ROWS and MOST_LISTS
        out = cut(_linked(classes, books, cosine))
        counts = out.filter("n IS NOT NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
        comps = connected_components(out.filter("n IS NULL").select("a", "b"))
        joined = classes.join(counts, "cls", "left").join(comps, F.col("cls") == F.col("node"), "left")
        joined = joined.select(
            "label", "raw", "first", F.coalesce("component", "cls").alias("c"),
            (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        )
        least = joined.groupBy("c").agg(F.min("first").alias("component_id"))
        told = joined.join(least, "c").select(F.col("label").alias("_l"), F.col("raw").alias("_r"), "n_links", "component_id")
        linked = rows.filter(able).join(told, (F.col("label") == F.col("_l")) & (F.col("raw") == F.col("_r")))
        alone = rows.filter(~able)
        found = linked.select("id", "n_links", "component_id").unionByName(
            alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        )
    else:
        found = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def small_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as one signed byte a component, the steps of these bytes, and the lengths of what is lost."""
    step = np.maximum(np.abs(x).max(1), 1e-30) / 127
    small = np.rint(x / step[:, None]).astype(np.int8)
    return small, step, np.sqrt(((x - small * step[:, None]) ** 2).sum(1))


_DEALT = [("label", None), ("dim", pa.int32()), ("list", pa.int32()), ("role", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("slack", pa.binary())]


def _linked(classes: DataFrame, books, cosine: float) -> DataFrame:
    """Counts (``a``, ``n``) and forest links (``a``, ``b``) between classes."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    label = classes.schema["label"].dataType.simpleString()
    where = ["label", "dim", "list"]

    def groups(batches):
        """Vectors of one length, with their book and their own lists."""
        known = {dim: Codebook(*state) for dim, state in books.value.items()}
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            sizes = np.fromiter(map(len, raws), np.int64, len(raws))
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for s in range(0, len(own), DEALT):
                    part = own[s : s + DEALT]
                    x = matrix([raws[i] for i in part], "<f8")
                    book = known.get(int(dim))  # a length that the sample lacks has one list and no codes
                    yield batch.take(pa.array(part)), int(dim), x, book, book.near(x)[0] if book else np.zeros(len(part), np.int64)

    def housed(batches):
        for rows, dim, _, _, at in groups(batches):
            extra = [pa.array(np.full(len(at), dim, np.int32)), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("cls", "label", "raw", "size")), *extra], ["cls", "label", "raw", "size", "dim", "list"])

    def deal(batches):
        for rows, dim, x, book, at in groups(batches):
            ids, labels = rows.column("cls").to_numpy(), rows.column("label")
            tag = np.unique(np.array(labels.to_pylist(), object).astype(str), return_inverse=True)[1]
            small, step, lost = small_bytes(x)
            codes, error = book.encode(x, at) if book else (np.zeros((len(x), 0), np.uint8), np.zeros(len(x)))
            who, probe = book.probes(x, radius) if book else (np.arange(len(x)), at)
            out = {name: [] for name, _ in _DEALT}
            for role, i, to in ((0, np.arange(len(x)), at), (1, who, probe)):
                order = np.lexsort((to, tag[i]))
                i, to = i[order], to[order]
                starts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (tag[i][1:] != tag[i][:-1])])
                for g in np.split(np.arange(len(i)), starts[1:]):
                    own = i[g]
                    data = codes[own] if role == 0 else np.concatenate([step[own, None].view(np.int8), small[own]], axis=1)
                    slack = error[own] if role == 0 else lost[own]
                    values = (labels[int(own[0])].as_py(), dim, int(to[g[0]]), role, len(own), ids[own].tobytes(), data.tobytes(), slack.tobytes())
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
            schema = pa.schema([(name, kind or labels.type) for name, kind in _DEALT])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    homes = cut(classes.select("cls", "label", "raw", "size").mapInArrow(housed, f"cls long, label {label}, raw binary, size long, dim int, list int"))
    dealt = cut(
        classes.select("cls", "label", "raw").mapInArrow(
            deal, f"label {label}, dim int, list int, role int, n long, ids binary, data binary, slack binary"
        )
    )
    dealt = dealt.withColumn("h", F.xxhash64("ids"))
    grid = dealt.groupBy(*where).agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("role") == 0, F.col("n")).otherwise(0)) / STORED)).cast("int").alias("ns"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("role") == 1, F.col("n")).otherwise(0)) / PROBING)).cast("int").alias("nq"),
    )
    placed = dealt.join(cut(grid), where)

    def side(role: int, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        part = placed.filter(F.col("role") == role).withColumn(own, F.pmod("h", F.col(n_own)).cast("int"))
        return part.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select(*[F.col(c).alias(c) for c in (*where, "s", "q", "ids", "data", "slack")])

    def joined(table: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def screen(key: tuple, kept: pa.Table, asking: pa.Table) -> pa.Table:
        """Queries that the codes of a list's block do not rule out."""
        out = np.zeros(0, np.int64)
        if len(kept) and len(asking):
            state, at = books.value.get(key[1].as_py()), key[2].as_py()
            own, who = joined(kept, "ids", np.int64), joined(asking, "ids", np.int64)
            if state is None:
                out = who
            else:
                book, dim = Codebook(*state), key[1].as_py() // 8
                codes, error = joined(kept, "data", np.uint8).reshape(len(own), -1), joined(kept, "slack", np.float64)
                packed, lost = joined(asking, "data", np.int8).reshape(len(who), 8 + dim), joined(asking, "slack", np.float64)
                q = packed[:, 8:].astype(np.float64) * packed[:, :8].copy().view(np.float64)
                place = np.argsort(own)
                self_at = np.minimum(np.searchsorted(own[place], who), len(own) - 1)
                self_at = np.where(own[place[self_at]] == who, place[self_at], -1)
                found, step = [], max(1, PAIRS // max(1, len(own)))
                for lo in range(0, len(who), step):
                    part = slice(lo, lo + step)
                    near = np.zeros((len(q[part]), len(own)), np.float32)
                    for m, table in enumerate(book.table(q[part], at)):
                        near += table.astype(np.float32)[:, codes[:, m]]
                    np.sqrt(np.maximum(near, 0, out=near), out=near)
                    near -= error[None, :].astype(np.float32)
                    mine = self_at[part]
                    near[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
                    found.append(who[part][near.min(axis=1) <= radius + lost[part] + ROUNDING])
                out = np.concatenate(found)
        none = [key[i] for i in (0, 1, 2, 3)]
        columns = [pa.array([k.as_py()] * len(out), k.type) for k in none]
        return pa.Table.from_arrays([*columns, pa.array(out, pa.int64())], [*where, "s", "cls"])

    keys = [*where, "s", "q"]
    stored = side(0, "s", "q", "ns", "nq").groupBy(*keys)
    left = cut(stored.cogroup(side(1, "q", "s", "nq", "ns").groupBy(*keys)).applyInArrow(screen, f"label {label}, dim int, list int, s int, cls long").distinct())
    # The first pass dealt packed rows into blocks; the second deals the vectors of a list anew.
    left = left.select(*where, "cls").distinct()
    busy = left.groupBy(*where).agg(F.count("*").alias("asked"))
    sizes = homes.groupBy(*where).agg(F.count("*").alias("held")).join(busy, where)
    sizes = sizes.select(*where, F.ceil(F.col("held") / STORED).cast("int").alias("ns"), F.ceil(F.col("asked") / PROBING).cast("int").alias("nq"))
    sizes = cut(sizes)

    def whole(df: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        part = df.join(sizes, where).withColumn(own, F.pmod(F.xxhash64("cls"), F.col(n_own)).cast("int"))
        return part.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).select(*[F.col(c).alias(c) for c in (*where, "s", "q", "cls", "raw", "size")])

    asking = left.join(classes.select("cls", "raw", "size"), "cls")

    def meet(key: tuple, kept: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "n": []}
        if len(kept) and len(asking):
            x, q = (matrix(t.column("raw").to_pylist(), "<f8") for t in (kept, asking))
            own, who = kept.column("cls").to_numpy(), asking.column("cls").to_numpy()
            weight = kept.column("size").to_numpy()
            state, at = books.value.get(key[1].as_py()), key[2].as_py()
            book = Codebook(*state) if state else Codebook.fit(x[:FIT_ROWS], 1)
            codes, error = book.encode(x, np.full(len(x), at))
            nodes = np.unique(np.concatenate([own, who]))
            on, wn = np.searchsorted(nodes, own), np.searchsorted(nodes, who)
            counts = np.zeros(len(who), np.int64)
            label = np.arange(len(nodes))
            for a, b in compare(book, at, q, x, codes, error, cosine):
                apart = who[a] != own[b]
                a, b = a[apart], b[apart]
                counts += np.bincount(a, weights=weight[b], minlength=len(who)).astype(np.int64)
                la, lb = label[wn[a]], label[on[b]]
                new = la != lb
                if new.any():
                    key2 = np.unique(np.minimum(la[new], lb[new]) * len(nodes) + np.maximum(la[new], lb[new]))
                    label = local_labels(len(nodes), key2 // len(nodes), key2 % len(nodes))[label]
            forest, some = np.flatnonzero(label != np.arange(len(nodes))), np.flatnonzero(counts)
            out["a"] = [*who[some].tolist(), *nodes[label[forest]].tolist()]
            out["b"] = [*[None] * len(some), *nodes[forest].tolist()]
            out["n"] = [*counts[some].tolist(), *[None] * len(forest)]
        return pa.table(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    stored = whole(homes, "s", "q", "ns", "nq").groupBy(*keys)
    return stored.cogroup(whole(asking, "q", "s", "nq", "ns").groupBy(*keys)).applyInArrow(meet, "a long, b long, n long")
