"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks; a block keeps, for each dimension, the list of
its rows sorted by that component.  Queries walk all lists at once, a few at a
time, score every row they meet, and one stops as soon as the score that the
walk's present depth still allows cannot beat its k-th best.
Queries come in blocks as well, and every pair of blocks is a task of bounded
size.  The first block is searched by itself: a query's k-th best score there is its
floor in all others, which stops walks earlier and keeps lower rows from being
handed on.  The best of what is handed on are taken by a window that Spark limits
before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut
from .vectors import as_bytes, matrix

BLOCK = 4096
QUERIES = 1024
#: Queries that read the lists together.
TOGETHER = 128
#: Depth to which the lists are read before the bound is first looked at; then it doubles.
DEPTH = 32
LIMIT = float(1 << 62)


def quantized(scale: int):
    def convert(v: np.ndarray) -> bytes:
        return np.clip(np.floor(v * scale), -LIMIT, LIMIT).astype("<i8").tobytes()

    return convert


def _best(scores: np.ndarray, rows: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each line, ties to the smaller row number, best first."""
    if exact:  # score and row number in one number that a float holds
        key = scores * float(1 << 20) - rows
        if key.shape[1] > k:
            pick = np.argpartition(-key, k - 1, axis=1)[:, :k]
            scores, rows, key = (np.take_along_axis(x, pick, 1) for x in (scores, rows, key))
        order = np.argsort(-key, axis=1, kind="stable")
    else:
        order = np.stack([np.lexsort((r, -s)) for s, r in zip(scores, rows, strict=True)])[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)


def threshold_search(
    queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, k: int, floor: np.ndarray | None = None
):
    """The ``k`` best rows for each query: scores and row numbers, best first, ties to the smaller id.

    ``ids`` rise; ``own`` are the ids that are no candidates of their queries;
    ``lists[:, j]`` are the row numbers by falling component ``j``.  Queries read the
    lists together, from both ends, and leave one by one: a query is done when what
    the lists can still hold for it, each component at its present depth, is less
    than its k-th best.  Missing places have row number -1.
    """
    n, m = len(rows), len(queries)
    low = -np.inf if rows.dtype == np.float64 else -(1 << 200)
    exact = rows.dtype == np.float64 and n < 1 << 20 and float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1] < 2**32
    best_s = np.full((m, k), low, rows.dtype)
    best_r = np.full((m, k), -1, np.int64)
    gain, loss = np.maximum(queries, 0), np.minimum(queries, 0)
    met = np.zeros(n, bool)
    live, dims = np.arange(m), np.arange(rows.shape[1])
    lo, hi = 0, min(DEPTH, n)
    while True:
        new = np.zeros(n, bool)
        new[lists[lo:hi].ravel()] = True
        new[lists[n - hi : n - lo].ravel()] = True
        fresh = np.flatnonzero(new & ~met)
        met |= new
        if len(fresh):
            scores = queries[live] @ rows[fresh].T
            scores[ids[fresh][None, :] == own[live][:, None]] = low
            every = np.concatenate([best_s[live], scores], axis=1)
            which = np.concatenate([best_r[live], np.broadcast_to(fresh, scores.shape)], axis=1)
            which[every == low] = -1
            best_s[live], best_r[live] = _best(every, which, k, exact)
        if hi >= n:
            break
        bound = gain[live] @ rows[lists[hi - 1], dims] + loss[live] @ rows[lists[n - hi], dims]
        least = best_s[live].min(axis=1)
        if floor is not None:
            least = np.maximum(least, floor[live])
        live = live[bound >= least]  # an equal score could still win by its id
        if not len(live):
            break
        lo, hi = hi, min(2 * hi, n)
    if floor is not None:
        best_r[best_s < floor[:, None]] = -1
    return best_s, best_r


def top_k(
    df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, k: int = 20
) -> DataFrame:
    """For each row that ``is_query`` marks: the ``k`` rows of highest score.

    A component counts as floor(scale * x); the score is the integer inner
    product.  Returns ``query_id``, ``rank`` (from 1), the id and ``score``; ties
    go to the smaller id.  Rows with the query's own id are no candidates of it.

    Vectors that are null or empty, or hold null or non-finite components, take
    no part, neither do rows without an id; vectors of different lengths do not
    meet.  Rows that repeat a query's id and vector ask once; other repeated rows are each a
    candidate.  Components beyond 2**62 and scores beyond 64 bits are clipped.  An
    empty table gives an empty result.  Vectors of very many components are compared
    whole, in blocks of ``BLOCK`` rows.  Other columns are ignored, whatever their names.
    """
    marked = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = cut(
        as_bytes(marked.filter("id IS NOT NULL"), "v", ["id", "q"], quantized(scale))
        .filter("raw IS NOT NULL")
        .withColumn("dim", F.octet_length("raw"))
    )
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, groups = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked / QUERIES))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        data = matrix(table.column("raw").to_pylist(), "<i8")[order]
        lists = np.argsort(-data, axis=0, kind="stable").astype("<i4")
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([key[1].as_py()], pa.int64()),
            "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
            "data": pa.array([data.tobytes()], pa.binary()), "lists": pa.array([lists.tobytes()], pa.binary()),
        })

    def search(key: tuple, packed: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"query_id": [], "ask": [], "id": [], "score": []}
        if len(packed) and len(asking):
            row = packed.to_pylist()[0]
            ids = np.frombuffer(row["ids"], "<i8")
            data = np.frombuffer(row["data"], "<i8").reshape(len(ids), -1)
            lists = np.frombuffer(row["lists"], "<i4").reshape(len(ids), -1)
            asked = matrix(asking.column("raw").to_pylist(), "<i8")
            most = float(np.abs(data).max()) * float(np.abs(asked).max()) * data.shape[1]
            kind = np.float64 if most < 2**52 else object  # whole numbers stay exact either way
            data, asked = data.astype(kind), asked.astype(kind)
            own, ask = asking.column("id").to_numpy(), asking.column("ask").to_numpy()
            floor = np.array([-(1 << 200) if f is None else f for f in asking.column("floor").to_pylist()], kind)
            for lo in range(0, len(asked), TOGETHER):
                part = slice(lo, lo + TOGETHER)
                scores, found = threshold_search(asked[part], own[part], ids, data, lists, k, floor[part])
                at, place = np.nonzero(found >= 0)
                out["query_id"] += own[part][at].tolist()
                out["ask"] += ask[part][at].tolist()
                out["id"] += ids[found[at, place]].tolist()
                out["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores[at, place]]
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    packed = rows.withColumn("c", F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)).cast("long"))
    packed = packed.groupBy("dim", "c").applyInArrow(pack, "dim int, c long, ids binary, data binary, lists binary")
    asking = rows.filter("q").select("id", "raw", "dim").distinct().withColumn("ask", F.xxhash64("raw"))
    asking = asking.withColumn("g", F.pmod(F.xxhash64("id", "raw"), F.lit(groups)).cast("int"))
    keys = ["dim", "c", "g"]

    def searched(part: DataFrame, asking: DataFrame) -> DataFrame:
        spread = part.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy(*keys)
        return spread.cogroup(asking.groupBy(*keys)).applyInArrow(search, "query_id long, ask long, id long, score long")

    none = F.lit(None).cast("long")
    found = cut(searched(packed.filter("c = 0"), asking.withColumn("c", F.lit(0).cast("long")).withColumn("floor", none)))
    if blocks > 1:
        # Clipped scores do not tell what lies beyond them, so they are no floor.
        floors = found.groupBy(F.col("query_id").alias("id"), "ask").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        floors = floors.filter((F.col("n") >= k) & F.col("floor").between(-(2**62), 2**62)).select("id", "ask", "floor")
        rest = asking.join(floors, ["id", "ask"], "left")
        rest = rest.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = found.unionByName(searched(packed.filter("c > 0"), rest))
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
