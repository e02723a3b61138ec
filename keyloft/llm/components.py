"""Connected components of a graph whose edges are spread over the cluster.

Rounds of two star operations: each node's larger neighbours are hung on its
least one, then its smaller ones are.  The edges shrink to one star for each
component; the number of rounds grows with the logarithm of the longest path.
Links, nodes and labels never leave the executors; the driver sees two numbers
a round.  Each round is cut off at the shared checkpoint folder, so a lost
executor costs one round at most.  As few links as ``LOCAL_LINKS`` are not worth
rounds: they are counted first, and one task joins them, with the same result.

A node with very many neighbours is no task of its own: least neighbours are
taken by partial aggregation, and the join that brings them back is one whose
large partitions adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

MAX_ROUNDS = 100
#: Links that one task joins, 16 MB of them at most; more are joined in rounds.
LOCAL_LINKS = 1 << 20


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes ``0..n-1`` with links ``a[i]-b[i]``: the least node each one reaches."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND((1 << 40) - 1))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have ``v < u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """Components of few links, in one task."""

    def solve(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = local_labels(len(nodes), at[: len(u)], at[len(u) :])
        for lo in range(0, len(nodes), 100_000):
            own = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(solve, "node long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its least node) for every node that has a link.

    Nodes are longs.  Links to oneself, repeated links and links with a null end
    are ignored; no links give an empty result.
    """
    lo, hi = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    kept = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(kept.select(hi, lo).distinct())
    state = _state(edges)
    if state[0] <= LOCAL_LINKS:
        return _joined(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
