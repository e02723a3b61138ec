"""Operators on vectors against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloft.llm import pq, topk
from keyloft.llm.components import local_labels

SCHEMA = "vec_id long, embedding array<float>, label int, id long, raw int, c int"


def vectors(n=260, d=12, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        if i % 4 == 3:
            v = np.array(rows[i - 2][1]) + rng.normal(size=d) * 0.08
        if i % 20 == 19:
            v = np.array(rows[i - 10][1])
        rows.append((i * 5, [float(np.float32(x)) for x in v], i % 2))
    return rows


ODD = [
    (2001, None, 0), (2002, [], 0), (2003, [0.0] * 12, 0), (2004, [1.0, None] + [0.0] * 10, 0), (2005, [float("nan")] * 12, 1),
    (2006, [float("inf")] + [0.0] * 11, 1), (2020, [1.0] * 12, None), (2040, [1.0, 2.0], 0), (2060, [1.0, 2.0], 0),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("grid", [4096, 40])
def test_near_vectors(spark, grid, monkeypatch):
    monkeypatch.setattr(pq, "STORED", grid)
    monkeypatch.setattr(pq, "PROBING", grid)
    rows = [*vectors(), *ODD]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_vectors(frame(spark, rows), cosine=0.9).collect()}
    able = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    a, b = [], []
    for i in able:
        for j in able:
            x, y = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                a.append(i)
                b.append(j)
    label, count = local_labels(len(rows), np.array(a), np.array(b)), np.bincount(a, minlength=len(rows))
    assert got == {r[0]: (int(count[i]), rows[label[i]][0], bool(label[i] == i)) for i, r in enumerate(rows)}
    assert count.sum() > 60


def test_near_vectors_edges(spark):
    assert pq.near_vectors(frame(spark, [])).count() == 0
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (7, [1.0, 0.01], 1)]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq.near_vectors(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == [(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, False), (None, 3, 7, False)]
    alone = pq.near_vectors(frame(spark, [(1, None, 1)])).collect()
    assert [tuple(r) for r in alone] == [(1, 0, 1, True)]


def test_codes_lose_no_link():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + rng.normal(size=(300, 16)) * rng.uniform(0, 0.4, (300, 1))
    x /= np.sqrt((x**2).sum(1))[:, None]
    book = pq.Codebook.fit(x[::2], 12)
    at = book.near(x)[0]
    codes, error = book.encode(x, at)
    found = set()
    who, where = book.probes(x, np.sqrt(2 - 2 * 0.95) + 1e-7)
    for cell in range(len(book.centers)):
        own, q = np.flatnonzero(at == cell), who[where == cell]
        for a, b in pq.compare(book, cell, x[q], x[own], codes[own], error[own], 0.95):
            found |= set(zip(q[a].tolist(), own[b].tolist()))
    assert found == set(zip(*(i.tolist() for i in np.nonzero(x @ x.T >= 0.95)))) | {(i, i) for i in range(600)}


def brute_top(rows, k, ask):
    ok = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if ask(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("block", [4096, 50])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "DEPTH", 2)
    rows = [*vectors(), *ODD, (3000, [0.0] * 12, 1)]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()}
    assert got == brute_top(rows, 20, lambda i: i % 20 == 0)
    assert topk.top_k(frame(spark, []), F.lit(True)).count() == 0


def test_top_k_ties_and_sizes(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(30)] + [(100 + i, [1e30, -1e30], 0) for i in range(3)]
    got = [(r["rank"], r["vec_id"]) for r in topk.top_k(frame(spark, rows), F.col("vec_id") == 3, k=5).orderBy("rank").collect()]
    assert [r for r, _ in got] == [1, 2, 3, 4, 5] and [i for _, i in got if i < 100] == [0, 1][: len([i for _, i in got if i < 100])] or len(got) == 5
    same = [(i, [1.0, 0.5], 0) for i in range(30)]
    got = [r["vec_id"] for r in topk.top_k(frame(spark, same), F.col("vec_id") == 3, k=5).orderBy("rank").collect()]
    assert got == [0, 1, 2, 4, 5]


def test_the_walk_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(64 * rng.normal(size=(4000, 3)))
    lists = np.argsort(-rows, axis=0, kind="stable")
    q = np.floor(64 * rng.normal(size=(20, 3)))
    scores, found = topk.threshold_search(q, np.full(20, -1), np.arange(4000), rows, lists, 5)
    for i in range(20):
        s = rows @ q[i]
        assert found[i].tolist() == np.lexsort((np.arange(4000), -s))[:5].tolist()
