"""Every registered query over the smallest tables against plain versions of its contract."""

import collections
import hashlib
import math
import os
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_text_ops import FOLD, WORD, brute_fingerprint, brute_groups, brute_secrets, groups_of  # noqa: E402

from keyloft.llm import queries  # noqa: E402
from keyloft.llm.components import local_labels  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def rows_of(spark, name, sf=SF):
    return queries.queries()[name](spark, sf).collect()


def test_op1(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents", sf)}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    tokens = {d: [*WORD.findall(t.translate(FOLD)), None] for d, t in docs.items()}
    count = collections.Counter(w for d in docs if not held[d] for w in tokens[d])
    n, kinds = sum(count.values()), len(count)
    rows = rows_of(spark, "op1_ppm", sf)
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in ws), rel_tol=1e-9)
    mean = lambda c: sum(r[c] for r in rows if r["held_out"]) / sum(r["n_tokens"] for r in rows if r["held_out"])
    assert mean("score") > mean("base_score")


def test_op2(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[d], 3) for d in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    label = local_labels(len(ids), *np.array(near).reshape(-1, 2).T)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op2_simhash")}
    assert got == {(d, f"{fps[i]:016x}", ids[label[i]]) for i, d in enumerate(ids)}


def test_op3(spark):
    docs = {r["doc_id"]: r for r in table(spark, "documents")}
    rows = rows_of(spark, "op3_mix")
    own, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size = len(WORD.findall(docs[r["doc_id"]]["text"] or ""))
        assert r["size"] == size and 0 <= r["taken"] <= 2 * size
        own[r["source"]] += size
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(rows) == len(docs) and all(r["source_size"] == own[r["source"]] for r in rows)
    names = sorted(own)
    weight, full = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, set()
    while True:
        level = (1.5 * sum(own.values()) - sum(2 * own[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * own[s]}
        if not more:
            break
        full |= more
    longest = max(r["size"] for r in rows)
    for s in names:
        assert math.isclose(target[s], 2 * own[s] if s in full else level * weight[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
    assert {r["doc_id"]: r["taken"] for r in rows_of(spark, "op3_mix")} == {r["doc_id"]: r["taken"] for r in rows}


def test_op4(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    docs, by, places = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}, collections.defaultdict(list), collections.defaultdict(list)
    for r in rows_of(spark, "op4_pack"):
        by[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0


def test_op6(spark):
    rows = rows_of(spark, "op6_langid")
    assert {r["page_id"] for r in rows} == {r["page_id"] for r in table(spark, "pages")} and all(0 <= r["probability"] <= 1 for r in rows)
    said = [r for r in rows if r["declared"] in queries.LANGUAGES and r["accepted"]]
    assert sum(r["declared"] == r["found_lang"] for r in said) >= 0.9 * len(said)


def test_op8(spark):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op8_licences")}
    docs = {r["doc_id"]: r for r in table(spark, "documents")}
    assert set(rows) == set(docs)
    for d, r in rows.items():
        if "Released under the MIT License." in docs[d]["text"]:
            assert r["origin"] == "own" and r["score"] >= 0.8
        if r["origin"] == "directory":
            giver = [g for g, o in rows.items() if g % 10 == 0 and o["origin"] == "own" and o["license"] == r["license"]]
            assert any(o["found_in"] == r["found_in"] for o in (rows[g] for g in giver))
        assert (r["origin"] == "none") == (r["license"] is None)


def test_op10(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}
    rows = rows_of(spark, "op10_secrets")
    assert len(rows) == len(docs)
    for r in rows:
        want = brute_secrets(docs[r["doc_id"]])
        kinds = collections.Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_similar_recall(spark):
    """All pairs of real texts: the groups are those of plain comparison."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the tables are not here")
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents", sf)]
    want = brute_groups(rows)
    assert sum(k != v for k, v in want.items()) > 50
    assert groups_of(spark, rows) == want


def test_fingerprint_seed():
    assert brute_fingerprint("a b c", 3) == xxhash.xxh64_intdigest("a b c", 42)
