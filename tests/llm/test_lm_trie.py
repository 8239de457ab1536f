import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from lodestone.llm import lm_trie
from lodestone.llm.lm_trie import LEVELS, NONE, EliasFano, TrieShard, trie_scores


@pytest.mark.parametrize("top", [5, 4000, 1 << 20, 1 << 62])
def test_elias_fano(tmp_path, top):
    values = np.unique(np.random.default_rng(1).integers(0, top, 3000, dtype=np.uint64))
    e = EliasFano(str(tmp_path / "x"), values)
    e.BLOCK = len(values) + 1
    assert (e.decode(0) == values).all()
    keys = np.unique(np.r_[values[::3], np.random.default_rng(2).integers(0, top, 500, dtype=np.uint64)])
    want = [int(np.searchsorted(values, k)) if k in set(values.tolist()) else -1 for k in keys.tolist()]
    assert e.search(keys).tolist() == want
    assert EliasFano(str(tmp_path / "y"), values[:0]).search(keys).tolist() == [-1] * len(keys)


def test_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(EliasFano, "BLOCK", 64)
    values = np.unique(np.random.default_rng(1).integers(0, 10**9, 3000, dtype=np.uint64))
    e = EliasFano(str(tmp_path / "x"), values)
    assert e.search(values).tolist() == list(range(len(values)))


def test_shard(tmp_path):
    c, w, n = np.array([7, 7, 9, 7], np.uint64), np.array([1, 5, 1, 1], np.uint32), np.array([2, 1, 4, 1])
    codes, t, total = TrieShard(str(tmp_path), c, w, n).query(np.array([7, 7, 8, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32))
    assert codes[1] == codes[2] == NONE and t.tolist() == [2, 2, 0, 1] and total.tolist() == [4, 4, 0, 4]
    assert abs(LEVELS[codes[0]] - 2.25 / 4) < 0.03 and abs(LEVELS[codes[3]] - 3.25 / 4) < 0.03


def plain(rows):
    """The model by definition, without quantisation."""
    words = {k: [*(x or "").encode().lower().split(), "end"] for k, (_, x) in enumerate(rows)}
    out = {k: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for k, (i, _) in enumerate(rows)}
    one, two = Counter(), Counter()
    for k, w in words.items():
        if not out[k]:
            one.update(w)
            two.update(zip(["start", *w], w))  # noqa: B905
    n, v = sum(one.values()), len(one)
    one["start"] = sum(not x for x in out.values())
    t = Counter(a for a, _ in two)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (max(two[a, w] - 0.75, 0) + min(0.75 * t[a], one[a]) * p1(w)) / one[a] if one[a] else p1(w)
    return {
        k: (out[k], len(w), sum(one[x] > 0 for x in w), n, sum(log10(p1(x)) for x in w), sum(log10(p2(a, x)) for a, x in zip(["start", *w], w)))  # noqa: B905
        for k, w in words.items()
    }


@pytest.mark.parametrize("share", [0.002, 0.03])
def test_scores_equal_the_definition(spark, monkeypatch, share):
    monkeypatch.setattr(lm_trie, "HOT_SHARE", share)
    monkeypatch.setattr(lm_trie, "BATCH_BYTES", 4000)
    pick = random.Random(1)
    words = ["The", "of", "AND"] * 8 + [f"w{i}" for i in range(200)] + ["é", "É"]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(0, 80)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, rows[5][1]), (402, rows[6][1]), (None, rows[7][1]), (403, "long text " * 20000)]
    docs = spark.createDataFrame([(i, x, 0.5) for i, x in rows], "doc_id long, text string, score double").repartition(3)
    got = trie_scores(docs).collect()
    assert len(got) == len(rows)
    want = plain(rows)
    key = lambda r: (-1 if r[0] is None else r[0], r[2], round(r[5], 6))
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    wanted = sorted(((rows[k][0], *x) for k, x in want.items()), key=key)
    for f, w in zip(found, wanted, strict=True):
        assert f[:5] == w[:5] and abs(f[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(f[6] - w[6]) <= 0.04 * f[2], (f, w)  # half a step of quantisation a token, and the estimate of T of spread contexts


@pytest.mark.parametrize("batch_bytes", [2000, 12 << 20])
def test_successors_of_hot_contexts_are_exact(spark, monkeypatch, batch_bytes):
    """Many shards, where most residues of a hot context hold nothing, and fewer shards than residues."""
    monkeypatch.setattr(lm_trie, "HOT_SHARE", 0.03)
    monkeypatch.setattr(lm_trie, "BATCH_BYTES", batch_bytes)
    pick = random.Random(2)
    # Held-out rows ask for known words after "of" that never follow it in training: their scores go by T("of") = 3 alone.
    after = lambda i: f"w{pick.randrange(400)}" if lm_trie.held_out(i) else pick.choice("xyz")
    rows = [(i, " ".join(f"of {after(i)} the w{pick.randrange(400)}" for _ in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    for r in trie_scores(docs).collect():
        assert abs(r.score - want[r.doc_id][5]) <= 0.0175 * r.n_tokens, (r, want[r.doc_id])  # half a step of quantisation a token


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    monkeypatch.setattr(lm_trie, "HOT_SHARE", 0.02)
    pick = random.Random(4)
    words = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(pick.choice(words) for _ in range(60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    for size in (12 << 20, 4000, 700):
        monkeypatch.setattr(lm_trie, "BATCH_BYTES", size)
        found.append({r.doc_id: r.score for r in trie_scores(docs).collect()})
    assert all(abs(found[0][k] - f[k]) < 1e-9 * abs(f[k]) for f in found[1:] for k in f)
    want = plain(rows)
    assert all(abs(found[0][k] - want[k][5]) <= 0.00013 * want[k][1] for k in want)  # half a step a token


def test_ranges_through_pointers(tmp_path, monkeypatch):
    monkeypatch.setattr(EliasFano, "BLOCK", 16)
    pick = np.random.default_rng(5)
    pairs = np.unique(pick.integers(0, 40, 900) * 1000 + pick.integers(0, 90, 900))
    c, w = (pairs // 1000).astype(np.uint64), (pairs % 1000).astype(np.uint32)
    shard = TrieShard(str(tmp_path), c, w, np.arange(1, len(c) + 1))
    asked = np.array([(a, b) for a in range(42) for b in range(0, 95)])
    codes, t, _ = shard.discounted(asked[:, 0].astype(np.uint64), asked[:, 1].astype(np.uint32))
    known = {(int(a), int(b)): n + 0.25 for n, (a, b) in enumerate(zip(c, w))}  # noqa: B905
    for (a, b), code, size in zip(asked.tolist(), codes.tolist(), t.tolist()):  # noqa: B905
        assert size == int((c == a).sum()) and (code == lm_trie.NO_COUNT) == ((a, b) not in known)
        assert code == lm_trie.NO_COUNT or abs(lm_trie.COUNT_LEVELS[code] / known[a, b] - 1) < 0.0004


def test_empty(spark):
    assert trie_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
