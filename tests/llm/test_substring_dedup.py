import hashlib
import random

import numpy as np

from lodestone.llm import substring_dedup
from lodestone.llm.substring_dedup import anchored, build_bwt, dedup_substrings, merge_bwts, repeated


def brute(rows):
    top = 1 << 62
    data = [(top if i is None else i, (x or "").encode()) for i, x in rows]
    least = {}
    for i, d in data:
        for s in range(len(d) - 49):
            w = d[s : s + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for (i, d), (name, _) in zip(data, rows):  # noqa: B905
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - 49):
            if least[d[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(c for c, g in zip(d, gone) if not g)  # noqa: B905
        out.append((name, len(d), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_merged_order_is_that_of_all_suffixes():
    pick = random.Random(1)
    shards = [[bytes(pick.choice(b"ab") for _ in range(pick.randrange(1, 12))) for _ in range(pick.randrange(1, 5))] for _ in range(3)]
    built = [build_bwt(s) for s in shards]
    z, block = merge_bwts([b[0] for b in built], [len(s) for s in shards], 14)
    rank, got = [0] * 3, []
    for k in z.tolist():
        _, s, o = built[k]
        got.append(shards[k][s[rank[k]]][o[rank[k]] :])
        rank[k] += 1
    assert got == sorted(got)
    places = {}
    for k, s in enumerate(shards):
        for j, x in enumerate(s):
            for o in range(len(x) - 2):
                places.setdefault(x[o : o + 3], set()).add((k, j, o))
    assert sorted(map(sorted, (v for v in places.values() if len(v) > 1))) == sorted(sorted(zip(a.tolist(), b.tolist(), c.tolist())) for a, b, c in repeated(shards, 3))  # noqa: B905


def test_anchors_depend_on_the_window_alone():
    pick = random.Random(2)
    for text in (bytes(pick.choice(b"abc ") for _ in range(400)), b"=" * 300, b"abcab" * 60):
        at, size, name = anchored(text)
        assert at[0] == 0 and (at[1:] == at[:-1] + size[:-1]).all() and at[-1] + size[-1] == len(text) - 49
        for s, k, a in zip(at.tolist(), size.tolist(), name.tolist()):  # noqa: B905
            for w in range(s, s + k):
                assert anchored(text[w : w + 50])[2].tolist() == [a]


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("aeithr") for _ in range(pick.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12) for _ in range(6)] + ["=" * 60, "é" * 40]
    rows = []
    for i in range(150):
        parts = [text(pick.randrange(1, 30))]
        for _ in range(pick.randrange(0, 3)):
            p = pick.choice(shared)
            a = pick.randrange(0, 10)
            parts += [p[a : len(p) - pick.randrange(0, 10)], text(pick.randrange(1, 8))]
        rows.append((i * 7 % 151, pick.choice(["", " ", "\n"]).join(parts)))
    for i in range(40):
        near = list(rows[3][1] + shared[0])
        near[pick.randrange(len(near))] = "X"
        rows.append((500 + i, "".join(near)))
    return [*rows, (900, rows[0][1]), (901, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "short"), (None, rows[1][1]), (None, "z" * 70), (905, shared[2] * 300)]


def test_table_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 6000)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, x, "s") for i, x in rows], "doc_id long, text string, n_bytes string").repartition(3)
    got = sorted(map(tuple, dedup_substrings(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_round_refines_by_several_characters(monkeypatch):
    pick = random.Random(7)
    shards = [[bytes(pick.choice(b"ab") for _ in range(pick.randrange(1, 70))) for _ in range(pick.randrange(1, 9))] for _ in range(3)]
    built = [build_bwt(s) for s in shards]
    for depth in (0, 1, 2, 3, 4, 5, 7, 8, 50):
        rounds, sort = [], np.argsort
        monkeypatch.setattr(substring_dedup.np, "argsort", lambda *a, **b: rounds.append(1) or sort(*a, **b))  # noqa: B023
        z, block = merge_bwts([b[0] for b in built], [len(s) for s in shards], depth)
        monkeypatch.undo()
        assert len(rounds) < 50
        rank, got = [0] * 3, []
        for k in z.tolist():
            _, s, o = built[k]
            got.append((shards[k][s[rank[k]]][o[rank[k]] :][:depth], k, int(s[rank[k]])))
            rank[k] += 1
        assert [x[0] for x in got] == sorted(x[0] for x in got)
        # Whole prefixes share a block, and what ends before is a block of its own.
        same = [a[0] == b[0] and len(a[0]) == depth for a, b in zip(got, got[1:])]  # noqa: B905
        assert [a == b for a, b in zip(block.tolist(), block[1:].tolist())] == same  # noqa: B905
