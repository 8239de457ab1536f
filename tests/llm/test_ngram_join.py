import random

import pytest

from lodestone.llm import ngram_join
from lodestone.llm.ngram_join import jaccard_components, one_of_each


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    s = [sets(x) for _, x in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: pick.choice("abcdefgh") + pick.choice("aeiou") + pick.choice("rstlnm") * pick.randrange(1, 3)
    common = " ".join(word() for _ in range(30))
    rows, k = [], 0
    for _ in range(40):
        text = [word() for _ in range(pick.choice((3, 8, 20, 60, 150)))]
        if pick.random() < 0.4:
            text += common.split()
        for _ in range(pick.choice((1, 1, 2, 4))):
            near = list(text)
            for _ in range(pick.randrange(0, 3)):
                near[pick.randrange(len(near))] = word()
            rows.append((k, " ".join(near)))
            k += 1
    # One large group of near copies, and texts that drift away step by step.
    base = [word() for _ in range(80)]
    for i in range(60):
        near = list(base)
        near[pick.randrange(80)] = word()
        rows.append((1000 - i, " ".join(near)))
    drift = [word() for _ in range(60)]
    for i in range(25):
        drift[pick.randrange(60)] = word()
        rows.append((2000 + i, " ".join(drift)))
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "One two"), (3004, "one  TWO"), (3005, rows[0][1].upper() + "\n"), (3006, "long " * 30000), (3007, "é È one two three four"), (3008, "é È one two three four")]
    return rows


@pytest.mark.parametrize(("seed", "least", "one_task"), [(1, 64, 10**6), (2, 3, 0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, least, one_task):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", least)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, x, -1) for k, x in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, one_task).collect())
    assert got == brute(rows)


def test_copies_in_every_partition(spark, monkeypatch):
    """All shingles are frequent; each partition has an exact copy of every text, so a prefix must not hold a shingle twice."""
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 1)
    pick = random.Random(3)
    texts = []
    for family in range(30):
        base = [f"{family}w{i}" for i in range(60)]
        near = list(base)
        near[pick.randrange(5, 55)] = "changed"
        texts += [" ".join(base), " ".join(near)]
    rows = [(100 * copy + k, x) for copy in range(16) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 16), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {i: i % 100 // 2 * 2 for i, _ in rows}


def test_one_of_each_and_odd_rows(spark):
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(4, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, "z"), (7, None, "n"), (7, "other words here", "n"), (9, "", "n")], "doc_id long, text string, source string")
    rows = jaccard_components(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 2), (2, 2), (2, 2), (4, 2), (7, 7), (7, 7), (9, 9)]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_stay(spark):
    texts = ["red apples fall from the old tree", "blue boats sail over a calm sea", "green hills rise behind our small town"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, "two more words"), (6, texts[2]), (5, texts[2]), (8, None), (8, ""), (None, ""), (5, " "), (6, "")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # (6, "") stays, as no text is kept under 6; (5, " ") goes, as texts are kept under 5.
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, "two more words"), (8, None), (8, ""), (None, ""), (6, "")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_memory_of_a_batch_is_a_few_times_its_text(spark, monkeypatch):
    """The workers' own function over one Arrow batch of 16 MB."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import DataFrame

    taken = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    assert isinstance(ngram_join._described(spark.createDataFrame([(1, "a")], "doc_id long, text string")), DataFrame)
    pick = random.Random(5)
    words = [f"{pick.randrange(1 << 30):x}" for _ in range(5000)]
    texts = [" ".join(pick.choices(words, k=900)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in taken[0]([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000 and peak < 5 * batch.nbytes


def test_often_in_is_a_count():
    import numpy as np

    pick = random.Random(6)
    for least in (1, 2.5, 3, 40):
        sets = [np.unique(np.array([pick.randrange(60) for _ in range(pick.randrange(30))], np.uint64)) for _ in range(50)]
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        assert ngram_join.often_in(sets, least).tolist() == values[counts >= least].tolist() and not sets
    assert len(ngram_join.often_in([], 64)) == 0
