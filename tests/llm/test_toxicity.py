import random
import zlib

import numpy as np

from lodestone.llm.toxicity import FitBounds, Scorer, fit, toxicity, without_toxic

PICK = random.Random(7)
PARTS = ["th", "an", "er", "in", "on", "ed", "re", "ti", "ou", "es"]
BAD = ["grunk", "blarty", "snorvel", "quibbed"]


def prose(n, bad=0.0):
    words = ["".join(PICK.choice(PARTS) for _ in range(PICK.randrange(1, 4))) for _ in range(n)]
    return " ".join(PICK.choice(BAD) if PICK.random() < bad else w for w in words)


def test_held_out_texts_are_told_apart():
    model = fit([prose(150, 0.05) for _ in range(200)], [prose(150) for _ in range(400)], 0.2, FitBounds(dictionary_windows=5000))
    scorer = Scorer(model)
    bad, fine = scorer.scores([prose(150, 0.05) for _ in range(100)]), scorer.scores([prose(150) for _ in range(200)] + [None, ""])
    assert (bad >= 0.5).mean() > 0.9 and (fine >= 0.5).mean() < 0.05
    assert np.all((0 <= fine) & (fine <= 1))


def test_table(spark):
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        docs.append((i, prose(120, 0.06 if toxic else 0.0), "clash"))
        labels.append((i, 1, int(toxic)))
    docs += [(None, "th an", "x"), (1000, None, "x"), (1001, "", "x"), (5, "again", "x"), (1002, prose(30000), "x")]
    labels += [(None, 1, 1), (4, 1, None), (3, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity(d, lab).collect()
    assert len(rows) == len(docs)
    tests = [r for r in rows if r.held_out and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in tests]) > 0.85
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    kept = without_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_missing_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity(d, none).collect()] == [(0.0, 0)]
    assert toxicity(d.limit(0), none).count() == 0
