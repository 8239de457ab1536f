import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import scoring as S
from lodestone.operators import temporal as T
from lodestone.operators import vector as V
from lodestone.streaming.churn import upsert_totals, windowed_churn


def baskets(spark, *sets):
    rows = [(f"c{i}", x, f"2026-01-{i + 1:02d}T10:00:00") for i, s in enumerate(sets) for x in s]
    return spark.createDataFrame(rows, "c string, f string, d string")


def test_coupling_golden(spark):
    rows = baskets(spark, "ab", "ab", "ab", "ac", "bd")
    got = T.coupling(rows, "c", "f", "d").collect()
    assert [tuple(r) for r in got] == [("a", "b", 3, 0.6, 0.75, 0.75, "2026-01-03T10:00:00")]
    rows = baskets(spark, "ab", "ab", "ab", "b1", "b2", "b3")
    r = T.coupling(rows, "c", "f", "d").first()
    assert (r.conf_ab, r.conf_ba, r.jaccard) == (1.0, 0.5, 0.5)
    big = [f"f{i}" for i in range(31)]
    rows = baskets(spark, big, *[["f0", "f1"]] * 3)
    assert T.coupling(rows, "c", "f", "d").first().support_count == 3
    assert tuple(T.basket_counts(rows, "c", "f").first()) == (4, 1, 3)
    rows = baskets(spark, ["zeta", "alpha"], ["zeta", "alpha"], ["zeta", "alpha"])
    pairs = T.coupling(rows, "c", "f", "d")
    assert [(r.item, r.other) for r in T.couplings_of(pairs, "zeta").collect()] == [("zeta", "alpha")]
    assert T.coupling_status(rows, "c", pairs).first().status == "success"
    assert T.coupling_status(rows.limit(0), "c", pairs.limit(0)).first().status == "insufficient_history"


def test_p95_golden(spark):
    def run(*xs):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
        return [r.x_norm for r in S.normalize_p95(df, ["x"]).orderBy("i").collect()]

    assert run(10.0, 20.0, 30.0, 40.0, 50.0) == [0.0, 0.2632, 0.5263, 0.7895, 1.0]
    assert run(5.0, 5.0) == [0.5, 0.5] and run(0.0, 0.0) == [0.0, 0.0] and run(7.0) == [0.5]
    assert run(1.0, None, 3.0)[1] is None


def test_scores_golden(spark):
    df = spark.createDataFrame([(0.8, 0.6, 0.7, 0.4), (0.8, 0.6, None, 0.4), (None, None, None, None)], "ccn double, cent double, churn double, coup double")
    got = [r[0] for r in df.select(S.base_score()).collect()]
    assert got == [0.66, round((0.24 + 0.15 + 0.06) / 0.7, 4), 0.0]
    mu = spark.createDataFrame([(0.5, 0.5, 0.5), (0.6, 0.6, 0.1), (0.6, 0.6, 0.6), (1.0, 1.0, 1.0), (0.7, 0.75, 0.8)], "ccn double, cent double, churn double")
    assert [round(r[0], 4) for r in mu.select(S.multiplier()).collect()] == [1.0, 1.15, 1.2, 1.5, 1.3125]
    arch = spark.createDataFrame([(0.7, 0.1, 0.7, 0.1, 30.0), (0.7, 0.5, 0.1, 0.1, 30.0), (0.7, 0.5, 0.1, 0.1, 10.0), (0.4, 0.5, 0.4, 0.6, 5.0), (0.1, 0.6, None, 0.1, 5.0)], "ccn double, cent double, churn double, coup double, raw_ccn double")
    assert [r[0] for r in arch.select(S.archetype()).collect()] == ["Volatile Fragile Hotspot", "Brain Module", "Normal Component", "Shotgun Surgery Catalyst", "Stable Core"]
    ok = spark.range(1).select(*S.impact_confidence(F.lit(10), F.lit(True), F.lit(True)), *S.impact_confidence(F.lit(0), F.lit(False), F.lit(True))).first()
    assert tuple(ok) == (1.0, "HIGH", 0.7, "MEDIUM")


def test_conformance_golden(spark):
    rows = [("a", "b", 1, 2), ("b", "c", 2, 3), ("c", "a", 3, 1), ("a", "c", 1, 3), ("a", "d", 1, 2)]
    e = spark.createDataFrame(rows, "src string, dst string, src_level int, dst_level int").withColumn("src_layer", F.lit("x")).withColumn("dst_layer", F.lit("y"))
    assert S.conformance_index(e, S.violations(e, S.Rules(strict=True))).first().aci == 72.0
    one = e.where("src = 'a' and dst = 'c'")
    assert S.conformance_index(one, S.violations(one)).first().aci == 100.0 and S.conformance_index(one, S.violations(one, S.Rules(strict=True))).first().aci == 60.0
    assert S.conformance_index(e.limit(0), S.violations(e.limit(0))).first().aci == 100.0


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_pagerank(spark, one_task):
    rows = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "A"), ("B", "D")]
    ranks = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        ranks.append({r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(rows, "src string, dst string"), one_task=one_task, max_iterations=25).collect()})
    assert ranks[0] == ranks[1] and abs(sum(ranks[0].values()) - 1) < 1e-5
    alone = spark.createDataFrame([("x",)], "node string")
    assert G.pagerank(spark.createDataFrame([], "src string, dst string"), alone, one_task=10**6).first()["rank"] == 1.0


def test_cycles_components_paths(spark):
    e = spark.createDataFrame([("c", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")], "src string, dst string")
    assert [r.cycle for r in G.simple_cycles(e).collect()] == [["c", "d"], ["a", "b", "c"]]
    assert {(r.node, r.component) for r in G.strong_components(e).collect()} == {(x, "a") for x in "abcd"}
    typed = e.withColumn("edge_type", F.lit("CALLS"))
    assert G.longest_path(typed, "a") == 4
    assert round(G.betweenness(e, "c"), 4) > 0
    log = spark.createDataFrame([("a", "b", "CALLS", 1), ("a", "b", "IMPORTS", 2)], "src string, dst string, edge_type string, seq int")
    assert [r.edge_type for r in G.last_edges(log).collect()] == ["IMPORTS"]


def test_components_behind_many_ascending_nodes(spark):
    """Each round of colors alone takes only the smallest node of these."""
    rows = [(a, b) for a in range(33) for b in range(a + 1, 34)] + [(33, 40), (40, 41), (41, 42), (42, 40), (42, 50)]
    found = G.strong_components(spark.createDataFrame(rows, "src long, dst long"))
    assert {(r.node, r.component) for r in found.collect()} == {(x, 40) for x in (40, 41, 42)}
    assert G.strong_components(spark.createDataFrame(rows[:50], "src long, dst long")).count() == 0


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    pick = random.Random(4)
    unit = lambda x: [y / sum(z * z for z in x) ** 0.5 for y in x]
    stored = {i: unit([pick.random() for _ in range(60)]) for i in range(15)}
    asked = {i: unit([pick.random() for _ in range(60)]) for i in range(9)}
    want = {(q, i): sum(a * b for a, b in zip(x, y, strict=True)) for q, x in asked.items() for i, y in stored.items()}
    store = spark.createDataFrame(list(stored.items()), "id long, embedding array<double>")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query array<double>")
    best = {(q, r + 1): i for q in asked for r, i in enumerate(sorted(stored, key=lambda i: (-want[q, i], i))[:3])}
    assert {(r.query_id, r["rank"]): r.id for r in V.top_k_each(store, queries, 3).collect()} == best
    long = lambda rows: spark.createDataFrame([(i, k, x) for i, v in rows.items() for k, x in enumerate(v)], "id long, idx int, weight double")
    got = {(r.query_id, r.id): r.score for r in V.sparse_scores(long(stored), long(asked)).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_batch_search_is_the_whole_search(spark, monkeypatch):
    """Ties by nine digits, scores below 0, equal vectors, ids that come twice, null and odd vectors, several turns of queries."""
    monkeypatch.setattr(V, "QUERY_BYTES", 64)
    monkeypatch.setattr(V, "STORE_TILE", 16)
    pick = random.Random(8)
    vectors = [[pick.gauss(0, 1) for _ in range(3)] for _ in range(150)] + [[1.0, 0.0, 0.0]] * 40 + [[-1.0, -1.0, 0.0], [0.0, 0.0, 0.0], None, [1.0], []]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(200, [1.0, 2e-6, 0.0]), (7, vectors[7])] + [(150, [1.0, 0.0, 0.0])] * 12 + [(None, [1.0, 0.0, 0.0])]
    pick.shuffle(rows)
    asked = [(i, vectors[i]) for i in range(0, 190, 10)] + [(201, [-1.0, -1.0, -1.0]), (202, [0.0, 0.0, 0.0]), (203, [1.0, 0.0, 0.0]), (203, [0.0, 1.0, 0.0])]

    def score(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / n)) if n else 0.0

    store = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    for drop in (True, False):
        want = []
        for q in {i for i, _ in asked}:
            every = [(-round(score(a, b), 9), -1 if i is None else i, score(a, b)) for j, a in asked if j == q for i, b in rows if not drop or i is not None and i != q]
            want += [(q, None if i < 0 else i, rank + 1, s) for rank, (_, i, s) in enumerate(sorted(every, key=lambda x: x[:2])[:10])]
        found = [(r.query_id, r.id, r["rank"], r.score) for r in V.top_k_each(store, queries, 10, drop_self=drop).collect()]
        order = lambda x: (x[0], x[2])
        assert [x[:3] for x in sorted(found, key=order)] == [x[:3] for x in sorted(want, key=order)]
        assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(sorted(found, key=order), sorted(want, key=order), strict=True))
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    got = V.top_k_each(named, named.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 1, drop_self=True).collect()
    assert sorted((r.query_id, r.id) for r in got) == [("a", "b"), ("b", "a"), ("c", "a")]
    assert V.top_k_each(store.limit(0), queries, 3).count() == 0 and V.top_k_each(store, queries.limit(0), 3).count() == 0


def test_hybrid_search(spark):
    scored = spark.createDataFrame([("s1", 0.9), ("s2", 0.8), ("s3", 0.3), ("x", 0.2), ("y", 0.1)], "id string, score double")
    edges = spark.createDataFrame([("s1", "x", "CALLS"), ("x", "z", "CALLS"), ("s1", "y", "IMPORTS"), ("s2", "x", "CALLS")], "src string, dst string, edge_type string")
    rows = {r.id: r for r in V.hybrid_search(scored, edges, "flow", V.HybridConfig(top_k=3)).collect()}
    # Two seeds at least, then the best of the graph: z is two calls from s1 and not in the pool.
    assert set(rows) == {"s1", "s2", "z"} and rows["z"].provenance == "graph_expanded" and rows["z"].expanded_from == "s1"
    assert rows["z"].hop == 2 and abs(rows["z"].score - 0.9 * 0.49) < 1e-9 and sorted(r.rank for r in rows.values()) == [1, 2, 3]
    found = {(r.seed, r.node): r.graph_score for r in V.expand(scored.limit(2).withColumnRenamed("id", "seed"), edges, "flow").collect()}
    assert abs(found["s1", "x"] - 0.9 * 0.7) < 1e-9 and abs(found["s1", "y"] - 0.9 * 0.5 * 0.7) < 1e-9 and abs(found["s2", "z"] - 0.8 * 0.49) < 1e-9


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 10:00:00", "a", 2), ("2026-01-01 11:00:00", "a", 3), ("2026-01-02 10:00:00", "b", 1)], "ts string, item string, n int").select(F.to_timestamp("ts").alias("ts"), "item", "n").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, item string, n int").parquet(source)
    q = windowed_churn(stream, "ts", "item", "n").writeStream.format("memory").queryName("churned").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.item, r.changes, r.amount) for r in spark.table("churned").collect()) == [("a", 2, 5), ("b", 1, 1)]
    batch = spark.read.parquet(source)
    for epoch in (0, 1, 1):
        upsert_totals(batch, epoch, str(tmp_path / "out"), "item", "n")
    assert {r.item: r.amount for r in spark.read.parquet(str(tmp_path / "out/version=1")).collect()} == {"a": 10, "b": 2}
