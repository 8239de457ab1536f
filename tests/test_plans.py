import pytest
from pyspark.sql import functions as F

from lodestone.plans import investigation as I
from lodestone.plans.intent import classify_table, entities, retrieval_kind
from lodestone.plans.tools import Workspace, registry
from tests.test_code_graph import FILES


def test_intents(spark):
    want = {
        "How does the parser work?": "UNDERSTAND", "Who calls process_order?": "STRUCTURE", "What breaks if Validator is modified?": "IMPACT", "Show the commit history of main.py": "EVOLUTION",
        "Are there package cycles?": "INSIGHTS", "zzz": "UNDERSTAND",
    }
    rows = classify_table(spark.createDataFrame([(q,) for q in want], "query string")).collect()
    assert {r.query: r.intent for r in rows} == want
    assert {r.query: (r.confidence, r.level) for r in rows}["zzz"] == (0.3, "LOW")
    kinds = spark.createDataFrame([("who uses x",), ("how does x run",), ("x",)], "q string").select(retrieval_kind(F.col("q"))).collect()
    assert [r[0] for r in kinds] == ["impact", "flow", "general"]


def test_entities():
    e = entities("Explain OrderService.process_order and `Validator` in shop/orders.py, call notify_user() of the billing module")
    assert e.methods == ["OrderService.process_order"] and e.classes == ["Validator"] and e.paths == ["shop/orders.py"] and e.functions == ["notify_user"] and e.modules == ["billing"]
    assert e.primary == "OrderService.process_order" and e.is_ambiguous


def test_plan_and_references():
    r = I.ToolRegistry()
    r.add("search_symbols", lambda query, limit=20: [{"id": "x"}], ("query",))
    r.add("get_node_details", lambda node_id: [{"id": node_id}], ("node_id",))
    r.defer("get_callees", "later")
    plan = I.make_plan("q", "UNDERSTAND", "X", r)
    assert plan.plan_id == I.make_plan("q", "UNDERSTAND", "X", r).plan_id and [s.step_id for s in plan.steps] == ["step_1", "step_2", "step_3"]
    assert [x.status for x in I.execute(plan, r)] == ["SUCCESS", "SUCCESS", "UNAVAILABLE_DEFERRED"]
    done = {"a": I.Result("a", "t", "SUCCESS", [{"id": 5}])}
    assert I.resolve({"n": ["$a.rows[0].id"]}, done) == {"n": [5]}
    for bad in ("$a.rows[3].id", "$b.rows", "$a.__import__('os')"):
        with pytest.raises(I.ReferenceError_):
            I.resolve(bad, done)
    with pytest.raises(ValueError):
        I.check_plan(I.Plan("p", "q", "i", [I.Step("s", "t", {}, ["later"])]))


def test_investigation_end_to_end(spark):
    files = spark.createDataFrame([(p, c, "python", len(c.splitlines())) for p, c in FILES.items()], "relative_path string, content string, language string, line_count long")
    ws = Workspace.of_files(spark, files)
    tools = registry(ws)
    out = I.investigate(spark, "What breaks if notify_user is changed?", tools)
    assert out["intent"]["intent"] == "IMPACT" and out["status"] == "COMPLETED", [(r.tool, r.error) for r in out["results"]]
    assert "process_order" in out["answer"] and any(e.category == "test" for e in out["evidence"])
    score = tools.run("s", "multi_signal_impact", {"node_id": "function:shop/notify.py:notify_user"})
    assert score.status == "SUCCESS" and 0 <= score.rows[0]["impact_score"] <= 1, score.error
    for name in ("get_architecture_overview", "check_architecture_conformance", "detect_package_cycles", "detect_maintenance_hotspots", "get_evidence_coverage", "detect_cycles"):
        assert tools.run("s", name, {}).status == "SUCCESS", tools.run("s", name, {}).error
    hits = tools.run("s", "hybrid_search", {"query": "validate order", "top_k": 4})
    assert hits.status == "SUCCESS" and hits.rows, hits.error
    assert tools.run("s", "git_code_churn", {}).status == "UNAVAILABLE_DEFERRED"
