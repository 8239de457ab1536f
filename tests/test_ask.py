from lodestone.plans.ask import INSUFFICIENT, NOTHING_FOUND, ask, evidence_model, make_prompt

RESULT = "query_id long, rank int, score double, relative_path string, start_line int, end_line int, chunk_type string, symbol_name string, signature string, content string, relationship string"


def results(spark):
    rows = [
        (1, 1, 0.9, "src/orders.py", 3, 9, "function", "process_order", "def process_order(x):", "def process_order(x): validate(x)", None),
        (1, 2, 0.5, "src\\check.py", 1, 4, "function", "validate", None, "def validate(x): return x", "CALLS"),
        (2, 1, 0.14, "src/orders.py", 3, 9, "function", "process_order", None, "text", None),
        (3, 1, 0.8, "src/orders.py", 3, 9, "block", None, None, "nothing alike", None),
        (5, 1, 0.8, "a.py", 1, 2, "block", None, None, "question words", None),
    ]
    return spark.createDataFrame(rows, RESULT)


def asked(spark):
    texts = {1: "How does process_order validate?", 2: "orders?", 3: "zebra xylophone", 4: "no results", 5: "  "}
    return spark.createDataFrame(list(texts.items()), "query_id long, question string")


def test_ask(spark):
    got = {r.query_id: r for r in ask(asked(spark), results(spark)).collect()}
    assert len(got) == 5
    one = got[1]
    assert one.is_sufficient and one.citations == ["src/orders.py:3-9", "src/check.py:1-4"]
    assert (one.n_sources, one.n_seeds, one.n_expanded, one.relationships) == (2, 1, 1, ["CALLS"])
    assert "process_order is defined at [src/orders.py:3-9]" in one.answer
    for k in (2, 3, 4):
        assert got[k].answer == NOTHING_FOUND and not got[k].is_sufficient and got[k].citations == []
    assert got[4].n_sources == 0 and got[5].answer.startswith("Please provide") and not got[5].is_sufficient


def test_other_models(spark):
    def fails(prompt):
        raise RuntimeError("down")

    first = lambda model: {r.query_id: r for r in ask(asked(spark), results(spark), model).collect()}[1]
    assert first(lambda p: "It is so.").citations == ["src/orders.py:3-9"]
    assert first(lambda p: "Insufficient context here").citations == []
    broken = first(fails)
    assert broken.answer == "Error generating answer from LLM provider: down" and not broken.is_sufficient and broken.citations == []
    assert evidence_model(make_prompt("why order", "no tags but order")) == INSUFFICIENT
