from lodestone.llm.decontaminate import benchmark_matches, decontaminate, without_contaminated

ITEM = "A train leaves Paris with 120 passengers and 35 of them get off after 90 km so how many passengers does the train still carry now"
MORE = "Filler words come before the passage. "


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b


def test_finds_copies_and_reparameterised_questions(spark):
    changed = ITEM.replace("Paris", "London").replace("120", "480").replace("35", "77").replace("90 km", "12 miles")
    # One item value goes with two document values, so this is no re-parameterised copy.
    twice = "She buys 7 apples and then 7 pears and then 7 plums and then 7 figs and then pays 7 coins for all"
    mixed = twice.replace("7 pears", "8 pears").replace("7 plums", "9 plums").replace("7 figs", "2 figs").replace("7 coins", "1 coins")
    other = twice.replace("7", "12")
    docs = [
        (1, MORE + ITEM + " and more follows here", "x"),
        (2, MORE + changed, "x"),
        (3, MORE * 5, "x"),
        (4, mixed, "x"),
        (5, other, "x"),
        (6, None, "x"),
        (7, "", "x"),
        (None, ITEM, "x"),
        (8, " ".join(ITEM.split()[:12]), "x"),
        (3, MORE, "x"),
    ]
    d, b = run(spark, docs, [(10, ITEM), (10, ITEM), (11, twice), (12, None), (13, "")])
    got = sorted((r.doc_id or 0, r.contaminated, r.n_items, r.item_id) for r in decontaminate(d, b).collect())
    assert got == sorted(
        [
            (0, True, 1, 10), (1, True, 1, 10), (2, True, 1, 10), (3, False, 0, None), (3, False, 0, None), (4, False, 0, None),
            (5, True, 1, 11), (6, False, 0, None), (7, False, 0, None), (8, False, 0, None),
        ],
        key=lambda x: x[:1],
    )
    kept = without_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 3, 4, 6, 7, 8]


def test_one_other_value_costs_its_windows_only(spark):
    long = "Every day the old shop sells 7 boxes of tea on a quiet day and later " + " ".join(f"word{chr(97 + i)}" for i in range(20)) + " until 7 boxes are left in the dark cellar"
    edited = long.replace("until 7", "until 8")
    comma = "We count 120, then we rest and walk home and count 120 again before the long night ends"
    merged = "He reads 5 books in spring and 9 books in autumn while snow falls over the old town"
    docs = [(1, MORE + edited, "x"), (2, MORE + comma.replace("120,", "120"), "x"), (3, merged.replace("5", "6").replace("9", "6"), "x"), (4, long.replace("until 7 boxes are left in the", "nothing was seen by us and"), "x")]
    d, b = run(spark, docs, [(1, long), (2, comma), (3, merged)])
    got = {(r.doc_id, r.item_id): r.n_held for r in benchmark_matches(d, b).collect()}
    n = len(long.split()) - 4
    assert got[1, 1] == n - 5 and got[2, 2] == len(comma.split()) - 4 and got[3, 3] == len(merged.split()) - 4


def test_names_at_the_start_of_texts_and_sentences(spark):
    item = "Tom has 5 apples. Tom gives 2 to Ann. Tom then buys 9 more pears. How many does he have now?"
    other = item.replace("Tom", "Carl").replace("Ann", "Eve").replace("5", "6").replace("9", "8")
    mixed = item.replace("Tom has", "Carl has").replace("Tom gives", "Max gives").replace("Tom then", "Jim then").replace("Ann", "Eve")
    short = "Paris is large"
    docs = [(1, other, "x"), (2, MORE + other, "x"), (3, mixed, "x"), (4, "So we think Rome is large", "x"), (5, item.lower(), "x")]
    d, b = run(spark, docs, [(1, item), (2, short)])
    got = {(r.doc_id, r.item_id): r.n_held for r in benchmark_matches(d, b).collect()}
    n = len(item.split()) - 4
    assert got[1, 1] == got[2, 1] == n and (3, 1) not in got


def test_short_items_and_large_benchmarks(spark, monkeypatch):
    d, b = run(spark, [(1, "only three words", "x"), (2, "here only three words stand", "x")], [(1, "Only three words.")])
    assert [r.doc_id for r in benchmark_matches(d, b).collect()] == [1]
    monkeypatch.setattr("lodestone.llm.decontaminate.BROADCAST_WINDOWS", 0)
    assert [r.doc_id for r in benchmark_matches(d, b).collect()] == [1]


def test_empty_tables_and_native_plan(spark):
    d, b = run(spark, [], [(1, ITEM)])
    assert decontaminate(d, b).count() == 0
    d, b = run(spark, [(1, ITEM, "x")], [])
    out = decontaminate(d, b)
    assert [r.contaminated for r in out.collect()] == [False]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
