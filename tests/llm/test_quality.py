import re
from collections import Counter

from lodestone.llm.quality import Rule, compile_rules, quality_rules, with_metrics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "a",
    "a b c d e",
    "a b c d e a b c d e",
    "x y z " * 50,
    "the cat sat on the mat and the dog sat on the mat and the cat sat on the mat\nrow\nrow\n\nrow \n",
    "$$$ ### a|b <c> %d &e *f\x85g h i j",
    "éè \U0001f600 b " * 7,
    " ".join(f"w{i % 977}" for i in range(30000)),
    "A B!! " * 40,
]


def test_counts_equal_brute_force(spark):
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "a b", "n"), (3, "a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality_rules(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key)
    assert found == sorted([(i, *brute(x)) for i, x, _ in rows], key=key)
    assert not any(r.kept for r in got if r.base_failed)


def test_clean_is_kept_and_junk_is_not(spark):
    clean = "The engine reads the tables of the corpus and it writes one row for each text that it has read to the end."
    docs = spark.createDataFrame(
        [(1, clean), (2, "Bu### the*** of%%% " * 1 + " ".join(f"w{i}$$$" for i in range(40))), (3, " | ".join(f"cell{i}" for i in range(60)))],
        "doc_id long, text string",
    )
    assert {r.doc_id: r.kept for r in quality_rules(docs).collect()} == {1: True, 2: False, 3: False}


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = quality_rules(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_compile_to_names_of_broken_metrics(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = with_metrics(docs).select(compile_rules([Rule("n_words", low=4), Rule("n_words", high=2), Rule("n_words", low=9, from_words=5)]).alias("x")).first()
    assert row.x == ["n_words", "n_words"]
