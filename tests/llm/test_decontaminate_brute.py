"""Decontamination against a version word by word, over all pairs of documents and items."""

import random
from collections import Counter

from lodestone.llm.decontaminate import THRESHOLD, UNITS, benchmark_matches

PLAIN = ["the", "shop", "sells", "tea", "and", "then", "buys", "red", "apples", "for", "old"]
NAMES = ["Tom", "Ann", "Paris", "Rome"]
ENDS = ".!?:"


def templates(text):
    """(words, values) of the first word of a window, of its other words in the first template, and of all in the second."""
    first, other, second, before = [], [], [], None
    for raw in text.split():
        core = raw.rstrip(".,;:!?")
        is_number = core[:1].isdigit()
        is_unit = before == ("<num>", False) and core.lower() in UNITS
        kind = "<num>" if is_number else "<unit>" if is_unit else None
        if kind:
            for x in (first, other, second):
                x.append((kind, core.lower()))
            before = (kind, False)
            continue
        is_capital = core[:1].isupper()
        plain, name = (core.lower(), ""), ("<name>", core.lower())
        first.append(plain)
        other.append(name if is_capital and before is not None and not before[1] else plain)
        second.append(name if is_capital else plain)
        before = (core, raw[-1] in ENDS)
    return first, other, second


def windows(text):
    """(at, template, values or None) and the number of windows."""
    first, other, second = templates(text)
    n = len(first) - 4 if len(first) >= 5 else min(len(first), 1)
    out = []
    for i in range(n):
        one, two = [first[i], *other[i + 1 : i + 5]], second[i : i + 5]
        for k, w in enumerate((one, two)):
            key, values = tuple(x[0] for x in w), [x[1] for x in w]
            if k == 0 or key != tuple(x[0] for x in one):
                out.append((i, key, values if any(values) else None))
    return out, n


def brute(docs, items):
    got = {}
    for d, text in docs:
        ours = windows(text)[0]
        for item, theirs_text in items:
            theirs, n = windows(theirs_text)
            shifts = {}
            for at, key, values in ours:
                for item_at, item_key, item_values in theirs:
                    if key == item_key:
                        pairs = None if values is None or item_values is None else tuple((a, b) for a, b in zip(item_values, values, strict=True) if a)
                        shifts.setdefault(at - item_at, set()).add((item_at, pairs))
            held = set()
            for met in shifts.values():
                votes = Counter(p for _, pairs in met for p in pairs or ())
                chosen = {}
                for a, b in sorted(votes, key=lambda p: (p[0], -votes[p], p[0] != p[1], p[1])):
                    chosen.setdefault(a, b)
                held |= {at for at, pairs in met if pairs is None or all(a == b for a, b in pairs) or all(chosen[a] == b for a, b in pairs)}
            if n and len(held) >= THRESHOLD * n:
                got[d, item] = len(held)
    return got


def sentence(pick, n):
    out = []
    for _ in range(n):
        word = pick.choice([*PLAIN, *PLAIN, *NAMES, "<n>"])
        if word == "<n>":
            out.append(str(pick.randrange(1, 40)) + pick.choice(["", "", ",", " km", " kg."]))
        else:
            out.append(word + pick.choice(["", "", "", "", "", ",", ".", "?"]))
    return " ".join(out)


def changed(pick, text):
    way = pick.randrange(6)
    words = text.split()
    if way == 0:
        return text.replace("Tom", "Carl").replace("Paris", "Oslo")
    if way == 1:
        return " ".join(str(int(w) + 50) if w.isdigit() else w for w in words)
    if way == 2:
        words[pick.randrange(len(words))] = pick.choice([*PLAIN, *NAMES, "77"])
        return " ".join(words)
    if way == 3:
        return text.lower()
    if way == 4:
        del words[pick.randrange(len(words))]
        return " ".join(words)
    return text


def test_equals_all_pairs(spark):
    pick = random.Random(4)
    items = [(i, sentence(pick, pick.choice([2, 4, 5, 8, 14, 25]))) for i in range(40)]
    docs = [(i, " ".join([sentence(pick, pick.randrange(1, 12)), changed(pick, pick.choice(items)[1]), sentence(pick, pick.randrange(1, 12))])) for i in range(160)]
    docs += [(200 + i, changed(pick, text)) for i, text in items]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_held for r in benchmark_matches(d, b).collect()}
    want = brute(docs, items)
    assert len(want) > 100 and got == want
