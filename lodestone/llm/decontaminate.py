"""Benchmark decontamination by template windows, in DataFrame operations only.

Numbers, names and units of a text become typed placeholders; five-word windows of what is left are hash-joined between
benchmark and corpus, so a question whose numbers or names were changed still meets its item. For the placeholders in
matching windows the slot values are then compared, without punctuation at their edges: within one alignment an item's value
goes with the document's value that it meets in most windows. Windows with another value count only where all their values
are the item's own; two values of an item may become one in the document.

A window has up to two templates. In the first a word counts as a name where it has a capital and follows, in the same
window, a word that does not end a sentence; the first word of a window is never a name. In the second, where it differs,
every word with a capital is a name, so that names at the start of a text, sentence or window may change too. Windows meet
by either. So a window is the same wherever it stands.

Cases: a null or empty text is clean; items without words match nothing; an item of fewer than five words is one window
and matches only a text that is that sequence; repeated item rows with an equal (id, text) count once, and the texts of an
item id that differ are items of their own; rows that share a ``doc_id`` are judged together, a null ``doc_id`` like any
other; other columns are ignored; an empty table on either side gives no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
WINDOW = 5
#: Share of an item's windows that a document must hold.
THRESHOLD = 0.75
#: Units that count as such directly after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mi", "mile", "miles", "mg", "g", "kg", "t",
    "tons", "lb", "lbs", "oz", "ml", "cl", "l", "liters", "litres", "s", "sec", "seconds", "min", "minutes", "h", "hours",
    "days", "weeks", "months", "years", "mph", "kmh", "hz", "w", "kw", "v", "j", "kj", "pa", "percent", "dollars", "euros",
    "cents", "usd", "eur", "degrees", "meters", "metres", "grams", "kilograms", "kilometers",
)
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: The small side of the window join is broadcast up to so many windows (about 60 bytes each), else both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000


def _stripped(text: Column) -> Column:
    """Without punctuation at the edges of words, found by the character itself before its surroundings; a word of punctuation only stays, so that words keep their places."""
    out = F.regexp_replace(text, r"(?=[.,;:!?\"')\]])(?<=[\p{L}\p{N}>%])[.,;:!?\"')\]]+(?=\s|$)", "")
    return F.regexp_replace(out, r"(?=[\"'(\[])(?<=^|\s)[\"'(\[]+(?=[\p{L}\p{N}<$€£])", "")


def _value_text(text: Column) -> Column:
    """Lower-cased and stripped, also before a sign: places of words stay."""
    return F.regexp_replace(_stripped(F.lower(text)), r"(?<=^|\s)[\"'(\[]+(?=[+-])", "")


def _words(text: Column) -> Column:
    """Only a text without words gives an empty string; a condition on the text would compute it twice."""
    return F.array_remove(F.split(F.trim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+"), "")


def _typed(t: Column) -> Column:
    """Numbers and units as placeholders."""
    units = "|".join(UNITS)
    number = r"(?=[$€£+(\d-])(?<=^|\s)[$€£+(-]*\d[\d.,:/]*(?:st|nd|rd|th|%)?[).,;:!?]*(?=\s|$)"
    glued = rf"(?=[+(\d-])(?<=^|\s)[+(-]*\d[\d.,]*(?:{units})[).,;:!?]*(?=\s|$)"
    typed = F.regexp_replace(F.regexp_replace(t, number, NUMBER), rf"(?i){glued}", NUMBER + UNIT)
    typed = F.regexp_replace(typed, rf"(?i)({NUMBER}\s+)(?:{units})[).,;:!?]*(?=\s|$)", "$1" + UNIT)
    return F.when(t.rlike(r"\d"), typed).otherwise(t)


#: A word that counts as a name where it is not the first of its window. Patterns test the next character first: what stands
#: before it is looked at in few places only.
NAME_PATTERN = r"(?=[\"'(\p{Lu}])(?<=[^.!?:\s]\s)[\"'(]*(\p{Lu}[\p{L}'’-]*)"
#: A word that counts as a name in the second template.
CAPITAL_PATTERN = r"(?=[\"'(\[\p{Lu}])(?<=^|\s)[\"'(\[]*(\p{Lu}[\p{L}'’-]*)"
CAPITAL = "<cap>"


def window_hashes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_windows, at, h: the templates alone, of words as numbers.

    A word's number is its hash with two low bits for what it is: 0 a plain word, 1 with a capital, 2 a name of the first
    template. Only this number is made within an array; windows are made of rows, where all expressions are compiled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(_typed(t), NAME_PATTERN, NAME + "$1"), CAPITAL_PATTERN, CAPITAL + "$1")
    clear = F.lit(~3)
    whole = lambda h: h.bitwiseAND(clear)
    after = lambda x, mark: whole(F.xxhash64(F.substring(x, len(mark) + 1, 1 << 30)))
    number = lambda x: F.when(
        x.startswith("<"),
        F.when(x.startswith(NAME), after(x, NAME).bitwiseOR(F.lit(2).cast("long")))
        .when(x.startswith(CAPITAL), after(x, CAPITAL).bitwiseOR(F.lit(1).cast("long")))
        .otherwise(whole(F.xxhash64(x))),
    ).otherwise(whole(F.xxhash64(x)))
    step = texts.select(*keys, F.transform(_words(_stripped(F.lower(marked))), number).alias("_x"))
    step = step.select(*keys, "_x", F.when(F.size("_x") >= WINDOW, F.size("_x") - WINDOW + 1).otherwise(F.least(F.size("_x"), F.lit(1))).alias("n_windows"))
    # An outer explode, as an inner one would compute its array a second time for a filter on its size.
    step = step.select(*keys, "_x", "n_windows", F.posexplode_outer("_x").alias("at", "_0")).where(F.col("at") < F.col("n_windows"))
    x = [F.col("_0"), *[F.get(F.col("_x"), F.col("at") + k) for k in range(1, WINDOW)]]
    holder = whole(F.xxhash64(F.lit(NAME)))
    kind = lambda h: h.bitwiseAND(F.lit(3).cast("long"))
    # The only window of a text of fewer words has nulls, which hashes pass over.
    first = F.xxhash64(whole(x[0]), *[F.when(kind(h) == 2, holder).otherwise(whole(h)) for h in x[1:]])
    second = F.xxhash64(*[F.when(kind(h) > 0, holder).otherwise(whole(h)) for h in x])
    step = step.select(*keys, "n_windows", "at", first.alias("_w"), second.alias("_v"))
    out = step.select(*keys, "n_windows", "at", F.explode_outer(F.array("_w", F.nullif("_v", "_w"))).alias("h"))
    return out.where(F.col("h").isNotNull())


def template_windows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, at (position), h (hash of a template), slots (values at placeholders, joined; null without any), n_windows."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.regexp_replace(F.col("_typed"), NAME_PATTERN, NAME)
    step = texts.select(*keys, t.alias("_t"), _typed(t).alias("_typed")).select(
        *keys,
        _words(_value_text(F.col("_t"))).alias("_o"),
        _words(_stripped(F.lower("_typed"))).alias("_f"),
        _words(_stripped(F.lower(named))).alias("_c"),
        _words(_stripped(F.lower(F.regexp_replace(F.col("_typed"), CAPITAL_PATTERN, NAME)))).alias("_b"),
    )
    # Values are needed only in texts with a placeholder.
    holder = lambda c: c.startswith("<") & c.rlike("<(?:num|unit|name)>")
    value = lambda words: F.transform(words, lambda c, i: F.when(holder(c), F.get(F.col("_o"), i)).otherwise(F.lit("")))
    any_slot = F.exists("_b", holder)
    none = F.array().cast("array<string>")
    step = step.select(
        *keys, "_f", "_c", "_b",
        F.when(any_slot, value(F.col("_f"))).otherwise(none).alias("_vf"),
        F.when(any_slot, value(F.col("_c"))).otherwise(none).alias("_vc"),
        F.when(any_slot, value(F.col("_b"))).otherwise(none).alias("_vb"),
    )

    def windows(f: Column, c: Column, vf: Column, vc: Column) -> Column:
        def window(i: Column) -> Column:
            values = F.array_join(F.array(F.get(vf, i), *[F.get(vc, i + k) for k in range(1, WINDOW)]), "\x1f")
            return F.struct(
                i.alias("at"),
                F.xxhash64(F.get(f, i), *[F.get(c, i + k) for k in range(1, WINDOW)]).alias("h"),
                F.when(F.size(vc) > 0, F.nullif(values, F.lit("\x1f" * (WINDOW - 1)))).alias("slots"),
            )

        short = F.array(
            F.struct(
                F.lit(0).alias("at"),
                F.xxhash64(F.lit("short"), F.array_join(F.concat(F.slice(f, 1, 1), F.slice(c, 2, WINDOW)), " ")).alias("h"),
                F.when(F.size(vc) > 0, F.array_join(F.concat(F.slice(vf, 1, 1), F.slice(vc, 2, WINDOW)), "\x1f")).alias("slots"),
            )
        )
        return (
            F.when(F.size(c) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(c) - WINDOW), window))
            .when(F.size(c) > 0, short)
            .otherwise(F.array().cast("array<struct<at:int,h:bigint,slots:string>>"))
        )

    f, c, b, vf, vc, vb = (F.col(x) for x in ("_f", "_c", "_b", "_vf", "_vc", "_vb"))
    step = step.select(*keys, windows(f, c, vf, vc).alias("_w"), windows(b, b, vb, vb).alias("_v"))
    second = F.zip_with("_w", "_v", lambda w, v: F.when(w["h"] != v["h"], v))
    # An inner explode would be preceded by a filter on the size of its array, for which the optimizer computes all of the
    # above a second time, within every lambda.
    out = step.select(*keys, F.size("_w").alias("n_windows"), F.explode_outer(F.concat("_w", second)).alias("_x"))
    return out.select(*keys, "n_windows", "_x.at", "_x.h", "_x.slots").where(F.col("h").isNotNull())


def _candidates(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id of the documents that hold enough windows of an item, whatever their slots."""
    theirs = window_hashes(items, ["item"]).select("item", F.col("n_windows").alias("item_windows"), F.col("at").alias("item_at"), "h")
    small = theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    ours = window_hashes(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "h")
    met = ours.join(F.broadcast(theirs) if small else theirs, "h")
    held = met.groupBy("doc_id", "item", "item_windows").agg(F.size(F.collect_set("item_at")).alias("n_held"))
    return held.where(F.col("n_held") >= threshold * F.col("item_windows")).select("doc_id").distinct()


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id) with the share of the item's windows that the document holds with consistent slots.

    Hashes of templates alone choose the documents first; slots are compared in those.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = items.withColumn("item", F.xxhash64(F.col("item_id"), F.col("text")))
    chosen = _candidates(docs, items, threshold).withColumnRenamed("doc_id", "_id")
    docs = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    theirs = template_windows(items, ["item", "item_id"]).select(
        "item", "item_id", F.col("n_windows").alias("item_windows"), F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots")
    )
    # One job over the benchmark alone decides how the join runs.
    small = theirs.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    ours = template_windows(docs.select("doc_id", "text"), ["doc_id"]).drop("n_windows")
    met = ours.join(F.broadcast(theirs) if small else theirs, "h")
    # The placeholders of a window as pairs (item's value, document's value).
    pairs = F.when(
        F.col("item_slots").isNotNull() & F.col("slots").isNotNull(),
        F.filter(
            F.arrays_zip(F.split("item_slots", "\x1f").alias("theirs"), F.split("slots", "\x1f").alias("ours")),
            lambda x: x["theirs"] != "",
        ),
    )
    met = met.select("doc_id", "item", "item_id", "item_windows", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"))
    # One alignment of a document and an item: bounded by the item's length.
    key = ["doc_id", "item", "item_id", "item_windows"]
    aligned = met.groupBy(*key, "shift").agg(F.collect_set(F.struct("item_at", "pairs")).alias("windows"))
    aligned = aligned.withColumn("slots", F.flatten(F.transform(F.filter("windows", lambda x: x["pairs"].isNotNull()), lambda x: x["pairs"])))
    # Each value's partners, those of most windows first; of equal ones the value itself, then the smallest.
    votes = F.transform(
        F.array_distinct("slots"),
        lambda p: F.struct(
            p["theirs"].alias("theirs"), (-F.size(F.filter("slots", lambda q: q == p))).alias("n"), (p["theirs"] != p["ours"]).alias("other"), p["ours"].alias("ours")
        ),
    )
    aligned = aligned.withColumn("votes", F.array_sort(votes))
    first = F.filter("votes", lambda v, i: (i == 0) | (F.get(F.col("votes"), i - 1)["theirs"] != v["theirs"]))
    aligned = aligned.withColumn("chosen", F.transform(first, lambda v: F.struct(v["theirs"].alias("theirs"), v["ours"].alias("ours"))))
    verbatim = lambda x: F.forall(x["pairs"], lambda p: p["theirs"] == p["ours"])
    agreed = lambda x: F.forall(x["pairs"], lambda p: F.array_contains("chosen", p))
    aligned = aligned.withColumn("windows", F.filter("windows", lambda x: x["pairs"].isNull() | verbatim(x) | agreed(x)))
    held = aligned.groupBy(*key).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("windows.item_at")))).alias("n_held"),
        F.max(F.exists("windows", lambda x: F.coalesce(F.size(x["pairs"]) > 0, F.lit(False)))).alias("has_slots"),
    )
    return held.where(F.col("n_held") >= threshold * F.col("item_windows")).select(
        "doc_id", "item_id", (F.col("n_held") / F.col("item_windows")).alias("share"), "n_held", "has_slots"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, contaminated, n_items (benchmark items held), item_id (the best held), share (of its windows)."""
    best = F.max_by(F.struct("item_id", "share"), F.struct("share", -F.col("item_id"))).alias("best")
    found = benchmark_matches(docs, benchmark, threshold).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), best)
    found = found.withColumnRenamed("doc_id", "_id")
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best.item_id").alias("item_id"),
        F.col("best.share").alias("share"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, in their own columns, that hold no benchmark item."""
    bad = benchmark_matches(docs, benchmark, threshold).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
