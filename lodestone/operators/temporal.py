"""Change history: churn of items and co-change of item pairs, over any (basket, item) tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CouplingConfig:
    min_support: int = 3
    min_jaccard: float = 0.20
    min_confidence: float = 0.50
    max_basket: int = 30
    min_baskets: int = 3


def author_identity(name: str | Column, email: str | Column) -> Column:
    """``Name <email>`` with the email in lower case, or what there is of it."""
    n, e = (F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))) for x in (name, email))
    e = F.lower(e)
    return F.when((n != "") & (e != ""), F.concat(n, F.lit(" <"), e, F.lit(">"))).when(e != "", e).when(n != "", n).otherwise(F.lit("unknown"))


def window_of_commits(commits: DataFrame, limit: int = 1000, order: str = "seq") -> DataFrame:
    """The newest commits that are no merges; ``order`` ascends from new to old."""
    return commits.where(~F.coalesce(F.col("is_merge"), F.lit(False))).orderBy(order).limit(limit)


def history(commits: DataFrame, changes: DataFrame | None = None, author: str | None = None, since=None, path: str | None = None, limit: int = 50) -> DataFrame:
    """Commits, newest first, by author (substring of name or email), date and touched path."""
    out = commits
    if author:
        needle = F.lit(author.lower())
        out = out.where(F.contains(F.lower("author_name"), needle) | F.contains(F.lower("author_email"), needle))
    if since is not None:
        out = out.where(F.col("author_date") >= F.lit(since))
    if path is not None and changes is not None:
        touched = changes.where((F.col("path") == path) | (F.col("old_path") == path)).select("full_hash").distinct()
        out = out.join(touched, "full_hash", "left_semi")
    return out.orderBy("seq").limit(limit)


def churn(commits: DataFrame, changes: DataFrame, limit: int | None = 1000) -> DataFrame:
    """Per path: commits, authors, lines, first and last date, deleted, binary.

    A rename also counts for its old path, as a deletion without lines.
    """
    chosen = (window_of_commits(commits, limit) if limit is not None else commits.where(~F.coalesce(F.col("is_merge"), F.lit(False)))).select(
        "full_hash", F.col("author_date").alias("_date"), author_identity("author_name", "author_email").alias("_author"), F.col("seq").alias("_seq")
    )
    rows = changes.join(chosen, "full_hash")
    lines = lambda c: F.when(F.coalesce(F.col("is_binary"), F.lit(False)), F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("long")
    binary = F.coalesce(F.col("is_binary"), F.lit(False)).alias("is_binary")
    own = rows.select("full_hash", "_date", "_author", "_seq", "path", "status", lines("additions").alias("add"), lines("deletions").alias("del"), binary)
    moved = rows.where("status = 'R' and old_path is not null").select(
        "full_hash", "_date", "_author", "_seq", F.col("old_path").alias("path"), F.lit("D").alias("status"), F.lit(0).cast("long").alias("add"), F.lit(0).cast("long").alias("del"), F.lit(False).alias("is_binary")
    )
    return churn_of(own.unionByName(moved), "path", "full_hash", "_author", "_date", F.struct(-F.col("_seq")), F.col("status") == "D")


def churn_of(rows: DataFrame, item: str, basket: str, author: str, date: str, recency: Column, deleted: Column, add: str = "add", dele: str = "del") -> DataFrame:
    """The aggregation of ``churn`` over any table; ``recency`` orders the rows of an item in time."""
    binary = F.bool_or("is_binary") if "is_binary" in rows.columns else F.lit(False)
    return rows.groupBy(F.col(item).alias("path")).agg(
        F.countDistinct(basket).alias("commit_frequency"),
        F.countDistinct(author).alias("author_count"),
        F.sum(add).alias("total_additions"),
        F.sum(dele).alias("total_deletions"),
        (F.sum(add) + F.sum(dele)).alias("total_churn"),
        (F.sum(add) - F.sum(dele)).alias("net_churn"),
        F.array_sort(F.collect_set(author)).alias("distinct_authors"),
        F.min(date).alias("first_seen"),
        F.max(date).alias("last_modified"),
        F.max_by(deleted, recency).alias("is_deleted"),
        binary.alias("is_binary"),
    )


SORT_KEYS = {
    "commits": "commit_frequency", "authors": "author_count", "additions": "total_additions", "deletions": "total_deletions",
    "churn": "total_churn", "total": "total_churn", "net": "net_churn",
}


def top_churn(metrics: DataFrame, sort_by: str = "commits", limit: int = 20, min_changes: int = 1, contains: str | None = None) -> DataFrame:
    """The items with the highest metric; ties by commits and then path."""
    key = SORT_KEYS.get(sort_by, sort_by)
    out = metrics.where(F.col("commit_frequency") >= min_changes)
    if contains:
        out = out.where(F.contains(F.lower("path"), F.lit(contains.lower())))
    return out.orderBy(F.desc(key), F.desc("commit_frequency"), "path").limit(limit)


def churn_summary(metrics: DataFrame, commits: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("files"), F.sum("total_additions").alias("additions"), F.sum("total_deletions").alias("deletions"), F.sum("total_churn").alias("churn")
    ).crossJoin(commits.agg(F.count("*").alias("commits")))  # two single rows


def eligible_baskets(rows: DataFrame, basket: str, item: str, max_basket: int = 30) -> DataFrame:
    """Distinct (basket, item) of baskets with 2 to max_basket items; counted before any pair is made."""
    pairs = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("item is not null").distinct()
    sizes = pairs.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_basket))
    return pairs.join(sizes.select("basket"), "basket", "left_semi")


def basket_counts(rows: DataFrame, basket: str, item: str, max_basket: int = 30) -> DataFrame:
    """One row: all baskets, bulk ones (too large), eligible ones."""
    sizes = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct().groupBy("basket").agg(F.count("item").alias("n"))
    return sizes.agg(
        F.count("*").alias("analyzed"),
        F.coalesce(F.sum((F.col("n") > max_basket).cast("long")), F.lit(0)).alias("bulk"),
        F.coalesce(F.sum(F.col("n").between(2, max_basket).cast("long")), F.lit(0)).alias("eligible"),
    )


def coupling(rows: DataFrame, basket: str, item: str, date: str, config: CouplingConfig = CouplingConfig()) -> DataFrame:
    """Pairs a < b that stand in the same baskets: support, Jaccard, both confidences, last date.

    Baskets are bounded by ``max_basket``, so a basket makes at most max_basket ** 2 / 2 pairs, which are summed where
    they arise. Counts of single items are over the same baskets. Ratios are rounded to 4 digits before the thresholds.
    """
    kept = eligible_baskets(rows, basket, item, config.max_basket)
    # One row a basket: pairs are made inside it, without a second shuffle by basket.
    dated = rows.groupBy(F.col(basket).alias("basket")).agg(F.max(date).alias("date"))
    bags = kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).join(dated, "basket")
    pairs = bags.select("date", F.posexplode("items").alias("i", "item_a"), "items").select(
        "date", "item_a", F.explode(F.slice("items", F.col("i") + 2, config.max_basket)).alias("item_b")
    )
    support = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("support_count"), F.max("date").alias("last_cochange_date"))
    support = support.where(F.col("support_count") >= config.min_support)
    counts = kept.groupBy("item").agg(F.count("*").alias("n"))
    out = support.join(counts.select(F.col("item").alias("item_a"), F.col("n").alias("na")), "item_a").join(
        counts.select(F.col("item").alias("item_b"), F.col("n").alias("nb")), "item_b"
    )
    s, a, b = F.col("support_count"), F.col("na"), F.col("nb")
    out = out.select(
        "item_a", "item_b", "support_count",
        F.round(s / (a + b - s), 4).alias("jaccard"), F.round(s / a, 4).alias("conf_ab"), F.round(s / b, 4).alias("conf_ba"), "last_cochange_date",
    )
    return out.where(
        (F.col("jaccard") >= config.min_jaccard) & ((F.col("conf_ab") >= config.min_confidence) | (F.col("conf_ba") >= config.min_confidence))
    )


def ordered_couplings(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("jaccard"), F.desc("support_count"), "item_a", "item_b")


def coupling_status(rows: DataFrame, basket: str, pairs: DataFrame, config: CouplingConfig = CouplingConfig()) -> DataFrame:
    """One row: insufficient_history, no_couplings_found or success."""
    n = rows.agg(F.countDistinct(basket).alias("commits"))
    m = pairs.agg(F.count("*").alias("pairs"))
    return n.crossJoin(m).select(  # two single rows
        F.when(F.col("commits") < config.min_support, "insufficient_history").when(F.col("pairs") == 0, "no_couplings_found").otherwise("success").alias("status"), "commits", "pairs"
    )


def oriented(pairs: DataFrame, focal: str | None = None) -> DataFrame:
    """Both directions of each pair, or those from one item: item, other, confidence from it and back."""
    rows = F.explode(
        F.array(
            F.struct(F.col("item_a").alias("item"), F.col("item_b").alias("other"), F.col("conf_ab").alias("confidence"), F.col("conf_ba").alias("reverse_confidence")),
            F.struct(F.col("item_b").alias("item"), F.col("item_a").alias("other"), F.col("conf_ba").alias("confidence"), F.col("conf_ab").alias("reverse_confidence")),
        )
    )
    if focal is not None:
        pairs = pairs.where((F.col("item_a") == focal) | (F.col("item_b") == focal))
    out = pairs.select("support_count", "jaccard", "last_cochange_date", rows.alias("x")).select("x.*", "support_count", "jaccard", "last_cochange_date")
    return out.where(F.col("item") == focal) if focal is not None else out


def couplings_of(pairs: DataFrame, focal: str, min_support: int = 3, min_confidence: float = 0.0, limit: int = 10) -> DataFrame:
    out = oriented(pairs, focal).where((F.col("support_count") >= min_support) & (F.col("confidence") >= min_confidence))
    return out.orderBy(F.desc("jaccard"), F.desc("support_count"), "other").limit(limit)
