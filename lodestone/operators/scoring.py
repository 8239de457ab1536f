"""Signals and scores: percentile normalisation, hotspots, impact signals, layers and conformance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- percentile normalisation -------------------------------------------------------------------------------------------


def normalize_p95(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (p95 - min), clipped to [0, 1], 4 digits; NULL stays NULL.

    One value gives 0.5; equal values give 0 where they are 0 and 0.5 otherwise; p95 at the minimum is replaced by the
    maximum. One aggregate row is joined back, so nothing is sorted in one task.
    """
    stats = df.agg(*[f for c in columns for f in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.percentile(c, F.lit(0.95)).alias(f"_p_{c}"), F.count(c).alias(f"_n_{c}"))])
    out = df.withColumn("_k", F.lit(1)).join(F.broadcast(stats.withColumn("_k", F.lit(1))), "_k").drop("_k")
    for c in columns:
        lo, hi, p, n = (F.col(f"_{k}_{c}") for k in ("lo", "hi", "p", "n"))
        x = F.col(c)
        top = F.when(p <= lo, hi).otherwise(p)
        scaled = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (top - lo))), 4)
        out = out.withColumn(f"{c}{suffix}", F.when(x.isNull(), None).when(n == 1, 0.5).when(hi == lo, F.when(x == 0, 0.0).otherwise(0.5)).otherwise(scaled))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi", "p", "n")])


def _weighted(parts: list[tuple[Column, float]]) -> Column:
    """The mean of the signals that are there, by their weights; NULL without any."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(total > 0, value / total)


# --- hotspots -----------------------------------------------------------------------------------------------------------

#: Fixed values of the hotspot model.
HOTSPOT_WEIGHTS = {"ccn": 0.30, "cent": 0.25, "churn": 0.30, "coup": 0.15}
SYNERGY = 0.60


def base_score(ccn="ccn", cent="cent", churn="churn", coup="coup") -> Column:
    return F.round(F.coalesce(_weighted([(F.col(n), HOTSPOT_WEIGHTS[k]) for k, n in (("ccn", ccn), ("cent", cent), ("churn", churn), ("coup", coup))]), F.lit(0.0)), 4)


def multiplier(ccn="ccn", cent="cent", churn="churn") -> Column:
    cols = [F.col(x) for x in (churn, ccn, cent)]
    high = [F.coalesce(c >= SYNERGY, F.lit(False)) for c in cols]
    n = sum((h.cast("int") for h in high), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.round(F.when(n <= 1, 1.0).when(n == 2, 1.15).otherwise(1.2 + 0.3 * ((total - 1.8) / 1.2)), 6)


def hotspot_score(base: Column, mu: Column) -> Column:
    return F.round(F.least(F.lit(1.0), base * mu), 4)


def archetype(ccn="ccn", cent="cent", churn="churn", coup="coup", raw_ccn="raw_ccn", is_class: Column | None = None, sloc: str = "sloc", methods: str = "methods", class_graph: bool = True) -> Column:
    """The first archetype of the cascade that fits; is_class: rows that are classes, with their sloc and methods."""
    at = lambda c, x: F.coalesce(F.col(c) >= x, F.lit(False))
    low = lambda c: F.col(c) <= 0.30
    out = F
    if is_class is not None:
        large = is_class & (F.col(sloc) >= 300) & (F.col(methods) >= 10) & (F.col(raw_ccn) >= 30)
        out = out.when(large & at(cent, 0.40) & F.lit(class_graph), "God Class").when(large, "God Class Candidate")
    out = out.when(at(churn, 0.60) & at(ccn, 0.60), "Volatile Fragile Hotspot")
    out = out.when(at(ccn, 0.70) & at(cent, 0.50) & F.coalesce(F.col(raw_ccn) >= 20, F.lit(True)), "Brain Module")
    out = out.when(at(coup, 0.60) & at(cent, 0.50), "Shotgun Surgery Catalyst")
    out = out.when(at(cent, 0.50) & F.coalesce(low(churn), F.lit(True)) & F.coalesce(low(ccn), F.lit(False)), "Stable Core")
    return out.otherwise("Normal Component")


#: The parts of the evidence, their weights, and what is said where one is missing.
EVIDENCE_PARTS = (
    ("ast", 0.25, "INCOMPLETE_AST_PARSING"),
    ("graph", 0.20, "STATIC_DEPENDENCY_GRAPH_UNAVAILABLE"),
    ("churn", 0.20, "GIT_CHURN_HISTORY_UNAVAILABLE"),
    ("temporal", 0.15, "TEMPORAL_COUPLING_INSUFFICIENT_COMMITS"),
    ("structure", 0.10, "STRUCTURAL_COUPLING_UNAVAILABLE"),
    ("classes", 0.10, "CLASS_DEPENDENCY_GRAPH_PARTIAL"),
)


def evidence_coverage(**shares: Column) -> tuple[Column, Column, Column]:
    """(coverage, state, missing) of the share in [0, 1] that there is of each part."""
    total = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((shares[n] * w for n, w, _ in EVIDENCE_PARTS), F.lit(0.0)))), 4)
    state = F.when(total >= 0.90, "FULL_EVIDENCE").when(total >= 0.55, "PARTIAL_STATIC_ONLY").otherwise("DEGRADED_ANALYSIS")
    full = lambda n: shares[n] < 1.0 if n in ("ast", "classes") else shares[n] == 0.0
    return total, state, F.array_compact(F.array(*[F.when(full(n), said) for n, _, said in EVIDENCE_PARTS]))


def graph_signal(in_degree: Column, rank: Column, max_rank: Column, n: Column) -> Column:
    """Half the in-degree over 10 and half the PageRank above its floor; 0 for nodes that nothing points at."""
    floor = 0.15 / n
    pr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(max_rank > floor, (rank - floor) / (max_rank - floor)).otherwise(0.0)))
    return F.when(in_degree == 0, 0.0).otherwise(0.5 * F.least(F.lit(1.0), in_degree / 10) + 0.5 * pr)


def coupling_signal(degree: Column, jaccard_sum: Column) -> Column:
    structural = F.least(F.lit(1.0), degree / 20)
    return F.when(jaccard_sum.isNull(), structural).otherwise(0.5 * structural + 0.5 * F.least(F.lit(1.0), jaccard_sum / 3))


def hotspots(modules: DataFrame, key: str = "module", is_class: Column | None = None) -> DataFrame:
    """Modules with raw ccn, cent, churn (NULL without history) and coup: normalised signals, scores, archetypes, in order."""
    raw = modules.withColumn("raw_ccn", F.col("ccn"))
    out = normalize_p95(raw, ["ccn", "cent", "churn", "coup"])
    names = {f"{c}": f"{c}_norm" for c in ("ccn", "cent", "churn", "coup")}
    out = out.withColumn("base_score", base_score(**names)).withColumn("multiplier", multiplier(ccn="ccn_norm", cent="cent_norm", churn="churn_norm"))
    out = out.withColumn("score", hotspot_score(F.col("base_score"), F.col("multiplier"))).withColumn("archetype", archetype(**names, is_class=is_class))
    return out


def repository_risk(scored: DataFrame, key: str = "module", top: int = 5) -> DataFrame:
    """The mean of the five highest scores."""
    return scored.orderBy(F.desc("score"), F.desc("base_score"), key).limit(top).agg(F.round(F.avg("score"), 4).alias("rrs"))


# --- impact -------------------------------------------------------------------------------------------------------------

#: Fixed values of the impact model.
IMPACT_WEIGHTS = {"s1": 0.30, "s2": 0.20, "s3": 0.15, "s4": 0.15, "s5": 0.10, "s6": 0.10}
IMPACT_NAMES = {"s1": "reachability", "s2": "centrality", "s3": "volatility", "s4": "coupling", "s5": "test_exposure", "s6": "complexity"}


def s1_reachability(n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(1 / (1 + F.exp(-0.25 * (n - 15))))


def s3_volatility(commits: Column, total_commits: Column) -> Column:
    return F.when(total_commits >= 3, F.least(F.lit(1.0), commits / 20))


def s5_exposure(exposure: Column) -> Column:
    """exposure: the sum of rank score times tier weight over recommended tests; NULL without tests."""
    return 1 - F.least(F.lit(1.0), F.coalesce(exposure, F.lit(0.0)))


def tier_weight(tier: Column) -> Column:
    return F.when(tier == 0, 1.0).when(tier == 1, 0.6).when(tier == 2, 0.3).otherwise(0.2)


def s6_complexity(ccn: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ccn - 1) / 15))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.50, "HIGH").when(score >= 0.25, "MEDIUM").otherwise("LOW")


def impact_score(df: DataFrame) -> DataFrame:
    """Signals s1..s6 (NULL: unavailable) to the composite with renormalised weights, each rounded to 4 digits before the sum."""
    there = {k: F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for k, w in IMPACT_WEIGHTS.items()}
    out = df.withColumn("_w", sum(there.values(), F.lit(0.0)))
    weights = {k: F.when(F.col(k).isNotNull() & (F.col("_w") > 0), F.round(F.lit(w) / F.col("_w"), 4)).otherwise(0.0) for k, w in IMPACT_WEIGHTS.items()}
    value = sum((weights[k] * F.coalesce(F.col(k), F.lit(0.0)) for k in IMPACT_WEIGHTS), F.lit(0.0))
    out = out.withColumn("impact_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4))
    parts = F.array(*[F.struct((weights[k] * F.coalesce(F.col(k), F.lit(0.0))).alias("v"), F.lit(-i).alias("i"), F.lit(IMPACT_NAMES[k]).alias("name")) for i, k in enumerate(IMPACT_WEIGHTS)])
    return out.withColumn("top_driver", F.array_max(parts)["name"]).withColumn("risk_level", risk_level(F.col("impact_score"))).drop("_w")


def impact_confidence(commits: Column, has_git: Column, has_tests: Column) -> tuple[Column, Column]:
    git = F.when(has_git & (commits >= 10), 0.30).when(has_git & (commits >= 3), 0.15).otherwise(0.0)
    value = F.round(0.5 + git + F.when(has_tests, 0.20).otherwise(0.0), 2)
    return value, F.when(value >= 0.8, "HIGH").when(value >= 0.5, "MEDIUM").otherwise("LOW")


#: Evidence for a test and its value, in order of precedence.
TEST_EVIDENCE = {"DIRECT_INVOCATION": 1.0, "DIRECT_IMPORT": 0.8, "HEURISTIC_NAMING": 0.6, "HEURISTIC_MIRRORING": 0.5, "HEURISTIC_CO_CHANGE": 0.4}


def test_recommendations(candidates: DataFrame) -> DataFrame:
    """One row for each (test_file, target) of candidates (test_file, target, evidence_type, tier, jaccard, order).

    score = evidence / (1 + tier) + jaccard / 4; the nearest tier and then the highest score stay, with 0.05 for each
    further candidate that equals it, up to 1.
    """
    value = F.element_at(F.create_map(*[F.lit(x) for kv in TEST_EVIDENCE.items() for x in kv]), F.col("evidence_type"))
    rows = candidates.withColumn("rank_score", F.round(F.least(F.lit(1.0), value / (1 + F.col("tier")) + 0.25 * F.coalesce("jaccard", F.lit(0.0))), 4))
    w = Window.partitionBy("test_file", "target").orderBy("tier", F.desc("rank_score"), "order")
    same = Window.partitionBy("test_file", "target", "tier", "rank_score")
    best = rows.withColumn("_ties", F.count("*").over(same) - 1).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.withColumn("rank_score", F.round(F.least(F.lit(1.0), F.col("rank_score") + 0.05 * F.col("_ties")), 4)).drop("_r", "_ties", "order")


def is_test_entity(node_id: Column, path: Column, name: Column) -> Column:
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    n = F.lower(F.coalesce(name, F.lit("")))
    in_directory = p.rlike(r"tests?/|^tests")
    in_file = p.rlike(r"_test\.py$|(^|/)test_")
    return in_directory | in_file | n.rlike(r"^test|_test$") | F.contains(F.lower(node_id), F.lit("test"))


def mirror_names(path: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.array(F.concat(F.lit("test_"), stem, F.lit(".py")), F.concat(stem, F.lit("_test.py")))


# --- modules, layers, conformance ---------------------------------------------------------------------------------------


def module_of(path: Column) -> Column:
    """Dotted directory of a file, or __root__."""
    directory = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)
    return F.when(directory == "", "__root__").otherwise(F.replace(directory, F.lit("/"), F.lit(".")))


#: Parts of a module's path and the layer they stand for, in order of precedence.
LAYER_PATTERNS = (
    ("Presentation", ("web", "api", "cli", "interfaces", "views", "controllers", "routes", "endpoints")),
    ("Domain", ("rag", "impact", "investigation", "chunking", "domain", "core", "models", "services")),
    ("Infrastructure", ("git", "graph", "retrieval", "embeddings", "vector_store", "db", "storage", "database")),
    ("Utilities", ("ingestion", "parsing", "config", "utils", "common", "helpers", "shared")),
)
#: Levels by layer name in lower case; any other layer is 5, what fits no layer 10.
LAYER_LEVELS = {
    "presentation": 1, "api": 1, "interfaces": 1, "application": 2, "domain": 3, "core": 3, "infrastructure": 4, "util": 5, "common": 5, "shared": 5, "unclassified": 10,
}


def infer_layer(name: Column, has_entrypoint: Column | None = None, configured: list[tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """(layer, confidence): configured prefix 1.0, entry point 0.95, name 0.80, else UNCLASSIFIED."""
    layer, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for prefix, to in configured or ():
        hit = (name == prefix) | F.startswith(name, F.lit(prefix + "."))
        layer, sure = layer.when(hit, to), sure.when(hit, 1.0)
    if has_entrypoint is not None:
        layer, sure = layer.when(has_entrypoint, "Presentation"), sure.when(has_entrypoint, 0.95)
    for to, words in LAYER_PATTERNS:
        hit = F.lower(name).rlike(r"(?:^|[._/])(?:" + "|".join(words) + r")(?:$|[._/])")
        layer, sure = layer.when(hit, to), sure.when(hit, 0.80)
    return layer.otherwise("UNCLASSIFIED"), sure.otherwise(0.0)


def layer_level(layer: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LAYER_LEVELS.items() for x in kv]), F.lower(layer)), F.lit(5))


def quotient_graph(imports: DataFrame, module_of_file: DataFrame) -> DataFrame:
    """(src, dst, weight): imports between different modules."""
    m = module_of_file.select("file", "module")
    rows = imports.join(m.select(F.col("file").alias("src_file"), F.col("module").alias("src")), "src_file").join(m.select(F.col("file").alias("dst_file"), F.col("module").alias("dst")), "dst_file")
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@dataclass(frozen=True)
class Rules:
    strict: bool = False
    #: layer -> (allowed, forbidden) layer names; none of either is no rule.
    lists: dict = field(default_factory=dict)


def violations(edges: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each rule that an edge (src, dst, src_layer, src_level, dst_layer, dst_level) breaks, with its weight."""
    forbidden = F.lit(False)
    for layer, (allowed, banned) in rules.lists.items():
        bad = F.col("dst_layer").isin(*banned) if banned else F.lit(False)
        if allowed:
            bad = bad | ~F.col("dst_layer").isin(*allowed, layer)
        forbidden = forbidden | ((F.col("src_layer") == layer) & bad)
    rule = lambda hit, name, w: F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(w).alias("weight")))
    found = F.array_compact(
        F.array(
            rule(F.col("src_level") > F.col("dst_level"), "UPWARD_DEPENDENCY", 1.0),
            rule(forbidden, "FORBIDDEN_DEPENDENCY", 1.0),
            rule(F.lit(rules.strict) & (F.abs(F.col("src_level") - F.col("dst_level")) > 1), "LAYER_SKIPPING", 0.4),
        )
    )
    return edges.select("*", F.explode(found).alias("_v")).select(*edges.columns, "_v.rule", "_v.weight")


def conformance_index(edges: DataFrame, broken: DataFrame) -> DataFrame:
    """aci = 100 * (1 - min(1, sum of each edge's heaviest violation / edges)), 2 digits; 100 without edges."""
    worst = broken.groupBy("src", "dst").agg(F.max("weight").alias("w")).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("numerator"), F.count("*").alias("violating_edges"))
    total = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    return total.crossJoin(worst).select(  # two single rows
        "edges", "violating_edges", F.round("numerator", 4).alias("numerator"),
        F.when(F.col("edges") == 0, 100.0).otherwise(F.round(100 * (1 - F.least(F.lit(1.0), F.col("numerator") / F.col("edges"))), 2)).alias("aci"),
    )


def normalize_dependency(name: Column) -> Column:
    """The package name of a requirement line: no comment, extras, version or marker; lower case with single dashes."""
    bare = F.trim(F.regexp_replace(name, r"(?:#.*|;.*)$", ""))
    bare = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.lower(F.regexp_replace(bare, r"[-_.]+", "-"))
