"""Queries of the operators over the generic tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import scoring as S
from lodestone.operators import temporal as T
from lodestone.operators import vector as V
from lodestone.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- co-change and churn ------------------------------------------------------------------------------------------------


def _coupling_sql(source: str, basket: str, item: str, date: str, support: int, jaccard: float, confidence: float, most: int = 30) -> str:
    return f"""
    with base as (select {basket} as basket, {item} as item, {date} as d from {source}),
    pairs as (select distinct basket, item from base),
    sizes as (select basket from pairs group by basket having count(*) between 2 and {most}),
    kept as (select p.* from pairs p join sizes using (basket)),
    dates as (select basket, max(d) as d from base group by basket),
    counts as (select item, count(*) as n from kept group by item),
    sup as (select a.item as item_a, b.item as item_b, count(*) as s, max(d.d) as last from kept a join kept b on a.basket = b.basket and a.item < b.item join dates d on d.basket = a.basket group by all)
    select item_a, item_b, s as support_count, round(s / (ca.n + cb.n - s), 4) as jaccard, round(s / ca.n, 4) as conf_ab, round(s / cb.n, 4) as conf_ba, last as last_cochange_date
    from sup join counts ca on ca.item = item_a join counts cb on cb.item = item_b
    where s >= {support} and round(s / (ca.n + cb.n - s), 4) >= {jaccard} and (round(s / ca.n, 4) >= {confidence} or round(s / cb.n, 4) >= {confidence})"""


SUPPLIERS = T.CouplingConfig(min_support=3, min_jaccard=0.02, min_confidence=0.03)
EVENTS = T.CouplingConfig(min_support=3, min_jaccard=0.20, min_confidence=0.44)


@query(_coupling_sql("lineitem", "l_orderkey", "l_suppkey", "l_shipdate", 3, 0.02, 0.03))
def coupling_suppliers(spark, sf_dir):
    return T.coupling(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_shipdate", SUPPLIERS)


def _user_days(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("basket"), "event_type", "ts")


_USER_DAYS = "(select user_id::varchar || '/' || ts::date::varchar as basket, event_type, ts from events)"
_EVENT_PAIRS = _coupling_sql(_USER_DAYS, "basket", "event_type", "ts", 3, 0.20, 0.44)


@query(_EVENT_PAIRS)
def coupling_events(spark, sf_dir):
    return T.coupling(_user_days(spark, sf_dir), "basket", "event_type", "ts", EVENTS)


@query(
    f"""with p as ({_EVENT_PAIRS})
    select item_a as item, item_b as other, conf_ab as confidence, conf_ba as reverse_confidence, support_count, jaccard, last_cochange_date from p
    union all select item_b, item_a, conf_ba, conf_ab, support_count, jaccard, last_cochange_date from p"""
)
def coupling_oriented(spark, sf_dir):
    return T.oriented(coupling_events(spark, sf_dir))


@query(
    """with n as (select l_orderkey, count(distinct l_partkey) as n from lineitem group by 1)
    select count(*) as analyzed, coalesce(sum((n > 5)::bigint), 0)::bigint as bulk, coalesce(sum((n between 2 and 5)::bigint), 0)::bigint as eligible from n"""
)
def coupling_bulk_filter(spark, sf_dir):
    return T.basket_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 5)


_CHURN_SQL = """
    select l_partkey as path, count(distinct l_orderkey) as commit_frequency, count(distinct l_suppkey) as author_count, sum(l_quantity) as total_additions, sum(l_linenumber)::bigint as total_deletions,
      sum(l_quantity) + sum(l_linenumber) as total_churn, sum(l_quantity) - sum(l_linenumber) as net_churn, min(l_shipdate) as first_seen, max(l_shipdate) as last_modified,
      arg_max(l_returnflag = 'R', (l_shipdate, l_orderkey, l_linenumber)) as is_deleted
    from lineitem group by 1"""


@query(_CHURN_SQL)
def churn_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", F.col("l_quantity").alias("add"), F.col("l_linenumber").cast("long").alias("del"), "l_returnflag"
    )
    out = T.churn_of(rows, "l_partkey", "l_orderkey", "l_suppkey", "l_shipdate", F.struct("l_shipdate", "l_orderkey", "l_linenumber"), F.col("l_returnflag") == "R")
    return out.drop("distinct_authors", "is_binary")


@query(f"select * from ({_CHURN_SQL}) where commit_frequency >= 2 order by author_count desc, commit_frequency desc, path limit 25")
def churn_top(spark, sf_dir):
    return T.top_churn(churn_parts(spark, sf_dir), "authors", 25, min_changes=2)


@query(
    """with c as (select o_orderkey from orders where o_orderstatus <> 'P' order by o_orderdate desc, o_orderkey limit 1000)
    select l_suppkey as path, count(distinct l_orderkey) as commit_frequency, sum(l_quantity) as total_additions from lineitem join c on o_orderkey = l_orderkey group by 1"""
)
def churn_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("full_hash"), F.col("o_orderdate").alias("author_date"), F.lit("a").alias("author_name"), F.lit("").alias("author_email"),
        (F.col("o_orderstatus") == "P").alias("is_merge"), F.struct((-F.unix_timestamp("o_orderdate")).alias("d"), "o_orderkey").alias("order"),
    )
    chosen = T.window_of_commits(o, 1000, "order").withColumn("seq", F.lit(0))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("full_hash"), F.col("l_suppkey").alias("path"), F.lit("M").alias("status"), F.lit(None).cast("bigint").alias("old_path"),
        F.col("l_quantity").alias("additions"), F.lit(0).alias("deletions"), F.lit(False).alias("is_binary"),
    )
    return T.churn(chosen, rows, None).select("path", "commit_frequency", F.col("total_additions").cast("double").alias("total_additions"))


@query("select event_id, ts, event_type from events where user_id = 7 and event_type <> 'view' order by ts desc, event_id limit 50")
def history_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    commits = e.select(
        "event_id", "ts", "event_type", F.col("event_id").cast("string").alias("full_hash"), F.col("ts").alias("author_date"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(".")).alias("author_name"),
        F.lit("").alias("author_email"), F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id").alias("seq"),
    )
    return T.history(commits, author="user 7.", limit=50).select("event_id", "ts", "event_type")


# --- vectors ------------------------------------------------------------------------------------------------------------

_COS = "greatest(0.0, least(1.0, list_cosine_similarity(e.embedding::double[], q.embedding::double[])))"
_BEST = f"""select q.vec_id as query_id, e.vec_id as id, {_COS} as s, row_number() over (partition by q.vec_id order by round({_COS}, 9) desc, e.vec_id) as rank
    from embeddings e, (select * from embeddings where vec_id % 100 = 0) q where e.vec_id <> q.vec_id"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"select query_id, id, round(s, 6) as score, rank from ({_BEST}) where rank <= 10")
def vector_topk_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.top_k_each(e, _queries(spark, sf_dir), 10, id_col="vec_id", drop_self=True).withColumn("score", F.round("score", 6))


def _first(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


@query(f"select e.vec_id, round({_COS}, 6) as score, row_number() over (order by {_COS} desc, e.vec_id)::int as rank from embeddings e, (select * from embeddings where vec_id = 0) q order by rank limit 10")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.top_k(e, _first(spark, sf_dir), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"select e.vec_id, round({_COS}, 6) as score, row_number() over (order by {_COS} desc, e.vec_id)::int as rank from embeddings e, (select * from embeddings where vec_id = 0) q where e.label = 3 order by rank limit 5")
def vector_topk_filtered(spark, sf_dir):
    return V.top_k(table(spark, sf_dir, "embeddings"), _first(spark, sf_dir), 5, "vec_id", filters={"label": 3}).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"select e.vec_id, round({_COS}, 6) as score from embeddings e, (select * from embeddings where vec_id = 1) q")
def vector_clamped_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 1").first().embedding
    return e.select("vec_id", F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("score"))


@query(
    f"""select query_id, round(sum((a.label = b.label)::int) / 10.0, 6) as precision_at_k, sum((a.label = b.label)::bigint)::bigint as hits, round(coalesce(max(case when a.label = b.label then 1 / rank end), 0), 6) as mrr
    from ({_BEST}) r join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = id where rank <= 10 group by 1"""
)
def retrieval_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = V.top_k_each(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10, id_col="vec_id", drop_self=True)
    found = found.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return V.retrieval_metrics(found, F.col("want") == F.col("label"), 10)


_WORDS = "regexp_replace(unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')), '[^\\p{L}\\p{N}_]', '', 'g')"


def _hash_sql(source: str, key: str) -> str:
    return f"""(with w as (select {key} as id, {_WORDS} as w from {source}),
      s as (select id, (('0x' || right(md5(w), 4))::bigint % 64)::int as idx, sum(1 + ln(1 + length(w))) as x from w where w <> '' group by all)
      select id, idx, x / sqrt(sum(x * x) over (partition by id)) as weight from s
      union all select {key}, 0, 1.0 from {source} where regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g') = '')"""


@query(f"select id, idx, round(weight, 6) as weight from {_hash_sql('benchmark', 'item_id')}")
def hash_embed_items(spark, sf_dir):
    return V.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    f"""with d as {_hash_sql('documents', 'doc_id')}, q as {_hash_sql('benchmark', 'item_id')},
    s as (select q.id as query_id, d.id, round(greatest(0, least(1, sum(d.weight * q.weight))), 6) as score from d join q using (idx) where q.id % 100 = 0 group by all),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, score, rank from r where rank <= 5"""
)
def doc_search(spark, sf_dir):
    d = V.hash_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    q = V.hash_embedding(table(spark, sf_dir, "benchmark").where("item_id % 100 = 0"), "item_id", "text")
    s = V.sparse_scores(d, q).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "id", "score", "rank")


@query(
    """with t as (select doc_id, 'see [a/b' || (doc_id % 3) || '.py:1-' || n_chars || '] and [x.py:2-3] then [x.py:2-3] or [bad] ' || lang as t from documents)
    select doc_id, c as citation, i - 1 as at from (select doc_id, unnest(c) as c, generate_subscripts(c, 1) as i from (
      select doc_id, case when doc_id >= 0 then ['a/b' || (doc_id % 3) || '.py:1-' || regexp_extract(t, '1-(\\d+)\\]', 1), 'x.py:2-3'] end as c from t))"""
)
def citations(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("see [a/b"), (F.col("doc_id") % 3).cast("string"), F.lit(".py:1-"), F.col("n_chars").cast("string"), F.lit("] and [x.py:2-3] then [x.py:2-3] or [bad] "), F.col("lang")).alias("t")
    )
    return t.select("doc_id", F.posexplode(V.citations(F.col("t"))).alias("at", "citation")).withColumn("at", F.col("at").cast("bigint"))


# --- graphs -------------------------------------------------------------------------------------------------------------

_FLOWS = """(select c_nationkey as src, s_nationkey as dst, count(*) as n from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by all)"""
_NATIONS = f"(select src, dst from (select *, row_number() over (partition by src order by n desc, dst) as r from {_FLOWS} where src <> dst) where r <= 2)"
_DEPENDS = "(select distinct 'customer:' || o_custkey as src, 'part:' || l_partkey as dst, 'CALLS' as edge_type from lineitem join orders on o_orderkey = l_orderkey union all select distinct 'nation:' || c_nationkey, 'customer:' || c_custkey, 'IMPORTS' from customer union all select distinct 'region:' || n_regionkey, 'nation:' || n_nationkey, 'CONTAINS' from nation)"


def _flows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _nations(spark, sf_dir):
    w = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return _flows(spark, sf_dir).where("src <> dst").withColumn("r", F.row_number().over(w)).where("r <= 2").select("src", "dst")


def _depends(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey")
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    a = a.select(name("customer", "o_custkey").alias("src"), name("part", "l_partkey").alias("dst")).distinct().withColumn("edge_type", F.lit("CALLS"))
    b = table(spark, sf_dir, "customer").select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst")).distinct().withColumn("edge_type", F.lit("IMPORTS"))
    c = table(spark, sf_dir, "nation").select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst")).distinct().withColumn("edge_type", F.lit("CONTAINS"))
    return a.unionByName(b).unionByName(c)


def _vertices(edges):
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ids.select("id", F.col("id").alias("name"), F.split("id", ":")[0].alias("node_type"))


@query(f"select src as id, edge_type, split_part(src, ':', 1) as node_type from {_DEPENDS} where dst = 'part:7' and edge_type = 'CALLS'")
def graph_neighbors(spark, sf_dir):
    e = _depends(spark, sf_dir)
    return G.neighbors(e, _vertices(e), "part:7").select("id", "edge_type", "node_type")


_REACH = f"""with recursive e as materialized {_DEPENDS}, r as (select 'part:7' as node, 0 as depth union select e.src, r.depth + 1 from r join e on e.dst = r.node and e.edge_type in ('IMPORTS', 'CALLS', 'INHERITS') where r.depth < 3)"""


@query(f"{_REACH} select node, split_part(node, ':', 1) as node_type, min(depth)::int as depth from r where depth > 0 group by all")
def impact_trace(spark, sf_dir):
    e = _depends(spark, sf_dir)
    return G.trace_impact(e, _vertices(e), "part:7").select("node", "node_type", "depth")


@query(f"{_REACH} select split_part(node, ':', 1) as node_type, depth, count(*) as n from (select node, min(depth)::int as depth from r where depth > 0 group by 1) group by all")
def blast_radius_counts(spark, sf_dir):
    return impact_trace(spark, sf_dir).groupBy("node_type", "depth").agg(F.count("*").alias("n"))


@query(
    f"""with e as {_DEPENDS}, v as (select distinct split_part(x, ':', 1) as type, x from (select src as x from e union select dst from e))
    select 'node' as kind, type, count(*) as n from v group by all union all select 'edge', edge_type, count(*) from e group by all"""
)
def graph_summary(spark, sf_dir):
    e = _depends(spark, sf_dir)
    return G.graph_summary(_vertices(e), e)


_STEP = """, r{i} as (select v.node, 0.15 / n + 0.85 * (coalesce(f, 0) + (select coalesce(sum(r), 0) from r{j} where node not in (select src from d)) / n) as r
    from v cross join n left join (select e.dst as node, sum(r.r / d.d) as f from e join r{j} r on r.node = e.src join d on d.src = e.src group by 1) using (node))"""


@query(
    f"""with e as materialized (select distinct src, dst from {_NATIONS}), v as materialized (select src as node from e union select dst from e), n as materialized (select count(*)::double as n from v),
    d as materialized (select src, count(*) as d from e group by 1), r0 as (select node, 1 / n as r from v, n)"""
    + "".join(_STEP.replace("{i}", str(i)).replace("{j}", str(i - 1)) for i in range(1, 21))
    + " select node, round(r, 6) as rank from r20"
)
def pagerank_nations(spark, sf_dir):
    return G.pagerank(_nations(spark, sf_dir), max_iterations=20, fixed=True)


@query(
    f"""with e as {_NATIONS}, v as (select src as node from e union select dst from e) select node, round(coalesce(d, 0) / ((select count(*) from v) - 1), 4) as in_degree
    from v left join (select dst as node, count(*) as d from e group by 1) using (node)"""
)
def centrality(spark, sf_dir):
    e = _nations(spark, sf_dir)
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return G.centrality(e, v, G.pagerank(e)).select("node", "in_degree")


@query(
    f"""with recursive e as materialized {_NATIONS}, p as (select src as anchor, dst as at, [src, dst] as path from e where src < dst union all
      select anchor, e.dst, list_append(path, e.dst) from p join e on e.src = p.at where e.dst > anchor and not list_contains(path, e.dst) and len(path) < 5)
    select array_to_string(path, '>') as cycle, len(path)::int as length from p join e on e.src = p.at and e.dst = anchor"""
)
def package_cycles(spark, sf_dir):
    return G.simple_cycles(_nations(spark, sf_dir), 5).select(F.array_join("cycle", ">").alias("cycle"), "length")


@query(
    f"""with recursive e as materialized {_NATIONS}, r as (select src as a, dst as b from e union select r.a, e.dst from r join e on e.src = r.b)
    select x.a as node, least(x.a, min(x.b)) as component from r x join r y on x.a = y.b and x.b = y.a where x.a <> x.b group by 1"""
)
def scc_nations(spark, sf_dir):
    return G.strong_components(_nations(spark, sf_dir))


@query(f"select r1.n_regionkey as src, r2.n_regionkey as dst, count(*) as weight from {_FLOWS} f join nation r1 on r1.n_nationkey = f.src join nation r2 on r2.n_nationkey = f.dst where r1.n_regionkey <> r2.n_regionkey group by all")
def quotient_graph(spark, sf_dir):
    imports = _flows(spark, sf_dir).select(F.col("src").alias("src_file"), F.col("dst").alias("dst_file"))
    return S.quotient_graph(imports, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_regionkey").alias("module")))


# --- layers and conformance ---------------------------------------------------------------------------------------------

_LAYERED = f"""(select f.src, f.dst, r1.n_regionkey as src_level, r2.n_regionkey as dst_level from {_FLOWS} f join nation r1 on r1.n_nationkey = f.src join nation r2 on r2.n_nationkey = f.dst where r1.n_regionkey <> r2.n_regionkey and f.n >= 3)"""
_BROKEN = f"""(select src, dst, 'UPWARD_DEPENDENCY' as rule, 1.0 as weight from {_LAYERED} where src_level > dst_level
    union all select src, dst, 'FORBIDDEN_DEPENDENCY', 1.0 from {_LAYERED} where src_level = 0 and dst_level in (4)
    union all select src, dst, 'LAYER_SKIPPING', 0.4 from {_LAYERED} where abs(src_level - dst_level) > 1)"""


def _layered(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("src_level"), F.col("n_regionkey").cast("string").alias("src_layer"))
    b = n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("dst_level"), F.col("n_regionkey").cast("string").alias("dst_layer"))
    return _flows(spark, sf_dir).where("n >= 3").join(a, "src").join(b, "dst").where("src_level <> dst_level")


RULES = S.Rules(strict=True, lists={"0": ((), ("4",))})


@query(f"select src, dst, rule, weight::double as weight from {_BROKEN}")
def violations(spark, sf_dir):
    return S.violations(_layered(spark, sf_dir), RULES).select("src", "dst", "rule", "weight")


@query(
    f"""with w as (select src, dst, max(weight) as w from {_BROKEN} group by all), t as (select count(*) as edges from {_LAYERED})
    select edges, (select count(*) from w) as violating_edges, round(coalesce((select sum(w) from w), 0), 4)::double as numerator, case when edges = 0 then 100.0 else round(100 * (1 - least(1.0, coalesce((select sum(w) from w), 0) / edges)), 2) end::double as aci from t"""
)
def conformance_aci(spark, sf_dir):
    e = _layered(spark, sf_dir)
    return S.conformance_index(e, S.violations(e, RULES))


@query(
    """select p_partkey, case when regexp_matches(lower(p_name), '(^|[._/])(web|api|cli|interfaces|views|controllers|routes|endpoints)($|[._/])') then 'Presentation'
      when p_size >= 45 then 'Presentation' when regexp_matches(lower('x/' || p_brand), '(^|[._/])(rag|impact|investigation|chunking|domain|core|models|services)($|[._/])') then 'Domain'
      when p_type = 'A' or p_size % 4 = 1 then 'Infrastructure' when p_size % 4 = 2 then 'Utilities' else 'UNCLASSIFIED' end as layer from part"""
)
def layer_infer(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.when(F.col("p_size") % 4 == 1, "db").when(F.col("p_size") % 4 == 2, "utils").otherwise("zzz")
    name = F.concat(F.lit("pkg/"), F.when(F.col("p_type") == "A", "git").otherwise(words))
    return p.select("p_partkey", S.infer_layer(name, F.col("p_size") >= 45)[0].alias("layer"))


# --- scores -------------------------------------------------------------------------------------------------------------

_SUPPLY = """(select s_suppkey as k, case when s_suppkey % 7 = 0 then null else sum(l_quantity) end as churn, count(distinct l_partkey)::double as ccn, max(l_extendedprice) as cent, avg(l_discount) as coup from supplier left join lineitem on l_suppkey = s_suppkey group by 1)"""
_P95 = lambda c: f"case when {c} is null then null when count({c}) over () = 1 then 0.5 when max({c}) over () = min({c}) over () then (case when {c} = 0 then 0.0 else 0.5 end) else round(greatest(0, least(1, ({c} - min({c}) over ()) / ((case when quantile_cont({c}, 0.95) over () <= min({c}) over () then max({c}) over () else quantile_cont({c}, 0.95) over () end) - min({c}) over ()))), 4) end"
_NORM = f"(select k, {_P95('ccn')} as a, {_P95('cent')} as b, {_P95('churn')} as c, {_P95('coup')} as d, ccn from {_SUPPLY})"
_SCORED = f"""(with x as (select *, round((coalesce(0.30 * a, 0) + coalesce(0.25 * b, 0) + coalesce(0.30 * c, 0) + coalesce(0.15 * d, 0)) /
      ((case when a is null then 0 else 0.30 end) + (case when b is null then 0 else 0.25 end) + (case when c is null then 0 else 0.30 end) + (case when d is null then 0 else 0.15 end)), 4) as base_score,
      (coalesce(a >= 0.6, false)::int + coalesce(b >= 0.6, false)::int + coalesce(c >= 0.6, false)::int) as h from {_NORM}),
    y as (select *, round(case when h <= 1 then 1.0 when h = 2 then 1.15 else 1.2::double + 0.3::double * ((c + a + b - 1.8::double) / 1.2::double) end, 6) as mu from x)
    select k, base_score, mu as multiplier, round(least(1.0, base_score * mu), 4) as score,
      case when c >= 0.6 and a >= 0.6 then 'Volatile Fragile Hotspot' when a >= 0.7 and b >= 0.5 and ccn >= 20 then 'Brain Module' when d >= 0.6 and b >= 0.5 then 'Shotgun Surgery Catalyst'
        when b >= 0.5 and coalesce(c <= 0.3, true) and a <= 0.3 then 'Stable Core' else 'Normal Component' end as archetype from y)"""


def _supply(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity", "l_partkey", "l_extendedprice", "l_discount")
    out = table(spark, sf_dir, "supplier").select("s_suppkey").join(li, "s_suppkey", "left").groupBy(F.col("s_suppkey").alias("k")).agg(
        F.sum("l_quantity").alias("churn"), F.countDistinct("l_partkey").cast("double").alias("ccn"), F.max("l_extendedprice").alias("cent"), F.avg("l_discount").alias("coup")
    )
    return out.withColumn("churn", F.when(F.col("k") % 7 != 0, F.col("churn")))


@query(f"select k, a::double as ccn_norm, b::double as cent_norm, c::double as churn_norm, d::double as coup_norm from {_NORM}")
def normalize_p95(spark, sf_dir):
    return S.normalize_p95(_supply(spark, sf_dir), ["ccn", "cent", "churn", "coup"]).select("k", "ccn_norm", "cent_norm", "churn_norm", "coup_norm")


@query(f"select k, base_score::double as base_score, multiplier::double as multiplier, score::double as score, archetype from {_SCORED}")
def hotspots(spark, sf_dir):
    return S.hotspots(_supply(spark, sf_dir), "k").select("k", "base_score", "multiplier", "score", "archetype")


@query(f"select round(avg(score), 4)::double as rrs from (select * from {_SCORED} order by score desc, base_score desc, k limit 5)")
def repository_risk(spark, sf_dir):
    return S.repository_risk(S.hotspots(_supply(spark, sf_dir), "k"), "k")


_SIGNALS = """(select s_suppkey as k, case when count(l_orderkey) = 0 then 0 else 1 / (1 + exp(-0.25 * (count(distinct l_partkey) - 15))) end as s1, s_suppkey % 10 / 10.0 as s2,
    case when s_suppkey % 5 = 0 then null else least(1.0, count(distinct l_orderkey) / 20) end as s3, case when s_suppkey % 3 = 0 then null else coalesce(avg(l_discount), 0) end as s4, 0.25 as s5, 0.5 as s6 from supplier left join lineitem on l_suppkey = s_suppkey group by 1)"""
_W = {"s1": 0.30, "s2": 0.20, "s3": 0.15, "s4": 0.15, "s5": 0.10, "s6": 0.10}
_TOTAL = " + ".join(f"(case when {k} is null then 0 else {w}::double end)" for k, w in _W.items())
_PART = {k: f"(case when {k} is null then 0 else round({w}::double / t, 4) * {k}::double end)" for k, w in _W.items()}


@query(
    f"""with x as (select *, {_TOTAL} as t from {_SIGNALS}), y as (select k, round(greatest(0, least(1, {' + '.join(_PART.values())})), 4) as impact_score from x)
    select k, impact_score, case when impact_score >= 0.75 then 'CRITICAL' when impact_score >= 0.5 then 'HIGH' when impact_score >= 0.25 then 'MEDIUM' else 'LOW' end as risk_level from y"""
)
def impact_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_partkey", "l_discount")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).join(li, "k", "left").groupBy("k")
    s = s.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"), F.avg("l_discount").alias("d"))
    k = F.col("k")
    signals = s.select(
        "k", S.s1_reachability(F.col("parts")).alias("s1"), (k % 10 / 10).alias("s2"), F.when(k % 5 != 0, S.s3_volatility(F.col("orders"), F.lit(10))).alias("s3"),
        F.when(k % 3 != 0, F.coalesce("d", F.lit(0.0))).alias("s4"), S.s5_exposure(F.lit(0.75)).alias("s5"), S.s6_complexity(F.lit(8.5)).alias("s6"),
    )
    return S.impact_score(signals).select("k", "impact_score", "risk_level")


@query(
    """with c as (select 'test_' || event_type as test_file, user_id % 20 as target, case event_id % 5 when 0 then 1.0 when 1 then 0.8 when 2 then 0.6 when 3 then 0.5 else 0.4 end as ev, (event_id % 3)::int as tier, (event_id % 4) / 10 as j, event_id from events),
    s as (select *, round(least(1.0, ev / (1 + tier) + 0.25 * j), 4) as r from c), t as (select *, count(*) over (partition by test_file, target, tier, r) - 1 as ties, row_number() over (partition by test_file, target order by tier, r desc, event_id) as rn from s)
    select test_file, target, tier, round(least(1.0, r + 0.05 * ties), 4)::double as rank_score from t where rn = 1"""
)
def test_reco(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(x) for x in S.TEST_EVIDENCE])
    c = e.select(
        F.concat(F.lit("test_"), "event_type").alias("test_file"), (F.col("user_id") % 20).alias("target"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("evidence_type"),
        (F.col("event_id") % 3).cast("int").alias("tier"), (F.col("event_id") % 4 / 10).alias("jaccard"), F.col("event_id").alias("order"),
    )
    return S.test_recommendations(c).select("test_file", "target", "tier", "rank_score")


@query("select event_type, json_extract(props, '$.k')::int as k, min(event_id) as event_id from events group by all")
def evidence_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    w = Window.partitionBy("event_type", "k").orderBy("event_id")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("event_type", "k", "event_id")


# --- texts --------------------------------------------------------------------------------------------------------------


@query("select lang as language, count(*) as files, sum(len(string_split(text, chr(10))))::bigint as lines, sum(n_chars)::bigint as bytes from documents group by 1")
def lang_breakdown(spark, sf_dir):
    from lodestone.sources.repository import language_breakdown

    d = table(spark, sf_dir, "documents")
    return language_breakdown(d.select(F.col("lang").alias("language"), F.size(F.split("text", "\n")).cast("long").alias("line_count"), F.col("n_chars").alias("file_size")))


_PATH = "case doc_id % 6 when 0 then 'src/a' || doc_id || '.py' when 1 then 'node_modules/x' || doc_id || '.js' when 2 then 'a' || doc_id || '.min.js' when 3 then 'img/' || doc_id || '.png' when 4 then 'doc/' || doc_id || '.md' else 'build/' || doc_id || '.txt' end"


@query(
    f"""with d as (select doc_id, {_PATH} as path, n_chars from documents) select doc_id, path, case when path like 'node_modules/%' or path like 'build/%' then 'ignored directory' when path like '%.min.js' then 'ignored pattern'
      when path like '%.png' then 'binary extension' when n_chars > 3000 then 'too large' when n_chars = 0 then 'empty' end as reason from d"""
)
def ingest_filter(spark, sf_dir):
    from lodestone.sources.repository import skip_reason

    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), "n_chars", F.encode("text", "UTF-8").alias("content"))
    return d.select("doc_id", "path", skip_reason(F.col("path"), F.col("n_chars"), F.col("content"), 3000).alias("reason"))


@query(
    """select doc_id, 'd/' || doc_id || '.csv' as relative_path, 'block' as chunk_type, doc_id || '.csv' as symbol_name, len(string_split(rtrim(text, chr(10)), chr(10)))::int as end_line,
      substr(sha256('d/' || doc_id || '.csv:block:' || doc_id || '.csv:1-' || len(string_split(rtrim(text, chr(10)), chr(10))) || ':' || trim(text, ' ' || chr(9) || chr(10) || chr(13))), 1, 16) as chunk_id
    from documents where trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''"""
)
def chunk_ids(spark, sf_dir):
    from lodestone.functions.code import chunk_files

    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("relative_path"), F.col("text").alias("content"), F.lit("csv").alias("language"))
    out = chunk_files(files)
    return out.select(F.regexp_extract("relative_path", r"(\d+)\.csv$", 1).cast("bigint").alias("doc_id"), "relative_path", "chunk_type", "symbol_name", "end_line", "chunk_id")


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
    h as (select doc_id, n, line, lead(n) over (partition by doc_id order by n) - 1 as e, max(n) over (partition by doc_id) as last from l where length(line) >= 200)
    select doc_id, n::int as start_line, coalesce(e, (select max(n) from l where l.doc_id = h.doc_id))::int as end_line, length(line)::int as width from h"""
)
def chunk_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("total"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    heads = lines.where(F.length("line") >= 200).withColumn("e", F.lead("n").over(w))
    return heads.select("doc_id", (F.col("n") + 1).alias("start_line"), F.coalesce("e", "total").alias("end_line"), F.length("line").alias("width"))


def _intent_sql() -> str:
    from lodestone.plans.intent import INTENT_PATTERNS, INTENTS

    case = lambda p, w: f"(case when regexp_matches(q, '{p}') then {w}::double else 0 end)"
    scores = ", ".join(" + ".join(case(p, w) for p, w in INTENT_PATTERNS[k]) + f" as {k.lower()}" for k in INTENTS)
    union = " union all ".join(f"select conv_id, turn, {k.lower()} as s, {i} as i, '{k}' as name from s" for i, k in enumerate(INTENTS))
    return f"""with b as ({_QUESTIONS_SQL}), s as (select conv_id, turn, {scores} from b), u as ({union}), r as (select *, row_number() over (partition by conv_id, turn order by s desc, i) as k from u)
      select conv_id, turn, case when s = 0 then 'UNDERSTAND' else name end as intent from r where k = 1"""


_ASKED = ("how does it work", "who calls it", "what breaks if it is changed", "show the commit history", "are there package cycles", "explain the architecture of it", "nothing")
_QUESTIONS_SQL = "select conv_id, turn, case (conv_id + turn) % 7 " + " ".join(f"when {i} then '{q}'" for i, q in enumerate(_ASKED)) + " end || ' ' || lower(coalesce(text, '')) as q from conversations"


@query(_intent_sql())
def intent_classify(spark, sf_dir):
    from lodestone.plans.intent import classify_table

    c = table(spark, sf_dir, "conversations")
    asked = F.get(F.array(*[F.lit(q) for q in _ASKED]), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    c = c.select("conv_id", "turn", F.concat(asked, F.lit(" "), F.lower(F.coalesce("text", F.lit("")))).alias("query"))
    return classify_table(c).select("conv_id", "turn", "intent")


@query(
    f"""with recursive e as materialized {_DEPENDS}, r as (select 'nation:3' as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node and e.edge_type in ('IMPORTS', 'CALLS') where r.depth < 2)
    select node, min(depth)::int as depth from r where depth > 0 group by 1"""
)
def dependencies_transitive(spark, sf_dir):
    e = _depends(spark, sf_dir)
    start = spark.createDataFrame([("nation:3",)], "root string")
    return G.reach(e, start, 2, ("IMPORTS", "CALLS")).select("node", "depth")


# Modules that register further queries here.
from lodestone.plans import code_rows  # noqa: E402, F401
