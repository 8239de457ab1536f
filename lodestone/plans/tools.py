"""The tools of an investigation over the tables of one repository, and the workspace that builds the tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import code
from lodestone.operators import code_graph as C
from lodestone.operators import graph as G
from lodestone.operators import scoring as S
from lodestone.operators import temporal as T
from lodestone.operators import vector as V
from lodestone.plans.intent import retrieval_kind
from lodestone.plans.investigation import ToolRegistry
from lodestone.session import checkpoint_root
from lodestone.sources.repository import load_repository, safe_slice


@dataclass
class Workspace:
    """Tables of a repository; each is written once and then read."""

    spark: SparkSession
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    chunks: DataFrame
    vertices: DataFrame
    edges: DataFrame
    edge_log: DataFrame
    complexity: DataFrame
    commits: DataFrame | None = None
    changes: DataFrame | None = None
    couplings: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, source: str, history: str | None = None) -> Workspace:
        files, _ = load_repository(spark, source)
        return cls.of_files(spark, files, history)

    @classmethod
    def of_files(cls, spark: SparkSession, files: DataFrame, history: str | None = None) -> Workspace:
        files = G.written(files, "files")
        symbols, imports = G.written(code.parse_symbols(files), "symbols"), G.written(code.parse_imports(files), "imports")
        vertices, log = C.build(files, symbols, imports)
        ws = cls(spark, files, symbols, imports, G.written(code.chunk_files(files), "chunks"), vertices, log, log, G.written(code.complexity(files), "complexity"))
        if history:
            from lodestone.sources.gitlog import read_history

            ws.commits, ws.changes = (G.written(x, "history") for x in read_history(spark, history))
            rows = ws.changes.join(ws.commits.select("full_hash", "author_date"), "full_hash")
            ws.couplings = G.written(T.coupling(rows, "full_hash", "path", "author_date"), "couplings")
            ws.vertices, ws.edge_log = C.temporal(ws.vertices, log, ws.commits, ws.changes, ws.couplings)
        ws.vertices, ws.edge_log = G.written(ws.vertices, "vertices"), G.written(ws.edge_log, "edge_log")
        ws.edges = G.written(G.last_edges(ws.edge_log), "edges")
        return ws

    def modules(self) -> DataFrame:
        """Modules with size, complexity, graph, churn and coupling signals."""
        files = self.files.where("language = 'python'").select("relative_path", "line_count", S.module_of(F.col("relative_path")).alias("module"))
        base = files.join(self.complexity, "relative_path", "left").groupBy("module").agg(F.sum("line_count").alias("loc"), F.sum("total_complexity").cast("double").alias("ccn"), F.bool_or(F.col("relative_path").rlike(r"(cli|app|main)\.py$")).alias("entry"))
        links = self.module_edges()
        ranks = G.pagerank(links, base.select(F.col("module").alias("node")))
        deg = links.groupBy(F.col("dst").alias("module")).agg(F.countDistinct("src").alias("indeg"))
        both = links.select(F.col("src").alias("module")).union(links.select("dst")).groupBy("module").agg(F.count("*").alias("degree"))
        out = base.join(ranks.withColumnRenamed("node", "module"), "module", "left").join(deg, "module", "left").join(both, "module", "left")
        stats = ranks.agg(F.max("rank").alias("_top"), F.count("*").alias("_n")).withColumn("_k", F.lit(1))
        out = out.withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k", "left")
        churn, jac = F.lit(None).cast("double"), F.lit(None).cast("double")
        if self.changes is not None:
            own = T.churn(self.commits, self.changes).select(S.module_of(F.col("path")).alias("module"), "commit_frequency").groupBy("module").agg(F.sum("commit_frequency").cast("double").alias("_churn"))
            pairs = T.oriented(self.couplings).groupBy(S.module_of(F.col("item")).alias("module")).agg(F.sum("jaccard").alias("_jac"))
            out = out.join(own, "module", "left").join(pairs, "module", "left")
            churn, jac = F.coalesce("_churn", F.lit(0.0)), F.coalesce("_jac", F.lit(0.0))
        cent = S.graph_signal(F.coalesce("indeg", F.lit(0)), F.coalesce("rank", F.lit(0.0)), F.col("_top"), F.col("_n"))
        layer, sure = S.infer_layer(F.col("module"), F.col("entry"))
        return out.select("module", "loc", F.coalesce("ccn", F.lit(0.0)).alias("ccn"), cent.alias("cent"), churn.alias("churn"), S.coupling_signal(F.coalesce("degree", F.lit(0)), jac).alias("coup"), layer.alias("layer"), sure.alias("layer_confidence"))

    def module_edges(self) -> DataFrame:
        e = self.edge_log.where("edge_type = 'IMPORTS'").select(F.substring("src", 6, 1 << 20).alias("src_file"), F.substring("dst", 6, 1 << 20).alias("dst_file"))
        return S.quotient_graph(e, self.files.select(F.col("relative_path").alias("file"), S.module_of(F.col("relative_path")).alias("module")))

    @cached_property
    def embedded(self) -> DataFrame:
        """The embeddings of all chunks, written once and read by every search."""
        named = self.chunks.withColumn("_t", V.embedding_text("relative_path", "symbol_name", "signature", "content"))
        path = f"{checkpoint_root(self.spark)}/chunk_embeddings_{uuid.uuid4().hex}"
        V.hash_embedding(named, "chunk_id", "_t").write.parquet(path)
        return self.spark.read.parquet(path)

    def search(self, query: str, top_k: int = 5, use_graph: bool = True, intent: str | None = None) -> DataFrame:
        """Chunks by hash embeddings, with neighbours in the graph."""
        docs = self.embedded
        q = self.spark.createDataFrame([("q", query)], "id string, text string")
        scores = V.sparse_scores(docs, V.hash_embedding(q, "id", "text")).select("id", "score")
        node = F.when(F.col("chunk_type") == "method", F.concat(F.lit("method:"), "relative_path", F.lit(":"), "symbol_name")).when(
            F.col("chunk_type").isin("class", "function"), F.concat("chunk_type", F.lit(":"), "relative_path", F.lit(":"), "symbol_name")
        )
        nodes = self.chunks.select("chunk_id", F.coalesce(node, C.file_id("relative_path")).alias("node")).dropDuplicates(["node"])
        if use_graph:
            kind = intent or self.spark.createDataFrame([(query,)], "q string").select(retrieval_kind(F.col("q"))).first()[0]
            by_chunk = self.edges.join(nodes.select(F.col("node").alias("src"), F.col("chunk_id").alias("_s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("chunk_id").alias("_d")), "dst")
            found = V.hybrid_search(scores, by_chunk.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "edge_type"), kind, V.HybridConfig(top_k=top_k))
        else:
            found = scores.orderBy(F.desc("score"), "id").limit(top_k)
        return found.join(self.chunks.withColumnRenamed("chunk_id", "id").drop("metadata"), "id").orderBy(F.desc("score"), "id")


def _rows(df: DataFrame, limit: int = 50) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def registry(ws: Workspace) -> ToolRegistry:
    """All tools; those whose tables are missing are deferred."""
    r = ToolRegistry()
    v, e = ws.vertices.drop("seq"), ws.edges
    start = lambda node: ws.spark.createDataFrame([(node,)], "root string")
    near = lambda node, types, direct, back: G.reach(e, start(node), 1 if direct else 20, types or G.DEPENDENCIES, incoming=back).drop("root").join(v.withColumnRenamed("id", "node"), "node")
    r.add("search_symbols", lambda query, node_type=None, limit=20: _rows(G.search_nodes(ws.vertices, query, node_type, limit).drop("seq"), limit), ("query",))
    r.add("get_node_details", lambda node_id: _rows(v.where(F.col("id") == node_id), 1), ("node_id",))
    r.add("get_file_content", lambda relative_path, start_line=None, end_line=None: _rows(safe_slice(ws.files, relative_path, start_line, end_line), 2000), ("relative_path",))
    r.add("get_callers", lambda node_id: _rows(G.neighbors(e, v, node_id)), ("node_id",))
    r.add("get_callees", lambda node_id: _rows(G.neighbors(e, v, node_id, incoming=False)), ("node_id",))
    r.add("get_dependencies", lambda node_id, edge_types=None, direct_only=True: _rows(near(node_id, edge_types, direct_only, False)), ("node_id",))
    r.add("get_dependents", lambda node_id, edge_types=None, direct_only=True: _rows(near(node_id, edge_types, direct_only, True)), ("node_id",))
    r.add("trace_structural_impact", lambda target_node_id, max_depth=3: _rows(G.trace_impact(e, v, target_node_id, max_depth if max_depth > 0 else 3).drop("root")), ("target_node_id",))
    r.add("detect_cycles", lambda edge_types=None, max_cycles=25: _rows(G.simple_cycles(e.where(F.col("edge_type").isin(*(edge_types or ("IMPORTS", "CALLS")))), 6, max_cycles)))
    r.add("semantic_search", lambda query, top_k=5: _rows(ws.search(query, top_k, False)), ("query",))
    r.add("hybrid_search", lambda query, top_k=5, use_graph=True, intent=None: _rows(ws.search(query, top_k, use_graph, intent)), ("query",))
    r.add("multi_signal_impact", lambda node_id, max_depth=3: impact(ws, node_id, max_depth), ("node_id",))
    r.add("get_test_coverage", lambda node_id, max_depth=3: _rows(tests_for(ws, node_id, max_depth)), ("node_id",))
    scored = lambda: S.hotspots(ws.modules().withColumn("sloc", F.col("loc")), "module")
    level = lambda c: S.layer_level(F.col(c))

    def conformance(strict_layering=False):
        m = ws.modules().select("module", "layer").where("layer <> 'UNCLASSIFIED'")
        rows = ws.module_edges().join(m.select(F.col("module").alias("src"), F.col("layer").alias("src_layer")), "src").join(m.select(F.col("module").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
        rows = rows.drop("weight").withColumn("src_level", level("src_layer")).withColumn("dst_level", level("dst_layer"))
        broken = S.violations(rows, S.Rules(strict=strict_layering))
        return _rows(S.conformance_index(rows, broken), 1) + _rows(broken)

    r.add("get_architecture_overview", lambda module_name="", layer_name="": _rows(ws.modules().where(F.contains("module", F.lit(module_name)) & F.contains("layer", F.lit(layer_name)))))
    r.add("check_architecture_conformance", conformance)
    r.add("detect_package_cycles", lambda max_length=6: _rows(G.simple_cycles(ws.module_edges().select("src", "dst"), max_length)))
    r.add("detect_maintenance_hotspots", lambda limit=10: _rows(scored().orderBy(F.desc("score"), F.desc("base_score"), "module"), limit))
    r.add("get_evidence_coverage", lambda: coverage(ws))
    if ws.commits is not None:
        r.add("git_commit_history", lambda path=None, limit=50, since=None, author=None: _rows(T.history(ws.commits, ws.changes, author, since, path, limit), limit))
        r.add("git_code_churn", lambda path=None, limit=20, min_changes=1, sort_by="commits": _rows(T.top_churn(T.churn(ws.commits, ws.changes), sort_by, limit, min_changes, path), limit))
        r.add("git_logical_coupling", lambda file_path, min_support=3, min_confidence=0.5, limit=20: _rows(T.couplings_of(ws.couplings, file_path, min_support, min_confidence, limit), limit), ("file_path",))
    else:
        for name in ("git_commit_history", "git_code_churn", "git_logical_coupling"):
            r.defer(name, "no history was read")
    return r


def tests_for(ws: Workspace, node: str, max_depth: int = 3) -> DataFrame:
    """Recommended tests of a node and of what depends on it."""
    v = ws.vertices.select(F.col("id").alias("node"), "name", "relative_path", "node_type")
    reached = C.blast_radius(ws.vertices, ws.edges, node, max_depth, False).select("node", F.least(F.col("depth"), F.lit(2)).alias("tier"))
    entities = reached.unionByName(ws.spark.createDataFrame([(node, 0)], "node string, tier int")).join(v, "node")
    entities = entities.where(~S.is_test_entity(F.col("node"), F.col("relative_path"), F.col("name")))
    tests = v.where(S.is_test_entity(F.col("node"), F.col("relative_path"), F.col("name"))).where("relative_path is not null")
    t = tests.select(F.col("node").alias("test"), F.col("name").alias("target"), F.col("relative_path").alias("test_file"), F.col("node_type").alias("kind"))
    e = ws.edges
    row = lambda df, kind, order: df.select("test_file", "target", F.lit(kind).alias("evidence_type"), "tier", F.lit(0.0).alias("jaccard"), F.lit(order).alias("order"))
    calls = entities.join(e.where("edge_type = 'CALLS'").select(F.col("dst").alias("node"), F.col("src").alias("test")), "node").join(t, "test")
    files = entities.withColumn("node", C.file_id("relative_path")).select("node", "tier").distinct()
    imports = files.join(e.where("edge_type = 'IMPORTS'").select(F.col("dst").alias("node"), F.col("src").alias("test")), "node").join(t, "test")
    names = entities.withColumn("want", F.concat(F.lit("test_"), F.lower("name"))).join(t.where("kind <> 'file'").withColumn("want", F.lower("target")), "want")
    mirrors = entities.select("tier", F.explode(S.mirror_names(F.col("relative_path"))).alias("target")).distinct().join(t.where("kind = 'file'"), "target")
    found = row(calls, "DIRECT_INVOCATION", 0).unionByName(row(imports, "DIRECT_IMPORT", 1)).unionByName(row(names, "HEURISTIC_NAMING", 2)).unionByName(row(mirrors, "HEURISTIC_MIRRORING", 3))
    if ws.couplings is not None:
        pairs = T.oriented(ws.couplings).where("jaccard >= 0.15").select(F.col("item").alias("relative_path"), F.col("other").alias("test_file"), "jaccard").where("lower(test_file) like '%test%'")
        both = entities.select("relative_path", "tier").distinct().join(pairs, "relative_path")
        found = found.unionByName(both.select("test_file", F.col("test_file").alias("target"), F.lit("HEURISTIC_CO_CHANGE").alias("evidence_type"), "tier", "jaccard", F.lit(4).alias("order")))
    return S.test_recommendations(found).orderBy("tier", F.desc("rank_score"), "test_file", "target")


def impact(ws: Workspace, node: str, max_depth: int = 3) -> list[dict]:
    """The impact score of one node with its signals."""
    reached = C.blast_radius(ws.vertices, ws.edges, node, max_depth)
    code_edges = ws.edges.where(F.col("edge_type").isin("CALLS", "INHERITS", "IMPORTS"))
    central = G.centrality(code_edges, ws.vertices.where("node_type <> 'commit'"), G.pagerank(code_edges.select("src", "dst"))).where(F.col("node") == node)
    tests = tests_for(ws, node, max_depth)
    path = (ws.vertices.where(F.col("id") == node).select("relative_path").first() or [None])[0]
    commits = changed = coupled = None
    if ws.commits is not None:
        commits = ws.commits.count()
        own = T.churn(ws.commits, ws.changes).where(F.col("path") == path).select("commit_frequency").first()
        changed = own[0] if own else 0
        coupled = T.oriented(ws.couplings, path).agg(F.max(F.col("jaccard") * F.col("confidence"))).first()[0] or 0.0
    ccn = (ws.complexity.where(F.col("relative_path") == path).select("max_complexity").first() or [1])[0]
    number = lambda x: F.lit(x).cast("double")
    row = reached.agg(F.count("*").alias("total_impacted")).withColumn("_k", F.lit(1))
    row = row.join(central.select("composite", F.lit(1).alias("_k")), "_k", "left").join(tests.agg(F.sum(F.col("rank_score") * S.tier_weight(F.col("tier"))).alias("exposure"), F.count("*").alias("tests"), F.lit(1).alias("_k")), "_k", "left")
    row = row.select(
        "total_impacted", "tests", S.s1_reachability(F.col("total_impacted")).alias("s1"), F.coalesce("composite", F.lit(0.0)).alias("s2"), S.s3_volatility(number(changed), number(commits)).alias("s3"),
        (number(coupled) if commits and commits >= 3 else number(None)).alias("s4"), S.s5_exposure(F.col("exposure")).alias("s5"), S.s6_complexity(number(ccn)).alias("s6"),
    )
    value, level = S.impact_confidence(number(commits or 0), F.lit(commits is not None), F.col("tests") > 0)
    return _rows(S.impact_score(row).withColumn("confidence", value).withColumn("confidence_level", level), 1)


def coverage(ws: Workspace) -> list[dict]:
    n = ws.complexity.agg(F.avg(F.col("is_valid").cast("double")).alias("ast")).first().ast or 0.0
    yes = lambda x: F.lit(1.0 if x else 0.0)
    has_class = not ws.edges.where("edge_type = 'INHERITS'").isEmpty()
    total, state, missing = S.evidence_coverage(
        ast=F.lit(float(n)), graph=yes(not ws.edges.isEmpty()), churn=yes(ws.changes is not None), temporal=yes(ws.couplings is not None and not ws.couplings.isEmpty()),
        structure=yes(not ws.edges.where("edge_type = 'IMPORTS'").isEmpty()), classes=yes(has_class),
    )
    return _rows(ws.spark.range(1).select(total.alias("coverage"), state.alias("state"), missing.alias("missing")), 1)
