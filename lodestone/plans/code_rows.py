"""Queries of the code operators over source files written from the rows of ``nation``, and the same in SQL.

Each nation is a Python module of a package for its region. It imports the class and the function of the next nation,
derives from the one and calls the other, so every kind of symbol, import and edge occurs and follows from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import code as C
from lodestone.operators import code_graph as K
from lodestone.operators import vector as V
from lodestone.plans.registry import _hash_sql, query
from lodestone.session import table

#: The lines of a module; k, r: nation and region, t, s: the next nation and its region, n: its name.
LINES = (
    '"""Module of {n}."""',
    "import os",
    "from region_{s}.nation_{t} import Nation{t}, serve_{t} as following",
    "",
    "class Nation{k}(Nation{t}):",
    "    def load(self, x):",
    "        return following(self.size())",
    "",
    "    @property",
    "    def size(self):",
    "        if {k} > 3 and {r} > 1:",
    "            return [x for x in range(3) if x]",
    "        return 0",
    "",
    "def serve_{k}(x, *rest, key=None):",
    "    while x:",
    "        x = Nation{k}()",
    "    return x",
)


def _of(line: str) -> str:
    """A line as an SQL expression."""
    out = "'" + line.replace("'", "''") + "'"
    for name in "krtsn":
        out = out.replace("{" + name + "}", f"' || {name} || '")
    return out.replace("'' || ", "").replace(" || ''", "")


def _text(first: int, last: int) -> str:
    """Lines of a module, from 1, as one SQL string."""
    return "(" + " || chr(10) || ".join(_of(x) for x in LINES[first - 1 : last]) + ")"


_NATIONS = """(select a.n_nationkey::varchar as k, a.n_regionkey::varchar as r, b.n_nationkey::varchar as t, b.n_regionkey::varchar as s, a.n_name as n,
    'src/region_' || a.n_regionkey || '/nation_' || a.n_nationkey || '.py' as path, 'src/region_' || b.n_regionkey || '/nation_' || b.n_nationkey || '.py' as next_path
    from nation a join nation b on b.n_nationkey = (a.n_nationkey + 1) % (select count(*) from nation))"""


def _values(rows: tuple[str, ...], names: str) -> str:
    """One select for each row of expressions, over the nations."""
    return " union all ".join(f"select {', '.join(f'{x} as {n}' for x, n in zip(r, names.split(), strict=True))} from m" for r in rows)


def files(spark, sf_dir: str) -> DataFrame:
    """relative_path, content, language, line_count of the modules."""
    n = table(spark, sf_dir, "nation")
    total = n.groupBy().agg(F.count("*").alias("total"))
    a = n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("n")).join(F.broadcast(total))
    b = n.select(F.col("n_nationkey").alias("t"), F.col("n_regionkey").alias("s"))
    rows = a.withColumn("t", ((F.col("k") + 1) % F.col("total")).cast("int")).join(b, "t")
    lines = []
    for line in LINES:
        x = F.lit(line)
        for name in "krtsn":
            if "{" + name + "}" in line:
                x = F.replace(x, F.lit("{" + name + "}"), F.col(name).cast("string"))
        lines.append(x)
    path = F.concat(F.lit("src/region_"), F.col("r"), F.lit("/nation_"), F.col("k"), F.lit(".py"))
    return rows.select(path.alias("relative_path"), F.concat_ws("\n", *lines).alias("content"), F.lit("python").alias("language"), F.lit(len(LINES)).cast("long").alias("line_count"))


def graph(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    return K.build(f, C.parse_symbols(f), C.parse_imports(f))


_SYMBOLS = (
    ("path", "'class'", "'Nation' || k", "null::varchar", "5", "13"),
    ("path", "'method'", "'load'", "'Nation' || k", "6", "7"),
    ("path", "'method'", "'size'", "'Nation' || k", "10", "13"),
    ("path", "'function'", "'serve_' || k", "null::varchar", "15", "18"),
)


@query(f"with m as {_NATIONS} " + _values(_SYMBOLS, "relative_path symbol_type name parent_name start_line end_line"))
def code_symbols(spark, sf_dir):
    return C.parse_symbols(files(spark, sf_dir)).select("relative_path", "symbol_type", "name", "parent_name", "start_line", "end_line")


@query(
    f"with m as {_NATIONS} "
    + _values(
        (
            ("path", "null::varchar", "'os'", "null::varchar", "false", "2", "'import os'"),
            ("path", "'region_' || s || '.nation_' || t", "'Nation' || t", "null::varchar", "true", "3", "'from region_' || s || '.nation_' || t || ' import Nation' || t"),
            ("path", "'region_' || s || '.nation_' || t", "'serve_' || t", "'following'", "true", "3", "'from region_' || s || '.nation_' || t || ' import serve_' || t || ' as following'"),
        ),
        "relative_path module name alias is_from line_number statement",
    )
)
def code_imports(spark, sf_dir):
    return C.parse_imports(files(spark, sf_dir)).select("relative_path", "module", "name", "alias", "is_from", "line_number", "statement")


@query(f"with m as {_NATIONS} select path as relative_path, true as is_valid, 'Module of ' || n || '.' as docstring, 1 as classes, 1 as functions, 2 as methods, 3 as imports from m")
def code_files(spark, sf_dir):
    return C.parse_files(files(spark, sf_dir)).select("relative_path", "is_valid", "docstring", "classes", "functions", "methods", "imports")


@query(
    f"with m as {_NATIONS} "
    + _values((("path", "'Nation' || k || '.load'", "6", "1"), ("path", "'Nation' || k || '.size'", "10", "5"), ("path", "'serve_' || k", "15", "2")), "relative_path symbol line complexity")
)
def code_complexity(spark, sf_dir):
    return C.symbol_complexity(files(spark, sf_dir))


def _chunk_sql(kind: str, name: str, parent: str, first: int, last: int) -> tuple[str, ...]:
    content = _text(first, last)
    said = f"path || ':{kind}:' || {name} || ':{first}-{last}:' || trim({content}, ' ' || chr(10))"
    return (f"substr(sha256({said}), 1, 16)", "path", f"'{kind}'", name, parent, str(first), str(last), content)


@query(
    f"with m as {_NATIONS} "
    + _values(
        (
            _chunk_sql("module_header", "'module:' || path", "null::varchar", 1, 3),
            _chunk_sql("class", "'Nation' || k", "null::varchar", 5, 5),
            _chunk_sql("method", "'Nation' || k || '.load'", "'Nation' || k", 6, 7),
            _chunk_sql("method", "'Nation' || k || '.size'", "'Nation' || k", 9, 13),
            _chunk_sql("function", "'serve_' || k", "null::varchar", 15, 18),
        ),
        "chunk_id relative_path chunk_type symbol_name parent_symbol start_line end_line content",
    )
)
def code_chunks(spark, sf_dir):
    return C.chunk_files(files(spark, sf_dir)).select("chunk_id", "relative_path", "chunk_type", "symbol_name", "parent_symbol", "start_line", "end_line", "content")


# --- the typed graph ----------------------------------------------------------------------------------------------------

_CLASS, _LOAD, _SIZE, _SERVE = "'class:' || path || ':Nation' || k", "'method:' || path || ':Nation' || k || '.load'", "'method:' || path || ':Nation' || k || '.size'", "'function:' || path || ':serve_' || k"
_NEXT_CLASS, _NEXT_SERVE = "'class:' || next_path || ':Nation' || t", "'function:' || next_path || ':serve_' || t"


@query(
    f"with m as {_NATIONS} "
    + _values(
        (
            ("'file:' || path", "'nation_' || k || '.py'", "'file'", "path", "1", str(len(LINES))),
            (_CLASS, "'Nation' || k", "'class'", "path", "5", "13"),
            (_LOAD, "'load'", "'method'", "path", "6", "7"),
            (_SIZE, "'size'", "'method'", "path", "10", "13"),
            (_SERVE, "'serve_' || k", "'function'", "path", "15", "18"),
        ),
        "id name node_type relative_path start_line end_line",
    )
)
def code_vertices(spark, sf_dir):
    return graph(spark, sf_dir)[0].select("id", "name", "node_type", "relative_path", "start_line", "end_line")


_CONTAINS = (("'file:' || path", _CLASS, "5"), (_CLASS, _LOAD, "6"), (_CLASS, _SIZE, "10"), ("'file:' || path", _SERVE, "15"))


@query(f"with m as {_NATIONS} " + _values(_CONTAINS, "src dst line_number"))
def code_contains(spark, sf_dir):
    return K.contains_edges(C.parse_symbols(files(spark, sf_dir))).select("src", "dst", "line_number")


@query(f"with m as {_NATIONS} " + _values((("path", "'os'", "null::varchar"), ("path", "'Nation' || t", "next_path"), ("path", "'serve_' || t", "next_path")), "relative_path name file"))
def code_resolved_imports(spark, sf_dir):
    f = files(spark, sf_dir)
    return K.resolve_imports(C.parse_imports(f), f).select("relative_path", "name", "file")


@query(f"with m as {_NATIONS} select 'file:' || path as src, 'file:' || next_path as dst, 3 as line_number, count(*) as n from m, (values (1), (2)) group by all")
def code_import_edges(spark, sf_dir):
    f = files(spark, sf_dir)
    return K.import_edges(K.resolve_imports(C.parse_imports(f), f)).groupBy("src", "dst", "line_number").agg(F.count("*").alias("n"))


@query(f"with m as {_NATIONS} select {_CLASS} as src, {_NEXT_CLASS} as dst, 'Nation' || t as detail from m")
def code_inherits(spark, sf_dir):
    f = files(spark, sf_dir)
    return K.inherits_edges(C.parse_symbols(f), K.resolve_imports(C.parse_imports(f), f)).select("src", "dst", "detail")


_CALLS = ((_LOAD, _NEXT_SERVE, "'following'"), (_LOAD, _SIZE, "'self.size'"), (_SERVE, _CLASS, "'Nation' || k"))


@query(f"with m as {_NATIONS} " + _values(_CALLS, "src dst detail"))
def code_calls(spark, sf_dir):
    return graph(spark, sf_dir)[1].where("edge_type = 'CALLS'").select("src", "dst", "detail")


@query(
    f"with m as {_NATIONS} "
    + _values((("path", "'os'", "'EXTERNAL_STDLIB'"), ("path", "'Nation' || t", "'INTERNAL'"), ("path", "'serve_' || t", "'INTERNAL'")), "relative_path name category")
)
def code_import_classes(spark, sf_dir):
    f = files(spark, sf_dir)
    return K.classify_imports(C.parse_imports(f), f, set()).select("relative_path", "name", "category")


_GRAPH = f"""m as materialized {_NATIONS}, edges as materialized (
    select src, dst, 'CONTAINS' as edge_type from ({_values(_CONTAINS, "src dst line_number")})
    union all select 'file:' || path, 'file:' || next_path, 'IMPORTS' from m
    union all select {_CLASS}, {_NEXT_CLASS}, 'INHERITS' from m
    union all select src, dst, 'CALLS' from ({_values(_CALLS, "src dst detail")})),
    start as (select {_SERVE} as node from m where k = '3'),
    seeds as (select node from start union select e.src from edges e join start on e.dst = node where e.edge_type = 'CONTAINS'),
    reached(node, depth) as (select node, 0 from seeds union select e.src, depth + 1 from reached r join edges e on e.dst = r.node where e.edge_type <> 'CONTAINS' and depth < 3)"""


@query(f"with recursive {_GRAPH} select node, min(depth)::int as depth from reached where node not in (select node from seeds) group by 1")
def code_blast_radius(spark, sf_dir):
    vertex, edges = graph(spark, sf_dir)
    target = vertex.where("name = 'serve_3'").first()["id"]
    return K.blast_radius(vertex, edges, target, 3, with_history=False).where("not array_contains(tags, 'CONTAINED_MEMBER')").select("node", "depth")


# --- grounded answers ---------------------------------------------------------------------------------------------------


@query(
    f"""with d as {_hash_sql('documents', 'doc_id')}, q as {_hash_sql('benchmark', 'item_id')},
    s as (select q.id as query_id, d.id, round(greatest(0, least(1, sum(d.weight * q.weight))), 6) as score from d join q using (idx) where q.id % 100 = 0 group by all),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s), t as (select * from r where rank <= 4),
    g as (select query_id, max(score) as best, count(*) as n_sources, 'd/' || arg_min(id, rank) || '.md:1-1' as first, coalesce('|d/' || max(case when rank = 2 then id end) || '.md:1-1', '') as second from t group by 1)
    select item_id as query_id, coalesce(best >= 0.15, false) as is_sufficient, coalesce(n_sources, 0) as n_sources, case when best >= 0.15 then first || second else '' end as citations
    from benchmark left join g on query_id = item_id where item_id % 100 = 0"""
)
def grounded_ask(spark, sf_dir):
    from lodestone.plans.ask import TOP_K, ask

    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0")
    scores = V.sparse_scores(V.hash_embedding(docs, "doc_id", "text"), V.hash_embedding(items, "item_id", "text")).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_K)
    found = best.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id").select(
        "query_id", "rank", "score", F.format_string("d/%d.md", "id").alias("relative_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("doc_section").alias("chunk_type"),
        F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("signature"), "content", F.lit(None).cast("string").alias("relationship"),
    )
    out = ask(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), found)
    return out.select("query_id", "is_sufficient", "n_sources", F.array_join("citations", "|").alias("citations"))
