"""Code as a typed graph: names are resolved by joins, the first match by priority wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOTS = ("", "src/", "lib/", "app/")
EDGE = ["src", "dst", "edge_type", "line_number", "detail", "seq"]


def file_id(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), F.col(path) if isinstance(path, str) else path)


def node_id() -> Column:
    """The id of a symbol: class:, method: or function:, its file, and its name within the file."""
    inner = F.when(F.col("symbol_type") == "method", F.concat("parent_name", F.lit("."), "name")).otherwise(F.col("name"))
    return F.concat("symbol_type", F.lit(":"), "relative_path", F.lit(":"), inner)


def vertices(files: DataFrame, symbols: DataFrame) -> DataFrame:
    f = files.select(
        file_id("relative_path").alias("id"), F.element_at(F.split("relative_path", "/"), -1).alias("name"), F.lit("file").alias("node_type"), "relative_path",
        F.lit(1).alias("start_line"), F.col("line_count").cast("int").alias("end_line"), "language", F.lit(None).cast("string").alias("class_name"),
    )
    s = symbols.select(
        node_id().alias("id"), "name", F.col("symbol_type").alias("node_type"), "relative_path", "start_line", "end_line", F.lit("python").alias("language"), F.col("parent_name").alias("class_name")
    )
    out = f.unionByName(s).dropDuplicates(["id"])
    return out.withColumn("seq", F.struct("relative_path", F.coalesce("start_line", F.lit(0)).alias("start_line"), "id"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    parent = F.when(F.col("symbol_type") == "method", F.concat(F.lit("class:"), "relative_path", F.lit(":"), "parent_name")).otherwise(file_id("relative_path"))
    return symbols.select(parent.alias("src"), node_id().alias("dst"), F.lit("CONTAINS").alias("edge_type"), F.col("start_line").alias("line_number"), F.lit(None).cast("string").alias("detail"))


def modules(files: DataFrame) -> DataFrame:
    """(module, file, full): dotted names of each Python file and their suffixes; a package's __init__ stands for it."""
    dotted = F.replace(F.regexp_replace(F.regexp_replace("relative_path", r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))
    parts = F.split("dotted", r"\.")
    rows = files.where("language = 'python'").select("relative_path", dotted.alias("dotted")).select("relative_path", "dotted", F.posexplode(parts).alias("k", "_p"), parts.alias("parts"))
    rows = rows.select("relative_path", F.array_join(F.slice("parts", F.col("k") + 1, 1000), ".").alias("module"), (F.col("k") == 0).alias("full"))
    # A full name beats a suffix; of suffixes the first file wins.
    w = Window.partitionBy("module").orderBy(F.desc("full"), "relative_path")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("module", F.col("relative_path").alias("file"), "full")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with ``file``: the file that each reaches, NULL for others.

    Relative imports go up from their file; then module, module.name and name are tried in this order.
    """
    known = modules(files)
    own = F.array_remove(F.split(F.regexp_replace("relative_path", r"/?[^/]*$", ""), "/"), "")
    bare = F.regexp_replace(F.coalesce("module", F.lit("")), r"^\.+", "")
    up = F.slice(own, F.lit(1), F.greatest(F.size(own) - F.col("level") + 1, F.lit(0)))
    base = F.array_join(F.array_compact(F.array(F.array_join(up, "."), bare)), ".")
    base = F.regexp_replace(F.regexp_replace(base, r"^\.+|\.+$", ""), r"\.{2,}", ".")
    first = F.when(F.col("level") > 0, base).when(F.col("is_from"), bare).otherwise(F.col("name"))
    both = F.concat(first, F.when(first == "", "").otherwise("."), "name")
    tried = F.when(F.col("is_from"), F.array(both, first)).otherwise(F.array(first))
    # from a import b: the module itself holds b unless b is a file of its own below it.
    rows = imports.withColumn("_id", F.xxhash64("relative_path", "line_number", "name", F.coalesce("module", F.lit("")))).withColumn("_tried", tried)
    asked = rows.select("_id", F.posexplode("_tried").alias("_k", "module")).where("module <> ''")
    found = asked.join(known.select("module", "file"), "module").groupBy("_id").agg(F.min_by("file", "_k").alias("file"))
    return rows.join(found, "_id", "left").drop("_id", "_tried")


def import_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("file is not null and file <> relative_path").select(
        file_id("relative_path").alias("src"), file_id("file").alias("dst"), F.lit("IMPORTS").alias("edge_type"), "line_number", F.col("statement").alias("detail")
    )


def inherits_edges(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """A class to each base: of its own file, of an imported file, or the only class of that name."""
    classes = symbols.where("symbol_type = 'class'").select(node_id().alias("id"), "name", "relative_path", "start_line", "bases")
    asked = classes.select("id", "relative_path", "start_line", F.explode("bases").alias("base")).withColumn("want", F.element_at(F.split("base", r"\."), -1))
    at = classes.select(F.col("id").alias("to"), F.col("name").alias("want"), F.col("relative_path").alias("file"))
    local = asked.join(at.withColumnRenamed("file", "relative_path"), ["want", "relative_path"]).withColumn("k", F.lit(0))
    reach = resolved.where("file is not null").select("relative_path", "file").distinct()
    imported = asked.join(reach, "relative_path").join(at, ["want", "file"]).drop("file").withColumn("k", F.lit(1))
    single = at.groupBy("want").agg(F.count("*").alias("n"), F.min("to").alias("to")).where("n = 1").drop("n")
    anywhere = asked.join(single, "want").withColumn("k", F.lit(2))
    found = local.unionByName(imported).unionByName(anywhere).where("to <> id").groupBy("id", "base").agg(F.min_by(F.struct("to", "start_line"), F.struct("k", "to")).alias("x"))
    return found.select(F.col("id").alias("src"), F.col("x.to").alias("dst"), F.lit("INHERITS").alias("edge_type"), F.col("x.start_line").alias("line_number"), F.col("base").alias("detail"))


def calls_edges(symbols: DataFrame, resolved: DataFrame, inherits: DataFrame) -> DataFrame:
    """A function to each function or class that it calls."""
    named = symbols.select(node_id().alias("to"), "name", "symbol_type", "relative_path", "parent_name")
    asked = symbols.where("symbol_type <> 'class'").select(node_id().alias("id"), "relative_path", "parent_name", F.explode("calls").alias("call"))
    parts = F.split("call", r"\.")
    asked = asked.withColumn("p", parts).withColumn("want", F.element_at("p", -1)).withColumn("n", F.size("p"))
    mine = asked.where("n = 2 and p[0] in ('self', 'cls') and parent_name is not null")
    methods = named.where("symbol_type = 'method'")
    own = mine.join(methods.select("to", F.col("name").alias("want"), "relative_path", "parent_name"), ["want", "relative_path", "parent_name"]).withColumn("k", F.lit(0))
    bases = inherits.select(F.col("src").alias("_c"), F.col("dst").alias("_b"))
    of_class = methods.select("to", F.col("name").alias("want"), F.concat(F.lit("class:"), "relative_path", F.lit(":"), "parent_name").alias("_b"))
    above = mine.withColumn("_c", F.concat(F.lit("class:"), "relative_path", F.lit(":"), "parent_name")).join(bases, "_c").join(of_class, ["_b", "want"]).drop("_b", "_c").withColumn("k", F.lit(1))
    bare = asked.where("n = 1")
    local = bare.join(named.select("to", F.col("name").alias("want"), "relative_path"), ["want", "relative_path"]).withColumn("k", F.lit(2))
    top = named.where("symbol_type <> 'method'")
    reach = resolved.where("file is not null").select("relative_path", "file", F.coalesce("alias", "name").alias("want"), F.col("name").alias("real")).distinct()
    imported = bare.join(reach, ["relative_path", "want"]).join(top.select("to", F.col("name").alias("real"), F.col("relative_path").alias("file")), ["real", "file"]).drop("real", "file").withColumn("k", F.lit(3))

    def single(kind: str, k: int) -> DataFrame:
        one = named.where(F.col("symbol_type") == kind).groupBy(F.col("name").alias("want")).agg(F.count("*").alias("_n"), F.min("to").alias("to")).where("_n = 1").drop("_n")
        return (asked.where("n = 2 and p[0] not in ('self', 'cls')") if kind == "method" else bare).join(one, "want").withColumn("k", F.lit(k))

    dotted = asked.where("n = 2 and p[0] not in ('self', 'cls')").withColumn("_q", F.col("p")[0])
    qualified = dotted.join(methods.groupBy(F.col("name").alias("want"), F.col("parent_name").alias("_q")).agg(F.max("to").alias("to")), ["want", "_q"]).drop("_q").withColumn("k", F.lit(6))
    rows = None
    for part in (own, above, local, imported, single("function", 4), single("class", 5), qualified, single("method", 7)):
        part = part.select("id", "call", "to", "k")
        rows = part if rows is None else rows.unionByName(part)
    found = rows.groupBy("id", "call").agg(F.min_by("to", F.struct("k", "to")).alias("to")).where("to <> id")
    return found.select(F.col("id").alias("src"), F.col("to").alias("dst"), F.lit("CALLS").alias("edge_type"), F.lit(None).cast("int").alias("line_number"), F.col("call").alias("detail"))


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edge log); seq is the order in which edges of a pair overwrite each other."""
    resolved = resolve_imports(imports, files)
    inherits = inherits_edges(symbols, resolved)
    parts = [contains_edges(symbols), import_edges(resolved), inherits, calls_edges(symbols, resolved, inherits)]
    log = None
    for k, part in enumerate(parts):
        part = part.withColumn("seq", F.lit(k) * 1_000_000 + F.coalesce("line_number", F.lit(0)))
        log = part if log is None else log.unionByName(part)
    return vertices(files, symbols), log.select(*EDGE)


def temporal(vertex: DataFrame, edges: DataFrame, commits: DataFrame, changes: DataFrame, couplings: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Commit nodes and CHANGED_IN edges of the newest commits, and CO_CHANGED_WITH both ways where no edge stands."""
    newest = commits.orderBy("seq").limit(limit)
    cid = F.concat(F.lit("commit:"), "full_hash")
    none = F.lit(None)
    nodes = newest.select(cid.alias("id"), F.col("short_hash").alias("name"), F.lit("commit").alias("node_type"), none.cast("string").alias("relative_path"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("language"), none.cast("string").alias("class_name"))
    touched = changes.join(newest.select("full_hash"), "full_hash", "left_semi")
    changed = touched.select(file_id("path").alias("src"), cid.alias("dst"), F.lit("CHANGED_IN").alias("edge_type"), none.cast("int").alias("line_number"), F.col("status").alias("detail"))
    pairs = couplings.select(F.explode(F.array(F.struct(F.col("item_a").alias("a"), F.col("item_b").alias("b")), F.struct(F.col("item_b").alias("a"), F.col("item_a").alias("b")))).alias("x"), "jaccard")
    together = pairs.select(file_id(F.col("x.a")).alias("src"), file_id(F.col("x.b")).alias("dst"), F.lit("CO_CHANGED_WITH").alias("edge_type"), none.cast("int").alias("line_number"), F.col("jaccard").cast("string").alias("detail"))
    new = changed.unionByName(together).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").withColumn("seq", F.lit(9_000_000)).select(*EDGE)
    path = F.substring("id", 6, 1 << 20)
    old = new.where("src like 'file:%'").select(F.col("src").alias("id")).distinct().join(vertex.select("id"), "id", "left_anti")
    gone = old.select("id", F.element_at(F.split(path, "/"), -1).alias("name"), F.lit("file").alias("node_type"), path.alias("relative_path"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("language"), none.cast("string").alias("class_name"))
    more = nodes.unionByName(gone).withColumn("seq", F.struct(F.coalesce("relative_path", F.lit("~")).alias("relative_path"), F.lit(0).alias("start_line"), F.col("id").alias("id")))
    return vertex.unionByName(more), edges.unionByName(new)


def blast_radius(vertex: DataFrame, edges: DataFrame, target: str, max_depth: int = 3, with_history: bool = True) -> DataFrame:
    """(node, depth, relationship, path, tags, node_type, name) of what a change of the target reaches.

    Members of a file or class go with it; a symbol's file stands for it to importers; history is one step, never more.
    """
    from lodestone.operators.graph import reach

    spark = edges.sparkSession
    code = edges.where(F.col("edge_type").isin("CALLS", "INHERITS", "IMPORTS")).select("src", "dst", "edge_type").distinct()
    start = spark.createDataFrame([(target,)], "root string")
    inside = reach(edges, start, 2, ["CONTAINS"])
    parents = reach(edges, start, 2, ["CONTAINS"], incoming=True).where("node like 'file:%'")
    seeds = start.select(F.col("root").alias("node")).union(inside.select("node")).union(parents.select("node")).distinct()
    found = reach(code, seeds.select(F.col("node").alias("root")), max_depth, incoming=True)
    found = found.join(seeds, "node", "left_anti").groupBy("node").agg(F.min_by(F.struct("depth", "relationship", "path"), F.struct("depth", "root")).alias("x")).select("node", "x.*")
    tag = (
        F.when((F.col("relationship") == "CALLS") & (F.col("depth") == 1), "DIRECT_CALLER").when(F.col("relationship") == "CALLS", "TRANSITIVE_CALLER")
        .when(F.col("relationship") == "INHERITS", "SUBCLASS").otherwise("COARSE_FILE_DEPENDENT")
    )
    found = found.withColumn("tags", F.array(tag))
    members = inside.select("node", F.lit(1).alias("depth"), F.lit("CONTAINS").alias("relationship"), "path", F.array(F.lit("CONTAINED_MEMBER")).alias("tags"))
    out = found.unionByName(members)
    if with_history:
        files = seeds.where("node like 'file:%'").select(F.col("node").alias("src"))
        near = edges.where("edge_type = 'CO_CHANGED_WITH'").join(files, "src").select(F.col("dst").alias("node"), F.lit(1).alias("depth"), F.lit("CO_CHANGED_WITH").alias("relationship"), F.array("src", "dst").alias("path"), F.array(F.lit("TEMPORAL_COUPLING")).alias("tags"))
        near = near.dropDuplicates(["node"]).join(out.select("node"), "node", "left_anti").join(seeds, "node", "left_anti")
        out = out.unionByName(near)
    return out.join(vertex.select(F.col("id").alias("node"), "node_type", "name", "relative_path"), "node", "left").orderBy("depth", "name", "node")


def resolve_target(vertex: DataFrame, target: str) -> dict:
    """One node by id, file path or its end, file::Symbol[::method], or a bare name; LookupError with what is near otherwise."""
    t = target.replace("\\", "/").strip()
    for stage, condition in (
        ("id", F.col("id") == t),
        ("path", (F.col("node_type") == "file") & (F.col("relative_path") == t)),
        ("path_end", (F.col("node_type") == "file") & F.endswith("relative_path", F.lit("/" + t.lstrip("/")))),
    ):
        if rows := vertex.where(condition).orderBy("seq").limit(1).collect():
            return rows[0].asDict() | {"resolution_method": stage}
    if "::" in t:
        path, _, inner = t.partition("::")
        want = inner.replace("::", ".")
        rows = vertex.where(F.endswith("relative_path", F.lit(path)) & F.endswith("id", F.lit(":" + want))).orderBy("seq").limit(2).collect()
    else:
        rows = vertex.where((F.col("name") == t) | F.endswith("id", F.lit(":" + t))).orderBy("seq").limit(2).collect()
    if len(rows) == 1:
        return rows[0].asDict() | {"resolution_method": "symbol" if "::" in t else "name"}
    if rows:
        raise LookupError(f"{target} is ambiguous: {', '.join(r.id for r in rows)}")
    near = vertex.select("name").distinct().withColumn("d", F.levenshtein("name", F.lit(t))).where(F.col("d") <= F.greatest(F.length("name"), F.lit(len(t))) / 2)
    raise LookupError(f"{target} is not known; near: {[r.name for r in near.orderBy('d', 'name').limit(3).collect()]}")


#: Modules whose distribution has another name.
DISTRIBUTIONS = {
    "yaml": "pyyaml", "sklearn": "scikit-learn", "bs4": "beautifulsoup4", "pil": "pillow", "cv2": "opencv-python", "dotenv": "python-dotenv", "dateutil": "python-dateutil",
    "jwt": "pyjwt", "psycopg2": "psycopg2-binary", "git": "gitpython",
}


def classify_imports(imports: DataFrame, files: DataFrame, manifest: set[str]) -> DataFrame:
    """imports with ``file`` and ``category``: internal, of the standard library, of the manifest, unresolved or unknown."""
    import sys

    top = F.split(F.regexp_replace(F.coalesce("module", "name"), r"^\.+", ""), r"\.")[0]
    packages = files.where("language = 'python'").select(F.split("relative_path", "/")[0].alias("_top")).where("_top not like '%.py'").distinct()
    rows = resolve_imports(imports, files).withColumn("_t", top).join(packages.withColumn("_own", F.lit(True)), F.col("_t") == F.col("_top"), "left")
    plain = F.lower(F.regexp_replace("_t", r"[-_.]+", "-"))
    dist = F.coalesce(F.create_map(*[F.lit(x) for pair in DISTRIBUTIONS.items() for x in pair])[plain], plain)
    stdlib = F.array(*[F.lit(x) for x in sorted(sys.stdlib_module_names)])
    category = (
        F.when(F.col("file").isNotNull(), "INTERNAL").when((F.col("level") == 0) & F.array_contains(stdlib, F.col("_t")), "EXTERNAL_STDLIB")
        .when((F.col("level") == 0) & (dist.isin(*(sorted(manifest) or [""])) | plain.isin(*(sorted(manifest) or [""]))), "EXTERNAL_MANIFEST")
        .when((F.col("level") > 0) | F.col("_own"), "UNRESOLVED_INTERNAL").otherwise("EXTERNAL_UNKNOWN")
    )
    return rows.withColumn("category", category).drop("_t", "_top", "_own")
