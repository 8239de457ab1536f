"""Vectors: exact top-k search, hash embeddings, hybrid vector and graph retrieval, and retrieval metrics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [0, 1]; 0 where a norm is 0."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(F.lit(0.0))


def matching(df: DataFrame, filters: dict[str, str] | None, metadata: str | None = None) -> DataFrame:
    """Rows whose column, or entry of the metadata map, equals each value."""
    for key, value in (filters or {}).items():
        own = F.col(key) == F.lit(value) if key in df.columns else F.lit(False)
        inside = F.coalesce(F.col(metadata)[key] == F.lit(str(value)), F.lit(False)) if metadata else F.lit(False)
        df = df.where(F.coalesce(own, F.lit(False)) | inside)
    return df


def top_k(store: DataFrame, query: list[float], k: int = 5, id_col: str = "id", vector: str = "embedding", filters: dict | None = None, metadata: str | None = None) -> DataFrame:
    """The k most similar rows with score and rank; filters come before scoring, ties go by id."""
    if not query or not any(query):
        return store.limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = matching(store, filters, metadata).withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), id_col).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # k rows


#: The weights of about so many queries of 64 dimensions are sent to every task; more are taken in blocks of this size.
QUERY_BLOCK = 2000


def _blocks(queries: DataFrame, query_id: str, rows: int) -> list[DataFrame]:
    """queries in blocks of about so many rows; the rows of a query stay together."""
    n = -(-queries.count() // rows)
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i) for i in range(n)]


#: Up to so many bytes of query vectors are held by the driver and sent to all tasks at once; more are taken in turns, each written below spark.checkpoint.dir.
QUERY_BYTES = 32 << 20
#: Store rows and query rows that are multiplied together, so that their scores stay in a processor's cache; queries that one message is for.
STORE_TILE, QUERY_TILE, MESSAGE = 1024, 256, 512


def top_k_each(store: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_id: str = "query_id", vector: str = "embedding", drop_self: bool = False, digits: int = 9) -> DataFrame:
    """The k most similar rows for each of the queries (query_id, query): (query_id, id, score, rank); scores that are equal in so many digits go by id.

    Every query meets every row of the store: vectors are multiplied as matrices of floats, and what may be among the best by
    their bound of error is scored in doubles. A row whose length is not the query's scores 0, as does one without length.
    """
    from lodestone.session import checkpoint_root

    found, spark = [], store.sparkSession
    queries = queries.select(F.col(query_id).alias("_q"), F.col("query").alias("_v"))
    if drop_self:
        store, queries = store.where(F.col(id_col).isNotNull()), queries.where("_q is not null")
    size = queries.agg(F.sum(F.greatest(F.lit(1), F.size("_v")))).first()
    turns = max(1, -(-8 * (size[0] or 0) // QUERY_BYTES))
    folder = f"{checkpoint_root(spark)}/top_k_{uuid.uuid4().hex}" if turns > 1 else ""
    for i in range(turns):
        block = queries.where(F.pmod(F.xxhash64("_q"), F.lit(turns)) == i) if turns > 1 else queries
        best = _top_k_block(store.select(F.col(id_col).alias("id"), F.col(vector).alias("_v")), block, k, drop_self, digits).withColumnRenamed("_q", query_id)
        if turns > 1:
            best.write.parquet(f"{folder}/{i}")
            best = spark.read.parquet(f"{folder}/{i}")
        found.append(best)
    return reduce(DataFrame.unionByName, found)


def _matrix(column, dimension: int) -> np.ndarray:
    """The vectors of an Arrow column of lists as rows of doubles, zeros for those of another length; elements that are null are 0."""
    import pyarrow.compute as pc

    good = pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(good), dimension))
    out[good] = pc.fill_null(pc.list_flatten(column.filter(good)), 0).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return out


def _units(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return (x / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids; None comes first."""
    if ids.dtype.kind == "i":
        return ids
    out, known = np.zeros(len(ids), np.int64), np.array([x is not None for x in ids], bool)
    out[known] = np.unique(ids[known], return_inverse=True)[1] + 1
    return out


def _nth(*keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by keys: which of its key each is, from 0."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys]) if n else False
    start = np.flatnonzero(new)
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


class _Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, names: np.ndarray, vectors: list, k: int, drop_self: bool, digits: int):
        self.names, self.k, self.drop, self.digits = names, k, drop_self, digits
        self.groups = vectors
        self.held = [(np.zeros(0, np.int64), names[:0], np.zeros(0)) for _ in vectors]
        self.least = [np.full(len(v), -np.inf) for _, v in vectors]

    def add(self, ids: np.ndarray, column) -> None:
        """Rows of the store, which come in any order."""
        for g, (rows, v) in enumerate(self.groups):
            x = _matrix(column, v.shape[1])
            # Of equal vectors only the first by id can be among the best; a query may leave out those with its own id.
            _, same = np.unique(x.view(f"V{8 * x.shape[1]}").ravel() if x.shape[1] else np.zeros(len(x)), return_inverse=True)
            code = _codes(ids)
            order = np.lexsort([code, same])
            order = order[_nth(same[order], code[order]) < self.k]
            order = order[_nth(same[order]) < 2 * self.k]
            order = order[np.argsort(code[order], kind="stable")]
            self._meet(g, rows, v, ids[order], x[order])

    def _meet(self, g: int, rows: np.ndarray, v: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        first = np.flatnonzero(_nth(_codes(ids)) < self.k)[: 2 * self.k]
        a, b = _units(v), _units(x)
        # Twice the error of a sum of floats, and what rounding hides.
        slack = np.float32((v.shape[1] + 16) * 2.0**-22 + 2 * 10.0**-self.digits)
        n, at, width = len(ids), 0, min(STORE_TILE, max(64, 8 * self.k))
        while at < n:
            stop = min(n, at + width)
            least, near, place = self.least[g], [], []
            for q in range(0, len(v), QUERY_TILE):
                s = a[q : q + QUERY_TILE] @ b[at:stop].T
                low = least[q : q + QUERY_TILE].copy()
                open_ = np.flatnonzero(np.isneginf(low))
                if len(open_) and stop - at > 2 * self.k:
                    # The k-th best of this tile, without rows of the query's own id; these queries have fewer than k rows so far.
                    t = s[open_]
                    if self.drop:
                        t[self.names[rows[q + open_]][:, None] == ids[None, at:stop]] = -np.inf
                    low[open_] = np.partition(t, stop - at - self.k, axis=1)[:, stop - at - self.k]
                # What is below 0 counts as 0, and of zeros the first by id are the best.
                low = np.where(low - slack > 0, low - slack, np.where(np.isneginf(low), -np.inf, -slack)).astype(np.float32)
                i, j = np.divmod(np.flatnonzero((s >= low[:, None]).ravel()), stop - at)
                near.append(i + q)
                place.append(j + at)
                zero = np.flatnonzero(low < 0)
                here = first[(first >= at) & (first < stop)]
                near.append(np.repeat(zero + q, len(here)))
                place.append(np.tile(here, len(zero)))
            self._keep(g, rows, v, ids, x, np.concatenate(near), np.concatenate(place))
            at, width = stop, min(STORE_TILE, 2 * width)

    def _keep(self, g: int, rows, v, ids, x, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        pair = np.unique(i * len(ids) + j)
        i, j = pair // len(ids), pair % len(ids)
        if self.drop:
            other = self.names[rows[i]] != ids[j]
            i, j = i[other], j[other]
        score = np.empty(len(i))
        for c in range(0, len(i), 1 << 16):
            p, q = v[i[c : c + (1 << 16)]], x[j[c : c + (1 << 16)]]
            length = np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q))
            score[c : c + (1 << 16)] = np.clip(np.einsum("ij,ij->i", p, q) / np.where(length > 0, length, 1), 0, 1)
        old_i, old_id, old_score = self.held[g]
        touched = np.zeros(len(v), bool)
        touched[i] = True
        move = touched[old_i]
        i, ids, score = (np.concatenate(pair) for pair in ((old_i[move], i), (old_id[move], ids[j]), (old_score[move], score)))
        i, ids, score, nth = _ranked(i, ids, score, self.k, self.digits)
        self.held[g] = tuple(np.concatenate(pair) for pair in ((old_i[~move], i), (old_id[~move], ids), (old_score[~move], score)))
        full = nth == self.k - 1
        self.least[g][i[full]] = score[full]

    def rows(self):
        """(row of the query, id, score)."""
        parts = [(rows[i], ids, score) for (rows, _), (i, ids, score) in zip(self.groups, self.held, strict=True)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ranked(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, digits: int):
    """The k best of each group in their order, and which of its group each is."""
    order = np.lexsort([_codes(ids), -np.floor(score * 10.0**digits + 0.5), group])
    nth = _nth(group[order])
    order, nth = order[nth < k], nth[nth < k]
    return group[order], ids[order], score[order], nth


def _top_k_block(store: DataFrame, queries: DataFrame, k: int, drop_self: bool, digits: int) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = store.sparkSession
    asked = queries.toArrow()
    # Rows of one query_id are one query.
    name = asked.column("_q").combine_chunks()
    slot = pc.rank(name, tiebreaker="dense").to_numpy().astype(np.int64) - 1 if len(name) else np.zeros(0, np.int64)
    vectors = asked.column("_v").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    integral = lambda kind: pa.types.is_integer(kind)
    whole = drop_self and integral(name.type) and store.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    plain = lambda column: column.to_numpy(zero_copy_only=False).astype(np.int64) if whole else np.array([*column.to_pylist(), None], object)[:-1]
    groups = [(np.flatnonzero(sizes == d), vectors.filter(pa.array(sizes == d))) for d in np.unique(sizes)]
    sent = spark.sparkContext.broadcast((plain(name), slot, [(rows, _matrix(v, int(sizes[rows[0]])).astype(np.float64)) for rows, v in groups]))
    id_type, name_type = (df.schema[c].dataType.simpleString() for df, c in ((store, "id"), (queries, "_q")))
    message = f"part int, slots array<bigint>, ids array<{id_type}>, scores array<double>"

    def search(batches):
        names, slots, groups = sent.value
        best, waiting, n, kind = _Best(names, groups, k, drop_self, digits), [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                waiting.append(part)
                n += part.num_rows
                if n >= 8192:
                    best.add(*taken(waiting))
                    waiting, n = [], 0
        if waiting:
            best.add(*taken(waiting))
        if kind is None or not len(names):
            return
        row, ids, score = best.rows()
        order = np.argsort(slots[row], kind="stable")
        of, ids, score = slots[row][order], ids[order], score[order]
        ends = np.searchsorted(of, np.arange(0, int(slots.max()) + MESSAGE + 1, MESSAGE))
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if b > a:
                lists = [pa.array([x], pa.list_(t)) for x, t in ((of[a:b], pa.int64()), (ids[a:b].tolist(), kind), (score[a:b], pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *lists], names=["part", "slots", "ids", "scores"])

    def taken(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        return plain(rows.column(0).combine_chunks()), rows.column(1).combine_chunks()

    def merge(rows: pa.Table) -> pa.Table:
        names, slots, _ = sent.value
        flat = [pc.list_flatten(rows.column(c)).combine_chunks() for c in ("slots", "ids", "scores")]
        of, ids, score, nth = _ranked(flat[0].to_numpy(), plain(flat[1]), flat[2].to_numpy(), k, digits)
        first = np.empty(int(slots.max()) + 1, np.int64)
        first[slots] = np.arange(len(slots))
        return pa.table({"_q": pa.array(names[first[of]].tolist(), queries_type), "id": pa.array(ids.tolist(), flat[1].type), "score": score, "rank": pa.array(nth + 1, pa.int32())})

    queries_type = name.type
    # Few bytes, much work: rows are dealt to all cores, whatever files they come from.
    dealt = store.repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(search, message).groupBy("part").applyInArrow(merge, f"_q {name_type}, id {id_type}, score double, rank int")


def embedding_text(path: str, symbol: str, signature: str, content: str) -> Column:
    """The text that a chunk is embedded by."""
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"# {name}: "), F.col(c), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.concat(F.lit("# File: "), F.col(path), F.lit("\n")), part("Symbol", symbol), part("Signature", signature), F.col(content))


def hash_embedding(texts: DataFrame, id_col: str, text: str, dimension: int = 64) -> DataFrame:
    """Long form (id, idx, weight) of unit vectors: words hashed to dimensions by MD5, weighted 1 + ln(1 + length).

    dimension: a power of two of at most 65,536. A text without words is the first axis.
    """
    words = F.explode_outer(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    clean = F.regexp_replace("w", r"[^\p{L}\p{N}_]", "")
    rows = texts.select(F.col(id_col).alias("id"), words.alias("w")).select("id", clean.alias("w"))
    used = rows.where("w <> ''").select(
        "id", (F.conv(F.right(F.md5("w"), F.lit(4)), 16, 10).cast("int") % dimension).alias("idx"), (1 + F.log(1 + F.length("w").cast("double"))).alias("x")
    )
    sums = used.groupBy("id", "idx").agg(F.sum("x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    found = sums.select("id", "idx", (F.col("x") / length).alias("weight"))
    bare = texts.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}_]", "").alias("w")).where("w = ''")
    return found.unionByName(bare.select("id", F.lit(0).alias("idx"), F.lit(1.0).alias("weight")))


def sparse_scores(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosines of two long-form tables of unit vectors: (query_id, id, score); equi-join on the dimension, by blocks of queries."""
    q = queries.select(F.col("id").alias("query_id"), "idx", F.col("weight").alias("wq"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("wq")))).alias("score")
    found = [documents.join(F.broadcast(block), "idx").groupBy("query_id", "id").agg(score) for block in _blocks(q, "query_id", 64 * QUERY_BLOCK)]
    return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class HybridConfig:
    top_k: int = 5
    alpha: float = 0.6
    gamma: float = 0.7
    per_seed: int = 3
    weights: tuple = (("CALLS", 1.0), ("INHERITS", 0.85), ("IMPORTS", 0.5), ("CONTAINS", 0.4))

    @property
    def pool(self) -> int:
        return max(20, 2 * self.top_k)

    @property
    def seeds(self) -> int:
        return max(2, min(self.top_k, 4))

    @property
    def limit(self) -> int:
        return min(self.top_k, 6)

    @property
    def min_seeds(self) -> int:
        return max(1, round(self.limit * 0.5))


#: Directions of expansion and their order of precedence, for each kind of question.
EXPANSIONS = {
    "flow": (("out", "CALLS"), ("out", "INHERITS"), ("out", "CONTAINS"), ("out", "IMPORTS")),
    "impact": (("in", "CALLS"), ("in", "INHERITS"), ("in", "IMPORTS")),
    "general": (("out", "CALLS"), ("out", "INHERITS"), ("out", "CONTAINS"), ("in", "CONTAINS")),
}


def expand(seeds: DataFrame, edges: DataFrame, kind: str, config: HybridConfig = HybridConfig()) -> DataFrame:
    """(seed, node, relationship, hop, graph_score): neighbours of seeds (seed, score), the first relationship of a node wins."""
    weights = dict(config.weights)
    parts = []
    step = seeds.select("seed", F.col("score").alias("_s"))
    for order, (way, relation) in enumerate(EXPANSIONS[kind]):
        a, b = ("src", "dst") if way == "out" else ("dst", "src")
        e = edges.where(F.col("edge_type") == relation).select(F.col(a).alias("seed"), F.col(b).alias("node"))
        parts.append(step.join(e, "seed").select("seed", "node", "_s", F.lit(relation).alias("relationship"), F.lit(1).alias("hop"), F.lit(order).alias("_order"), F.lit(weights[relation]).alias("_w")))
    if kind == "flow":
        e = edges.where("edge_type = 'CALLS'")
        first = e.select(F.col("src").alias("seed"), F.col("dst").alias("_via"))
        second = e.select(F.col("src").alias("_via"), F.col("dst").alias("node"))
        parts.append(step.join(first, "seed").join(second, "_via").select("seed", "node", "_s", F.lit("CALLS").alias("relationship"), F.lit(2).alias("hop"), F.lit(9).alias("_order"), F.lit(weights["CALLS"]).alias("_w")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("node <> seed").groupBy("seed", "node").agg(F.min_by(F.struct("relationship", "hop", "_w", "_s"), F.struct("_order", "hop")).alias("x"))
    return rows.select("seed", "node", "x.relationship", "x.hop", (F.col("x._s") * F.col("x._w") * F.pow(F.lit(config.gamma), F.col("x.hop"))).alias("graph_score"))


def hybrid_search(scored: DataFrame, edges: DataFrame, kind: str = "general", config: HybridConfig = HybridConfig()) -> DataFrame:
    """Vector scores (id, score) of one query and graph expansion fused: id, score, provenance, relationship, hop, rank.

    Everything after the pool is over a few dozen rows.
    """
    pool = scored.orderBy(F.desc("score"), "id").limit(config.pool)
    ranked = pool.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    seeds = ranked.where(F.col("r") <= config.seeds)
    found = expand(seeds.select(F.col("id").alias("seed"), "score"), edges, kind, config)
    best = Window.partitionBy("seed").orderBy(F.desc("graph_score"), "node")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= config.per_seed)
    found = found.join(seeds.select(F.col("id").alias("seed"), F.col("r").alias("_seed_rank")), "seed")
    found = found.join(seeds.select(F.col("id").alias("node")), "node", "left_anti")
    found = found.groupBy("node").agg(F.min_by(F.struct("seed", "relationship", "hop", "graph_score"), F.struct("_seed_rank", "_r")).alias("x"))
    known = pool.select(F.col("id").alias("node"), F.col("score").alias("vector_score"))
    a = F.lit(config.alpha)
    expanded = found.join(known, "node", "left").select(
        F.col("node").alias("id"), F.lit("graph_expanded").alias("provenance"), "x.relationship", F.col("x.seed").alias("expanded_from"), "x.hop",
        F.coalesce(a * F.col("vector_score") + (1 - a) * F.col("x.graph_score"), F.col("x.graph_score")).alias("score"),
    )
    own = seeds.select("id", F.lit("vector_seed").alias("provenance"), F.lit(None).cast("string").alias("relationship"), F.lit(None).cast(scored.schema["id"].dataType).alias("expanded_from"), F.lit(0).alias("hop"), "score", "r")
    # At least min_seeds seeds, then expansions, then more seeds up to the limit.
    top = expanded.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    slot = own.withColumn("slot", F.when(F.col("r") <= config.min_seeds, F.col("r")).otherwise(F.col("r") + 1000)).unionByName(top.withColumn("slot", F.col("r") + 500))
    chosen = slot.orderBy("slot").limit(config.limit)
    return chosen.drop("r", "slot").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def retrieval_metrics(results: DataFrame, relevant: Column, k: int) -> DataFrame:
    """Per query of (query_id, rank): precision at k, hits, and the reciprocal rank of the first relevant row."""
    rows = results.where(F.col("rank") <= k).withColumn("_ok", relevant)
    return rows.groupBy("query_id").agg(
        F.round(F.sum(F.col("_ok").cast("double")) / k, 6).alias("precision_at_k"),
        F.sum(F.col("_ok").cast("long")).alias("hits"),
        F.round(F.coalesce(F.max(F.when(F.col("_ok"), 1 / F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
    )


def citations(text: Column) -> Column:
    """Distinct tags [path:a-b] of an answer in their order."""
    found = F.regexp_extract_all(text, F.lit(r"\[([a-zA-Z0-9_\-./\\]+:\d+-\d+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit("\\"), F.lit("/"))))


def evidence_block(number: Column, path: Column, start: Column, end: Column, kind: Column, symbol: Column, relation: Column, score: Column, signature: Column, content: Column) -> Column:
    """One retrieved chunk as a block of evidence; relation: how the graph led to it, NULL for a seed."""
    title = F.format_string("--- Evidence #%d [%s:%d-%d]", number, path, start, end)
    what = F.when(symbol.isNotNull(), F.concat(F.lit(" ("), F.upper(kind), F.lit(": "), symbol, F.lit(")"))).otherwise("")
    how = F.when(relation.isNotNull(), F.concat(F.lit(" [Graph-Expanded via "), relation, F.lit("]"))).otherwise("")
    head = F.concat(title, what, how, F.format_string(" (Relevance Score: %.3f) ---", score))
    return F.concat(head, F.when(signature.isNotNull(), F.concat(F.lit("\nSignature: "), signature)).otherwise(""), F.lit("\n"), content, F.lit("\n"))
