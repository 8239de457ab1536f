"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its distinct five-word shingles (64-bit hashes). Two sets link at a Jaccard similarity of 0.75 or more.

1. Documents with equal sets are one node. Shingles that stand in a hundredth of the documents of a quarter of all batches
   are *frequent*; there are at most 400 times as many as shingles in a mean document, so the list has a bound.
2. All other shingles go to buckets by hash, packed; each bucket sends back those of two or more nodes with their number of
   nodes. Sorted by that number, the frequent ones last, the first n - ceil(0.75 n) + 1 shingles of a set are its prefix; two
   sets that link share a shingle of both prefixes, with enough shingles behind it for the overlap they need.
3. Nodes of one prefix and size are a group. Groups meet over the shingles of their prefixes; pairs whose sizes or
   positions rule out a link are dropped; the groups of pairs are expanded and verified on whole sets.
4. A group of near copies would make all its pairs. So each list is first joined to one leader only (linear), and again to
   another where it still has several components; then all pairs are made between different components of a list. Pairs
   within one component cannot change the components, so no link between different components is lost.

Nothing is collected to the driver but counts and the bounded list of frequent shingles. Intermediate tables are written
below spark.checkpoint.dir.

Cases: a null or empty text has no shingles and is its own component; fewer than five words are one shingle; rows that
share a ``doc_id`` are documents of their own, whose components are named by the smallest id in them; a null ``doc_id`` is
never the smallest unless it is alone; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm import flat
from lodestone.session import checkpoint_root

WORDS = 5
#: A shingle is frequent where it stands in at least this share of the documents of a batch ...
FREQUENT_SHARE = 0.01
FREQUENT_LEAST = 64
#: ... in at least this share of the batches.
FREQUENT_BATCHES = 0.25
#: Up to so many links (16 bytes each) are merged in one task, more in distributed rounds.
ONE_TASK_LINKS = 2_000_000
BUCKET_BYTES = 12 << 20
#: Bytes of text whose words are in memory at a time, some twenty times their size.
SLICE_BYTES = 2 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow column."""
    words, ends = flat.words(column)
    n = len(words) - WORDS + 1
    h = np.full(max(n, 0), WORDS, np.uint64)
    for j in range(WORDS):
        h = _mixed(h, words[j : j + len(h)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(_distinct(h[a : b - WORDS + 1]))
        else:
            one = np.full(min(1, b - a), b - a, np.uint64)
            for w in words[a:b]:
                one = _mixed(one, w)
            out.append(one)
    return out


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingles(text: str | None) -> np.ndarray:
    import pyarrow as pa

    return shingle_sets(pa.array([text], pa.large_string()))[0]


def often_in(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The hashes that stand in at least so many (one or more) of the sets, which are emptied; one copy of them is in memory."""
    h = np.empty(sum(map(len, sets)), np.uint64)
    at = len(h)
    while sets:
        s = sets.pop()
        h[at - len(s) : at] = s
        at -= len(s)
    h.sort()
    last = int(np.ceil(least)) - 1
    h = h[last:][h[last:] == h[: max(0, len(h) - last)]]
    return _distinct(h) if len(h) else h


def signature(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def links(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, frequent): frequent shingles of a batch stand in its first row."""
    import pyarrow as pa

    least, share = FREQUENT_LEAST, FREQUENT_SHARE

    def look(batches):
        for batch in batches:
            n, node, every, seen = [], [], [], set()
            for part in flat.slices(batch, 1, SLICE_BYTES):
                for s in shingle_sets(part.column(1)):
                    n.append(len(s))
                    node.append(signature(s))
                    if node[-1] not in seen:
                        seen.add(node[-1])
                        every.append(s)
            often = often_in(every, max(least, share * len(every))).view(np.int64)
            flat.give_back()
            often = [often, *[None] * (len(n) - 1)] if n else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(often, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "frequent"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, n int, node bigint, frequent array<bigint>")


def _shared(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(node, n, n_rare, h, df): the shingles that two or more nodes share; of the frequent ones those that reach a prefix."""
    import pyarrow as pa

    names = ["bucket", "payload"]
    one = lambda x: pa.RecordBatch.from_arrays([pa.array([b for b, _ in x], pa.int32()), pa.array([p for _, p in x], pa.binary())], names=names)
    known = frequent

    def pack(kind: int, h: np.ndarray, at: np.ndarray, nodes: np.ndarray) -> bytes:
        """kind, how many entries and nodes; shingles; which node; node, size and size without frequent shingles."""
        used, at = np.unique(at, return_inverse=True)
        at = at.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
        return np.array([kind, len(h), len(used)], np.int64).tobytes() + h.tobytes() + at.tobytes() + nodes[used].tobytes()

    def packed(nodes, hs, ats, often, often_at):
        table = np.array(nodes, np.int64)
        h, at = np.concatenate(hs), np.concatenate(ats)
        hs.clear()
        ats.clear()
        b = (h % np.uint64(buckets)).astype(np.int32)
        # A shingle is known by its bucket and 32 more bits. Clashes between documents only add pairs to verify; shingles
        # of one document that clash are one, and counted as one, so its prefix gets no shorter.
        short = (h >> np.uint64(31)).astype(np.uint32)
        del h
        order = np.argsort((b.astype(np.uint64) << np.uint64(32)) | short, kind="stable")
        short, at, b = short[order], at[order], b[order]
        again = np.zeros(len(b), bool)
        again[1:] = (b[1:] == b[:-1]) & (short[1:] == short[:-1]) & (at[1:] == at[:-1])
        np.subtract.at(table[:, 2], at[again], 1)
        short, at, b = short[~again], at[~again], b[~again]
        ends = np.searchsorted(b, np.arange(buckets + 1))
        out = [(k, pack(0, short[ends[k] : ends[k + 1]], at[ends[k] : ends[k + 1]], table)) for k in range(buckets) if ends[k + 1] > ends[k]]
        if often:
            out.append((int(table[0, 0] % buckets), pack(1, np.concatenate(often), np.concatenate(often_at), table)))
        for i in range(0, len(out), 64):
            yield one(out[i : i + 64])

    def send(batches):
        seen: set[int] = set()
        nodes, hs, ats, often, often_at, total = [], [], [], [], [], 0
        for s in (s for batch in batches for part in flat.slices(batch, 0, SLICE_BYTES) for s in shingle_sets(part.column(0))):
            if not len(s):
                continue
            name = signature(s)
            if name in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(name)
            rare = s
            if len(known):
                is_often = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                if is_often.any():
                    rare = s[~is_often]
                    # Some more than reach a prefix, as rare ones that clash count once.
                    reach = len(s) + (-3 * len(s) // 4) + 1 - len(rare)
                    if reach > 0:
                        top = s[is_often][: reach + 8]
                        often.append(top)
                        often_at.append(np.full(len(top), len(nodes)))
            hs.append(rare)
            ats.append(np.full(len(rare), len(nodes), np.int32))
            nodes.append((name, len(s), len(rare)))
            total += len(s)
            if total > 1_000_000:
                yield from packed(nodes, hs, ats, often, often_at)
                nodes, hs, ats, often, often_at, total = [], [], [], [], [], 0
        if nodes:
            yield from packed(nodes, hs, ats, often, often_at)
        del nodes, hs, ats, often, often_at
        flat.give_back()

    def receive(batches):
        parts: dict[int, list] = {}
        frequent_parts = []
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, n, m = np.frombuffer(payload, np.int64, 3)
                size = 8 if kind else 4
                h = np.frombuffer(payload, np.uint64 if kind else np.uint32, n, 24)
                width = 2 if m < 1 << 16 else 4
                at = np.frombuffer(payload, f"<u{width}", n, 24 + size * n)
                table = np.frombuffer(payload[24 + (size + width) * n :], np.int64).reshape(m, 3)
                if kind:
                    frequent_parts.append(((h ^ np.uint64(1 << 63)).view(np.int64), table[at]))  # keeps the order
                else:
                    parts.setdefault(k, []).append((h, at, table))
        row = lambda h, t, df: pa.RecordBatch.from_arrays(
            [pa.array(t[:, 0]), pa.array(t[:, 1].astype(np.int32)), pa.array(t[:, 2].astype(np.int32)), pa.array(h), pa.array(df)], names=["node", "n", "n_rare", "h", "df"]
        )
        for h, t in frequent_parts:
            yield row(h, t, np.full(len(h), np.iinfo(np.int64).max))
        for k, found in parts.items():
            h = np.concatenate([x[0] for x in found]).astype(np.int64)
            t = np.concatenate([x[2][x[1]] for x in found])
            order = np.lexsort((t[:, 0], h))
            h, t = h[order], t[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (t[1:, 0] != t[:-1, 0])]
            h, t = h[new], t[new]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            df = np.repeat(np.diff(np.r_[start, len(h)]), np.diff(np.r_[start, len(h)]))
            keep = df > 1
            # 32 bits and the bucket; frequent shingles are told apart by their sign where they clash at all.
            name = (h[keep] << 31) | np.int64(k & 0x7FFFFFFF)
            for i in range(0, int(keep.sum()), 200_000):
                yield row(name[i : i + 200_000], t[keep][i : i + 200_000], df[keep][i : i + 200_000])
        parts.clear()
        flat.give_back()

    sent = docs.select("text").mapInArrow(send, "bucket int, payload binary").repartition(buckets, "bucket")
    return sent.mapInArrow(receive, "node bigint, n int, n_rare int, h bigint, df bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    import pyarrow as pa

    def check(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame, folder: str, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, root) of the nodes with an edge (a, b); the root is the smallest node reachable."""
    import pyarrow as pa

    spark = edges.sparkSession
    if edges.limit(one_task + 1).count() <= one_task:

        def merge(batches):
            up: dict[int, int] = {}

            def find(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for batch in batches:
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    up.setdefault(a, a)
                    up.setdefault(b, b)
                    x, y = find(a), find(b)
                    if x != y:
                        up[max(x, y)] = min(x, y)
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

        return edges.select("a", "b").coalesce(1).mapInArrow(merge, "node bigint, root bigint")
    # Large star and small star: neighbours are hung under the smallest until each component is one star.
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for turn in count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        path = f"{folder}/stars_{turn}"
        small.write.parquet(path)
        now = spark.read.parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _possible(one: str, two: str):
    """Whether sizes and positions allow a link; r: shingles from this one to the end of the sorted set."""
    n1, n2, r1, r2 = (F.col(f"{s}.{c}") for c in ("n", "r") for s in (one, two))
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * F.least(r1, r2) >= 3 * (n1 + n2))


def _labelled(docs: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """Per row: doc_id, n, node, label (of its component; null without shingles)."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/ngram_join_{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    described = kept(_described(docs), "described")
    total = described.agg(F.count("frequent"), F.sum("n")).first()
    often = described.where("frequent is not null").select(F.explode("frequent").alias("h")).groupBy("h").count().where(F.col("count") >= FREQUENT_BATCHES * total[0])
    frequent = np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))
    buckets = max(spark.sparkContext.defaultParallelism, 1 + (total[1] or 0) * 7 // BUCKET_BYTES)

    # Copies in several tasks send their frequent shingles once each; a set holds them once.
    prefix = (
        _shared(docs, frequent, buckets)
        .groupBy("node", "n", "n_rare")
        .agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("x"), F.count(F.when(F.col("df") < 2**63 - 1, 1)).alias("n_shared"))
        .withColumn("alone", F.col("n_rare") - F.col("n_shared"))
        .withColumn("reach", F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - F.col("alone"))
        .where("reach > 0")
        .withColumn("x", F.transform(F.slice("x", F.lit(1), F.col("reach").cast("int")), lambda e: e["h"]))
    )
    group = F.when(F.col("alone") == 0, F.xxhash64("n", "x")).otherwise(F.col("node"))
    prefix = kept(prefix.select("node", "n", "alone", "x", group.alias("g")), "prefix")
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    groups = prefix.groupBy("g", "n").agg(F.first("x").alias("x"), F.first("alone").alias("alone"), F.min("node").alias("rep"))
    lists = groups.select("g", "n", "rep", size.alias("size"), F.posexplode("x").alias("i", "h"), "alone").select("g", "n", "rep", "size", "h", (F.col("n") - F.col("alone") - F.col("i")).alias("r"))
    lists = kept(lists, "lists")
    ends = lists.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h")
    lists = kept(lists.join(ends, "h"), "shared_lists")
    # Nodes that may be verified, with their sets; all come from these lists or share their group.
    crowd = prefix.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    asked = lists.select("g").unionByName(crowd).distinct()
    members = kept(prefix.join(asked, "g").select("g", "node"), "members")
    reps = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = members.select("node").distinct().join(reps, "node")

    def to_sets(batches):
        for batch in batches:
            for part in flat.slices(batch, 1, SLICE_BYTES):
                names, sets = [], []
                for node, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True):
                    if signature(s) == node:  # rows that share a doc_id differ in their sets
                        names.append(node)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])
        flat.give_back()

    texts = wanted.join(docs.select(F.col("doc_id").alias("_id"), "text"), F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = kept(texts.select("node", "text").mapInArrow(to_sets, "node bigint, set binary").dropDuplicates(["node"]), "sets")

    # First each list to a leader of its own, and each group to its first member.
    inner = members.join(prefix.groupBy("g").agg(F.min("node").alias("rep")), "g").select(F.least("rep", "node").alias("a"), F.greatest("rep", "node").alias("b"))
    every = kept(lists.join(members, "g").select("h", "size", F.struct("n", "r", "node").alias("x"), "g"), "named_lists")
    ours = lambda pairs: pairs.select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))

    def star(rows: DataFrame, turn: int) -> DataFrame:
        """Each row of a list with the leader of its size and of the next smaller; lists differ in their leaders, and so do turns."""
        order = F.xxhash64("x.node", "h", F.lit(turn))
        leaders = rows.where(7 * F.col("x.r") >= 6 * F.col("x.n")).groupBy("h", "size").agg(F.min_by("x", order).alias("two"))
        near = rows.select("h", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("size"), F.col("x").alias("one"))
        return near.join(leaders, ["h", "size"]).where(_possible("one", "two"))

    found = kept(_verified(ours(star(every, 0)).unionByName(inner).where("a <> b").distinct(), sets), "links_0")
    # Then lists that still have several components, with other leaders; at last all pairs between their components.
    for turn in (1, 2):
        roots = components(found, f"{folder}/round_{turn}", one_task)
        named = every.join(roots, F.col("x.node") == F.col("node"), "left").select("h", "size", "g", F.struct("x.*", F.coalesce("root", "x.node").alias("root")).alias("x"))
        named = kept(named, f"rooted_{turn}")
        split = named.groupBy("h").agg(F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where("lo <> hi").select("h")
        open_lists = named.join(split, "h")
        if turn == 1:
            pairs = star(open_lists, 1).where("one.root <> two.root")
        else:
            # A pair meets over the first shingle that both prefixes hold, and nowhere else.
            whole = prefix.select(F.col("node").alias("_n"), F.col("x").alias("prefix"))
            named = open_lists.join(whole, F.col("x.node") == F.col("_n")).select("h", F.struct("x.*", "prefix").alias("x"))
            first = F.get(F.array_intersect("one.prefix", "two.prefix"), 0) == F.col("a.h")
            met = (F.col("a.h") == F.col("b.h")) & (F.col("one.node") < F.col("two.node")) & (F.col("one.root") != F.col("two.root")) & _possible("one", "two") & first
            pairs = named.select("h", F.col("x").alias("one")).alias("a").join(named.select("h", F.col("x").alias("two")).alias("b"), met)
        more = ours(pairs)
        if turn == 2:  # members of one group in different components meet as well
            grouped = members.join(roots, "node", "left").select("g", F.struct("node", F.coalesce("root", "node").alias("root")).alias("x"))
            mixed = grouped.groupBy("g").agg(F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where("lo <> hi").select("g")
            inside = grouped.join(mixed, "g")
            inside = inside.select("g", F.col("x").alias("one")).join(inside.select("g", F.col("x").alias("two")), "g")
            more = more.unionByName(ours(inside.where((F.col("one.node") < F.col("two.node")) & (F.col("one.root") != F.col("two.root")))))
        found = found.unionByName(kept(_verified(more.distinct(), sets), f"links_{turn}"))
    roots = components(found, f"{folder}/round_3", one_task)

    known = described.where("n > 0").select("doc_id", "n", "node").join(roots, "node", "left")
    known = known.select("doc_id", "n", "node", F.coalesce("root", "node").alias("label"))
    return known.unionByName(described.where("n = 0").select("doc_id", "n", "node", F.lit(None).cast("bigint").alias("label")))


def jaccard_components(docs: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows = _labelled(docs, one_task)
    known = rows.where("n > 0")
    lowest = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = known.join(lowest, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, in their own columns, with a row of the smallest doc_id of each component and all rows without words.

    Rows are told apart by id and set, so different texts that share an id, or have none, all stay. A row without words is
    left out only where a text is kept under its own id.
    """
    import pyarrow as pa

    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x")
    keep = _labelled(docs).where("n > 0").groupBy("label").agg(least).select(F.col("x.doc_id").alias("_id"), F.col("x.node").alias("_set"))
    columns = docs.columns
    at = columns.index("text")

    def name(batches):
        for batch in batches:
            for part in flat.slices(batch, at, SLICE_BYTES):
                nodes = [signature(s) if len(s) else None for s in shingle_sets(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.int64())], names=[*columns, "_node"])
        flat.give_back()

    named = docs.mapInArrow(name, StructType([*docs.schema.fields, StructField("_node", LongType())]))
    same_id = F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = named.where("_node is not null").join(keep, same_id & (F.col("_node") == F.col("_set")), "left_semi").dropDuplicates(["doc_id", "_node"])
    bare = docs.where(F.coalesce(F.trim("text", F.lit(" \t\n\x0b\f\r")), F.lit("")) == "").join(keep.select("_id"), F.col("doc_id") == F.col("_id"), "left_anti")
    return texts.drop("_node").unionByName(bare)
