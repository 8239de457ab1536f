"""Language-model scores from an Elias-Fano n-gram trie.

Training counts are kept in shards of a trie: level one the context words, level two the successors of each context. Both
levels are Elias-Fano coded monotone sequences in memory-mapped files, with quantised discounted counts beside them, the
numerators of smoothed probabilities; pointers from a context to its successors, and sums of counts, are Elias-Fano coded too.
A query looks its context up, reads the ends of its range from the pointers, and searches the successor in that range.

    p(w | v) = max(c(v, w) - D, 0) / c(v) + D * T(v) / c(v) * p(w),   p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with T(v) the number of different successors of v. A shard builds its trie, answers all queries that were sent to it, and
drops it, all in one task that can run again. Documents are dealt to batches by a hash of their id; a batch asks each shard
once for each different pair in it, so a frequent pair costs a shard one question a batch. Successors of contexts with a
large share of all tokens (at most 1 / HOT_SHARE of them) are spread over several shards; each shard tells once how many it
has of each, and T(v) of these contexts is the sum over all shards.

Cases: a null or empty text is the end token alone; null ``doc_id``s are training rows in one batch; rows that share a
``doc_id`` are scored one by one; other columns are ignored; an empty table gives an empty result; without training rows
counts are 0 and N and V too.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import flat
from lodestone.llm.batches import dealt
from lodestone.session import checkpoint_root

START, END = 2, 1
DISCOUNT = 0.75
HOT_SHARE = 0.002
SPREAD = 16
BATCH_BYTES = 12 << 20
#: Quantised log10 values: 255 steps over 8 decades.
STEPS, DECADES = 255, 8.0
FOLDS = 10


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * (STEPS - 1) / DECADES), 0, STEPS - 1).astype(np.uint8)


LEVELS = np.r_[10.0 ** (-np.arange(STEPS) * DECADES / (STEPS - 1)), 0.0]
NONE = STEPS
#: Stored are quantised log10 values of discounted counts, the numerators of probabilities: 65,535 steps over 16 decades from
#: 0.1. They are the same however the pairs of a context are dealt to shards.
COUNT_STEPS, COUNT_DECADES = 65_535, 16.0
COUNT_LEVELS = np.r_[10.0 ** (np.arange(COUNT_STEPS) * COUNT_DECADES / (COUNT_STEPS - 1) - 1), 0.0]
NO_COUNT = COUNT_STEPS


def quantised_counts(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log10(np.maximum(x, 0.1)) + 1) * (COUNT_STEPS - 1) / COUNT_DECADES), 0, COUNT_STEPS - 1).astype(np.uint16)


class EliasFano:
    """A monotone sequence: low bits packed, high parts as a bit vector in unary, both memory-mapped."""

    BLOCK = 1 << 16

    def __init__(self, path: str, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n, self.top = len(values), int(values[-1]) + 1 if len(values) else 1
        self.low = max(0, (self.top // max(1, self.n)).bit_length() - 1)
        # Low parts are whole bytes each.
        low = np.ascontiguousarray((values & np.uint64((1 << self.low) - 1)).view(np.uint8).reshape(-1, 8)[:, : (self.low + 7) // 8]).reshape(-1)
        high = (values >> np.uint64(self.low)).astype(np.int64) + np.arange(self.n)
        unary = np.zeros(int(high[-1]) + 1 if self.n else 1, np.uint8)
        unary[high] = 1
        self.parts = [self._mapped(f"{path}.low", low), self._mapped(f"{path}.high", np.packbits(unary, bitorder="little"))]
        # Where each block of elements begins in the bit vector.
        self.marks = high[:: self.BLOCK].copy()
        self.first = values[:: self.BLOCK].copy()

    @staticmethod
    def _mapped(path: str, data: np.ndarray) -> np.ndarray:
        data.tofile(path)
        return np.memmap(path, np.uint8, "r") if len(data) else np.zeros(0, np.uint8)

    def decode(self, block: int) -> np.ndarray:
        """The elements of one block."""
        a, b = block * self.BLOCK, min(self.n, (block + 1) * self.BLOCK)
        start = int(self.marks[block])
        stop = int(self.marks[block + 1]) if block + 1 < len(self.marks) else len(self.parts[1]) * 8
        bits = np.unpackbits(self.parts[1][start // 8 : (stop + 7) // 8], bitorder="little")
        at = np.flatnonzero(bits) + start // 8 * 8
        at = at[(at >= start)][: b - a] - np.arange(a, b)
        size = (self.low + 7) // 8
        raw = np.zeros((b - a, 8), np.uint8)
        if size:
            raw[:, :size] = np.asarray(self.parts[0][a * size : b * size]).reshape(-1, size)
        low = raw.view(np.uint64).reshape(-1)
        return (at.astype(np.uint64) << np.uint64(self.low)) | low

    def take(self, places: np.ndarray) -> np.ndarray:
        """The elements at ascending places, block by block."""
        out = np.empty(len(places), np.int64)
        block = places // self.BLOCK
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else block
        for a, b in zip(edges, [*edges[1:], len(places)], strict=True):
            out[a:b] = self.decode(int(block[a]))[places[a:b] - block[a] * self.BLOCK]
        return out

    def search(self, keys: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """For sorted keys the place of the element that is equal, -1 without one; first, stop: the range that each key may lie in."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        if first is None:
            block = np.maximum(np.searchsorted(self.first, keys, side="right") - 1, 0)
        else:
            # A range within one block names it; longer ranges are searched by the blocks' first elements.
            block = first // self.BLOCK
            long = np.flatnonzero((stop - 1) // self.BLOCK != block)
            block[long] = np.maximum(np.searchsorted(self.first, keys[long], side="right") - 1, block[long])
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else block
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            values, base = self.decode(int(block[a])), int(block[a]) * self.BLOCK
            at = np.searchsorted(values, keys[a:b])
            near = np.minimum(at, len(values) - 1)
            found = values[near] == keys[a:b]
            if stop is not None:
                found &= (near + base >= first[a:b]) & (near + base < stop[a:b])
            out[a:b] = np.where(found, near + base, -1)
        return out


class TrieShard:
    """Counted pairs of a shard: contexts and the 32-bit names of their successors."""

    def __init__(self, folder: str, context: np.ndarray, word: np.ndarray, count: np.ndarray):
        if not ((context[1:] > context[:-1]) | (context[1:] == context[:-1]) & (word[1:] >= word[:-1])).all():
            order = np.lexsort((word, context))
            context, word, count = context[order], word[order], count[order]
        new = np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])] if len(context) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        count = np.add.reduceat(count, start) if len(start) else count
        context, word = context[new], word[new]
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(context)])
        keys = context[first] if len(first) else context
        total = np.add.reduceat(count, first) if len(first) else count
        rank = np.repeat(np.arange(len(first)), size)
        self.level1 = EliasFano(f"{folder}/1", keys)
        self.pointers = EliasFano(f"{folder}/p", np.r_[first, len(context)])
        # A context's successors are a range of one monotone sequence, whose ends the pointers give.
        self.level2 = EliasFano(f"{folder}/2", (rank.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))
        quantised_counts(count - DISCOUNT).tofile(f"{folder}/q")
        self.counts = np.memmap(f"{folder}/q", np.uint16, "r") if len(count) else np.zeros(0, np.uint16)
        # Sums of counts before each context are monotone too.
        self.totals = EliasFano(f"{folder}/t", np.r_[0, np.cumsum(total)].astype(np.uint64))

    def discounted(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries sorted by context and word: codes of the discounted counts (NO_COUNT without an entry), the context's successors here, and its rank, -1 where it is unknown."""
        rank = self.level1.search(context)
        codes, t = np.full(len(context), NO_COUNT, np.uint16), np.zeros(len(context), np.int64)
        ok = np.flatnonzero(rank >= 0)
        if len(ok):
            first, stop = self.pointers.take(rank[ok]), self.pointers.take(rank[ok] + 1)
            t[ok] = stop - first
            at = self.level2.search((rank[ok].astype(np.uint64) << np.uint64(32)) | word[ok].astype(np.uint64), first, stop)
            codes[ok] = np.where(at >= 0, self.counts[np.maximum(at, 0)], NO_COUNT)
        return codes, t, rank

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries sorted by context and word: codes of the probabilities (NONE without an entry), and the context's successors and total here."""
        found, t, rank = self.discounted(context, word)
        total = np.zeros(len(context), np.int64)
        ok = np.flatnonzero(rank >= 0)
        if len(ok):
            total[ok] = self.totals.take(rank[ok] + 1) - self.totals.take(rank[ok])
        codes = np.where(found == NO_COUNT, NONE, quantised(COUNT_LEVELS[found] / np.maximum(total, 1))).astype(np.uint8)
        return codes, t, total


def token_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """(names, how many) of the tokens of each row of an Arrow column: lower-cased words and one end."""
    words, ends = flat.words(column)
    count = np.diff(ends) + 1
    out = np.full(int(count.sum()), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(count)), count - 1)] = words | np.uint64(4)  # apart from START and END
    return out, count


def tokens(text: str | None) -> np.ndarray:
    import pyarrow as pa

    return token_rows(pa.array([text], pa.large_string()))[0]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Batch:
    """The different tokens and pairs of the documents of a batch, in an order that depends on them alone."""

    def __init__(self, ids: list, texts, shards: int, hot: np.ndarray):
        every, self.length = token_rows(texts)
        self.out = np.array([held_out(i) for i in ids], bool)
        train = np.repeat(~self.out, self.length)
        before = np.r_[np.uint64(START), every[:-1]] if len(every) else every
        begins = np.cumsum(self.length) - self.length
        before[begins] = START
        # Equal names are found by a hash table; only different ones are sorted, by shard and name.
        seen, u = pd.factorize(every)
        shard = (u % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((u, shard))
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        self.token, self.token_shard, self.of_token = u[order], shard[order], place[seen]
        inverse = self.of_token
        self.token_count = np.bincount(self.of_token, weights=train, minlength=len(u)).astype(np.int64)
        # Pairs: names of words in pairs have 32 bits; the shard goes by the context, of a hot one by the word as well.
        w = (every >> np.uint64(32)).astype(np.uint32)
        spread = np.isin(before, hot)
        shard = ((before * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) + np.where(spread, w % np.uint32(SPREAD), 0).astype(np.uint64)) % np.uint64(shards)
        # By shard, context and word: places in the sorted tokens stand for both, so one key does.
        if len(u) < 1 << 22 and shards < 1 << 18:
            left = np.r_[0, inverse[:-1] + 1] if len(every) else inverse
            left[begins] = 0
            order = np.argsort((shard.astype(np.int64) << 45) | (left.astype(np.int64) << 22) | inverse, kind="stable")
        else:
            order = np.lexsort((w, before, shard))
        s, c, x = shard[order], before[order], w[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])] if len(every) else np.zeros(0, bool)
        self.of_pair = np.empty(len(every), np.int64)
        self.of_pair[order] = np.cumsum(new) - 1
        self.pair_shard, self.context, self.word = s[new].astype(np.int64), c[new], x[new]
        self.pair_count = np.bincount(self.of_pair, weights=train, minlength=len(self.word)).astype(np.int64)
        self.before, self.flat = before, every


def _whole(column):
    """A chunked column as one array with wide offsets."""
    import pyarrow as pa

    return pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())


def _cut(values: np.ndarray, shards: int):
    ends = np.searchsorted(values, np.arange(shards + 1))
    return [(k, slice(ends[k], ends[k + 1])) for k in range(shards) if ends[k + 1] > ends[k]]


def _packed(kind: int, *arrays: np.ndarray) -> bytes:
    head = np.array([kind, len(arrays), *[len(a) for a in arrays]], np.int64).tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x.astype(np.uint64)


def _unpacked(data: bytes, widths: dict[int, tuple]) -> tuple[int, list[np.ndarray]]:
    kind, n = np.frombuffer(data, np.int64, 2)
    sizes = np.frombuffer(data, np.int64, int(n), 16)
    at, out = 16 + 8 * int(n), []
    for size, t in zip(sizes, widths[int(kind)], strict=True):
        out.append(np.frombuffer(data, t, int(size), at))
        at += int(size) * np.dtype(t).itemsize
    return int(kind), out


#: kind 0: tokens and counts; kind 1: contexts, how many words each, words, counts.
REQUEST = {0: ("<u8", "<u4"), 1: ("<u8", "<u4", "<u4", "<u4")}
#: kind 0: counts; kind 1: codes and successors; of a shard, kind 2: different tokens and tokens, kind 3: successors of each hot context.
REPLY = {0: ("<i8",), 1: ("<u2", "<i8"), 2: ("<i8",), 3: ("<i8",)}


def trie_scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/lm_trie_{uuid.uuid4().hex}"
    key = docs.schema["doc_id"].dataType.simpleString()
    share = HOT_SHARE

    def hot_words(batches):
        for batch in batches:
            for part in flat.slices(batch, 1):
                names, length = token_rows(part.column(1))
                train = ~np.array([held_out(i) for i in part.column(0).to_pylist()], bool)
                which, u = pd.factorize(names[np.repeat(train, length)])
                c = np.bincount(which, minlength=len(u))
                total = int(c.sum())
                keep = c >= max(1, share / 2 * total)
                names = np.r_[u[keep], np.uint64(0), np.uint64(START)].view(np.int64)
                counts = np.r_[c[keep], total, int(train.sum())].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["w", "c"])

    # At most 2 / HOT_SHARE words of a batch; of all, those with a share of HOT_SHARE.
    seen = docs.select("doc_id", "text").mapInArrow(hot_words, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))
    n_train = seen.where("w = 0").select("c").first()
    often = seen.where((F.col("w") != 0) & (F.col("c") >= share * (n_train.c if n_train else 0))).select("w").limit(int(4 / share)).collect()
    hot = np.sort(np.array([r.w for r in often], np.int64).view(np.uint64))
    rows, shards = dealt(docs, folder, BATCH_BYTES)

    def ask(table: pa.Table) -> pa.Table:
        b = Batch(table.column("doc_id").to_pylist(), _whole(table.column("text")), shards, hot)
        name = table.column("batch")[0].as_py()
        to, payload = [], []
        for k, s in _cut(b.token_shard, shards):
            to.append(k)
            payload.append(_packed(0, b.token[s], b.token_count[s].astype(np.uint32)))
        for k, s in _cut(b.pair_shard, shards):
            c = b.context[s]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            to.append(k)
            payload.append(_packed(1, c[first], np.diff(np.r_[first, len(c)]).astype(np.uint32), b.word[s], b.pair_count[s].astype(np.uint32)))
        return pa.table({"batch": pa.array([name] * len(to), pa.int32()), "shard": pa.array(to, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def answer(batches):
        asked: dict[int, list] = {}
        for batch in batches:
            for name, k, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked.setdefault(k, []).append((name, payload))
        for k, rows in asked.items():
            got = [(name, *_unpacked(p, REQUEST)) for name, p in rows]
            one = [(name, a) for name, kind, a in got if kind == 0]
            two = [(name, a) for name, kind, a in got if kind == 1]
            out = []
            if one:
                at, u = pd.factorize(np.concatenate([a[0] for _, a in one]))
                count = np.bincount(at, weights=np.concatenate([a[1] for _, a in one])).astype(np.int64)
                at_end = np.cumsum([len(a[0]) for _, a in one])
                for (name, _), part in zip(one, np.split(at, at_end[:-1]), strict=True):
                    out.append((name, _packed(0, count[part])))
                out.append((-1, _packed(2, np.array([(count > 0).sum(), count.sum()], np.int64))))
            if two:
                context = np.concatenate([np.repeat(a[0], a[1]) for _, a in two])
                word, count = np.concatenate([a[2] for _, a in two]), np.concatenate([a[3] for _, a in two])
                # Different pairs in order, and which of them each request is: all batches are answered in one pass.
                which, names = pd.factorize(context)
                by_name = np.argsort(names)
                rank = np.empty(len(names), np.uint64)
                rank[by_name] = np.arange(len(names), dtype=np.uint64)
                key = (rank[which] << np.uint64(32)) | word
                order = np.argsort(key, kind="stable")
                key = key[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                start = np.flatnonzero(new)
                which = np.empty(len(key), np.int64)
                which[order] = np.cumsum(new) - 1
                n = np.add.reduceat(count[order].astype(np.int64), start)
                c, w = names[by_name][(key[start] >> np.uint64(32)).astype(np.int64)], key[start].astype(np.uint32)
                keep = n > 0
                with tempfile.TemporaryDirectory() as place:
                    trie = TrieShard(place, c[keep], w[keep], n[keep])
                    codes, t, _ = trie.discounted(c, w)
                    ends = np.cumsum([len(a[2]) for _, a in two])
                    for (name, a), own in zip(two, np.split(which, ends[:-1]), strict=True):
                        out.append((name, _packed(1, codes[own], t[own[np.cumsum(a[1], dtype=np.int64) - a[1]]])))
                    if len(hot):
                        out.append((-1, _packed(3, trie.discounted(hot, np.zeros(len(hot), np.uint32))[1])))
                    del trie
            for i in range(0, len(out), 16):
                part = out[i : i + 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int32()), pa.array([k] * len(part), pa.int32()), pa.array([x[1] for x in part], pa.binary())], names=["batch", "shard", "payload"]
                )

    requests = rows.groupBy("batch").applyInArrow(ask, "batch int, shard int, payload binary")
    requests.repartition(shards, "shard").mapInArrow(answer, "batch int, shard int, payload binary").write.parquet(f"{folder}/replies")
    replies = spark.read.parquet(f"{folder}/replies")
    sums = {2: np.zeros(2, np.int64), 3: np.zeros(len(hot), np.int64)}
    for r in replies.where("batch = -1").select("payload").toLocalIterator():
        kind, (x,) = _unpacked(bytes(r.payload), REPLY)
        sums[kind] += x
    (v, n), t_hot = sums[2].tolist(), sums[3]
    starts = seen.where(F.col("w") == START).select("c").first()
    n_start = int(starts.c) if starts else 0
    schema = f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left.column("doc_id").to_pylist(), _whole(left.column("text")), shards, hot)
        by: dict[tuple[int, int], list] = {}
        for k, payload in zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True):
            kind, a = _unpacked(payload, REPLY)
            by[kind, k] = a
        joined = lambda kind, i, t: np.concatenate([by[x][i] for x in sorted(by) if x[0] == kind]) if any(x[0] == kind for x in by) else np.zeros(0, t)
        count, codes = joined(0, 0, np.int64), joined(1, 0, np.uint16)
        # Successors come for each stretch of a context within a shard; a hot context has several.
        t_part = joined(1, 1, np.int64)
        new = np.r_[True, (b.context[1:] != b.context[:-1]) | (b.pair_shard[1:] != b.pair_shard[:-1])] if len(b.context) else np.zeros(0, bool)
        stretch = np.cumsum(new) - 1
        names, at = np.unique(b.context[new], return_inverse=True)
        t = np.bincount(at, weights=t_part) if len(names) else np.zeros(0)
        is_hot = np.isin(names, hot)
        t[is_hot] = t_hot[np.searchsorted(hot, names[is_hot])]
        c = count[b.of_token]
        p1 = (c + 0.1) / (n + 0.1 * (v + 1))
        # The count of a context is that of its token, and of documents at a start.
        order = np.argsort(b.token)
        found = np.minimum(np.searchsorted(b.token[order], names), max(0, len(order) - 1))
        total = np.where(b.token[order][found] == names, count[order][found], 0).astype(np.float64) if len(order) else np.zeros(len(names))
        total[names == START] = n_start
        of_context = at[stretch[b.of_pair]]
        cv, tv = total[of_context], t[of_context]
        direct = COUNT_LEVELS[codes[b.of_pair]] / np.maximum(cv, 1)
        back = np.where(cv > 0, DISCOUNT * tv / np.maximum(cv, 1), 1.0)
        p = np.where(cv > 0, direct + back * p1, p1)
        first = np.r_[0, np.cumsum(b.length)[:-1]]
        add = lambda x: np.add.reduceat(x, first)
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "held_out": pa.array(b.out), "n_tokens": pa.array(b.length), "n_known": pa.array(add((c > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(b.length), n, np.int64)), "base_score": pa.array(add(np.log10(p1))), "score": pa.array(add(np.log10(p))),
            }
        )

    return rows.groupBy("batch").cogroup(replies.where("batch >= 0").groupBy("batch")).applyInArrow(score, schema)
