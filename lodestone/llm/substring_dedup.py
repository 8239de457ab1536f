"""Exact substring deduplication by merged Burrows-Wheeler transforms.

Every 50-byte window has an anchor: the first 24-byte gram of it whose first eight bytes have the least hash. Equal windows
have equal anchors at equal places, so they meet where anchors are dealt out by hash.

1. Documents are dealt to batches by a hash of their id. Each batch sends its different anchors once; anchors of two or more
   documents come back marked.
2. For marked anchors a batch sends its different *segments*: the bytes of all neighbouring windows with that anchor, with
   the smallest document in the batch. Equal segments of all batches become one. Where an anchor has several segments,
   each sender's segments are a shard with a Burrows-Wheeler transform; the transforms are merged by refining their
   interleave a few characters at a time. The blocks of the interleave after k characters are the suffixes with a common
   prefix of k, so after 50 the blocks of two or more are the repeated 50-byte strings, and no suffix of the whole is sorted
   again. Back goes the smallest document of each window, as runs.
3. A batch removes the bytes of windows that a smaller document holds.

A passage in a third of all documents costs a shard one segment a batch. Documents travel once, into a bucketed table that
all passes read; nothing is collected to the driver.

Cases: a null or empty text, and one of fewer than 50 bytes, loses nothing; equal ``doc_id``s never remove from each other; a
null ``doc_id`` is larger than all others; other columns are ignored; an empty table gives an empty result; a very long text is
handled in its batch alone.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import dealt
from lodestone.llm.flat import hashes
from lodestone.session import checkpoint_root

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
BATCH_BYTES = 12 << 20
#: Bytes of segments whose transforms are merged together, so that they stay in a processor's cache.
MERGE_BYTES = 192 << 10
NO_ID = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each stretch of so many neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def _eights(data: bytes) -> np.ndarray:
    """Eight bytes from every place as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def anchored(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of each stretch of windows with one anchor.

    The anchor of a window is the hash of a gram of it: of those that begin with the least hash of eight bytes, the first.
    """
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = _eights(data)
    h = ((x[: len(data) - GRAM + 1] * _M1) >> np.uint64(32)).astype(np.uint32)
    least = _sliding(h, SPAN, np.minimum)
    # A stretch ends where the least hash changes, and behind the first place of one that comes again.
    n = len(least)
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])
    at = np.flatnonzero(cut)
    place = at + np.argmin(np.lib.stride_tricks.sliding_window_view(h, SPAN)[at], axis=1)
    name = np.zeros(len(at), np.uint64)
    for j in range(0, GRAM, 8):
        name = (name ^ x[place + j]) * _M1
        name ^= name >> np.uint64(32)
    name *= _M2
    return at, np.diff(np.append(at, n)), name ^ (name >> np.uint64(29))


def build_bwt(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters + 1 with 0 for an end, segment, offset) of the sorted suffixes of a shard; ends come first, in order.

    UTF-8 has no byte over 0xF4, so characters fit in a byte.
    """
    m = len(segments)
    length = np.array([len(s) for s in segments], np.int64)
    # One slot for each suffix, the empty one of each segment included.
    stop = np.cumsum(length + 1) - 1
    seg = np.repeat(np.arange(m), length + 1)
    off = np.arange(len(seg)) - (stop - length)[seg]
    codes = np.zeros(len(seg) + 8, np.uint8)
    codes[np.flatnonzero(off < length[seg])] = np.frombuffer(b"".join(segments), np.uint8) + np.uint8(1)
    # Ranks by eight characters, then by twice as many, until a whole segment is compared; behind an end come no characters.
    room = stop[seg] - np.arange(len(seg))
    key = np.ndarray((len(seg),), ">u8", codes, strides=(1,)).astype(np.uint64)
    key &= ~((np.uint64(1) << (np.uint64(8) * np.maximum(8 - room, 0).astype(np.uint64))) - np.uint64(1)) * (room > 0)
    width, end = 8, stop[seg]
    while True:
        # Ranks do not depend on the order of equal keys; in the last round equal suffixes are in the order of their segments.
        order = np.argsort(key, kind="stable" if width > length.max() else None)
        low = key[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = low[1:] != low[:-1]
        if width > length.max() or fresh.all():
            break
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(fresh, dtype=np.uint64)
        key = (rank << np.uint64(32)) | rank[np.minimum(np.arange(len(order)) + width, end)]
        width *= 2
    s, o = seg[order], off[order]
    return np.where(o > 0, codes[np.maximum(order - 1, 0)], 0).astype(np.uint8), s, o


#: So many characters are refined in one round.
STEP = 4


def _backwards(chars: np.ndarray, ends: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(the step characters before each suffix as a number, the place of the suffix that is so much longer).

    A number is 0 where a suffix has fewer characters before it.
    """
    order = np.argsort(chars, kind="stable")[ends:]
    longer = np.zeros(len(chars), np.int32 if len(chars) < 1 << 31 else np.int64)
    longer[order] = np.arange(ends, len(chars))
    grams, at, whole = chars.astype(np.uint32), longer, chars > 0
    for width in range(1, step):
        c = chars[at]
        whole &= c > 0
        grams |= c.astype(np.uint32) << np.uint32(8 * width)
        at = longer[at]
    grams[~whole] = 0
    return grams, at


def _shorter(chars: np.ndarray, ends: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters from the left with ends behind them, place) of the suffixes of one to step - 1 characters, string by string."""
    order = np.argsort(chars, kind="stable")[ends:]
    longer = np.zeros(len(chars), np.int64)
    longer[order] = np.arange(ends, len(chars))
    texts, places, names = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    text, at, name = np.zeros(ends, np.uint32), np.arange(ends), np.arange(ends)
    for width in range(1, step):
        c = chars[at]
        go = c > 0
        text, at, name = text[go] | (c[go].astype(np.uint32) << np.uint32(8 * (width - 1))), longer[at[go]], name[go]
        texts.append(text << np.uint32(8 * (step - width)))
        places.append(at)
        names.append(name)
    rank = np.argsort(np.concatenate(names), kind="stable")
    return np.concatenate(texts)[rank], np.concatenate(places)[rank]


def merge_bwts(shards: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, block) in merged order: the interleave, and the numbers of the blocks with a common prefix of depth.

    ends: how many strings each shard has; their end marks are first in its order and stay in the order of the shards.
    A round refines by the STEP characters before each suffix, which the transforms themselves give. The suffixes that are
    shorter than that are the same in every round, and each of them is a block of its own: strings of different texts never
    go on into each other.
    """
    base = np.cumsum([0, *map(len, shards)])
    n, tops = int(base[-1]), sum(ends)
    kind = np.int32 if n < 1 << 30 else np.int64
    rows, block = np.arange(n, dtype=kind), np.zeros(n, kind)
    top = np.concatenate([np.arange(b, b + e, dtype=kind) for b, e in zip(base[:-1].tolist(), ends, strict=True)])
    plans: dict[int, tuple] = {}
    left = depth
    while left:
        step = min(STEP, left)
        if step not in plans:
            back = [_backwards(x, e, step) for x, e in zip(shards, ends, strict=True)]
            short = [_shorter(x, e, step) for x, e in zip(shards, ends, strict=True)]
            key = np.concatenate([x for x, _ in short] + [x for x, _ in back])
            # Codes of 16 bits, where they are enough, are sorted by their digits; 0 stays 0, as each string has a suffix with nothing before it.
            sorted_ = np.sort(key)
            values = sorted_[np.r_[True, sorted_[1:] != sorted_[:-1]]]
            key = np.searchsorted(values, key).astype(np.uint16 if len(values) < 1 << 16 else np.uint32)
            m = len(key) - n
            longer = np.concatenate([x + kind(b) for (_, x), b in zip(back, base.tolist(), strict=False)]).astype(kind)
            at = np.concatenate([x + b for (_, x), b in zip(short, base.tolist(), strict=False)]).astype(kind)
            plans[step] = key[:m], at, key[m:], longer, int((key[m:] == 0).sum())
        short, at, key, longer, drop = plans[step]
        c = np.concatenate([short, key[rows]])
        order = np.argsort(c, kind="stable")[drop:]
        c = c[order]
        b = np.concatenate([np.arange(-len(short), 0, dtype=kind), block])[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        block = np.concatenate([np.arange(tops, dtype=kind), kind(tops - 1) + np.cumsum(fresh, dtype=kind)])
        rows = np.concatenate([top, np.concatenate([at, longer[rows]])[order]])
        left -= step
    return np.repeat(np.arange(len(shards)), np.diff(base)).astype(np.uint8 if len(shards) < 256 else np.int64)[rows], block


def merged_rows(shards: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, shard, segment, offset) of the suffixes with depth characters or more, in merged order."""
    built = [build_bwt(s) for s in shards if s]
    names = np.array([k for k, s in enumerate(shards) if s], np.int64)
    if not built:
        return (np.zeros(0, np.int64),) * 4
    z, block = merge_bwts([b[0] for b in built], [len(shards[k]) for k in names], depth)
    seg, off, room = (np.empty(len(z), np.int64) for _ in range(3))
    for k, (_, s, o) in enumerate(built):
        length = np.array([len(x) for x in shards[names[k]]], np.int64)
        seg[z == k], off[z == k], room[z == k] = s, o, length[s] - o
    # A block whose prefix runs over the end of a string is none of that length.
    keep = room >= depth
    return block[keep], names[z[keep]], seg[keep], off[keep]


def repeated(shards: list[list[bytes]], depth: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The repeated strings of that length: (shard, segment, offset) of the places of each."""
    block, *places = merged_rows(shards, depth)
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else block
    size = np.diff(np.r_[start, len(block)])
    return [tuple(x[a : a + k] for x in places) for a, k in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True)]


def _runs(values: list[int]) -> list[tuple[int, int]]:
    return [(len(list(g)), v) for v, g in groupby(values)]


def smallest_holders(senders: list[list[tuple[int, bytes, int]]]) -> list[list[list[tuple[int, int]]]]:
    """For each sender's segments (anchor, bytes, smallest id): runs (windows, smallest id that holds them), over all senders."""
    least: dict[tuple[int, bytes], int] = {}
    owner: dict[tuple[int, bytes], int] = {}
    for k, rows in enumerate(senders):
        for anchor, data, doc in rows:
            key = anchor, data
            known = least.get(key)
            if known is None:
                least[key], owner[key] = doc, k
            elif doc < known:
                least[key] = doc
    several: dict[int, int] = {}
    for anchor, _ in least:
        several[anchor] = several.get(anchor, 0) + 1
    # Only anchors with different segments go through the transforms, a bounded number of bytes of whole anchors at a time;
    # a shard is what its first sender brought.
    keys = sorted(key for key in owner if several[key[0]] > 1)
    spread: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    at = 0
    while at < len(keys):
        stop, size = at, 0
        while stop < len(keys) and (size < MERGE_BYTES or keys[stop][0] == keys[stop - 1][0]):
            size += len(keys[stop][1])
            stop += 1
        shards: list[list[tuple[int, bytes]]] = [[] for _ in senders]
        for key in keys[at:stop]:
            shards[owner[key]].append(key)
        spread.update(_merged_holders(_evened([s for s in shards if s]), least))
        at = stop
    return [[spread.get((a, d)) or [(len(d) - LENGTH + 1, least[a, d])] for a, d, _ in rows] for rows in senders]


def _merged_holders(shards: list[list[tuple[int, bytes]]], least: dict[tuple[int, bytes], int]) -> dict[tuple[int, bytes], list[tuple[int, int]]]:
    """The runs of each segment: its windows that stand in others too have the smallest id of all."""
    keys = [key for s in shards for key in s]
    low = np.array([least[key] for key in keys], np.int64)
    n = np.array([len(d) - LENGTH + 1 for _, d in keys], np.int64)
    base = np.cumsum(n) - n
    held = np.repeat(low, n)
    first = np.cumsum([0, *(len(s) for s in shards)])[:-1]
    block, shard, seg, off = merged_rows([[data for _, data in s] for s in shards], LENGTH)
    of = first[shard] + seg
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    smallest = np.minimum.reduceat(low[of], start)
    held[base[of] + off] = np.repeat(smallest, np.diff(np.r_[start, len(block)]))
    values = held.tolist()
    return {key: _runs(values[b : b + k]) for key, b, k in zip(keys, base.tolist(), n.tolist(), strict=True)}


def _evened(shards: list[list], most: int = 2) -> list[list]:
    """Small shards put together, so that a merge has few of them."""
    out: list[list] = [[] for _ in range(min(most, len(shards)))]
    for s in sorted(shards, key=len, reverse=True):
        min(out, key=len).extend(s)
    return out


class Batch:
    """The documents of a batch in an order that follows from them alone, and their windows by anchors."""

    def __init__(self, ids: list, texts: list):
        data = [(x or "").encode() for x in texts]
        names = [NO_ID if i is None else i for i in ids]
        self.order = sorted(range(len(data)), key=lambda i: (names[i], data[i]))
        self.ids = np.array([names[i] for i in self.order], np.int64)
        self.data = [data[i] for i in self.order]

    def anchors(self, shards: int) -> None:
        parts = [anchored(d) for d in self.data]
        self.doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        cat = lambda i, t: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
        self.first, self.size, anchor = cat(0, np.int64), cat(1, np.int64), cat(2, np.uint64)
        order = np.argsort(anchor, kind="stable")
        sorted_ = anchor[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        start = np.flatnonzero(new)
        self.names = sorted_[start]
        # Shards are ranges of names.
        self.shard = (((self.names >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        # Documents are in the order of their ids, so a name's first and last stretch tell whether several ids have it.
        own = self.ids[self.doc[order]]
        last = np.append(start[1:], len(order)) - 1
        self.several = own[start] < own[last] if len(start) else np.zeros(0, bool)

    def segments(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, segment of each, first stretch of each segment) of shared anchors: different segments in the order of their names."""
        at = np.flatnonzero(shared[self.of])
        at = at[np.argsort(self.of[at], kind="stable")]
        begin = np.cumsum([0, *map(len, self.data)])[:-1]
        whole = np.frombuffer(b"".join(self.data), np.uint8)
        # A segment is told by its name and by hashes of its bytes before and behind the middle.
        start, size = begin[self.doc[at]] + self.first[at], self.size[at] + LENGTH - 1
        half = size // 2
        one, two = hashes(whole, start, half), hashes(whole, start + half, size - half)
        which = pd.factorize(one * _M1 ^ two ^ (self.of[at].astype(np.uint64) * _M2))[0]
        first = np.empty(int(which.max(initial=-1)) + 1, np.int64)
        first[which[::-1]] = at[::-1]
        return at, which, first

    def bytes_of(self, stretch: int) -> bytes:
        s = int(self.first[stretch])
        return self.data[self.doc[stretch]][s : s + int(self.size[stretch]) + LENGTH - 1]


def _cut(values: np.ndarray, shards: int):
    ends = np.searchsorted(values, np.arange(shards + 1))
    return [(k, slice(ends[k], ends[k + 1])) for k in range(shards) if ends[k + 1] > ends[k]]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, with their types and lengths."""
    head = ",".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return zs.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays))


def _unpacked(payload: bytes) -> list[np.ndarray]:
    data = zs.ZstdDecompressor().decompress(payload)
    at, out = 4 + int.from_bytes(data[:4], "little"), []
    for x in data[4:at].decode().split(","):
        kind, n = np.dtype(x[:3]), int(x[3:])
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


#: Kinds of messages: anchors and their marks; segments and their holders; where the segments of a batch stand in it.
ANCHORS, SEGMENTS, PLACES = 0, 1, 2


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/substring_dedup_{uuid.uuid4().hex}"
    key = docs.schema["doc_id"].dataType.simpleString()
    table, shards = dealt(docs, folder, BATCH_BYTES)
    message = "kind int, batch int, shard int, payload binary"
    names = [x.split()[0] for x in message.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def batch_of(rows: pa.Table) -> Batch:
        return Batch(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())

    def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def by_shard(batches):
        found: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for _, name, k, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(k, []).append((name, payload))
        return found

    def answers(rows: list[tuple[int, int, int, bytes]]):
        for i in range(0, len(rows), 8):
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 8]], t) for j, t in enumerate(types)], names=names)

    def ask_anchors(rows: pa.Table) -> pa.Table:
        b, name = batch_of(rows), rows.column("batch")[0].as_py()
        b.anchors(shards)
        # 32 bits of the anchor beside its shard: a clash only marks an anchor that need not be marked.
        short = (b.names * np.uint64(shards) >> np.uint64(32)).astype(np.uint32) if shards < 1 << 32 else b.names
        return messages([(ANCHORS, name, k, _packed(short[s], np.packbits(b.several[s]))) for k, s in _cut(b.shard, shards)])

    def mark(batches):
        for k, rows in by_shard(batches).items():
            asked = [_unpacked(p) for _, p in rows]
            several = np.concatenate([np.unpackbits(bits)[: len(x)] for x, bits in asked])
            u, at = np.unique(np.concatenate([x for x, _ in asked]), return_inverse=True)
            score = np.bincount(at, weights=several) + np.bincount(at)
            good = np.split((score > 1)[at], np.cumsum([len(x) for x, _ in asked])[:-1])
            yield from answers([(ANCHORS, name, k, _packed(np.array([len(g)], np.int64), np.packbits(g))) for (name, _), g in zip(rows, good, strict=True)])

    def of_kind(rows: pa.Table, kind: int) -> dict[int, list[np.ndarray]]:
        """The messages of a kind by shard."""
        return {k: _unpacked(p) for x, k, p in zip(rows.column("kind").to_pylist(), rows.column("shard").to_pylist(), rows.column("payload").to_pylist(), strict=True) if x == kind}

    def ask_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        name = (left if left.num_rows else right).column("batch")[0].as_py()
        if left.num_rows:
            b = batch_of(left)
            b.anchors(shards)
            bits = of_kind(right, ANCHORS)
            marked = np.concatenate([np.unpackbits(bits[k][1])[: int(bits[k][0][0])] for k in sorted(bits)]).astype(bool) if bits else np.zeros(0, bool)
            at, which, first = b.segments(marked)
            # Segments are numbered by name, so those of a shard are neighbours.
            name_of = b.of[first]
            for k, s in _cut(b.shard[name_of], shards):
                own = first[s]
                data = [b.bytes_of(i) for i in own.tolist()]
                low = b.ids[b.doc[own]]  # stretches are in the order of ids
                rows.append((SEGMENTS, name, k, _packed(b.names[name_of[s]], low, np.array(list(map(len, data)), np.uint32), np.frombuffer(b"".join(data), np.uint8))))
                here = (which >= s.start) & (which < s.stop)
                rows.append((PLACES, name, k, _packed(b.doc[at[here]].astype(np.uint32), b.first[at[here]].astype(np.uint32), (which[here] - s.start).astype(np.uint32))))
        return messages(rows)

    def hold(batches):
        for k, rows in by_shard(batches).items():
            senders = []
            for _, p in rows:
                anchor, low, length, data = _unpacked(p)
                data, ends = data.tobytes(), np.cumsum(length, dtype=np.int64).tolist()
                senders.append([(a, data[e - s : e], d) for a, d, e, s in zip(anchor.tolist(), low.tolist(), ends, length.tolist(), strict=True)])
            out = []
            for (name, _), runs in zip(rows, smallest_holders(senders), strict=True):
                count = np.array([len(r) for r in runs], np.uint32)
                out.append((SEGMENTS, name, k, _packed(count, np.array([x for r in runs for x, _ in r], np.uint32), np.array([x for r in runs for _, x in r], np.int64))))
            yield from answers(out)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        b = batch_of(left)
        size = np.array([len(d) + 1 for d in b.data], np.int64)
        base = np.cumsum(size) - size
        cover = np.zeros(int(size.sum()), np.int32)
        places, holders = of_kind(right, PLACES), of_kind(right, SEGMENTS)
        for k, found in places.items():
            doc, first, which = (x.astype(np.int64) for x in found)
            count, span, held = (x.astype(np.int64) for x in holders[k])
            end = np.cumsum(count)
            # Every place with every run of its segment.
            n = count[which]
            place = np.repeat(np.arange(len(which)), n)
            head = (end - count)[which][place]
            run = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + head
            before = np.cumsum(span) - span
            gone = held[run] < b.ids[doc[place]]
            start = (base[doc] + first)[place[gone]] + before[run[gone]] - before[head[gone]]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + span[run[gone]] + LENGTH - 1, -1)
        cover = np.cumsum(cover) > 0
        n_bytes, removed, spans, kept = [], [], [], []
        for d, at in zip(b.data, base.tolist(), strict=True):
            gone = cover[at : at + len(d)]
            n_bytes.append(len(d))
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if removed[-1] else 0)
            kept.append(hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes() if removed[-1] else d).hexdigest())
        ids = left.column("doc_id").take(pa.array(b.order, pa.int64()))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    table.groupBy("batch").applyInArrow(ask_anchors, message).repartition(shards, "shard").mapInArrow(mark, message).write.parquet(f"{folder}/marks")
    marks = spark.read.schema(message).parquet(f"{folder}/marks")
    table.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(ask_segments, message).write.partitionBy("kind").parquet(f"{folder}/segments")
    asked = spark.read.schema(message).parquet(f"{folder}/segments").select(*names)
    asked.where(F.col("kind") == SEGMENTS).repartition(shards, "shard").mapInArrow(hold, message).write.parquet(f"{folder}/holders")
    both = asked.where(F.col("kind") == PLACES).unionByName(spark.read.schema(message).parquet(f"{folder}/holders"))
    schema = f"doc_id {key}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return table.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(remove, schema)
