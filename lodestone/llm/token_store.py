"""Content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of the last ids has its low bits zero, so equal stretches of
different documents give equal chunks wherever they begin. A chunk is stored once under the hash of its bytes; a document
is a recipe of chunk addresses with a Merkle root over them; parts of the recipe table, in ascending ``doc_id``, have roots
over their documents, and one root stands over all parts.

Layout, all Parquet: ``loose/kind=chunk`` (address, n, payload: ids as little-endian integers of ``width`` bytes), ``recipes``
(part, row_id, doc_id, n_tokens, addresses, root) and ``manifest`` (part, at, n_docs, n_tokens, root). Chunks are deduplicated by
their address in one aggregation that first drops repetitions where they arise; what is read back is checked against its
addresses and roots, and CRCs of documents are combined from those of chunks, so payloads never travel to their readers.

Cases: a null or empty text is the end id alone; a null ``doc_id`` comes before all others; rows that share a ``doc_id``
follow one another; other columns are ignored; an empty table gives an empty store; a very long text is many chunks.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import flat
from lodestone.session import checkpoint_root

#: Children of a node of a Merkle tree, and levels of it (2**30 documents a part; more get several roots).
FAN, LEVELS = 1024, 3
SPAN = 8
#: A cut on average every 2**BITS ids, never closer than LEAST or farther than MOST.
BITS, LEAST, MOST = 9, 64, 4096
#: Ids are dense already: a higher level of the codec costs more than it saves.
CODEC = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Pieces that the model tokenizes before their ids are packed.
SOME = 20_000
#: Letters without marks and those of two bytes that begin with 0xC3, with a blank before them or not.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_GEAR = np.random.default_rng(0x5EED).integers(0, 2**63, 1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    g = _GEAR[ids & 0xFFFF] + (ids.astype(np.uint64) >> np.uint64(16)) * np.uint64(0x9E3779B1)
    # The sum over the last SPAN ids, each shifted by its distance, by doubling.
    h, j = g, 1
    while j < SPAN:
        longer = h.copy()
        longer[j:] += h[:-j] << np.uint64(j)
        h, j = longer, 2 * j
    found = np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << BITS) - 1) == 0) + 1
    out, last = [], 0
    for c in chain(found.tolist(), (n,)):
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or (c == n and c > last):
            out.append(c)
            last = c
    return out


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer: itself where it can be seen, else the next from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LibraryEncoder:
    """The tokenizers library over a column of texts.

    For a byte-level model without a normalizer a slice of texts is cut where the library's pattern surely ends a match, and
    each different piece goes through the library once; what pieces gave is kept within a bound. Texts that hold the string
    of an added token, and all texts of other tokenizers, go through the library whole.
    """

    def __init__(self, path: str, max_known: int = 400_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        t = self.tokenizer
        self.by_piece = (
            isinstance(t.model, models.BPE) and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and t.normalizer is None
            and not t.pre_tokenizer.add_prefix_space and t.pre_tokenizer.use_regex and t.truncation is None and t.padding is None
        )
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.max_known, self.longest = max_known, longest

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Letters, with a blank before them or not, are one match and need the model alone."""
        out: list[bytes] = [b""] * len(pieces)
        plain, other = [], []
        for i, x in enumerate(pieces):
            (plain if WORD(x) else other).append(i)
        said = b"\n".join([pieces[i] for i in plain]).decode("latin-1").translate(self.letters).split(self.letters[10])
        tokenize, size = self.tokenizer.model.tokenize, self.type.itemsize
        for at in range(0, len(plain), SOME):
            tokens = [tokenize(x) for x in said[at : at + SOME]]
            data = np.array([t.id for x in tokens for t in x], self.type).tobytes()
            b = 0
            for i, x in zip(plain[at : at + SOME], tokens, strict=True):
                e = b + size * len(x)
                out[i] = data[b:e]
                b = e
        for i, x in zip(other, self.packed([pieces[i].decode() for i in other]), strict=True):
            out[i] = x
        return out

    def encode_rows(self, column, end_id: int) -> list[np.ndarray]:
        """The ids of each row of an Arrow column, with the end id."""
        end = np.array([end_id], self.type)
        if not self.by_piece:
            return [np.frombuffer(x, self.type) for x in (p + end.tobytes() for p in self.packed([x or "" for x in column.to_pylist()]))]
        which, strings, ends = flat.pieces(column)
        known, longest = self.known, self.longest
        found = list(map(known.get, strings))
        new = [i for i, x in enumerate(found) if x is None]
        for i, value in zip(new, self.encode_pieces([strings[i] for i in new]), strict=True):
            found[i] = value
        if len(known) + len(new) > self.max_known:
            # Those of this slice stay, as far as they fit.
            known.clear()
            new = range(min(len(strings), self.max_known))
        known.update((strings[i], found[i]) for i in new if len(strings[i]) <= longest)
        data, at = flat.joined(found, which, ends)
        ids, at = np.frombuffer(data, self.type), (at // self.type.itemsize).tolist()
        rows = [np.concatenate([ids[a:b], end]) for a, b in zip(at, at[1:])]  # noqa: B905
        every = flat.flat_bytes(column)[0].tobytes()
        if any(x in every for x in self.added):
            for i, text in enumerate(column.to_pylist()):
                if text and any(x in text.encode() for x in self.added):
                    rows[i] = np.frombuffer(self.packed([text])[0] + end.tobytes(), self.type)
        return rows

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        import pyarrow as pa

        return self.encode_rows(pa.array(texts, pa.large_string()), end_id)


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode, cut, and write the three tables below the folder."""
    import pyarrow as pa

    spark = docs.sparkSession

    names = ["deal", "address", "doc_id", "n", "addresses", "payload"]
    key_type = docs.schema["doc_id"].dataType.simpleString()
    both = f"address binary, doc_id {key_type}, n bigint, addresses array<binary>, payload binary"

    def encode(batches):
        """Rows of chunks (address, n, payload) that are new to the task, and rows of recipes (their root, doc_id, n, addresses).

        deal: chunks go by their address, recipes anywhere, so copies of a document don't meet in one task.
        """
        seen: set[bytes] = set()
        row = 0
        for batch in batches:
            for part in flat.slices(batch, 1):
                chunks, roots, sizes, recipes = [], [], [], []
                for ids in _encoder(tokenizer).encode_rows(part.column(1), end_id):
                    last, own = 0, []
                    for c in cuts(ids):
                        payload = ids[last:c].tobytes()
                        own.append(name := address(payload))
                        if name not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(name)
                            chunks.append((name, c - last, payload))
                        last = c
                    roots.append(address(b"".join(own)))
                    sizes.append(len(ids))
                    recipes.append(own)
                n, m = len(roots), len(chunks)
                addresses = [*roots, *(x[0] for x in chunks)]
                deal = np.frombuffer(b"".join([x[:8] for x in addresses]), np.int64).copy()
                deal[:n] += np.arange(row, row + n) * 0x61C8864680B583
                row += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(deal), pa.array(addresses, pa.binary()), pa.concat_arrays([part.column(0), pa.nulls(m, part.column(0).type)]), pa.array([*sizes, *(x[1] for x in chunks)], pa.int64()),
                        pa.array([*recipes, *[None] * m], pa.list_(pa.binary())), pa.array([*[None] * n, *(x[2] for x in chunks)], pa.binary()),
                    ],
                    names=names,
                )

    def unique(batches):
        """All chunks of an address are in one partition: the first of each stays, and all recipes."""
        import pyarrow.compute as pc

        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for name, is_recipe in zip(batch.column(1).to_pylist(), pc.is_valid(batch.column(4)).to_pylist(), strict=True):
                keep.append(is_recipe or name not in seen)
                if not is_recipe:
                    seen.add(name)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=names[1:]).filter(pa.array(keep, pa.bool_()))

    loose = f"{folder}/loose"
    sent = docs.select("doc_id", "text").mapInArrow(encode, f"deal bigint, {both}").repartition("deal")
    kind = F.when(F.col("payload").isNull(), "recipe").otherwise("chunk").alias("kind")
    sent.mapInArrow(unique, both).select("*", kind).write.options(**CODEC).partitionBy("kind").mode("overwrite").parquet(loose)
    # Recipes alone are put in order: some bytes for each chunk.
    recipes = spark.read.schema(f"{both}, kind string").parquet(loose).where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "addresses", F.col("address").alias("root"))
    ordered = recipes.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "root")
    ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row_id"), "*").write.mode("overwrite").parquet(f"{folder}/recipes")
    # The tree of a part, level by level: a node stands over FAN nodes, so no row gathers more.
    level = spark.read.parquet(f"{folder}/recipes").select(
        "part", F.col("row_id").bitwiseAND((1 << 33) - 1).alias("at"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", F.lower(F.hex("root")).alias("root")
    )
    for _ in range(LEVELS):
        below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: x["root"]), "")
        level = level.groupBy("part", F.floor(F.col("at") / FAN).alias("up")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(below, 256).alias("root"))
        level = level.withColumnRenamed("up", "at")
    level.write.mode("overwrite").parquet(f"{folder}/manifest")


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(address, n, payload) of all chunks."""
    schema = "address binary, n bigint, payload binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/loose").where("kind = 'chunk'").select("address", "n", "payload")


def store_root(spark: SparkSession, folder: str) -> str:
    """The root over all parts, of which there are as many as range partitions."""
    rows = spark.read.parquet(f"{folder}/manifest").orderBy("part", "at").select("root").collect()
    return hashlib.sha256("".join(r.root for r in rows).encode()).hexdigest()


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, bits reversed."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


_shifts: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    if n_bytes not in _shifts:
        out, base, n = 1 << 31, 1 << 30, 8 * n_bytes
        while n:
            if n & 1:
                out = _times(base, out)
            base, n = _times(base, base), n >> 1
        if len(_shifts) > 20_000:
            _shifts.clear()
        _shifts[n_bytes] = out
    return _shifts[n_bytes]


def combine_crc(left: int, right: int, right_bytes: int) -> int:
    """The CRC-32 of two byte strings in a row from theirs."""
    return _times(_shift(right_bytes), left) ^ right


def read_digests(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified (addresses and root hold)."""
    import pyarrow as pa

    kind = np.dtype(f"<u{width}")

    def look(batches):
        for batch in batches:
            n, crc, good = [], [], []
            for name, said, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(payload, kind)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                good.append(said == len(ids) and address(payload) == name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["address", "n", "crc", "good"])

    chunks = stored_chunks(spark, folder).mapInArrow(look, "address binary, n bigint, crc bigint, good boolean")
    recipes = spark.read.parquet(f"{folder}/recipes")
    steps = recipes.select("part", "row_id", "doc_id", "root", F.posexplode("addresses").alias("at", "address"))
    met = steps.join(chunks, "address", "left").groupBy("part", "row_id", "doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("at", "address", "n", "crc", "good"))).alias("steps"))
    key_type = recipes.schema["doc_id"].dataType.simpleString()

    def join(batches):
        for batch in batches:
            n, crc, good = [], [], []
            for root, parts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                total, value = 0, 0
                for x in parts:
                    value = combine_crc(value, x["crc"] or 0, 4 * (x["n"] or 0))
                    total += x["n"] or 0
                n.append(total)
                crc.append(value)
                good.append(all(x["good"] for x in parts) and address(b"".join(x["address"] for x in parts)) == root)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["part", "row_id", "doc_id", "n_tokens", "ids_crc32", "verified"])

    found = met.mapInArrow(join, f"part int, row_id bigint, doc_id {key_type}, n_tokens bigint, ids_crc32 bigint, verified boolean")
    # Ids before a part: the manifest has one row a part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.read.parquet(f"{folder}/manifest").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(offsets, "part").select(
        "doc_id", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32", "verified"
    )


def read_documents(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(doc_id, ids): the documents put together again from their chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("row_id", "doc_id", F.posexplode("addresses").alias("at", "address"))
    chunks = stored_chunks(spark, folder).select("address", "payload")
    whole = recipes.join(chunks, "address").groupBy("row_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"))
    kind = np.dtype(f"<u{width}")
    key_type = whole.schema["doc_id"].dataType.simpleString()

    def ids(batches):
        import pyarrow as pa

        for batch in batches:
            out = [np.frombuffer(b"".join(x["payload"] for x in parts), kind).astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return whole.select("doc_id", "parts").mapInArrow(ids, f"doc_id {key_type}, ids array<int>")


def token_width(tokenizer: str) -> int:
    return _encoder(tokenizer).type.itemsize


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write a store of the documents in the shared folder and read its digests back."""
    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/token_store_{uuid.uuid4().hex}"
    write_store(docs, folder, tokenizer, end_id)
    return read_digests(spark, folder, token_width(tokenizer))
