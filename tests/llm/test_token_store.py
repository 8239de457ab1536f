import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lodestone.llm.token_store import LibraryEncoder, address, combine_crc, cuts, read_digests, read_documents, store_root, stored_chunks, token_width, write_store

PATH = P.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: [*t.encode(x, add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library():
    plain, pick = library(), random.Random(1)
    alphabet = "aetin oshr'ds\n\t  .,-=_#1234é漢\xa0\x85\x1c\U0001f600TH"
    texts = ["", " ", "<|endoftext|> x", "a  <|endoftext|>", "hello <|endoftext|> world", "a\xa0 b", "x" * 500] + ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 90))) for _ in range(800)]
    got = LibraryEncoder(PATH).encode([None, *texts], 0)
    assert [x.tolist() for x in got] == [[0], *map(plain, texts)]


def test_cuts_follow_the_content():
    ids = np.random.default_rng(2).integers(0, 50000, 40000).astype("<u2")
    ends = cuts(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= 4096 and ends == sorted(set(ends))
    chunks = lambda x: {address(x[a:b].tobytes()) for a, b in zip([0, *cuts(x)], cuts(x))}  # noqa: B905, E731
    moved = np.r_[ids[:5000], ids[5003:]]
    assert len(chunks(ids) & chunks(moved)) > 0.9 * len(ends)
    assert cuts(ids[:1]) == [1]
    assert max(np.diff([0, *cuts(np.zeros(20000, "<u2"))])) <= 4096


def test_combined_crc():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert combine_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_store(spark, tmp_path):
    pick = random.Random(3)
    long = " ".join(f"w{pick.randrange(3000)}" for _ in range(20000))
    texts = {5: long, 1: long + " tail", 9: "short", 7: None, 3: "", 4: long[:30000]}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(9, "short", 1), (None, "no id", 1)], "doc_id long, text string, n_tokens int").repartition(3)
    folder = str(tmp_path / "store")
    write_store(docs, folder, PATH)
    rows = sorted(read_digests(spark, folder, token_width(PATH)).collect(), key=lambda r: r.start)
    plain = library()
    assert [r.doc_id for r in rows] == [None, 1, 3, 4, 5, 7, 9, 9]
    at = 0
    for r in rows:
        ids = plain("no id" if r.doc_id is None else texts[r.doc_id] or "")
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        at += len(ids)
    chunks = stored_chunks(spark, folder)
    stored = chunks.agg({"n": "sum"}).first()[0]
    assert chunks.count() == chunks.select("address").distinct().count() and stored < 0.6 * at
    again = {r.doc_id: r.ids for r in read_documents(spark, folder, 2).where("doc_id is not null").collect()}
    assert again == {k: plain(v or "") for k, v in texts.items()}
    assert len(store_root(spark, folder)) == 64
    write_store(docs.limit(0), str(tmp_path / "none"), PATH)
    assert read_digests(spark, str(tmp_path / "none"), 2).count() == 0
