import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm.bpe import Encoder, StreamDecoder, Utf8Machine, load_ranks, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    ranks = load_ranks(PATH)
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(known):
    ranks, library = known
    encoder = Encoder(ranks, P.PATTERN, max_states=3000)
    pick = random.Random(1)
    texts = ["", " ", "  a", "a  b \n c\t", "don't we'll I'M", "x" * 700, " " * 300, "-" * 200, "\x1c \x1c a", "a\xa0 b 　c", "<|endoftext|>", "ñandú größe être 漢字 \U0001f600\U0001f468‍\U0001f469"]
    alphabet = "aetin oshr'ds\n\t  .,-=_#1234é漢\xa0\x85\x1c\U0001f600TH"
    texts += ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(pick.choice((pick.randrange(32, 0x250), pick.randrange(0x3000, 0x4000)))) for _ in range(30)) for _ in range(300)]
    decoder = StreamDecoder(ranks)
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert decoder.decode(ids) == text == "".join(decoder.stream(ids))


def test_pieces_of_random_bytes(known):
    ranks, library = known
    machine = Encoder(ranks, P.PATTERN).machine
    pick = random.Random(2)
    for _ in range(400):
        piece = bytes(pick.choice((pick.randrange(256), 97 + pick.randrange(26))) for _ in range(pick.randrange(1, 24)))
        assert list(machine.encode(piece)) == library._encode_single_piece(piece)


def test_utf8_machine_equals_the_incremental_decoder():
    pick = random.Random(4)
    for _ in range(2000):
        data = bytes(pick.choice((0x41, 0xC3, 0xA9, 0xE0, 0xA0, 0x80, 0xED, 0xF0, 0x9F, 0xF4, 0x8F, 0xFF)) for _ in range(8))
        state, text = Utf8Machine.feed(b"", data)
        assert text + ("�" if state else "") == data.decode(errors="replace")


def test_table(spark, known):
    texts = [None, "", "The same text. ", "The same text. ", "word " * 40000]
    docs = spark.createDataFrame([(i if i else None, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in round_trip(docs, PATH, P.PATTERN).collect()}
    for i, x in enumerate(texts):
        ids = known[1].encode_ordinary(x or "")
        row = got[i or None]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
