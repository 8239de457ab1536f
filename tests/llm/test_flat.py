import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex

from lodestone.llm import flat

LETTERS = ["a", "B", "'", "s", " ", "  ", "\n", "\t", "1", "é", "ß", "×", "!", ",", "’", "\xa0", "漢", "ll", "²", "\x1c", "\x85", "\U0001f600"]


def rows(pick, most=14):
    return ["".join(pick.choice(LETTERS) for _ in range(pick.randrange(most))) for _ in range(5)] + [None, ""]


def test_pieces_never_cut_a_match():
    pattern, pick = regex.compile(P.PATTERN), random.Random(1)
    for _ in range(4000):
        texts = rows(pick)
        which, strings, ends = flat.pieces(pa.array(texts))
        for i, text in enumerate(texts):
            own = [strings[k].decode() for k in which[ends[i] : ends[i + 1]]]
            assert [m for p in own for m in pattern.findall(p)] == pattern.findall(text or ""), text


def test_words_equal_plain_search():
    pick = random.Random(2)
    for _ in range(2000):
        texts = rows(pick)
        names, ends = flat.words(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            said = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
            sizes = np.array([len(x) for x in said], np.int64)
            plain = flat.hashes(np.frombuffer(b"".join(said), np.uint8), np.cumsum(sizes) - sizes, sizes) if said else np.zeros(0, np.uint64)
            assert names[ends[i] : ends[i + 1]].tolist() == plain.tolist()


def test_hashes_tell_strings_apart():
    pick = random.Random(3)
    said = list({bytes(pick.choice(b"ab\0") for _ in range(pick.randrange(1, 40))) for _ in range(5000)} | {b"x" * n for n in (255, 256, 257, 5000)})
    sizes = np.array([len(x) for x in said], np.int64)
    found = flat.hashes(np.frombuffer(b"".join(said), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert len(set(found.tolist())) == len(said)


def test_slices_and_joined():
    texts = ["abc" * 10, None, "", "x" * 500, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["k", "t"])
    parts = list(flat.slices(batch, 1, 64))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4]]
    assert list(flat.slices(batch.slice(0, 0), 1)) == []
    data, at = flat.joined([b"a", b"", b"xyz"], np.array([2, 0, 1, 2]), np.array([0, 2, 2, 4]))
    assert bytes(data)[: at[-1]] == b"xyzaxyz" and at.tolist() == [0, 4, 4, 7]
    assert flat.pieces(pa.array([None, ""]))[2].tolist() == [0, 0, 0] and flat.words(pa.array([], pa.string()))[1].tolist() == [0]
