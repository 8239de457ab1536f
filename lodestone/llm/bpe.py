"""Byte-level BPE: merges as a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is the result of the merges exactly if each neighbouring pair is, so every prefix of a piece
has one last token, and the tokens of a longer text differ from those of a prefix only behind the earliest place where
some token may still be under way. The transducer keeps just that: its state is the last token given out and the bytes
behind it; a transition on a byte finds the last token of the new prefix and gives out the tokens that every possible
continuation shares. Its lookahead is bounded by the longest token. States and transitions are made when first needed and
dropped together when there are too many, so memory is bounded. Texts are taken in slices of bounded bytes; a slice is cut
where the pattern surely ends a match, and each different piece of it is encoded once.

Decoding. A machine over UTF-8 (at most three bytes are under way) reads tokens one by one and gives out the characters
that are complete; its moves are made for whole tokens when first needed.

Cases: a null or empty text has no tokens; a null ``doc_id`` and repeated rows are kept, one output row per input row;
other columns are ignored; an empty table gives an empty result; a very long text costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import flat


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


#: Stands for no token on the left.
NO_TOKEN = (1 << 20) - 1


class TokenTrie:
    """The tokens as a trie in flat arrays; children are found by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        edges, rank = {}, [-1]
        for token, r in ranks.items():
            node = 0
            for byte in token:
                if (down := edges.get(node << 8 | byte)) is None:
                    down = edges[node << 8 | byte] = len(rank)
                    rank.append(-1)
                node = down
            rank[node] = r
        self.rank = np.array(rank, np.int64)
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        bits = max(4, (4 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.down = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys, down = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        at = self._home(keys)
        while len(keys):
            # Of the keys that want a free place the last one gets it; the others go on.
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.down[at[placed]] = down[placed]
            keys, down, at = keys[~placed], down[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes below by a byte each, -1 where there is none."""
        key = node << 8 | byte
        at = self._home(key)
        out = np.where(self.keys[at] == key, self.down[at], -1)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.down[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


class MergeTransducer:
    """Tokens of one piece of text at a time; ``encode`` is the whole-piece form of ``step`` and ``end``."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 50_000):
        self.ranks, self.max_states = ranks, max_states
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.bytes_of = {NO_TOKEN: b"", **{r: t for t, r in ranks.items()}}
        self.trie: TokenTrie | None = None
        self.reset()

    def reset(self) -> None:
        # last token given out, bytes behind it, length of the last token of each prefix of them, places where a token may be under way
        self.states: list[tuple[bytes, bytes, list[int], list[int]]] = [(b"", b"", [0], [0])]
        self.known = {(b"", b""): 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ends: list[tuple[int, ...] | None] = [None]
        self.asked: dict[int, int] = {}

    def halved(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge made this one; None for a byte, and for a token that merges never make."""
        if token not in self.halves:
            parts, ranks = [token[i : i + 1] for i in range(len(token))], self.ranks
            while len(parts) > 2:
                found = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
                at = found.index(min(found))
                if found[at] == 1 << 60 or parts[at] + parts[at + 1] == token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def stands(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart when their bytes are merged.

        The merges are undone from the last to the first; at any time only the tokens on both sides of the border count:
        had they a merge with a better rank than the one undone last, it would have come first.
        """
        ranks = self.ranks
        key = (ranks[left] if left else NO_TOKEN) << 20 | ranks[right]
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 8 * self.max_states:
                self.pairs.clear()
            if not left or len(right) > 1 and self.halved(right) is None:
                known = self.pairs[key] = len(right) == 1 or self.halved(right) is not None
                return known
            known, a, b, limit = True, left, right, 1 << 60
            while True:
                if ranks.get(a + b, 1 << 60) < limit:
                    known = False
                    break
                ra, rb = (ranks[a] if len(a) > 1 else -1), (ranks[b] if len(b) > 1 else -1)
                if ra < 0 and rb < 0:
                    break
                # Of equal merges the left one comes first, so it is undone last.
                if ra > rb:
                    limit, a = ra, self.halved(a)[1]
                else:
                    limit, b = rb + 1, self.halved(b)[0]
            self.pairs[key] = known
        return known

    @staticmethod
    def _path(lasts: list[int], n: int) -> list[int]:
        out = []
        while n > 0:
            out.append(n)
            n -= lasts[n]
        return out[::-1]

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens given out."""
        if (move := self.moves[state].get(byte)) is not None:
            return move
        before, pending, lasts, live = self.states[state]
        text = pending + bytes((byte,))
        n, lasts, ranks = len(text), [*lasts, 0], self.ranks
        for i in live:
            if text[i:] in ranks and self.stands(text[i - lasts[i] : i] if i else before, text[i:]):
                lasts[n] = n - i
                break
        live = [i for i in live if text[i:] in self.starts]
        if lasts[n]:
            live.append(n)
        cut, out, last = 0, [], before
        if live and live[0]:
            shared = self._path(lasts, live[0])
            for i in live[1:]:
                path = self._path(lasts, i)
                same = 0
                while same < min(len(shared), len(path)) and shared[same] == path[same]:
                    same += 1
                shared = shared[:same]
            for end in shared:
                last = text[cut:end]
                out.append(ranks[last])
                cut = end
        key = last, text[cut:]
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.states)
            rest = [0, *(0 if x > i else x for i, x in enumerate(lasts[cut + 1 :], 1))]
            self.states.append((*key, rest, [i - cut for i in live]))
            self.moves.append({})
            self.ends.append(None)
        move = self.moves[state][byte] = at, tuple(out)
        return move

    def end(self, state: int) -> tuple[int, ...]:
        """The tokens of what is under way where the piece ends."""
        if (out := self.ends[state]) is None:
            _, text, lasts, _ = self.states[state]
            cut, got = 0, []
            for end in self._path(lasts, len(text)):
                got.append(self.ranks[text[cut:end]])
                cut = end
            out = self.ends[state] = tuple(got)
        return out

    def _span(self, text: bytes, at: int) -> int:
        """Bytes that the longest token from a place may have."""
        left = len(text) - at
        if left <= 16:
            return left
        size = 1
        while size < left and text[at : at + size] in self.starts:
            size += 1
        return size

    def simulate(self, state: int, rest: bytes) -> tuple[int, ...]:
        """The tokens of what is under way and of the rest of a piece, without making states.

        As neighbours decide alone, a search for tokens that all stand beside each other has one outcome; it takes the
        longest first and steps back from places from which no token goes on.
        """
        left, pending, _, _ = self.states[state]
        text, ranks, stands = pending + rest, self.ranks, self.stands
        n, at, closed, out = len(text), 0, set(), [left]
        size = self._span(text, 0)
        while at < n:
            while size:
                token = text[at : at + size]
                if token in ranks and at + size not in closed and stands(left, token):
                    break
                size -= 1
            if size:
                out.append(token)
                left = token
                at += size
                size = self._span(text, at)
            else:
                closed.add(at)
                size = len(out.pop())
                at, left = at - size, out[-1]
                size -= 1
        return tuple([ranks[x] for x in out[1:]])

    def tokens_at(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, bytes, rank) of all tokens that stand anywhere in the bytes; room: bytes from each place to the end of its piece."""
        at, node, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
        size = 0
        while len(at):
            node = self.trie.child(node, flat[at + size])
            size += 1
            keep = node >= 0
            at, node = at[keep], node[keep]
            token = self.trie.rank[node]
            is_token = token >= 0
            found.append((at[is_token], np.full(int(is_token.sum()), size), token[is_token]))
            keep = room[at] > size
            at, node = at[keep], node[keep]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pieces, four bytes each: the machine goes over all of them at once, a byte a round.

        Before each byte the state of a piece is the last token of each of its prefixes; the tokens that end with the byte
        are under way from their places, and the one that stands beside the last token there is the last of the new prefix.
        """
        if self.trie is None:
            self.trie = TokenTrie(self.ranks)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(length) - length
        piece = np.repeat(np.arange(len(pieces)), length)
        offset = np.arange(len(flat)) - begin[piece]
        at, size, token = self.tokens_at(flat, length[piece] - offset)
        # Slots: one for each prefix, the empty one included.
        slot, end = at + piece[at], offset[at] + size
        order = np.argsort(end, kind="stable")
        slot, size, token = slot[order], size[order], token[order]
        rounds = np.searchsorted(end[order], np.arange(1, int(length.max(initial=0)) + 2)).tolist()
        last = np.full(len(flat) + len(pieces), NO_TOKEN, np.int64)
        get, bytes_of, stands = self.pairs.get, self.bytes_of, self.stands
        for a, b in zip(rounds, rounds[1:]):  # noqa: B905
            keys = (last[slot[a:b]] << 20 | token[a:b]).tolist()
            fits = list(map(get, keys))
            if None in fits:
                fresh = {k: stands(bytes_of[k >> 20], bytes_of[k & NO_TOKEN]) for k in {k for k, x in zip(keys, fits, strict=True) if x is None}}
                fits = [fresh[k] if x is None else x for k, x in zip(keys, fits, strict=True)]
            good = np.flatnonzero(fits) + a
            last[slot[good] + size[good]] = token[good]
        # Back from the end of each piece, a token a round.
        first = begin + np.arange(len(pieces))
        now, who, steps = first + length, np.arange(len(pieces)), []
        while len(who):
            more = now > first[who]
            now, who = now[more], who[more]
            steps.append((who, last[now]))
            now = now - self.trie.size[last[now]]
        owner, ids = np.concatenate([x[0] for x in steps[::-1]] or [[]]), np.concatenate([x[1] for x in steps[::-1]] or [[]])
        order = np.argsort(owner, kind="stable")
        data = ids[order].astype("<i4").tobytes()
        ends = (4 * np.searchsorted(owner[order], np.arange(len(pieces) + 1))).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A transition is made when it is needed for the fourth time; until then the rest of the piece is simulated."""
        if len(self.states) > self.max_states or len(self.asked) > 8 * self.max_states:
            self.reset()
        state, out, moves, asked = 0, [], self.moves, self.asked
        for at, byte in enumerate(piece):
            if (move := moves[state].get(byte)) is None:
                key = state << 8 | byte
                if (times := asked.get(key, 0)) < 3:
                    asked[key] = times + 1
                    return (*out, *self.simulate(state, piece[at:]))
                move = self.step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return (*out, *self.end(state))


class Encoder:
    """Whole texts: the pattern's matches, each through the transducer; what different pieces gave is kept within a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_known: int = 300_000, longest: int = 48, **bounds: int):
        import regex

        self.machine, self.matches = MergeTransducer(ranks, **bounds), regex.compile(pattern)
        self.known: dict[bytes, bytes] = {}
        self.max_known, self.longest = max_known, longest

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, four bytes each."""
        out: list[bytes] = [b""] * len(pieces)
        whole, several = [], []
        for i, x in enumerate(pieces):
            # Letters, with a blank before them or not, are one match.
            (whole if len(x) <= self.longest and x[1:].isalpha() and (x[:1].isalpha() or x[:1] == b" ") else several).append(i)
        parts = [[x.encode() for x in self.matches.findall(pieces[i].decode())] for i in several]
        short = [x for found in parts for x in found if len(x) <= self.longest]
        done = iter(self.machine.encode_many([*(pieces[i] for i in whole), *short]))
        for i in whole:
            out[i] = next(done)
        for i, found in zip(several, parts, strict=True):
            out[i] = b"".join([next(done) if len(x) <= self.longest else np.array(self.machine.encode(x), "<i4").tobytes() for x in found])
        return out

    def encode_rows(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the rows of an Arrow column; those of row i from ends[i] to ends[i + 1]."""
        which, strings, ends = flat.pieces(column)
        known, longest = self.known, self.longest
        found = list(map(known.get, strings))
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            for i, value in zip(part, self.encode_pieces([strings[i] for i in part]), strict=True):
                found[i] = value
                if len(strings[i]) <= longest:
                    if len(known) >= self.max_known:
                        known.clear()
                    known[strings[i]] = value
        data, at = flat.joined(found, which, ends)
        return np.frombuffer(data, "<i4"), at // 4

    def encode(self, text: str) -> list[int]:
        import pyarrow as pa

        return self.encode_rows(pa.array([text], pa.large_string()))[0].tolist()


class Utf8Machine:
    """The states of UTF-8 decoding are the bytes of a character under way; malformed bytes become U+FFFD."""

    @staticmethod
    def needed(first: int) -> int:
        return 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0

    @staticmethod
    def follows(under_way: bytes, byte: int) -> bool:
        if len(under_way) == 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(under_way[0], (0x80, 0xBF))
            return low <= byte <= high
        return 0x80 <= byte <= 0xBF

    @classmethod
    def feed(cls, under_way: bytes, data: bytes) -> tuple[bytes, str]:
        out = []
        for byte in data:
            if under_way and not cls.follows(under_way, byte):
                out.append("�")
                under_way = b""
            if under_way:
                under_way += bytes((byte,))
            elif cls.needed(byte):
                under_way = bytes((byte,))
            else:
                out.append("�")
                continue
            if len(under_way) == cls.needed(under_way[0]):
                out.append(under_way.decode())
                under_way = b""
        return under_way, "".join(out)


class StreamDecoder:
    """Tokens in, characters out as soon as they are complete."""

    def __init__(self, ranks: dict[bytes, int], max_moves: int = 100_000):
        import pyarrow as pa

        self.bytes_of = {i: t for t, i in ranks.items()}
        self.max_moves = max_moves
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.whole: dict[int, str] = {}
        for i, t in self.bytes_of.items():
            state, text = Utf8Machine.feed(b"", t)
            if not state and "�" not in text:
                self.whole[i] = text
        top = max(self.bytes_of, default=-1) + 1
        self.said = pa.array([self.bytes_of.get(i, b"") for i in range(top)], pa.large_binary())
        self.decimal = pa.array([b"%d " % i for i in range(top)], pa.large_binary())
        self.is_partial = np.ones(top, bool)
        self.is_partial[list(self.whole)] = False

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = b""
        moves, whole = self.moves, self.whole
        for i in ids:
            if not state and (text := whole.get(i)) is not None:
                yield text
                continue
            if (move := moves.get((state, i))) is None:
                if len(moves) > self.max_moves:
                    moves.clear()
                move = moves[state, i] = Utf8Machine.feed(state, self.bytes_of[i])
            state = move[0]
            yield move[1]
        if state:
            yield "�"

    def decode(self, ids: list[int]) -> str:
        parts = list(map(self.whole.get, ids))
        return "".join(self.stream(ids) if None in parts else parts)

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The bytes of each row. Tokens of whole characters leave the machine where it is, so their rows need no moves."""
        data, at = flat.joined(self.said, ids, ends)
        partial = np.concatenate([[0], np.cumsum(self.is_partial[ids])])[ends]
        for i in range(len(ends) - 1):
            if partial[i] == partial[i + 1]:
                yield memoryview(data)[at[i] : at[i + 1]]
            else:
                yield self.decode(ids[ends[i] : ends[i + 1]].tolist()).encode()


_built: dict[tuple[str, str], tuple[Encoder, StreamDecoder]] = {}


def built(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One encoder and decoder for each vocabulary and process."""
    if (path, pattern) not in _built:
        ranks = load_ranks(path)
        _built[path, pattern] = Encoder(ranks, pattern), StreamDecoder(ranks)
    return _built[path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``ids``, an array of token ids."""
    import pyarrow as pa

    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches):
        encoder, _ = built(path, pattern)
        for batch in batches:
            for part in flat.slices(batch, 1):
                ids, ends = encoder.encode_rows(part.column(1))
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(encode, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of the decimal ids and of the bytes decoded from them."""
    import pyarrow as pa

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digest(batches):
        encoder, decoder = built(path, pattern)
        for batch in batches:
            for part in flat.slices(batch, 1):
                ids, ends = encoder.encode_rows(part.column(1))
                data, at = flat.joined(decoder.decimal, ids, ends)
                data = memoryview(data)
                of_ids = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                of_text = [hashlib.sha256(x).hexdigest() for x in decoder.decode_rows(ids, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(digest, schema)
