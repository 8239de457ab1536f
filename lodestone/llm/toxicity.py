"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Fitting, on a bounded sample of the labelled rows that are not held out:
1. Byte grams are counted by the number of different left contexts they stand in, in toxic and in ordinary texts, so that a
   passage copied many times counts once. Stretches of toxic texts made of grams that are far more usual there are the
   toxic training text.
2. One dictionary is trained on those stretches, one on windows of ordinary texts. The toxic compressor gets the ordinary
   content too, so windows without toxic stretches cost it the same and the difference of the lengths is the signal.
3. The shares of windows whose difference passes each threshold, and its mean, maximum and upper mean, are weighed by a
   logistic model fitted on sampled texts that the dictionaries have not seen, at the label frequencies of the table.
Scoring reads the text alone, window by window, on the executors; the model has a fixed size.

Cases: a null or empty text has no window above a threshold and gets the score of an ordinary text without signs; a null
``doc_id`` is not held out; rows that share a ``doc_id`` are scored one by one; labels of one ``doc_id`` that differ count
as toxic; null labels are left out; where the labels lack a class, all scores are 0; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.flat import give_back, slices

WINDOW, STEP, GRAM, CONTEXT = 48, 36, 5, 4
LEVELS = (1, 2, 3, 4, 5, 6)


@dataclass(frozen=True)
class FitBounds:
    """Bounds of the sample that the model is fitted on, and of its parts."""

    toxic_docs: int = 2500
    ordinary_docs: int = 5000
    #: Longer texts are not sampled; all texts are scored.
    longest_bytes: int = 20_000
    dictionary_windows: int = 60_000
    ordinary_bytes: int = 24_000
    toxic_bytes: int = 6_000
    min_contexts: int = 24
    min_ratio: float = 25.0
    #: Share of the sample kept from the dictionaries, for the weights.
    calibration: float = 0.4
    #: Folds of held-out rows: crc32(doc_id as text) mod folds = 0.
    folds: int = 5


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @property
    def fitted(self) -> bool:
        return bool(self.weights)


def held_out(key: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def folded(text: str | None) -> bytes:
    return (text or "").encode().lower()


def windows(data: bytes) -> list[bytes]:
    """Windows that overlap by more than most words, so that a word is whole in one of them."""
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)] if data else []


def compressor(content: bytes) -> zs.ZstdCompressor:
    parameters = zs.ZstdCompressionParameters.from_level(
        6, source_size=WINDOW, dict_size=len(content), format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def lengths(how: zs.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    out = how.multi_compress_to_buffer(parts, threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int32, len(out))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.toxic + model.ordinary)

    def features(self, text: str | None) -> list[float]:
        parts = windows(folded(text))
        if not parts:
            return [0.0] * (len(LEVELS) + 4)
        less = lengths(self.ordinary, parts) - lengths(self.toxic, parts)
        upper = np.partition(less, len(less) - (k := max(1, len(less) // 20)))[-k:]
        return [float((less >= x).mean()) for x in LEVELS] + [float(less.mean()), float(less.max()), float(upper.mean()), float(np.log1p((less >= 4).sum()))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -30, 30)))


def _grams(data: bytes) -> np.ndarray:
    """Each gram as an integer of forty bits, with spaces around the text."""
    x = np.frombuffer(b" " * CONTEXT + data + b" " * GRAM, np.uint8).astype(np.uint64)
    m = len(x) - GRAM - CONTEXT + 1
    gram = np.zeros(m, np.uint64)
    for j in range(GRAM):
        gram = (gram << np.uint64(8)) | x[CONTEXT + j : CONTEXT + j + m]
    return gram


def _befores(data: bytes) -> np.ndarray:
    """24 bits of a hash of the bytes before each gram."""
    x = np.frombuffer(b" " * CONTEXT + data + b" " * GRAM, np.uint8).astype(np.uint64)
    m = len(x) - GRAM - CONTEXT + 1
    before = np.zeros(m, np.uint64)
    for j in range(CONTEXT):
        before = (before << np.uint64(8)) | x[j : j + m]
    return (before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams, and in how many contexts each stands; gram and context share a number, so memory is eight bytes a byte and a copy."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.empty(sum(len(t) + 1 for t in texts), np.uint64)
    at = 0
    for t in texts:
        one = (_grams(t) << np.uint64(24)) | _befores(t)
        both[at : at + len(one)] = one
        at += len(one)
    both.sort()
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    gram = both[keep] >> np.uint64(24)
    del both, keep
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[start], np.diff(np.r_[start, len(gram)])


def _stretches(texts: list[bytes], wanted: np.ndarray) -> list[bytes]:
    out = []
    for data in texts:
        at = np.flatnonzero(np.isin(_grams(data), wanted))
        if len(at):
            first = np.r_[True, np.diff(at) > 1]
            out += [data[max(0, a - 1) : e + GRAM + 1] for a, e in zip(at[first], at[np.r_[first[1:], True]], strict=True)]
    return out


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """The content of a dictionary trained on the samples; very small samples are their own dictionary."""
    try:
        raw = zs.train_dictionary(size, samples, k=k, d=6, level=6).as_bytes()
        return raw[-max(256, len(raw) - 1024) :]  # the content follows the entropy tables
    except zs.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method, with a ridge on all but the constant."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], toxic_share: float, bounds: FitBounds = FitBounds()) -> Model:
    """A model from sampled texts of both classes; toxic_share: of all labelled rows."""
    if len(toxic) < 5 or len(ordinary) < 5:
        return Model()
    cut_t, cut_o = (max(2, int(len(x) * (1 - bounds.calibration))) for x in (toxic, ordinary))
    t, o = [folded(x) for x in toxic[:cut_t]], [folded(x) for x in ordinary[:cut_o]]
    (gt, ct), (go, co) = _contexts(t), _contexts(o)
    at = np.minimum(np.searchsorted(go, gt), max(0, len(go) - 1))
    known = np.where(go[at] == gt, co[at], 0) if len(go) else np.zeros(len(gt), np.int64)
    ratio = (ct / max(1, ct.sum())) / ((known + 1) / max(1, co.sum()))
    low = min(bounds.min_contexts, max(2, cut_t // 30))
    stretches = _stretches(t, gt[(ct >= low) & (ratio >= min(bounds.min_ratio, max(2.0, cut_t / 30)))])
    plain = [w for data in o for w in windows(data)]
    plain = plain[:: max(1, len(plain) // bounds.dictionary_windows)]
    model = Model(_trained(bounds.ordinary_bytes, plain, 32), _trained(bounds.toxic_bytes, stretches or [b" " * 8], 16))
    scorer = Scorer(model)
    x = np.array([scorer.features(s) for s in [*toxic[cut_t:], *ordinary[cut_o:]]])
    y = np.r_[np.ones(len(toxic) - cut_t), np.zeros(len(ordinary) - cut_o)]
    weight = np.where(y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum())) * len(y)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.mean, model.scale = mean.tolist(), scale.tolist()
    model.weights = _logistic((x - mean) / scale, y, weight).tolist()
    return model


def fit_table(docs: DataFrame, labels: DataFrame, bounds: FitBounds = FitBounds()) -> Model:
    """Sample labelled rows outside the held-out fold by the order of a hash, and fit on the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), bounds.folds))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for kind, n in ((1, bounds.toxic_docs), (0, bounds.ordinary_docs)):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    # At most toxic_docs + ordinary_docs ids: a broadcast of bounded size.
    rows = (
        docs.where(F.octet_length("text") <= bounds.longest_bytes)
        .join(F.broadcast(picked), "doc_id")
        .select("text", "toxic", F.xxhash64("doc_id").alias("h"))
        .toPandas()
        .sort_values(["h", "text"])
    )
    return fit(
        rows.text[rows.toxic == 1].tolist(), rows.text[rows.toxic == 0].tolist(), totals.get(1, 0) / max(1, totals.get(1, 0) + totals.get(0, 0)), bounds
    )


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = model.toxic + repr(model.weights).encode()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column ``_score``."""
    import pyarrow as pa

    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])

    def score(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                found = _scorer(model).scores(texts) if model.fitted and texts else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=schema.names)
            give_back()

    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, bounds: FitBounds = FitBounds()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score_table(docs.select("doc_id", "text"), fit_table(docs, labels, bounds))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), bounds.folds).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, bounds: FitBounds = FitBounds()) -> DataFrame:
    """The rows of docs, in their own columns, that are not predicted toxic."""
    return score_table(docs, fit_table(docs, labels, bounds)).where("_score < 0.5").drop("_score")
