"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list.

The entropy of a window is kept by incremental counts: moving the window by one character changes two counts, so a
candidate of n characters costs n steps whatever the window. No pattern of the allow-list backtracks by more than a constant
times the length of a candidate. Rows never leave their partition; memory is one slice of an Arrow batch.

Cases: a null or empty text has no spans; a null ``doc_id`` and repeated rows are kept, one output row per input row; other
columns are ignored; an empty table gives an empty result; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.flat import slices

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
ORDER = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class EntropyClass:
    """A class of characters; a window of its characters with at least so many bits a character is suspicious."""

    kind: str
    pattern: re.Pattern
    bits: float
    window: int = 20


#: The first class whose pattern holds a whole candidate judges it.
CLASSES = (
    EntropyClass("entropy_hex", re.compile(r"[0-9a-fA-F]+"), 2.8),
    EntropyClass("entropy_alnum", re.compile(r"[A-Za-z0-9]+"), 3.6),
    EntropyClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8),
)
#: Candidates that are known not to be secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9_/=+-]+"),  # numbers and rules
    re.compile(r"[A-Za-z][A-Za-z\-_/+=]*"),  # words, joined or not
    re.compile(r".*(?:EXAMPLE|example|placeholder|changeme|xxxxxx|XXXXXX).*"),
    re.compile(r".*(?:abcdefghij|ABCDEFGHIJ|0123456789|1234567890).*"),
    re.compile(r"(.{1,8}?)\1+.{0,8}"),  # repetitions; at most eight units, each tried once along the value
)


def window_entropy(value: str, window: int) -> Iterator[tuple[int, float]]:
    """(start, bits a character) of each window, by incremental counts."""
    counts: dict[str, int] = {}
    # entropy = log2(n) - sum(c * log2(c)) / n
    total, scale = 0.0, log2(window)
    term = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    for at, char in enumerate(value):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if at >= window:
            old = value[at - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if at >= window - 1:
            yield at - window + 1, scale - total / window


def entropy_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end): the unions of suspicious windows."""
    found: list[tuple[int, str, int]] = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if any(x.fullmatch(value) for x in ALLOWED):
            continue
        rule = next(c for c in CLASSES if c.pattern.fullmatch(value))
        start = end = -1
        for at, bits in window_entropy(value, rule.window):
            part = value[at : at + rule.window]
            if bits < rule.bits or part.isalpha() or part.isdigit():
                continue
            if start >= 0 and at > end:
                found.append((m.start() + start, rule.kind, m.start() + end))
                start = -1
            start, end = (at if start < 0 else start), at + rule.window
        if start >= 0:
            found.append((m.start() + start, rule.kind, m.start() + end))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[1]]))


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and all spans; a span by entropy inside a base span adds nothing and is left out."""
    text = text or ""
    base, more = base_spans(text), []
    # Both lists go by start: a span is inside a base span if one that begins no later ends no earlier.
    at, reach = 0, -1
    for x in entropy_spans(text):
        while at < len(base) and base[at][0] <= x[0]:
            reach = max(reach, base[at][2])
            at += 1
        if x[2] > reach:
            more.append(x)
    return base, sorted(base + more, key=lambda x: (x[0], ORDER[x[1]]))


def redact(text: str | None, mask: str = "<secret>") -> str | None:
    """The text with each maximal run of spans replaced by the mask."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``spans``, an array of (start, kind, end, base) by start and kind."""
    import pyarrow as pa

    schema = T.StructType([docs.schema[key], T.StructField("spans", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())]))

    def spans(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for x in part.column(1).to_pylist():
                    base, every = scan(x)
                    known = set(base)
                    rows.append([{"start": s, "kind": k, "end": e, "base": (s, k, e) in known} for s, k, e in every])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(spans, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The spans as counts and strings."""
    spans = scan_secrets(docs)
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["base"]), said), ",")
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with the spans of every text masked, and its length where that column is present."""
    import pyarrow as pa

    columns = docs.columns
    at = columns.index(text)

    def masked(batches):
        for batch in batches:
            for part in slices(batch, at):
                new = pa.array([redact(x) for x in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    out = docs.mapInArrow(masked, docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in columns else out

