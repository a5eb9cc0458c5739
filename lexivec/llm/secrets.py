"""Secret scan: fixed patterns, and a battery of randomness tests for what has no pattern.

Base spans (whole matches, leftmost and non-overlapping per kind, code points):
``assign`` key=value pairs, ``access`` key ids, ``hex`` runs.

The battery looks at every other run of 16 or more encoding characters, whole texts:

1. the encoding is the smallest alphabet of ``ENCODINGS`` that holds the run;
2. chi-squared statistic against a uniform alphabet, Wald-Wolfowitz runs above and below the middle symbol, and lag-one
   serial correlation;
3. how often would text, symbols drawn by their frequency in all texts, look so random?  Those frequencies give, per encoding and
   length, mean and deviation of the chi-squared statistic, and so its normal score; the scores of the runs and the
   correlation are those of their p-values, high where a run has structure.  The three are combined by Stouffer's
   method with the weights 1, ``WEIGHT`` and ``WEIGHT`` to one score;
4. Benjamini-Hochberg at ``fdr``, separately by doubling length, on counts of the scores over all documents.

Only counts (at most strata x bins) reach the driver.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each by itself; an
empty table gives an empty result; a candidate that touches a base span is left to it.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.bpe import pieces
from lexivec.llm.common import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_low, _up, _dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
ENCODINGS = (_dig, _dig + "abcdef", _dig + "ABCDEF", _low, _up, _up + "234567", _low + _dig, _up + _dig, _low + _up, _low + _up + _dig, _low + _up + _dig + "+/", _low + _up + _dig + "-_", _low + _up + _dig + "+/-_")
SYMBOLS = [np.array([e.find(chr(c)) for c in range(128)]) for e in ENCODINGS]
WEIGHT = 0.5  # of the scores of runs and correlation; that of chi-squared is 1
BIN = 20  # of the score, per unit


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, end and place in ``KINDS``."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in KEYS):
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, float]]:
    """Start, end, encoding, chi-squared statistic and the sum of the scores of runs and correlation."""
    out = []
    starts = [s for s, _, _ in taken]  # sorted
    ends = list(accumulate((e for _, e, _ in taken), max))
    for m in RUN.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)
        if before and ends[before - 1] > a:
            continue
        codes = np.frombuffer(m[0].encode(), np.uint8)
        k = next(k for k, s in enumerate(SYMBOLS) if s[codes].min() >= 0)
        out.append((a, b, k, *battery(SYMBOLS[k][codes], len(ENCODINGS[k]))))
    return out


def battery(x: np.ndarray, size: int) -> tuple[float, float]:
    """Chi-squared statistic, and the normal scores of how random runs and correlation look, summed."""
    n = len(x)
    counts = np.bincount(x, minlength=size)
    chi = float(size / n * (counts**2).sum() - n)
    above = x * 2 >= size
    n1 = int(above.sum())
    n2 = n - n1
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z = (1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9))
        runs = math.erfc(abs(z) / math.sqrt(2))
    else:
        runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / power if power else 1.0
    serial = math.erfc(abs(r) * math.sqrt(n) / math.sqrt(2))
    return chi, score_of(runs) + score_of(serial)


def score_of(p: float) -> float:
    """The normal score of ``1 - p``; few runs make p discrete, so what looks most random counts as one in twenty."""
    return NormalDist().inv_cdf(min(max(1 - p, 0.05), 1 - 1e-12))


SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "kind")]))
CANDIDATE = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "enc")] + [T.StructField(n, T.DoubleType()) for n in ("chi", "order")])
)


def extract(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``_base``, ``_found`` and, in one row of each batch, ``_chars``: the ASCII counts of its texts."""
    frame = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType(
        [*frame.schema.fields[:-1], T.StructField("_base", SPAN), T.StructField("_found", CANDIDATE), T.StructField("_chars", T.ArrayType(T.LongType()))]
    )
    kinds = [pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "kind")])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("enc", pa.int32()), ("chi", pa.float64()), ("order", pa.float64())])), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                base, found, chars = [], [], np.zeros(256, np.int64)
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    spans = base_spans(t or "")
                    base.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans])
                    found.append([dict(zip(("start", "end", "enc", "chi", "order"), c, strict=True)) for c in candidates(t or "", spans)])
                    chars += np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)
                counts = [chars[:128].tolist()] + [None] * (len(base) - 1)
                columns = [pa.array(v, k) for v, k in zip((base, found, counts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "_base", "_found", "_chars"])

    return frame.mapInArrow(run, schema)


def text_moments(chars: np.ndarray) -> list[tuple[float, float]]:
    """For each encoding: sums of squares and cubes of the symbol frequencies in text."""
    out = []
    for e in ENCODINGS:
        f = np.array([chars[ord(c)] for c in e], float) + 1
        f /= f.sum()
        out.append((float((f**2).sum()), float((f**3).sum())))
    return out


def _z(c: Column, moments: list[tuple[float, float]]) -> Column:
    """The combined score; the more negative, the more random."""
    n = (c["end"] - c["start"]).cast("double")
    size, m2, m3 = (F.get(F.array(*[F.lit(float(v)) for v in x]), c["enc"]) for x in ([len(e) for e in ENCODINGS], [m[0] for m in moments], [m[1] for m in moments]))
    mean = size * (1 - m2) + n * (size * m2 - 1)
    var = 4 * n * size * size * (m3 - m2 * m2) + 2 * (size - 1)
    return ((c["chi"] - mean) / F.sqrt(var) + WEIGHT * c["order"]) / math.sqrt(1 + 2 * WEIGHT**2)


def _stratum(c: Column) -> Column:
    return F.floor(F.log2((c["end"] - c["start"]).cast("double"))).cast("int")


def thresholds(counts: list[tuple[int, int, int]], fdr: float) -> dict[int, float]:
    """Largest score bin edge of each stratum at which Benjamini-Hochberg still accepts.
    ``counts``: stratum, bin, candidates."""
    out = {}
    for s in {c[0] for c in counts}:
        rows = sorted(c[1:] for c in counts if c[0] == s)
        total, accepted = sum(r[1] for r in rows), 0
        for b, n in rows:
            accepted += n
            edge = (b + 1) / BIN
            if edge < 0 and 0.5 * math.erfc(-edge / math.sqrt(2)) * total <= fdr * accepted:
                out[s] = edge
    return out


def secret_spans(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), fdr: float = 0.05) -> DataFrame:
    """``keep``, ``base`` and ``spans``: arrays of start, end and kind (place in ``KINDS``), by start, then kind."""
    found = written(extract(docs, text=text, keep=keep))
    chars = np.zeros(128)
    for r in found.select(F.posexplode("_chars").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # 128 rows
        chars[r.i] = r.n
    moments = text_moments(chars)
    one = found.select(F.explode("_found").alias("c"))
    # Scores have some thousand bins and length some ten strata, for any input.
    score = F.floor(_z(F.col("c"), moments) * BIN).cast("int")
    binned = one.select(_stratum(F.col("c")).alias("s"), F.least(F.greatest(score, F.lit(-2000)), F.lit(2000)).alias("b"))
    counts = binned.groupBy("s", "b").agg(F.count("*").alias("n")).collect()
    limits = thresholds([(r.s, r.b, r.n) for r in counts], fdr)
    edge = lambda c: _limit(_stratum(c), limits)
    more = F.filter("_found", lambda c: _z(c, moments) < edge(c))
    more = F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("kind")))
    every = F.transform(
        F.sort_array(F.transform(F.concat("_base", more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return found.select(*[F.col(f"`{k}`") for k in keep], F.col("_base").alias("base"), every.alias("spans"))


def _limit(stratum: Column, limits: dict[int, float]) -> Column:
    out = F.lit(-1e9)
    for s, z in limits.items():
        out = F.when(stratum == s, F.lit(z)).otherwise(out)
    return out


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one mark.  One pass over the spans."""

    def replaced(texts: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for t, flat in zip(texts, edges, strict=True):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for a, b in zip(flat[::2].tolist(), flat[1::2].tolist(), strict=True):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    some = F.size(spans) > 0
    edges = F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"])))
    return F.when(some, F.pandas_udf(replaced, "string")(F.when(some, text), F.when(some, edges))).otherwise(text)
