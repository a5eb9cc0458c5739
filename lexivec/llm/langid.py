"""Language identification by a byte convolutional network, trained in numpy.

The input is a window of ``length`` UTF-8 bytes, zero-padded.  For every width of
``widths``, ``filters`` filters slide over the one-hot bytes (so a filter is a sum of table rows), pass a
rectifier and are max-pooled over the window; a softmax layer gives the languages.

Training uses a bounded sample of labelled rows: about ``max_docs`` documents, the same number of every language as far as it has
them, chosen by a hash of their id, with up to ``TAKE`` windows from each, spread over the text.  Prediction covers every text whole, in
windows that overlap by the widest filter less one, in batches; a text's probabilities are the mean over its
windows, weighted by their bytes.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is everything if no row can be
learned from; ties go to the language that sorts first; repeated rows are predicted each by itself;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.bpe import pieces

TAKE = 4


@dataclass
class ByteNet:
    languages: list[str]
    length: int
    tables: list[np.ndarray]  # per width: width x 256 x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima of all filters; with ``places`` also where they are."""
        found, at = [], []
        for table, bias in zip(self.tables, self.bias, strict=True):
            n = x.shape[1] - len(table) + 1
            y = table[0][x[:, :n]]
            for j in range(1, len(table)):
                y += table[j][x[:, j : j + n]]
            if places:
                at.append(y.argmax(1))
            found.append(y.max(1) + bias)
        return np.maximum(np.concatenate(found, axis=1), 0), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x)[0] @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], *, widths: Sequence[int], filters: int, epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 7) -> ByteNet:
    """Adam on cross-entropy.  Only the place of a maximum passes its gradient on, so the backward step is sparse."""
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
    net = ByteNet(languages, windows.shape[1], tables, [np.zeros(filters, np.float32) for _ in widths], rng.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y = windows[rows].copy(), target[rows]
            x[np.arange(x.shape[1]) >= rng.integers(16, 2 * x.shape[1], (len(x), 1))] = 0  # short texts too
            hidden, at = net.pooled(x, places=True)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (hidden > 0)
            grads = []
            for k, table in enumerate(net.tables):
                g, part = np.zeros_like(table), back[:, k * filters : (k + 1) * filters]
                for j in range(len(table)):
                    np.add.at(g[j], (np.take_along_axis(x, at[k] + j, 1), np.arange(filters)[None]), part)
                grads.append(g)
            grads += [back[:, k * filters : (k + 1) * filters].sum(0) for k in range(len(net.tables))]
            grads += [hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, (m, v) in zip(params, grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(texts: list[bytes], length: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text of each, and its bytes."""
    step = length - overlap
    count = np.array([max(1, -(-(len(t) - overlap) // step)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), count)
    out = np.zeros((len(owner), length), np.uint8)
    size = np.zeros(len(owner), np.int64)
    k = 0
    for t, n in zip(texts, count, strict=True):
        data = np.frombuffer(t, np.uint8)
        for i in range(n):
            part = data[i * step : i * step + length]
            out[k, : len(part)], size[k] = part, len(part)
            k += 1
    return out, owner, size


def fit(docs: DataFrame, *, may_learn: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id", max_docs: int = 4000, length: int = 256, widths: Sequence[int] = (2, 3, 4), filters: int = 16, epochs: int = 8) -> ByteNet | None:
    """Train on rows for which ``may_learn`` holds and ``lang`` is not null."""
    rows = docs.where(may_learn & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}"))
    # One row per language: its share of rows for an equal part of the sample.
    counts = rows.groupBy(F.col(f"`{lang}`").alias("_lang")).agg(F.count("*").alias("_n"))
    counts = {r._lang: r._n for r in counts.collect()}
    if not counts:
        return None
    part = max_docs / len(counts)
    shares = docs.sparkSession.createDataFrame([(k, int(1.2e6 * part / n) + 1) for k, n in counts.items()], "_lang string, _share long")
    place = F.pmod(F.xxhash64(F.col(f"`{id_column}`").cast("string")), F.lit(1_000_000))
    chosen = rows.join(F.broadcast(shares), F.col(f"`{lang}`") == F.col("_lang")).where(place < F.col("_share"))
    t = F.col(f"`{text}`")
    spots = [F.substring(t, F.lit(1) + F.floor(F.greatest(F.length(t) - length, F.lit(0)) * k / (TAKE - 1)).cast("int"), F.lit(length)) for k in range(TAKE)]
    sample = chosen.select(place.alias("place"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.array_distinct(F.array(*spots)).alias("parts"))
    sample = sample.orderBy("place", "id", "lang", "parts").limit(2 * max_docs).collect()  # of TAKE windows each
    languages = sorted({r.lang for r in sample})
    sample.sort(key=lambda r: (str(r.id), r.parts))
    parts = [(p.encode(), languages.index(r.lang)) for r in sample for p in r.parts]
    out = np.zeros((len(parts), length), np.uint8)
    for k, (p, _) in enumerate(parts):
        data = np.frombuffer(p[:length], np.uint8)
        out[k, : len(data)] = data
    return train(out, np.array([c for _, c in parts]), languages, widths=widths, filters=filters, epochs=epochs)


def predict(docs: DataFrame, net: ByteNet | None, *, text: str = "text", keep: Sequence[str] = ("doc_id",), batch: int = 64) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score``."""
    frame = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, 200):
                texts = part.column(part.num_columns - 1).to_pylist()
                name, score = ["und"] * len(texts), [0.0] * len(texts)
                rows = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
                if rows:
                    p = _mean(net, [texts[i].encode() for i in rows], batch)
                    for i, k in enumerate(rows):
                        best = int(p[i].argmax())
                        name[k], score[k] = net.languages[best], min(1.0, float(p[i, best]))
                columns = [pa.array(name, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], "lang_pred", "score"])

    return frame.mapInArrow(run, schema)


def _mean(net: ByteNet, texts: list[bytes], batch: int) -> np.ndarray:
    x, owner, size = windows_of(texts, net.length, max(map(len, net.tables)) - 1)
    total, weight = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    for k in range(0, len(x), batch):
        s = slice(k, k + batch)
        np.add.at(total, owner[s], net.probabilities(x[s]) * size[s, None])
        np.add.at(weight, owner[s], size[s])
    return total / weight[:, None]
