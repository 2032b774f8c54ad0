"""Language of whole texts: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text in lower case, everything but letters as one blank, is a bag of hashed byte n-grams (2 to 4). Its vector is the mean of
their embeddings; a linear softmax over it gives the language. Both are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows: the `per_language` rows of smallest hash of each
language, fewer where there are so many languages that MOST_ROWS would be passed, and an error where not even one row of each
would be left. Every language of the labels is learned. Texts become bags where they are; only bags reach the driver. A fifth of the sample is kept out of training; on it a temperature is fitted, so that the score is a
probability, and the threshold under which a prediction is rejected: the largest one, 0.5 at most, that
rejects no more than `lost` of its right predictions.

Edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; if there are no labelled rows,
everything is `und`; repeated rows give repeated rows; a very long text is read whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormshift.llm._encode import release
from stormshift.llm._shared import checked_broadcast, written

BUCKETS, DIMENSIONS, GRAMS = 1 << 12, 24, (2, 3, 4)
MOST_ROWS = 12_000  # labelled rows that may reach the driver, as two bags each of BUCKETS numbers at most
PREDICTIONS = "lang_pred string, score double, rejected boolean"
_OTHER = re.compile(r"[\W\d_]+")


def bag(text: str) -> np.ndarray | None:
    """Relative frequencies of the hashed n-grams; None if there is no letter."""
    s = _OTHER.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, s)):
        return None
    b = np.frombuffer(f" {s} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ b[i : len(b) - n + 1 + i]) * np.uint32(0x01000193)
            found.append((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    return (counts / counts.sum()).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = [("und", 0.0, True)] * len(texts)
        for k in range(0, len(texts) if self.languages else 0, 256):  # a bag is dense: few at a time
            part = [(i, x) for i, t in enumerate(texts[k : k + 256], k) if t and (x := bag(t)) is not None]
            if not part:
                continue
            p = _softmax((np.stack([x for _, x in part]) @ self.table + self.bias) / self.temperature)
            for (i, _), row in zip(part, p):
                best = int(row.argmax())
                out[i] = (self.languages[best], float(row[best]), bool(row[best] < self.threshold))
        return out


def sparse(x: np.ndarray | None) -> tuple[bytes, bytes] | None:
    """The numbers of a bag that are not 0: places and values."""
    if x is None:
        return None
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes(), x[at].tobytes()


def dense(bags: list[tuple[bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(bags), BUCKETS), np.float32)
    for row, (at, values) in zip(out, bags):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(values, np.float32)
    return out


def lesson(text: str, seed: int) -> list[tuple[bytes, bytes] | None]:
    """Bags of a text and of a window of 4 to 40 of its words, so that short texts are learned too."""
    draw, words = np.random.default_rng(seed & (2**63 - 1)), text.split()
    n = int(draw.integers(4, 41))
    at = int(draw.integers(0, max(1, len(words) - n)))
    return [sparse(bag(part)) for part in (text, " ".join(words[at : at + n]))]


def train(lessons: list[list], labels: list[str], epochs: int = 12, rate: float = 0.4, lost: float = 0.001, seed: int = 7) -> Model:
    """lessons: for each row its bags; every fifth row is kept out of training."""
    draw = np.random.default_rng(seed)
    languages = sorted(set(labels))
    found = [(x, languages.index(label), i % 5 == 4) for i, (own, label) in enumerate(zip(lessons, labels)) for x in own if x is not None]
    if not found:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.5)
    bags, y, valid = [x for x, *_ in found], np.array([t for _, t, _ in found]), np.array([v for *_, v in found])
    rows = lambda at: dense([bags[i] for i in at])
    own = np.flatnonzero(~valid)
    e = draw.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    scale = np.float32(30.0)  # mean embeddings are small: as if the rate were larger
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = draw.permutation(own)
        for k in range(0, len(order), 64):
            at = order[k : k + 64]
            f = rows(at) * scale
            v = f @ e
            g = _softmax(v @ w + b)
            g[np.arange(len(at)), y[at]] -= 1
            g /= len(at)
            dw, dv = v.T @ g, g @ w.T
            w -= step * dw
            b -= step * g.sum(0)
            e -= step * (f.T @ dv)
    table = scale * (e @ w)
    tried = np.flatnonzero(valid) if valid.any() else np.arange(len(y))
    z, t = np.concatenate([rows(tried[k : k + 512]) @ table + b for k in range(0, len(tried), 512)]), y[tried]
    fits = [(-np.log(np.maximum(_softmax(z / k)[np.arange(len(t)), t], 1e-12)).mean(), k) for k in np.geomspace(0.25, 8, 26)]
    temperature = float(min(fits)[1])
    p = _softmax(z / temperature)
    right = np.sort(p.max(1)[p.argmax(1) == t])
    threshold = min(0.5, float(right[int(lost * len(right))])) if len(right) else 0.0
    return Model(languages, table, b, temperature, threshold)


def fit(docs: DataFrame, per_language: int = 600, most_rows: int = MOST_ROWS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """A model of labelled rows of docs, of every language among them. At most most_rows rows reach the driver, as bags.

    Counts per language come first; they give each language a hash limit that about twice its rows stay under, so that what is
    dealt by language is as little for a large corpus as for a small one.
    """
    rows = docs.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.xxhash64(id_column).alias("h")).where("lang is not null and text is not null")
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if languages > most_rows:
        raise ValueError(f"{languages} languages, but only {most_rows} rows may be learned from")
    own = min(per_language, most_rows // max(1, languages))
    limit = counts.select("lang", F.least(F.lit(1.0), 2.0 * own / F.col("n")).alias("limit"))
    rows = rows.join(checked_broadcast(limit, languages), "lang").where(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < F.col("limit"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= own).select("lang", "h", "text")

    def learn(batches):
        for batch in batches:
            bags = [lesson(text, h) for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist())]
            parts = [pa.array([x and x[k] for x in column], pa.binary()) for column in zip(*bags) for k in (0, 1)] if bags else [pa.array([], pa.binary())] * 4
            yield pa.record_batch([batch.column("lang"), batch.column("h"), *parts], names=["lang", "h", "a", "b", "c", "d"])

    found = rows.mapInArrow(learn, "lang string, h long, a binary, b binary, c binary, d binary").collect()
    found = sorted(found, key=lambda r: (r.h, r.lang, r.a or b"", r.b or b""))
    pair = lambda a, b: None if a is None else (a, b)
    return train([[pair(r.a, r.b), pair(r.c, r.d)] for r in found], [r.lang for r in found])


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        release()
        for batch in batches:
            lang, score, rejected = zip(*shared.value.predict(batch.column(text_column).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs.where(~held_out))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
