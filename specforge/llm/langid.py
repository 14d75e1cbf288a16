"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training text. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of labelled rows (TRAIN_DOCS in all, balanced over languages, drawn by a
hash), and a temperature is then chosen on sampled rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, unit_hash
from .tokens import LETTER, _tables

BUCKETS = 1 << 16
ORDERS = 3
TRAIN_DOCS = 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.02, 1.0
UNKNOWN = "und"
_ANY_LETTER = regex.compile(r"\p{L}")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the character n-grams of a text's letters; None where it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _tables()[0][np.minimum(code, 0xFFFF)] == LETTER
    if not letter.any() and not _ANY_LETTER.search(text):
        return None
    code = np.where(letter | (code > 0xFFFF), code, np.uint32(32))
    code = np.concatenate(([np.uint32(32)], code[(code != 32) | np.concatenate(([True], code[:-1] != 32))], [np.uint32(32)]))
    found = []
    mixed = np.zeros(len(code), np.uint32)
    for n in range(ORDERS):
        if len(code) <= n:
            break
        mixed = (mixed[: len(code) - n] * np.uint32(0x01000193) + code[n:]) * np.uint32(0x9E3779B1)
        found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(16))
    every = np.concatenate(found)
    if len(every) > 4_000:
        count = np.bincount(every, minlength=BUCKETS)
        bucket = np.flatnonzero(count)
        return bucket, count[bucket]
    return np.unique(every, return_counts=True)


def weigh(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(found[1])) * idf[found[0]]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets and a bias row, by languages
    temperature: float

    def scores(self, text: str | None) -> np.ndarray | None:
        found = grams(text)
        if found is None:
            return None
        logit = (weigh(found, self.idf) @ self.weights[found[0]] + self.weights[-1]) / self.temperature
        e = np.exp(logit - logit.max())
        return e / e.sum()


def fit(rows: list[tuple[str, str]], idf: np.ndarray) -> Model:
    """A model from (text, language) rows; every fourth row is kept for the temperature."""
    languages = sorted({lang for _, lang in rows})
    data = [(f, weigh(f, idf), languages.index(lang)) for text, lang in rows if (f := grams(text)) is not None]
    train, rest = [x for i, x in enumerate(data) if i % 4], [x for i, x in enumerate(data) if not i % 4]
    z, n = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))
    l1 = np.full((BUCKETS + 1, 1), L1)
    l1[-1] = 0

    def closed(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0.0, -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            (bucket, _), x, y = train[i]
            at, value = np.append(bucket, BUCKETS), np.append(x, 1.0)
            w = closed(at)
            logit = value @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    weights = closed(slice(None)).astype(np.float32)
    logits = [(x @ weights[f[0]] + weights[-1], y) for f, x, y in rest]

    def loss(t: float) -> float:
        return float(sum(np.logaddexp.reduce(v / t) - v[y] / t for v, y in logits))

    temperature = min((2.0 ** (k / 8) for k in range(-40, 17)), key=loss) if logits else 1.0
    return Model(languages, idf.astype(np.float32), weights, temperature)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (found := grams(text)) is not None:
                total[found[0]] += 1
                docs += 1
    total[BUCKETS] = docs
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "docs"])


def train(docs: DataFrame, learn: Column, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the rows where learn holds and lang is known."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_lang:
        return Model([UNKNOWN], np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS + 1, 1), np.float32), 1.0)
    counts = known.select("text").mapInArrow(_frequencies, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[counts["bucket"].to_numpy()] = counts["docs"].to_numpy()
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    rate = F.create_map(*[x for lang, n in per_lang.items() for x in (F.lit(lang), F.lit(min(1.0, train_docs / len(per_lang) / n)))])
    sample = known.filter(unit_hash(F.col("doc_id"), F.col("text")) < rate[F.col("lang")]).select("text", "lang").toPandas()
    sample = sample.sort_values(["lang", "text"], ignore_index=True)
    return fit(list(zip(sample["text"], sample["lang"], strict=True)), idf)


def predictor(model: Model):
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [model.scores(t) for t in batch]
            yield pd.DataFrame({"lang_pred": [UNKNOWN if p is None else model.languages[int(p.argmax())] for p in found], "score": [0.0 if p is None else float(p.max()) for p in found]})

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added. A null text, or one without a letter, is `und` with score 0.

    Repeated rows get equal answers; an empty table stays empty; other columns are kept as they are.
    """
    return docs.withColumn("_language", predictor(model)(F.col("text").cast("string"))).withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")


def predictions(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning from folds other than 1 of 3."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(named, fold(F.col("doc_id"), 3) != 1, train_docs)
    return identify(named.select("doc_id", "text", held_out(F.col("doc_id"), 3).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
