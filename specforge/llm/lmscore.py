"""Language-model scoring by deleted interpolation of word bigram, unigram and uniform estimates.

Counts come from every training text. Texts are dealt to chunks of a few million characters; a chunk turns its words
into 64-bit hashes and asks for each of its distinct words and word pairs once. A question is a row of packed arrays
per chunk and bucket of the hash space, so what is shuffled is sorted keys, not a row per word; a bucket adds the
counts of its chunks and answers each with the totals of its own keys. A key's total is one number however often it
occurs, so a very frequent word is no hot spot. The mixture weights depend on how often the context was seen: one set
per frequency bucket, fitted by expectation-maximisation on held-out counts: each chunk in turn is held out, with its
own counts deleted from the totals. Scores then use the totals of all training texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, staged

CHUNK_CHARS = 8_000_000
CONTEXT_BUCKETS = 12
BINS = 40
EM_ROUNDS = 50
LEAST_CHUNKS = 24
END = 0x5851F42D4C957F2D
DOCS = "doc_id long, learn boolean, held_out boolean, text string"


def hashes(text: str | None) -> np.ndarray:
    """The 64-bit hashes of a text's tokens: lower-cased words, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(END))


def pair_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key for each token with the token before it; texts begin after an end."""
    before = np.concatenate(([np.uint64(END)], tokens[:-1]))
    before[starts] = END
    mixed = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tokens
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


class Chunk:
    """The tokens of a chunk of texts, its distinct words and pairs, and where each token stands among them."""

    def __init__(self, texts: list[str | None], learn: np.ndarray):
        own = [hashes(t) for t in texts]
        self.sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.starts = np.cumsum(self.sizes) - self.sizes
        tokens = np.concatenate(own) if own else np.zeros(0, np.uint64)
        counted = np.repeat(learn, self.sizes)
        self.words, self.word_at = np.unique(tokens, return_inverse=True)
        self.word_counts = np.bincount(self.word_at, counted, len(self.words)).astype(np.uint32)
        self.pairs, self.pair_at = np.unique(pair_keys(tokens, self.starts), return_inverse=True)
        self.pair_counts = np.bincount(self.pair_at, counted, len(self.pairs)).astype(np.uint32)
        self.counted = counted

    def before(self, per_word: np.ndarray) -> np.ndarray:
        """per_word of the token before each token."""
        value = per_word[self.word_at]
        end = per_word[np.searchsorted(self.words, np.uint64(END))]
        shifted = np.concatenate(([end], value[:-1]))
        shifted[self.starts] = end
        return shifted


def _unpack(pdf: pd.DataFrame) -> tuple[list[str | None], pd.DataFrame]:
    """The rows of a chunk, in one order whatever the order of arrival."""
    pdf = pdf.sort_values(["doc_id", "part"], ignore_index=True, na_position="last")
    return [None if t is None else zstandard.decompress(t).decode("utf-8", "surrogatepass") for t in pdf["text"]], pdf


def _ask(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, rows = _unpack(pdf)
        chunk = Chunk(texts, rows["learn"].to_numpy(bool))
        found = []
        for kind, keys, counts in ((0, chunk.words, chunk.word_counts), (1, chunk.pairs, chunk.pair_counts)):
            cut = np.searchsorted(keys >> np.uint64(40), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(24)) // np.uint64(buckets))
            for bucket, (a, b) in enumerate(itertools.pairwise(cut.tolist())):
                if b > a:
                    found.append((kind, bucket, int(pdf["chunk"].iloc[0]), zstandard.compress(keys[a:b].tobytes(), 1), zstandard.compress(counts[a:b].tobytes(), 1)))
        return pd.DataFrame(found, columns=["kind", "bucket", "chunk", "keys", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's keys for each chunk that asked; where no training text has a key, zero."""
    keys = [np.frombuffer(zstandard.decompress(x), np.uint64) for x in pdf["keys"]]
    counts = [np.frombuffer(zstandard.decompress(x), np.uint32) for x in pdf["counts"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, np.concatenate(counts), len(every)).astype(np.uint64)
    seen = np.array([int((totals > 0).sum()), int(totals.sum())], np.int64)
    cuts = np.cumsum([0, *map(len, keys)])
    return pd.DataFrame({
        "kind": pdf["kind"], "bucket": pdf["bucket"], "chunk": pdf["chunk"],
        "totals": [zstandard.compress(totals[at[a:b]].astype(np.uint64).tobytes(), 1) for a, b in itertools.pairwise(cuts.tolist())],
        "distinct": [int(seen[0]), *[0] * (len(pdf) - 1)], "tokens": [int(seen[1]), *[0] * (len(pdf) - 1)],
    })


def _totals(answers: pd.DataFrame, kind: int) -> np.ndarray:
    own = answers[answers["kind"] == kind].sort_values("bucket")
    return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(zstandard.decompress(x), np.uint64) for x in own["totals"])]).astype(np.float64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context not seen, then one bucket per factor of four."""
    return np.where(count <= 0, 0, np.minimum(1 + np.log2(np.maximum(count, 1)) // 2, CONTEXT_BUCKETS - 1)).astype(np.int64)


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: float, v: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood bigram and unigram estimates and the uniform one, over the words of training and one class of all others."""
    return np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0), word / max(n, 1.0), 1.0 / (v + 1.0)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p <= 0, 0, np.clip(BINS + np.log2(np.maximum(p, 1e-300)), 1, BINS)).astype(np.int64)


def _held_counts(n: float, v: float):
    """For EM: held-out tokens by context bucket and by bins of their two estimates, with sums of the estimates."""

    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts, rows = _unpack(docs)
        chunk = Chunk(texts, rows["learn"].to_numpy(bool))
        word, pair = _totals(answers, 0) - chunk.word_counts, _totals(answers, 1) - chunk.pair_counts
        context = chunk.before(word)
        two, one, _ = estimates(pair[chunk.pair_at], context, word[chunk.word_at], n - chunk.counted.sum(), v)
        code = (context_bucket(context) * (BINS + 1) + _bin(two)) * (BINS + 1) + _bin(one)
        code, two, one = code[chunk.counted], two[chunk.counted], one[chunk.counted]
        size = CONTEXT_BUCKETS * (BINS + 1) ** 2
        many = np.bincount(code, minlength=size)
        at = np.flatnonzero(many)
        return pd.DataFrame({"code": at, "n": many[at], "two": np.bincount(code, two, size)[at], "one": np.bincount(code, one, size)[at]})

    return run


def expectation_maximisation(held: pd.DataFrame, uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights of bigram, unigram and uniform for each context bucket; buckets without held-out tokens take the pooled ones."""
    context = held["code"].to_numpy() // (BINS + 1) ** 2
    n = held["n"].to_numpy(float)
    p = np.stack([held["two"] / n, held["one"] / n, np.full(len(held), uniform)], axis=1)

    def learned(own: np.ndarray) -> np.ndarray:
        w = np.array([0.3, 0.6, 0.1])
        for _ in range(rounds):
            share = p[own] * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[own, None]).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-4)
            w /= w.sum()
        return w

    pooled = learned(np.ones(len(n), bool)) if len(n) else np.array([0.3, 0.6, 0.1])
    return np.stack([learned(context == b) if (context == b).any() else pooled for b in range(CONTEXT_BUCKETS)])


def _scores(n: float, v: float, weights: np.ndarray):
    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts, rows = _unpack(docs)
        chunk = Chunk(texts, rows["learn"].to_numpy(bool))
        word, pair = _totals(answers, 0), _totals(answers, 1)
        own = word[chunk.word_at]
        context = chunk.before(word)
        two, one, uniform = estimates(pair[chunk.pair_at], context, own, n, v)
        w = weights[context_bucket(context)]
        w = np.where(context[:, None] > 0, w, w / np.maximum(w[:, 1:].sum(axis=1, keepdims=True), 1e-12) * np.array([0.0, 1, 1]))
        score = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform)
        base = np.log10((own + 0.5) / (n + 0.5 * (v + 1)))
        sums = lambda x: np.add.reduceat(x, chunk.starts) if len(chunk.starts) else np.zeros(0)
        return pd.DataFrame({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": chunk.sizes, "n_known": sums((own > 0).astype(np.int64)), "train_tokens": int(n), "base_score": sums(base), "score": sums(score)})

    return run


def _compress(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.binary())], names=batch.schema.names)

    return docs.mapInArrow(run, "chunk long, doc_id long, learn boolean, held_out boolean, part long, text binary")


def score_texts(docs: DataFrame, learn: Column, held: Column, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end token. A null doc_id is scored, never learned from. Repeated rows are learned from
    and scored each. Without training text every probability is the uniform one. An empty table gives no rows. Other
    columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    size = named.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = max(LEAST_CHUNKS, -(-size // chunk_chars))
    part = F.xxhash64("doc_id", "text")
    dealt = _compress(named.select(F.pmod(part, F.lit(chunks)).alias("chunk"), "doc_id", "learn", "held_out", part.alias("part"), "text"))
    asked = dealt.groupBy("chunk").applyInPandas(_ask(chunks), "kind int, bucket int, chunk long, keys binary, counts binary")
    answers = staged(asked.groupBy("kind", "bucket").applyInPandas(_answer, "kind int, bucket int, chunk long, totals binary, distinct long, tokens long"), "answers")
    seen = answers.filter("kind = 0").agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    n, v = float(seen["n"]), float(seen["v"])
    held_counts = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_held_counts(n, v), "code long, n long, two double, one double")
    held_counts = staged(held_counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")), "held")
    held_pdf = held_counts.toPandas().sort_values("code", ignore_index=True)
    weights = expectation_maximisation(held_pdf, 1.0 / (v + 1.0))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scores(n, v, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def predictions(docs: DataFrame) -> DataFrame:
    """Scores learned from the folds other than 1 of 5."""
    doc_id = F.col("doc_id").cast("long")
    return score_texts(docs, fold(doc_id, 5) != 1, held_out(doc_id, 5))
