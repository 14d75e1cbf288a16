"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A leaf holds a few consecutive pre-tokens; each node knows the characters and tokens below it. An edit finds its place by
walking down, re-encodes from the pre-token that may depend on it until the new boundaries meet the old ones again, and adds
the difference along the paths to the root. A pre-token depends on two characters after its end at most, or on as many
as an added token's literal has, so everything up to there before the edit, and everything after the boundaries have
met, keeps its count. A literal is a pre-token, and the text on either side ends at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import PATTERN, BatchEncoder, encoder

LEAF = 32
_PIECE = regex.compile(PATTERN)


def pieces(text: str, at: int, encode: BatchEncoder) -> Iterator[tuple[str, int]]:
    """The pre-tokens from a boundary on, and where they end."""
    while True:
        literal = encode.added.search(text, at) if encode.added else None
        for match in _PIECE.finditer(text, at, literal.start() if literal else len(text)):
            yield match.group(), match.end()
        if literal is None:
            return
        at = literal.end()
        yield literal.group(), at


class CountTree:
    """Counts of one text. text is kept so that edits can read the characters around them."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, encode: BatchEncoder):
        self.text, self.encode = text, encode
        self.leaves = [(lengths[a : a + LEAF].tolist(), counts[a : a + LEAF].tolist()) for a in range(0, len(lengths), LEAF)] or [([], [])]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        for i, (own, n) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(own), sum(n)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _locate(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end) and the leaf's first character."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.chars[node] <= char and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def _put(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = self.width + leaf
        more = (sum(lengths) - int(self.chars[node]), sum(counts) - int(self.tokens[node]))
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, start: int, deleted: int, inserted: str) -> int:
        """Replaces deleted characters from start by inserted; returns the tokens that the text has now."""
        start = max(0, min(start, len(self.text)))
        stop = min(len(self.text), start + max(0, deleted))
        reach = max(2, self.encode.longest_added)
        leaf, at = self._locate(max(0, start - reach))
        own, counts = self.leaves[leaf]
        keep, left = 0, at
        while keep < len(own) and left + own[keep] <= start - reach:
            left += own[keep]
            keep += 1
        self.text = self.text[:start] + inserted + self.text[stop:]
        shift = len(inserted) - (stop - start)
        last, old_leaf, old_at, rest = keep, leaf, left, []
        fresh: list[str] = []
        now = left
        for piece, now in pieces(self.text, left, self.encode):
            fresh.append(piece)
            while old_at + shift < now and old_leaf < len(self.leaves):
                if last < len(self.leaves[old_leaf][0]):
                    old_at += self.leaves[old_leaf][0][last]
                    last += 1
                else:
                    old_leaf, last = old_leaf + 1, 0
            if old_at >= stop and old_at + shift == now:
                break
        else:
            old_leaf, last = len(self.leaves) - 1, len(self.leaves[-1][0])
        sizes = [len(x) for x in self.encode.encode(fresh)]
        self.encoded += sum(sizes)
        if old_leaf >= len(self.leaves):
            old_leaf, last = len(self.leaves) - 1, len(self.leaves[-1][0])
        rest = (self.leaves[old_leaf][0][last:], self.leaves[old_leaf][1][last:])
        for i in range(leaf + 1, old_leaf + 1):
            self._put(i, *(rest if i == old_leaf else ([], [])))
        tail = rest if old_leaf == leaf else ([], [])
        self._put(leaf, own[:keep] + [len(x) for x in fresh] + tail[0], counts[:keep] + sizes + tail[1])
        return self.total


def trees(texts: list[str | None], encode: BatchEncoder) -> Iterator[CountTree]:
    """The tree of each text, encoded together."""
    texts = [t or "" for t in texts]
    plain = [i for i, t in enumerate(texts) if encode.plain(t)]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a in range(0, len(plain), 200):
        group = plain[a : a + 200]
        owner, _, lengths, slot = encode.pieces([texts[i] for i in group])
        cuts = np.searchsorted(owner, np.arange(len(group) + 1))
        size = encode.size[slot]
        for i, s, e in zip(group, cuts[:-1], cuts[1:], strict=True):
            found[i] = lengths[s:e], size[s:e]
    for i, text in enumerate(texts):
        if i not in found:
            own = [x for x, _ in pieces(text, 0, encode)]
            found[i] = np.array(list(map(len, own)), np.int64), np.array([len(x) for x in encode.encode(own)], np.int64)
        yield CountTree(text, *found.pop(i), encode)


def count_edited(docs: DataFrame, edits: Column, tokenizer: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens before and after its edits, the tokens that were encoded again.

    edits is an array of (start, deleted, inserted), applied in order; places count code points and are clipped to the
    text, null fields count as zero or empty, a null array as none. A null text is empty. Repeated rows are counted
    each. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, own, tree in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), trees(batch.column(1).to_pylist(), encode), strict=True):
                before = tree.total
                for e in own or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                rows.append((doc, before, tree.total, tree.encoded, len(own or [])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_tokens", "n_tokens_after", "n_encoded_again", "n_edits"])

    kind = "array<struct<start:long,deleted:long,inserted:string>>"
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(kind).alias("edits"))
    return named.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_after long, n_encoded_again long, n_edits long")


def sample_edits(text: Column) -> Column:
    """Two edits that depend on the text alone: a third in, 24 characters give way to the text's first nine; at two thirds, a sentence goes in."""
    size = F.length(text)
    edit = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), inserted.alias("inserted"))
    return F.array(edit(F.floor(size / 3), 24, F.substring(text, 1, 9)), edit(F.floor(size * 2 / 3), 0, F.lit(" It's edited; see\n\n  page 42. ")))
