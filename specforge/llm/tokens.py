"""Byte-level BPE ids for many texts at once.

The pre-token pattern of this tokenizer looks only forward and at four character classes, so the boundaries of a
whole batch come from a few array operations. Equal pre-tokens have equal ids: only those not met before are merged,
and the ids of the batch are gathered from a pool. Pre-tokens are told apart by a 64-bit hash. The merges run over
the vocabulary of the tokenizer file, whose ids are in merge order; that the ids equal those of the tokenizer is
tested. Texts with characters above U+FFFE or an added token's literal take the tokenizer itself.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
_MARK = "￿"
_POOL_MOST = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0xFFFF)]))
    kind = np.zeros(0x10000, np.uint8)
    for value, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        kind[[ord(x) for x in regex.findall(what, every)]] = value
    kind[0xFFFF] = MARK
    mixed = np.random.default_rng(11).integers(1, 1 << 63, 0x10000, dtype=np.uint64)
    return kind, mixed


def boundaries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in an array of code points; marks between texts are no pre-tokens."""
    kind = _tables()[0][code]
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    end = np.concatenate((start[1:], [n]))
    what = kind[start]
    follows = np.concatenate((what[1:], [MARK]))
    cut = np.zeros(n + 1, bool)
    cut[start] = True
    before_word = (what == SPACE) & (follows != MARK)
    cut[end[before_word] - 1] = True
    joined = before_word & (code[end - 1] == 0x20)
    cut[end[joined]] = False
    after_join = np.concatenate(([False], joined[:-1]))
    short = np.flatnonzero((what == OTHER) & (end - start == 1) & (code[start] == 0x27) & (follows == LETTER) & ~after_join)
    if len(short):
        at, stop = end[short], end[short + 1]
        a, b = code[at], code[np.minimum(at + 1, n - 1)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (stop - at >= 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        cut[at[one | two]] = False
        cut[at[one] + 1] = True
        cut[at[two] + 2] = True
    first = np.flatnonzero(cut[:n])
    last = np.concatenate((first[1:], [n]))
    real = kind[first] != MARK
    return first[real], last[real]


class BatchEncoder:
    """Ids and pre-token counts of texts, with a bounded pool of pre-tokens met before."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        literals = sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, literals))) if literals else None
        self.longest_added = max(map(len, literals), default=0)
        self.merge = _merger(path or tokenizer_path())
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            base = 0x9E3779B97F4A7C15
            with np.errstate(over="ignore"):
                self.powers = np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))).cumprod()[:n]
                self.inverse = np.concatenate(([np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64))).cumprod()[:n]

    def _learn(self, pieces: list[str], keys: list[int]) -> None:
        found = list(map(self.merge, pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        slot, used = len(self.known), self.used
        while slot + len(found) > len(self.at):
            self.at, self.size = np.concatenate((self.at, self.at)), np.concatenate((self.size, self.size))
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        self.ids[used : used + len(flat)] = flat
        self.at[slot : slot + len(found)] = used + np.cumsum(sizes) - sizes
        self.size[slot : slot + len(found)] = sizes
        self.used += len(flat)
        self.known.update(zip(keys, range(slot, slot + len(found)), strict=True))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For plain texts: the text of each pre-token, its start in that text, its characters, its slot in the pool."""
        whole = _MARK.join(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first, last = boundaries(code)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        owner = np.searchsorted(begins, first, side="right") - 1
        self._powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_tables()[1][code] * self.powers[: len(code)], out=total[1:])
        key = (total[last] - total[first]) * self.inverse[first]
        unique, example, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > _POOL_MOST:
            self._clear()
        keys = unique.tolist()
        slots = list(map(self.known.get, keys))
        if None in slots:
            new = [i for i, k in enumerate(slots) if k is None]
            s, e = first[example[new]].tolist(), last[example[new]].tolist()
            fresh = range(len(self.known), len(self.known) + len(new))
            self._learn([whole[a:b] for a, b in zip(s, e, strict=True)], [keys[i] for i in new])
            for i, k in zip(new, fresh, strict=True):
                slots[i] = k
        slot = np.array(slots, np.int64)[inverse]
        return owner, first - begins[owner], last - first, slot

    def plain(self, text: str) -> bool:
        if self.added and self.added.search(text):
            return False
        return text.isascii() or _MARK not in text and len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)

    def encode(self, texts: list[str], most_chars: int = 1_000_000) -> list[np.ndarray]:
        """The ids of each text; null texts count as empty."""
        texts = [t or "" for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        size, group = 0, []
        for i, text in enumerate(texts):
            group.append(i)
            size += len(text)
            if size > most_chars or i == len(texts) - 1:
                self._encode_group(texts, group, out)
                size, group = 0, []
        return out

    def _encode_group(self, texts: list[str], group: list[int], out: list[np.ndarray]) -> None:
        whole = "".join(texts[i] for i in group)
        if not self.plain(whole):
            for i in [i for i in group if not self.plain(texts[i])]:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            group = [i for i in group if self.plain(texts[i])]
        owner, _, _, slot = self.pieces([texts[i] for i in group])
        counts = self.size[slot]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.at[slot] - total[:-1], counts) + np.arange(total[-1])]
        cuts = total[np.searchsorted(owner, np.arange(len(group) + 1))]
        for i, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
            out[i] = ids[a:b]


def _merger(path: str):
    """The ids of one pre-token, by the vocabulary of a byte-level tokenizer file."""
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    byte = {c: b for b, c in letter.items()}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
    ranks = {token: i for token, i in ranks.items() if token != b"<|endoftext|>"}
    core = tiktoken.Encoding("vocabulary", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_ordinary


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> BatchEncoder:
    return BatchEncoder(path)
