"""SentencePiece ids of texts by merge rounds over flat arrays, and texts of ids.

A text is cut where no piece of the vocabulary can span: before a space mark, around a line break and, inside a word,
between two characters that no piece holds side by side. The words of a batch that were not met before then lie in one
flat array of symbols. Each round finds the smallest pair rank of every word, merges its occurrences from the left,
and compacts the array; a word without a pair left is done. Of the occurrences in a word, those after one whose merge
gives rise to a pair of the same or a smaller rank wait for the next round, so the order is that of one merge at a
time, always of the best pair and of equal ones the leftmost.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.int64(1) << 40
_CUT = "\x1f"
_KNOWN_MOST = 500_000
_CHARS_MOST = 4_000_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pool(dict):
    """Slots of words; a word asked for the first time gets the next one and is noted."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.fresh.append(word)
        return slot


class _Pairs:
    """Pairs of symbols to rank and merged symbol, looked up for whole arrays: a hash table, and a second one for slots hit twice."""

    BITS = 19

    def __init__(self, key: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.key, self.rank, self.merged = (np.append(x, last) for x, last in ((key, -1), (rank, NONE), (merged, 0)))
        self.tables, left = [], np.arange(len(key))
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
            at = self._slot(key[left], salt)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[at] = left
            lost = table[at] != left
            twice = np.zeros(1 << self.BITS, bool)
            twice[at[lost]] = True
            self.tables.append((salt, table, twice))
            left = left[lost]
            if not len(left):
                return
        raise ValueError("too many pairs for the tables")

    def _slot(self, key: np.ndarray, salt: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(salt) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, NONE without one, and merged symbol of each key."""
        found, ask = np.full(len(key), -1, np.int64), None
        for salt, table, twice in self.tables:
            own = key if ask is None else key[ask]
            slot = self._slot(own, salt)
            at = table[slot]
            hit = self.key[at] == own
            if ask is None:
                found[hit] = at[hit]
                ask = np.flatnonzero(~hit & twice[slot])
            else:
                found[ask[hit]] = at[hit]
                ask = ask[~hit & twice[slot]]
            if not len(ask):
                break
        return self.rank[found], self.merged[found]


def _first_true(at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For runs that start at the indices at: how many true flags stand before each element of its run."""
    before = np.cumsum(flags) - flags
    return before - np.repeat(before[at], np.diff(np.append(at, len(flags))))


class PieceEncoder:
    """A BPE model with byte fallback and identity normalisation; other models are refused."""

    def __init__(self, path: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path or model_path(), "rb") as f:
            raw = f.read()
        spec = sentencepiece_model_pb2.ModelProto.FromString(raw)
        library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and identity normalisation are encoded")
        self.prefix = norm.add_dummy_prefix
        kinds = [p.type for p in spec.pieces]
        if {*kinds} - {1, 2, 3, 6}:
            raise ValueError("models with user-defined or unused pieces are not encoded")
        self.pieces = [p.piece for p in spec.pieces]
        own = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" if p.type == 3 else train.unk_surface.encode() if p.type == 2 else bytes([int(p.piece[3:5], 16)]) for p in spec.pieces]
        self.kinds = np.array(kinds, np.int8)
        self._pairs(own, spec)
        self._spaces(own, spec)
        self._clear()

    def _pairs(self, own: dict[str, int], spec) -> None:
        """Symbols are pieces, then single characters that only occur inside longer pieces."""
        loose = sorted({c for p in own for c in p} - own.keys())
        self.symbol = own | {c: len(spec.pieces) + i for i, c in enumerate(loose)}
        self.width = len(spec.pieces) + len(loose) + 1
        scores = np.unique([-spec.pieces[i].score for i in own.values()])
        rank = {p: int(np.searchsorted(scores, -spec.pieces[i].score)) for p, i in own.items()}
        found = [(self.symbol[p[:k]] * self.width + self.symbol[p[k:]], rank[p], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.pairs = _Pairs(*(np.array(c, np.int64) for c in zip(*found, strict=True)))
        #: Characters as small numbers, 0 for those in no piece; which of them stand side by side in a piece.
        letters = sorted({c for p in own for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.of_letter = np.array([0, *(self.symbol[c] for c in letters)], np.int64)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in own:
            at = self.letter[[ord(c) for c in p]]
            self.beside[at[:-1], at[1:]] = True

    def _spaces(self, own: dict[str, int], spec) -> None:
        """Runs of space marks. Their pieces share the lowest score of all, so they merge last and from the left; a longer run begins with the longest piece."""
        runs = {len(p): i for p, i in own.items() if {*p} == {SPACE}}
        tied = {spec.pieces[i].score for n, i in runs.items() if n > 1}
        rest = min(spec.pieces[i].score for p, i in own.items() if len(p) > 1 and {*p} != {SPACE})
        self.longest = max(runs, default=0)
        self.cut = {n: self._from_left(n, runs) for n in range(3 * self.longest)}
        periodic = all(self.cut[n] == [runs[self.longest], *self.cut[n - self.longest]] for n in range(self.longest, 3 * self.longest))
        if 1 not in runs or any(SPACE in p[1:] and {*p} != {SPACE} for p in own) or len(tied) > 1 or tied and max(tied) >= rest or not periodic:
            raise ValueError("models whose pieces hold space marks in another way are not encoded")
        self.runs = runs
        alone = "".join(c for c in "\n\t" if all(c not in p or len(p) == 1 for p in own))
        self.alone = alone
        self.words = re.compile(f"{SPACE}?[^{SPACE}{alone}]+|{SPACE}+(?={SPACE})|{SPACE}" + f"|[{alone}]" * bool(alone))

    @staticmethod
    def _from_left(n: int, runs: dict[int, int]) -> list[int]:
        """The pieces of n space marks when the leftmost pair that makes a piece merges first."""
        parts = [1] * n
        while (at := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in runs), None)) is not None:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [runs[k] for k in parts]

    def _clear(self) -> None:
        self.known = _Pool()
        self.flat = self.at = self.size = np.zeros(0, np.int64)
        self.run = self.lone = np.zeros(0, bool)

    def _shrink(self) -> None:
        """Keeps the older half of the words: common ones are met early."""
        half = _KNOWN_MOST // 2
        kept = _Pool()
        kept.update(itertools.islice(self.known.items(), half))
        self.known, self.flat = kept, self.flat[: self.at[half]]
        self.at, self.size, self.run, self.lone = self.at[:half], self.size[:half], self.run[:half], self.lone[:half]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        letter = self.letter[code]
        fits = self.beside[letter[:-1], letter[1:]]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        inner = begins[1:-1]
        fits[inner[(inner > 0) & (inner < len(code))] - 1] = False
        unit = np.concatenate(([0], np.cumsum(~fits))) if len(code) else np.zeros(0, np.int64)
        place, symbol = np.arange(len(code)), np.where(letter > 0, self.of_letter[letter], self.width - 1)
        rank, merged = self.pairs(symbol[:-1] * self.width + symbol[1:])
        rank, merged = np.append(np.where(fits, rank, NONE), NONE)[: len(code)], np.append(merged, 0)[: len(code)]
        done_place, done_symbol = [place[:0]], [symbol[:0]]
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(unit))))
            live = least != NONE
            if not live.all():
                done_place.append(place[~live])
                done_symbol.append(symbol[~live])
                place, symbol, unit, rank, merged, least = (x[live] for x in (place, symbol, unit, rank, merged, least))
                if not len(symbol):
                    break
            best = np.flatnonzero(rank == least)
            begun = np.concatenate(([True], best[1:] != best[:-1] + 1))
            chosen = best[(best - np.maximum.accumulate(np.where(begun, best, 0))) % 2 == 0]
            x, own, mine = merged[chosen], unit[chosen], rank[chosen]
            follows = np.concatenate(([False], (chosen[1:] == chosen[:-1] + 2) & (own[1:] == own[:-1])))
            left_at, right_at = np.maximum(chosen - 1, 0), np.minimum(chosen + 2, len(unit) - 1)
            left = np.where(follows, np.concatenate(([0], x[:-1])), symbol[left_at])
            both = self.pairs(np.concatenate((left * self.width + x, x * self.width + symbol[right_at])))
            had_left = (unit[left_at] == own) & (left_at < chosen)
            had_right = (unit[right_at] == own) & (right_at == chosen + 2)
            first, second = np.where(had_left, both[0][: len(x)], NONE), np.where(had_right, both[0][len(x) :], NONE)
            better = np.minimum(first, second) <= mine
            go = slice(None)
            if better.any():
                go = _first_true(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))), better) == 0
            at = chosen[go]
            symbol[at] = x[go]
            rank[at], merged[at] = second[go], both[1][len(x) :][go]
            before = (at - 1 - follows[go])[had_left[go]]
            rank[before], merged[before] = first[go][had_left[go]], both[1][: len(x)][go][had_left[go]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            place, symbol, unit, rank, merged = place[stay], symbol[stay], unit[stay], rank[stay], merged[stay]
        place, symbol = np.concatenate(done_place), np.concatenate(done_symbol)
        order = np.argsort(place, kind="stable")
        return self._fall_back(place[order], symbol[order], code, begins)

    def _fall_back(self, place: np.ndarray, symbol: np.ndarray, code: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their bytes."""
        word = np.searchsorted(begins, place, side="right") - 1
        odd = np.flatnonzero(symbol >= len(self.pieces))
        if len(odd):
            raw = [self.bytes[list(chr(c).encode())] for c in code[place[odd]].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[odd] = list(map(len, raw))
            ends = np.cumsum(times)
            symbol, word = np.repeat(symbol, times), np.repeat(word, times)
            for i, ids in zip(odd.tolist(), raw, strict=True):
                symbol[ends[i] - len(ids) : ends[i]] = ids
        return symbol, np.bincount(word, minlength=len(begins) - 1)

    def _slots(self, words: list[str]) -> np.ndarray:
        """The slots of words; those not met before are merged together."""
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if fresh := self.known.fresh:
            run = np.fromiter((w[:2] == SPACE * 2 for w in fresh), bool, len(fresh))
            ids, sizes = self.merge(["" if r else w for r, w in zip(run, fresh, strict=True)] if run.any() else fresh)
            at = len(self.flat) + np.cumsum(sizes) - sizes
            first = np.append(ids, -1)[np.minimum(at - len(self.flat), len(ids))]
            self.lone = np.concatenate((self.lone, (first == self.runs[1]) & (sizes > 0)))
            self.flat, self.at, self.size, self.run = (np.concatenate(x) for x in ((self.flat, ids), (self.at, at), (self.size, sizes), (self.run, run)))
            self.known.fresh = []
        return slots

    def _run(self, n: int) -> list[int]:
        return [self.runs[self.longest]] * (n // self.longest) + self.cut[n % self.longest]

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in bounded lists. A run of spaces before a space-marked word has one mark too many, as no word begins with two."""
        marked = SPACE * (self.prefix and bool(text)) + text.replace(" ", SPACE)
        if SPACE * 2 not in marked and _CUT not in marked and len(marked) <= _CHARS_MOST:
            cut = marked.replace(SPACE, _CUT + SPACE)
            for c in self.alone:
                cut = cut.replace(c, _CUT + c + _CUT)
            yield cut.split(_CUT)
            return
        held: list[str] = []
        size = 0
        for found in self.words.finditer(marked):
            w = found.group()
            size += len(w)
            run = w[-1] == SPACE and marked[found.end() : found.end() + 1] == SPACE
            held.append(w + SPACE if run else w)
            if size > _CHARS_MOST and not run:
                yield held
                held, size = [], 0
        if held:
            yield held

    def _ids(self, words: list[str], slot: np.ndarray) -> np.ndarray:
        size, begin = self.size[slot], self.at[slot]
        spaces = np.flatnonzero(self.run[slot])
        alone = spaces[self.lone[slot[spaces + 1]]] + 1
        begin[alone] += 1
        size[alone] -= 1
        total = np.cumsum(size)
        ids = self.flat[np.repeat(begin - total + size, size) + np.arange(total[-1])] if len(total) else np.zeros(0, np.int64)
        if len(spaces):
            joined = {*alone.tolist()}
            cut = [self._run(len(words[i]) - 1 + (i + 1 in joined)) for i in spaces.tolist()]
            ids = np.insert(ids, np.repeat(total[spaces], list(map(len, cut))), list(itertools.chain.from_iterable(cut)))
        return ids.astype(np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text counts as empty and has none."""
        out: list[np.ndarray] = []
        group: list[list[str]] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if len(self.known) > _KNOWN_MOST:
                self._shrink()
            slots = self._slots(list(itertools.chain.from_iterable(group)))
            ends = np.cumsum([0, *map(len, group)]).tolist()
            out.extend(self._ids(words, slots[a:b]) for words, a, b in zip(group, ends[:-1], ends[1:], strict=True))
            group, size = [], 0

        for text in texts:
            if len(text or "") > _CHARS_MOST:
                flush()
                ids = []
                for part in self._parts(text):
                    group = [part]
                    flush()
                    ids.append(out.pop())
                out.append(np.concatenate(ids))
                continue
            group.append(next(self._parts(text or ""), []))
            size += len(text or "")
            if size > _CHARS_MOST // 2:
                flush()
        flush()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. A leading space mark goes, control ids are silent, each byte that is no UTF-8 becomes U+FFFD."""
        silent = self.kinds[ids] == 3
        given = (ids[~silent] if silent.any() else ids).tolist()
        if self.prefix and given and self.pieces[given[0]][0] == SPACE and self.kinds[given[0]] == 1:
            head, given = self.surface[given[0]][1:], given[1:]
        else:
            head = b""
        raw = head + b"".join(map(self.surface.__getitem__, given))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._mended(head, given)

    def _mended(self, head: bytes, given: list[int]) -> str:
        """Runs of byte pieces are decoded on their own, each byte that begins no character as U+FFFD."""
        parts = [head.decode()]
        for byte, run in itertools.groupby(given, key=lambda i: self.kinds[i] == 6):
            raw = b"".join(map(self.surface.__getitem__, run))
            if not byte:
                parts.append(raw.decode())
                continue
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(raw[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    parts.append("�")
                at += n
        return "".join(parts)


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str | None = None) -> PieceEncoder:
    return PieceEncoder(path)


def ids_of(text: Column, path: str | None = None) -> Column:
    """The ids of a text column as array<int>; a null text counts as empty. path must be readable on every executor."""

    @F.arrow_udf("array<int>")
    def pieces(texts: pa.Array) -> pa.Array:
        found = piece_encoder(path).encode(texts.to_pylist())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return pieces(text)


def text_of(ids: Column, path: str | None = None) -> Column:
    """The text of a column of ids; null for null."""

    @F.arrow_udf("string")
    def texts(rows: pa.Array) -> pa.Array:
        decode = piece_encoder(path).decode
        ends, flat, known = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False), rows.is_valid().to_pylist()
        return pa.array([decode(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known, strict=True)], pa.string())

    return texts(ids)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>), decoded (the text of those ids).

    A null or empty text has no ids and decodes to an empty text. A null doc_id stays null, repeated rows each give
    theirs, an empty table gives no rows, other columns of any name are ignored. Very long texts are encoded whole, in
    bounded parts cut where no piece can span. There are no ties: of equal ranks the leftmost pair merges.
    """
    named = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = named.select("doc_id", ids_of(F.col("text"), path).alias("ids"))
    return encoded.select("doc_id", "ids", text_of(F.col("ids"), path).alias("decoded"))
