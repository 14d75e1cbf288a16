"""Texts that hold an added token's literal: ids, counts after edits and packed ids equal the tokenizer's."""

import random
import zlib

import numpy as np
import pytest

from specforge.llm import packing, tokencount, trainorder
from specforge.llm.tokens import encoder

MARK = "<|endoftext|>"
TEXTS = [f"a {MARK} b", MARK, f"{MARK}{MARK}", f"two  {MARK}  lines\n\n{MARK}\n", f"it{MARK}'s", f"!!{MARK}!!", "<|endof", "text|> c", f"café ☃ {MARK}", f"🙂 {MARK} 🙂", "no literal <|endoftext| > here", f"word {MARK} " * 100]


@pytest.fixture(scope="module")
def known():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda text: own.encode(text, add_special_tokens=False).ids


def test_ids(known):
    assert known(TEXTS[0]) == [64, 220, 50256, 275]
    assert [x.tolist() for x in encoder(None).encode(TEXTS)] == [known(t) for t in TEXTS]


def test_counts_after_edits(known):
    rng = random.Random(1)
    bits = [MARK, "<|endof", "text|>", ">", "<", " ", "  ", "'s", "word", "\n", "|", "e", ""]
    for text in ["".join(rng.choice(bits) for _ in range(rng.choice((3, 30, 300)))) for _ in range(150)]:
        tree = next(tokencount.trees([text], encoder(None)))
        assert tree.total == len(known(text))
        for _ in range(12):
            start, deleted, inserted = rng.randint(0, len(text)), rng.choice((0, 0, 1, 5, 24)), rng.choice(bits)
            text = text[:start] + inserted + text[start + deleted :]
            assert tree.edit(start, deleted, inserted) == len(known(text)), text


def test_packed_and_sharded_ids(spark, known):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    assert {p["doc_id"]: (p["doc_tokens"], p["ids_crc32"]) for p in pieces} == {i: (len(known(t)) + 1, zlib.crc32(np.array([*known(t), packing.END_ID], "<u4").tobytes())) for i, t in enumerate(TEXTS)}
    for r in trainorder.tokenise(docs).filter("start = 0").collect():
        own = [*known(TEXTS[r["doc_id"]]), trainorder.END_ID]
        assert np.frombuffer(r["ids"], "<u2")[: r["n_ids"]].tolist() == own[: r["n_ids"]]
