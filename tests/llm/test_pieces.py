"""SentencePiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from specforge.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


PARTS = ["a", "b", "ab", "▁", " ", "  ", "\n", "\t", "é", "①", "ﬁ", "中文", "the", "ing", "\x00", "<s>", "<0x0A>", "😀", "​", ".", ",", "23", " " * 17, "�", "﻿", " system", "Quest", " conflict", "abab"]


def odd_texts() -> list[str | None]:
    rnd = random.Random(5)
    mixed = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    letters = ["".join(rnd.choice("abcdefghijklmnop ABCD.,-") for _ in range(rnd.randint(1, 300))) for _ in range(500)]
    return [*mixed, *letters, "a" * 5000, " " * 5000, "ab" * 3000, "", None, " ", "▁", *(" " * n + "x" for n in range(50))]


def test_ids_and_texts_equal_the_library(library):
    encoder, texts = pieces.piece_encoder(), odd_texts()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "")
        assert encoder.decode(ids) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(library):
    encoder, rnd = pieces.piece_encoder(), random.Random(1)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, 3, 10, 130, 200, 230, 250, 259, 260, 261, 300, 5000, 29871, 28705]) for _ in range(rnd.randint(0, 12))]
        assert encoder.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_very_long_texts_are_cut_without_a_trace(library, monkeypatch):
    monkeypatch.setattr(pieces, "_CHARS_MOST", 50)
    encoder, rnd = pieces.PieceEncoder(), random.Random(2)
    texts = ["".join(rnd.choice(PARTS) for _ in range(200)) for _ in range(50)] + [" " * 500, "x" * 500]
    assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts)


def test_query_over_odd_rows(spark, tmp_path, library):
    rows = [(1, "The cat  sat.", "x"), (1, "The cat  sat.", "x"), (2, None, None), (None, "", None), (3, "①\n" * 2000, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for doc, text, _ in rows:
        ids = library.encode(text or "")
        wanted.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_and_decode(empty).collect() == []


def test_whole_table_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    found = {r[0]: tuple(r)[1:] for r in queries.op11_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc, text in docs:
        ids = library.encode(text or "")
        assert found[doc] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
