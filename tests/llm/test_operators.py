"""Each query against a brute-force version, a round trip or held-out accuracy, over rows with nulls and ties."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import same

import corpus_pipeline
from specforge.llm import packing, tokencount, trainorder
from specforge.llm.queries import oracle_sql, queries
from specforge.llm.tokens import PATTERN  # noqa: F401

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"
TALK = "conv_id long, turn long, role string, text string"
BASE = "The quick brown fox jumps over the lazy dog while seven clever judges watch the quiet harbour at dawn and write long letters home"


def crc(doc, folds):
    return zlib.crc32(str(doc).encode()) % folds


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, empty and long texts, repeated rows, extra columns."""
    sf = tmp_path_factory.mktemp("odd")
    line = "a line of common licence words that stands in several documents"
    texts = [None, "", " \n ", "one", BASE, BASE, BASE + ".", BASE.upper(), f"{line}\n{BASE}", f"{line}x\nother words here entirely, nothing alike", "12 !! ??", "été über naïve ☃ façade", " ".join(f"w{i % 997} of {i}" for i in range(30000)), f"start {BASE} the end of it all is near enough"]
    data = [(i + 1, t, ["en", "fr", None][i % 3], ["web", None][i % 2], len(t) if t else None, 0.5, "x") for i, t in enumerate(texts)]
    data += [(5, BASE, "en", "web", len(BASE), 0.5, "x"), (None, BASE, "en", "web", 3, None, None), (None, None, None, None, None, None, None)]
    spark.createDataFrame(data, KIND).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, BASE), (2, None), (None, "x y"), (4, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(12, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(i, i % 4, [0.1 * i, -0.2, 0.5], "x") for i in range(0, 300, 10)] + [(None, 1, [1.0], None), (1, None, None, None)], "vec_id long, label int, embedding array<float>, parts string").write.parquet(f"{sf}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, None, None), (None, None, None, None), (2, 3, "assistant", "x" * 100_000), (2, 3, "assistant", "x")], TALK).write.parquet(f"{sf}/conversations.parquet")
    return str(sf), data


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("empty")
    for name, kind in (("documents", KIND), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, label int, embedding array<float>"), ("conversations", TALK)):
        spark.createDataFrame([], kind).write.parquet(f"{sf}/{name}.parquet")
    return str(sf)


ALL = queries() | {"pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows_do_not_crash(spark, odd, name):
    ALL[name](spark, odd[0]).collect()


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert ALL[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001")


def test_language_id_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op1_language_id"](spark, sf).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in got)
    judged = [(r["lang_pred"], docs[r["doc_id"]]["lang"]) for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and len(docs[r["doc_id"]]["text"] or "") > 100]
    assert np.mean([a == b for a, b in judged]) > 0.9


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries()["op6_quality_classifier"](spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = ([r["score"] for r in got if truth[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.75


def words(text):
    return (text or "").encode().lower().split()


def test_base_language_model(spark, odd):
    sf, data = odd
    count = Counter()
    for doc, text, *_ in data:
        if doc is not None and crc(doc, 5) != 1:
            count.update([*words(text), None])
    n, v = sum(count.values()), len(count)
    for r in queries()["op4_lm_scoring"](spark, sf).filter("doc_id < 5").collect():
        own = [*words(data[r["doc_id"] - 1][1]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_counts_after_edits_equal_encoding_anew(spark, odd):
    sf, data = odd
    from specforge.llm.tokens import encoder

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    edits = tokencount.sample_edits(docs["text"])
    encode = encoder(None).encode
    got = {r["doc_id"]: r for r in tokencount.count_edited(docs, edits).filter("doc_id IS NOT NULL").collect()}
    for r in docs.select("doc_id", "text", edits.alias("e")).filter("doc_id IS NOT NULL AND text IS NOT NULL").collect():
        text = r["text"]
        before = len(encode([text])[0])
        for e in r["e"]:
            text = text[: e["start"]] + e["inserted"] + text[e["start"] + e["deleted"] :]
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_tokens_after"]) == (before, len(encode([text])[0]))


def test_training_order_is_a_permutation(spark, odd):
    for n in (1, 2, 5, 1000, 4097):
        slots = trainorder.permute(np.arange(n), n, 7)
        assert sorted(slots) == list(range(n)) and (trainorder.invert(slots, n, 7) == np.arange(n)).all()
    got = queries()["op7_train_order"](spark, odd[0]).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))


def test_base_quality_counts(spark, odd):
    sf, data = odd
    for r in queries()["op8_quality_rules"](spark, sf).filter("doc_id IS NOT NULL").collect():
        text = data[r["doc_id"] - 1][1] or ""
        own = text.split()
        seen, dup = set(), 0
        for line in text.split("\n"):
            dup += bool(line.split()) and line in seen
            seen.add(line)
        spots = defaultdict(list)
        for i in range(len(own) - 7):
            spots[tuple(own[i : i + 8])].append(i)
        repeated = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))
        assert r["base_failed"] == (len(own) < 20 or 100 * len(repeated) > 30 * len(own)) and not (r["kept"] and r["base_failed"])


def test_simhash_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {}
    for r in docs:
        w = words(r["text"])
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    got = queries()["op9_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", least[d]) for d in prints}


def test_packing_covers_every_id_once(spark, odd):
    sf, data = odd
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = queries()["op10_packing"](spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc in range(1, 15):
        if doc == 5:
            continue
        ids = np.array([*known.encode(data[doc - 1][1] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_sum_of_squares_choice():
    where, offset = packing.sum_of_squares(np.array([6, 4, 6, 4, 5, 5]), 10)
    assert len(set(where)) == 3 and sorted(offset.tolist()) == [0, 0, 0, 5, 6, 6]


def test_pipeline_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, all_ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= all_ids
        all_ids = now
    left = {r["doc_id"] for r in corpus_pipeline.packed(spark, docs, sf).select("doc_id").collect()}
    assert left == all_ids
