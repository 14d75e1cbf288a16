"""Which rows each stage keeps, on rows with nulls, repeated ids and columns that clash."""

import random

import pytest

import corpus_pipeline
from specforge.llm import decontam, linededup, simhash

KIND = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, rk string, language string, gone int"
A, B, C, D = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue white black brown pink grey", "north south east west up down left right")


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t or ""), 777, "keep", "mine", 9) for d, t in rows], KIND)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_dedup_tells_rows_apart_by_id_and_text(spark):
    docs = docs_of(spark, [(3, A), (5, A), (5, B), (7, C), (7, D), (9, D), (9, D)])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and kept(got) == sorted([(3, A), (5, B), (7, C), (7, D)], key=str)


def test_near_dedup_keeps_one_of_repeated_rows_and_of_rows_without_id(spark):
    docs = docs_of(spark, [(None, A), (None, A), (2, A), (2, A), (None, B), (None, None), (4, None), (4, "")])
    assert kept(corpus_pipeline.near_duplicates(spark, docs, "")) in ([(2, A), (4, ""), (None, B)], [(2, A), (4, None), (None, B)])


def test_near_dedup_of_a_hot_group(spark, monkeypatch):
    from specforge.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_PART", 0.2)
    rows = [(i, A) for i in range(60)] + [(100 + i, f"{B} {i} {C} {i * 7}") for i in range(20)]
    got = kept(corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), ""))
    assert (0, A) in got and sum(t == A for _, t in got) == 1
    ids = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert {d for d, _ in got} == set(ids.values())


def test_line_stage_keeps_clashing_columns(spark):
    line = "this line of text stands in both of the documents"
    docs = docs_of(spark, [(1, f"{line}\nfirst words of a document here"), (2, f"{line}\nother things that nobody wrote before"), (3, line), (4, None)])
    got = corpus_pipeline.lines(spark, docs, "")
    assert got.columns == docs.columns
    assert kept(got) == sorted([(1, f"{line}\nfirst words of a document here"), (2, "other things that nobody wrote before"), (4, None)], key=str)
    assert {(r["n_lines"], r["rk"], r["gone"]) for r in got.collect()} == {(777, "keep", 9)}
    assert {r["doc_id"]: r["n_chars"] for r in got.collect()}[2] == len("other things that nobody wrote before")


def test_language_stage_keeps_columns_and_drops_texts_without_letters(spark):
    english = [(i, f"the {w} was with them and they were here for the {w} of it all") for i, w in enumerate(("house", "river", "garden", "letter", "winter", "market") * 5)]
    docs = docs_of(spark, [*english, (100, None), (101, "12 !! ??"), (102, "")])
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and {r["language"] for r in got.collect()} == {"mine"}
    assert {d for d, _ in kept(got)} == {d for d, _ in english}


def test_benchmark_stage(spark, tmp_path):
    item = "what is the distance between the two towns if a cart needs three hours for the way there and four for the way back"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, [(1, f"{A} {item} {B}"), (2, f"{A} {B}"), (3, None), (4, f"{C} {item.replace('the way back', 'the way home')} {D}"), (4, C)])
    got = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and kept(got) == sorted([(2, f"{A} {B}"), (3, None), (4, C)], key=str)
    assert {r["item_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()} == {1}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_near_copies_of_one_line(spark, monkeypatch, broadcast):
    """Against brute force, with groups far beyond what meets at once."""
    from specforge.llm import common

    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linededup, "HOT_LINES", 4)
    monkeypatch.setattr(linededup, "BLOCK_LINES", 16)
    draw = random.Random(5)
    base = "a common line of text that very many of the documents hold 0123"
    rows = []
    for i in range(150):
        line = list(base)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(line))
            line[at : at + 1] = draw.choice(["", "x", line[at] + "q", "7"])
        rows.append((i, "".join(line)))
    got = {r["doc_id"]: r["n_removed"] for r in linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, line in rows:
        assert got[i] == int(any(distance(line, other) <= 2 for _, other in rows[:i])), (i, line)


def test_5000_near_copies_of_one_line(spark):
    """One word pair apart each from the first: all but the first go."""
    base = "the quick brown fox jumps over the lazy dog number {} and runs away into the dark forest"
    rows = [(i, base.format(f"{i:04d}")) for i in range(5000)]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = lambda i: any(sum(x != y for x, y in zip(f"{i:04d}", f"{j:04d}")) <= 2 for j in range(i))
    want = {i: int(i > 0 and near(i)) for i in range(0, 5000, 61)}
    assert {i: got[i] for i in want} == want
