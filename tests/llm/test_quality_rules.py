"""The limits of the quality rules: from each source's own documents, and able to reject what the base rules pass."""

import math
import random

import pytest

from specforge.llm import rules


def word(rng, least, most):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))


def prose(rng, least, most, n=100, upper=3):
    """n words in lines of five, about upper of them with a capital."""
    own = [word(rng, least, most) for _ in range(n)]
    for i in rng.sample(range(n), rng.randint(max(0, upper - 2), upper + 2)):
        own[i] = own[i].capitalize()
    return [own[i : i + 5] for i in range(0, n, 5)]


def text(lines):
    return "\n".join(" ".join(x) for x in lines)


@pytest.fixture(scope="module")
def judged(spark):
    """Source a: short words, few capitals; b: long words, many capitals and symbols. One document per rule in each."""
    rng, data, names = random.Random(3), [], {}
    for source, (least, most), upper in (("a", (3, 7), 3), ("b", (8, 14), 60)):
        for i in range(300):
            lines = prose(rng, least, most, upper=upper)
            if source == "b":
                for x in rng.sample(lines, rng.randint(4, 8)):
                    x[0] += "##"
            if i % 60 == 0:
                lines[7] = lines[2]
            if i % 60 == 1:
                lines[8:10] = lines[2:4]
            data.append((len(data), text(lines), "en", source))
        made = {k: prose(rng, least, most, upper=upper) for k in ("symbols_per_word", "trace", "dup_line_ratio", "repeat_ratio", "upper_ratio")}
        for x in made["symbols_per_word"]:
            x[0] += "##########"
        made["trace"][0][0] += "&"
        made["dup_line_ratio"][1::3] = [made["dup_line_ratio"][1]] * len(made["dup_line_ratio"][1::3])
        made["repeat_ratio"][8:10] = made["repeat_ratio"][2:4]
        made["upper_ratio"] = [[w.upper() if i % 2 else w for w in x] for i, x in enumerate(made["upper_ratio"])]
        made["longer"], made["shorter"] = prose(rng, 2 * most, 2 * most, upper=upper), prose(rng, 1, 2, upper=upper)
        for name, lines in made.items():
            names[len(data)] = (source, name)
            data.append((len(data), text(lines), "en", source))
    same = text(prose(rng, 8, 14, upper=60))
    for source in "ab":
        names[len(data)] = (source, "as in b")
        data.append((len(data), same, "en", source))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in rules.apply_rules(docs).collect()}
    return {names[i]: r for i, r in found.items() if i in names}, [r for i, r in found.items() if i not in names]


@pytest.mark.parametrize("name", ["symbols_per_word", "dup_line_ratio", "repeat_ratio", "upper_ratio", "longer", "shorter"])
@pytest.mark.parametrize("source", ["a", "b"])
def test_each_rule_rejects_what_the_base_rules_pass(judged, source, name):
    row = judged[0][source, name]
    assert not row["base_failed"] and not row["kept"]
    assert ("word_length" if name in ("longer", "shorter") else name) in row["broken"]


def test_limits_differ_by_source(judged):
    a, b = judged[0]["a", "as in b"], judged[0]["b", "as in b"]
    assert {"upper_ratio", "word_length"} <= set(a["broken"]) and not a["kept"]
    assert b["broken"] == [] and b["kept"]


def test_most_documents_and_traces_stay(judged):
    special, plain = judged
    assert sum(r["kept"] for r in plain) >= 0.9 * len(plain)
    assert special["b", "trace"]["kept"]


def plain_verdict(rows, stats):
    """limits of each group by plain counting over buckets, one level after the other."""
    bucket = lambda v: 0 if v < rules.SMALLEST else math.ceil(math.log(v / rules.SMALLEST) / math.log(rules.GAMMA)) + 1
    value = lambda b: 0.0 if b == 0 else rules.GAMMA ** (b - 1.5) * rules.SMALLEST
    edge = lambda b: rules.GAMMA ** max(b - 1, 0) * rules.SMALLEST * (1 + 1e-9)

    def quantiles(own):
        own, some = sorted(own), sorted(b for b in own if b)
        at = lambda xs, p: next(x for i, x in enumerate(xs, 1) if i >= len(xs) * p)
        return {"q25": value(at(own, 0.25)), "q75": value(at(own, 0.75)), "low": edge(at(own, 0.02) - 1), "high": edge(at(own, 0.98)), "begin": value(at(some, 0.05)) if some else None}, len(own), len(some)

    def fences(kept):
        out = {}
        for group in {(r["lang"], r["source"]) for r in rows}:
            for k in stats:
                chosen = {}
                for test in (lambda r: True, lambda r, g=group: r["lang"] == g[0], lambda r, g=group: (r["lang"], r["source"]) == g):
                    own = [bucket(r[k]) for r in kept if test(r)]
                    if own:
                        q, n, m = quantiles(own)
                        for name, v in q.items():
                            weight, count = (rules.PRIOR_NONZERO, m) if name == "begin" else (rules.PRIOR, n)
                            before = chosen.get(name)
                            chosen[name] = before if v is None else v if before is None else (v * count + before * weight) / (count + weight)
                out[group, k] = chosen
        return out

    fine = [r for r in rows if not r["base_failed"]]
    first = fences(fine)
    varied = {g: q["q25"] > 0 and q["q75"] > q["q25"] for g, q in first.items()}

    def inside(r, k, by):
        g = ((r["lang"], r["source"]), k)
        if not varied[g]:
            return True
        q = first[g]
        return r[k] <= q["q75"] + by * (q["q75"] - q["q25"]) and (not rules.RULES[k] or r[k] >= q["q25"] - by * (q["q75"] - q["q25"]))

    core = fences([r for r in fine if all(inside(r, k, rules.INNER) for k in stats)])

    def breaks(r, k):
        g = ((r["lang"], r["source"]), k)
        if varied[g]:
            return not inside(r, k, rules.FENCE)
        high, begin = core[g]["high"], first[g].get("begin")
        high = high if begin is None else max(high, (high + begin) / 2)
        return r[k] > high or rules.RULES[k] and r[k] < core[g]["low"]

    return {r["doc_id"]: not r["base_failed"] and not any(breaks(r, k) for k in stats) for r in rows}


def test_kept_equals_plain_counting(spark):
    rng, data = random.Random(9), []
    for i in range(420):
        lines = prose(rng, *rng.choice([(3, 7), (8, 14)]), n=rng.choice([40, 60, 120]), upper=rng.choice([3, 30]))
        if i % 7 == 0:
            lines[-1] = lines[0]
        if i % 5 == 0:
            lines[0][0] += "#" * rng.randint(1, 30)
        data.append((i, text(lines), ["en", "en", "fr", None][i % 4], f"s{min(i % 13, 5)}" if i % 3 else "big"))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    rows = [r.asDict() for r in rules.statistics(docs).collect()]
    found = {r["doc_id"]: r["kept"] for r in rules.apply_rules(docs).collect()}
    assert found == plain_verdict(rows, list(rules.RULES)) and 0 < sum(found.values()) < len(found)


def test_no_number_of_documents_is_a_switch(spark):
    """With one document more in a group no limit jumps."""
    rng = random.Random(4)
    data = [(i, text(prose(rng, 3, 7, n=60)), "en", "a" if i < 203 else "b") for i in range(600)]

    def upper(n):
        docs = spark.createDataFrame([r for r in data if r[0] < n or r[0] >= 203], "doc_id long, text string, lang string, source string")
        stats = rules.statistics(docs)
        groups = stats.groupBy("lang", "source").count().withColumnRenamed("count", "n")
        return next(r["word_length_highest"] for r in rules.limits(stats, groups).collect() if r["source"] == "a")

    limits = [upper(n) for n in (198, 199, 200, 201, 202)]
    assert max(limits) - min(limits) < 0.02 * max(limits)
