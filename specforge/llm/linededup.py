"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are first made distinct by their text. Each distinct line of length n is cut into TAU + 1 segments; a line within
TAU edits must hold one of them unchanged, near its place. Lines index their own segments by (length, segment, hash)
and probe the segments of lines up to TAU characters shorter, at the few places where a match can start. Lines that
meet are compared by a banded bit-parallel edit distance. A line goes if its text stood earlier (by doc_id, then
place), or if a line within TAU edits did.

A segment that many lines share is a hot key. Its lines meet under finer keys: of the five blocks of the full letter
signature, of which TAU = 2 edits change at most four bits, one must be equal. They meet the earliest lines of the group
first, a few and then more, and a line that is settled drops out: a group of near copies is settled without its pairs.
The lines still open then meet all earlier ones. Groups are cut into blocks on both sides, so that no task holds a whole
one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, look_up, shuffle_parts, small, staged, unused

TAU = 2
LEAST_CHARS = 16
NEAR_CHARS = 24
PLACES = 10**10
LETTERS = "dlshcugi"
#: Characters of the full signature, eight to a block; one block more than the bits that two edits can change.
ALPHABET = " etaoinshrdlucmfwygpbvkxjqz.,-0123456789"
#: Lines of one length that share a segment up to which they meet at once.
HOT_LINES = 32
#: Earliest open lines of a finer key that the others meet, round by round, before all meet.
LEADERS = (1, 16, 128)
#: Lines of a finer key on either side in one block.
BLOCK_LINES = 2048
_RING = 0x00FF00FF  # shifted by a count and cut to eight bits: neighbours on the ring differ in one bit


def _places(tau: int) -> list[tuple[int, int, int]]:
    """(delta, segment, move): where a segment of a line shorter by delta can stand, by the multi-match-aware windows."""
    return [(delta, i, move) for delta in range(tau + 1) for i in range(tau + 1) for move in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1)]


def _keys(lines: DataFrame, places: list[tuple[int, int, int]], tau: int) -> DataFrame:
    """id, n, sig, own, key: a row for each place inside the line; own where the line indexes itself. The longer segments come last."""
    spots = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("delta", "segment", "move"), p, strict=True)]) for p in places])
    spread = lines.select("id", "n", "sig", "line", F.explode(spots).alias("p")).select("id", "n", "sig", "line", (F.col("n") - F.col("p.delta")).alias("of"), "p.segment", "p.move", ((F.col("p.delta") == 0) & (F.col("p.move") == 0)).alias("own"))
    size = F.floor(F.col("of") / (tau + 1)).cast("int")
    short = F.lit(tau + 1) - F.col("of") % (tau + 1)
    at = F.lit(1) + size * F.col("segment") + F.greatest(F.lit(0), F.col("segment") - short) + F.col("move")
    cut = spread.select("id", "n", "sig", "line", "of", "segment", "own", at.alias("at"), (size + (F.col("segment") >= short).cast("int")).alias("size"))
    inside = cut.filter((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n")))
    return inside.select("id", "n", "sig", "own", F.xxhash64(F.substr("line", F.col("at"), F.col("size")), F.col("of"), F.col("segment")).alias("key"))


def letter_signature(letters: str = LETTERS) -> Column:
    """64 bits: for each of eight letters its count on a ring of sixteen. An edit changes two bits at most."""
    sig = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        count = (F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))) % 16
        own = F.call_function("shiftright", F.lit(_RING), count).bitwiseAND(F.lit(255)).cast("long")
        sig = sig.bitwiseXOR(F.shiftleft(own, 8 * i))
    return sig


def within(a: Column, b: Column, tau: int) -> Column:
    """True if the edit distance of a and b, whose lengths differ by tau at most, is tau at most.

    What a and b begin and end with alike is set aside. Of the rest, rows of a stand against columns of b. The 2 * tau + 1
    rows around the diagonal are one small bit vector each for positive and negative vertical differences; a column costs
    a fixed number of operations on them. The distance is followed down the lowest diagonal of the band and, once that
    leaves a, along a's last row. Characters are code points.
    """
    alike = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False)).cast("int") - 1
    tail = lambda x, n: F.slice(x, n + 1, F.size(x) - n)
    back = lambda x, y, n: F.struct(F.reverse(tail(x, n)).alias("x"), F.reverse(tail(y, n)).alias("y"))
    middle = lambda r: let(alike(r["x"], r["y"]), lambda n: F.when(n < 0, F.lit(True)).otherwise(let(F.struct(tail(r["x"], n).alias("x"), tail(r["y"], n).alias("y")), lambda s: _banded(s["x"], s["y"], F.size(s["x"]), F.size(s["y"]), tau))))
    whole = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    front = lambda s: let(alike(s["x"], s["y"]), lambda n: F.when(n < 0, F.lit(True)).otherwise(let(back(s["x"], s["y"], n), middle)))
    return F.when(a == b, F.lit(True)).when((a == "") | (b == ""), F.abs(F.length(a) - F.length(b)) <= tau).otherwise(let(whole, front))


def _banded(x: Column, y: Column, m: Column, n: Column, tau: int) -> Column:
    band = 2 * tau + 1
    full = (1 << band) - 1
    right = lambda v, k: F.call_function("shiftright", v, k)

    def column(j: Column) -> Column:
        match = F.lit(0)
        for k in range(band):
            i = j - tau + k
            match = match + F.when((i >= 1) & (i <= m) & (F.get(x, i - 1) == F.get(y, j - 1)), F.lit(1 << k)).otherwise(F.lit(0))
        return F.struct(j.alias("j"), match.alias("pm"))

    def step(state: Column, at: Column) -> Column:
        vp, vn, d, pm, j = state["vp"], state["vn"], state["d"], at["pm"], at["j"]
        diagonal = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(full))

        def horizontal(d0: Column) -> Column:
            plus = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))

            def done(hp: Column) -> Column:
                hn, moved, k = d0.bitwiseAND(vp), F.shiftright(d0, 1), m - j + tau
                down = F.lit(1) - F.shiftright(d0, 2 * tau).bitwiseAND(F.lit(1))
                along = right(hp, k).bitwiseAND(F.lit(1)) - right(hn, k).bitwiseAND(F.lit(1))
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"),
                    moved.bitwiseAND(hp).alias("vn"),
                    (d + F.when(j + tau <= m, down).otherwise(along)).alias("d"),
                )

            return let(plus, done)

        return let(diagonal, horizontal)

    start = F.struct(F.lit(full ^ ((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(tau)).alias("d"))
    distance = F.aggregate(F.transform(F.sequence(F.lit(1), n), column), start, step, lambda s: s["d"])
    return F.when(F.abs(m - n) > tau, F.lit(False)).when(n == 0, m <= tau).otherwise(distance <= tau)


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, rk (a hash of the text, for rows that repeat an id), pos, line, place, id, id2: the lines that count.

    place orders them as they are read; id and id2 are two hashes of the line, 128 bits in all.
    """
    split = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("rk"), F.split("text", "\n").alias("lines"))
    lines = split.select("doc_id", "rk", F.posexplode("lines").alias("pos", "line"))
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos")
    return lines.filter(F.length("line") >= least_chars).select("*", place.alias("place"), F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"))


def _signatures() -> Column:
    """The blocks of the full signature. An edit changes two bits of all of them at most."""
    return F.array(*[letter_signature(ALPHABET[i : i + 8]) for i in range(0, len(ALPHABET), 8)])


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two full signatures differ."""
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(len(ALPHABET) // 8)])


def verified(pairs: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """id of the later line of each pair (r, s) within tau edits."""
    ids = staged(pairs.select(F.col("r").alias("id")).union(pairs.select("s")).distinct(), "ids")
    texts = staged(lines.select("id", "line", "place").join(small(ids), "id").withColumn("sigs", _signatures()), "texts")
    a, b = (texts.select(F.col("id").alias(k), F.col("line").alias(f"{k}_line"), F.col("place").alias(f"{k}_place"), F.col("sigs").alias(f"{k}_sigs")) for k in "rs")
    close = pairs.join(a, "r").join(b, "s").filter(_apart(F.col("r_sigs"), F.col("s_sigs")) <= 2 * tau)
    later = F.when(F.col("r_place") < F.col("s_place"), F.col("s")).otherwise(F.col("r"))
    # Comparing costs time, not bytes: the rows are dealt evenly before.
    close = staged(close.select("r_line", "s_line", later.alias("id")).repartition(shuffle_parts(lines.sparkSession)), "close")
    return staged(close.filter(within(F.col("r_line"), F.col("s_line"), tau)).select("id").distinct(), "verified")


def _finer(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """sub (the finer key), id, side, size, place, sigs, n0, n1 (lines of either side) of the lines under hot keys.

    probes has key, id and own; a line that indexes the key (side 0) also probes it.
    """
    members = probes.withColumn("side", F.explode(F.when(F.col("own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).drop("own")
    ids = staged(members.select("id").distinct(), "ids")
    own = staged(lines.join(small(ids), "id").select("id", F.col("n").alias("size"), "place", _signatures().alias("sigs")), "signed")
    spread = members.join(own, "id").select("key", "id", "side", "size", "place", "sigs", F.posexplode("sigs").alias("block", "sig"))
    spread = staged(spread.select(F.xxhash64("key", "block", "sig").alias("sub"), "id", "side", "size", "place", "sigs"), "spread")
    groups = spread.groupBy("sub").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    groups = staged(groups.filter("n0 > 0 AND n1 > 0").withColumn("n", F.col("n0") + F.col("n1")), "groups")
    return staged(look_up(spread, groups, ["sub"]).filter("n0 IS NOT NULL"), "finer")


def _meet(later: DataFrame, earlier: DataFrame, tau: int) -> DataFrame:
    """r, s: an earlier and a later line of one finer key, from different sides, that the full signatures do not tell apart.

    Either side's lines are dealt to blocks; a line meets all blocks of the other side.
    """
    def blocks(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        at = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias("at")
        return df.select("*", at, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias("over"))

    def count(side: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.when(F.col("side") == side, F.col("n0")).otherwise(F.col("n1")) / BLOCK_LINES)).cast("int")

    cut = lambda df: df.withColumns({"mine": count(0), "theirs": count(1)})
    a = blocks(cut(later), "mine", "theirs").select("sub", "side", F.col("at").alias("x"), F.col("over").alias("y"), "id", "size", "place", "sigs")
    b = blocks(cut(earlier), "mine", "theirs").select("sub", (F.lit(1) - F.col("side")).alias("side"), F.col("over").alias("x"), F.col("at").alias("y"), *[F.col(c).alias(f"e_{c}") for c in ("id", "size", "place", "sigs")])
    alike = (F.col("e_place") < F.col("place")) & (F.abs(F.col("e_size") - F.col("size")) <= tau) & (_apart(F.col("e_sigs"), F.col("sigs")) <= 2 * tau)
    on = ["sub", "side", "x", "y"]
    return a.join(b, [*on]).filter(alike).select(F.col("e_id").alias("r"), F.col("id").alias("s")).distinct()


def _hot_near(probes: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """id of the lines under hot keys that have an earlier line within tau edits."""
    finer = _finer(probes, lines)
    near: DataFrame | None = None
    for leaders in LEADERS:
        still = finer if near is None else finer.join(small(near), "id", "left_anti")
        place = F.row_number().over(Window.partitionBy("sub", "side").orderBy("place", "id"))
        lead = staged(still.withColumn("rank", place).filter(F.col("rank") <= leaders).drop("rank"), "lead")
        met = staged(_meet(still, lead, tau), "led")
        if met.isEmpty():
            break
        found = verified(met, lines, tau)
        near = found if near is None else staged(near.union(found).distinct(), "near")
    still = finer if near is None else finer.join(small(near), "id", "left_anti")
    rest = verified(staged(_meet(still, finer, tau), "rest"), lines, tau)
    return rest if near is None else near.union(rest)


def near_lines(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """id of the lines within tau edits of a line that stands earlier; lines has id, n, sig, place and line, each line once."""
    index = _keys(lines, [(0, i, 0) for i in range(tau + 1)], tau)
    probe = _keys(lines, _places(tau), tau)
    hot = staged(index.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > HOT_LINES).select("key"), "hot")
    r = index.join(small(hot), "key", "left_anti").select("key", F.col("id").alias("r"), F.col("n").alias("rn"), F.col("sig").alias("rs"))
    # A hot key stands on this side once, without a line: it hands on the lines that probe it.
    r = r.union(hot.select("key", *[F.lit(None).cast(t) for t in ("long", "int", "long")]))
    s = probe.withColumnsRenamed({"id": "s", "n": "sn", "sig": "ss", "key": "probed"})
    order = (F.col("rn") < F.col("sn")) | ((F.col("rn") == F.col("sn")) & (F.col("r") < F.col("s")))
    alike = order & (F.col("sn") - F.col("rn") <= tau) & (F.bit_count(F.col("rs").bitwiseXOR(F.col("ss"))) <= 2 * tau)
    met = r.hint("shuffle_hash").join(s, (F.col("key") == F.col("probed")) & (F.col("r").isNull() | alike))
    met = staged(met.select("r", "s", F.when(F.col("r").isNull(), F.struct("key", "own")).alias("hot")), "met")
    near = verified(staged(met.filter("r IS NOT NULL").select("r", "s").distinct(), "pairs"), lines, tau)
    if hot.isEmpty():
        return near
    return near.union(_hot_near(met.filter("r IS NULL").select("hot.key", F.col("s").alias("id"), "hot.own"), lines, tau)).distinct()


def deduplicate(docs: DataFrame, tau: int = TAU, least_chars: int = LEAST_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with text replaced by what stays of it, and n_lines, n_removed and n_near (removed as near copies) added.

    Lines are what stands between line feeds; those shorter than least_chars stay, and those shorter than near_chars go
    only as exact copies. A null text stays null with no lines, and rows with a null doc_id are returned as they are.
    Rows that repeat a doc_id count as one document with it. An empty table stays empty; very long texts are handled
    like any; other columns are kept, whatever their names. Of equal lines in one place (rows that repeat a doc_id) all stay.
    """
    found = occurrences(docs, least_chars)
    counts = found.groupBy("id", "id2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = staged(counts.filter("n > 1"), "repeated")
    known = look_up(found.select("id", "id2", "place", "line"), repeated, ["id", "id2"])
    firsts = known.filter((F.length("line") >= near_chars) & (F.col("first").isNull() | (F.col("place") == F.col("first"))))
    lines = staged(firsts.select("id", "id2", "place", F.length("line").alias("n"), letter_signature().alias("sig"), "line"), "lines")
    near = near_lines(lines, tau)
    near = staged(lines.select("id", "id2").join(small(near), "id").distinct().withColumn("near", F.lit(True)), "near")
    marks = repeated.join(near, ["id", "id2"], "full_outer").select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n", F.lit(1)).alias("n"))
    copies = look_up(found.select("doc_id", "rk", "pos", "place", "id", "id2"), staged(marks, "marks"), ["id", "id2"])
    removed = copies.filter(F.col("near") | (F.col("place") != F.col("first")))
    rk, doc, own_rk, gone = unused(docs.columns, "rk", "doc", "own_rk", "gone")
    per_doc = removed.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("pos", "near")).alias(gone)).withColumnsRenamed({"doc_id": doc, "rk": own_rk})
    joined = docs.withColumn(rk, F.xxhash64("text")).join(per_doc, (F.col("doc_id") == F.col(doc)) & (F.col(rk) == F.col(own_rk)), "left")
    lines_of = F.split("text", "\n")
    places = F.transform(gone, lambda g: g["pos"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), places)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(let(lines_of, lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")))
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    own = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", "n_near")]
    return joined.select(*own, count(F.size(lines_of)).alias("n_lines"), count(F.size(gone)).alias("n_removed"), count(F.size(F.filter(gone, lambda g: g["near"]))).alias("n_near"))
