"""Nearly equal keys, ranges, greedy chains and batches against brute force, with hot groups cut into small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from glossaria.functions.text import key_likeness
from glossaria.operators import chains, fuzzy, joins


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, text, n):
    for _ in range(n):
        i, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:i] + (rng.choice("abé") if kind < 2 else "") + text[i + (kind > 0) :]
    return text


def test_nearest_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé_") for _ in range(rng.randrange(0, 26)))
    right = {(rng.choice("pq"), word()) for _ in range(250)} | {("p", ""), ("p", "a"), ("q", "zz"), (None, "lone")}
    left = {(g, mutated(rng, t, rng.randrange(0, 8))) for g, t in right} | {("p", word()) for _ in range(60)} | {("r", "abc"), ("q", ""), (None, "lune")}
    schema = "group string, text string"
    got = {(r.group, r.text): (r.near, r.distance) for r in fuzzy.nearest(spark.createDataFrame(sorted(left, key=str), schema), spark.createDataFrame(sorted(right, key=str), schema)).collect()}
    want = {}
    for g, t in left:
        best = min(((edits(t, u), u) for h, u in right if h == g), default=(99, ""))
        if best[0] <= max(2, len(t) // 4):
            want[g, t] = (best[1], best[0])
    assert got == want and {d for _, d in got.values()} >= {0, 1, 2, 3, 4, 5}


def test_candidates_follow_matches(spark):
    """Ten thousand keys under one prefix: candidates are a small multiple of the pairs, not all pairs."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(10, 24))) for _ in range(10_000)]
    right = spark.createDataFrame([("p", w) for w in words], "group string, text string")
    left = spark.createDataFrame([("p", mutated(rng, w, 2)) for w in words[:2000]], "group string, text string")
    a, b = fuzzy._probes(left.withColumn("edits", F.lit(2))), fuzzy._index(right, F.array(F.lit(2)))
    joined = a.join(b, "key").count()
    pairs = fuzzy.near_pairs(left, right, F.lit(2), F.array(F.lit(2))).count()
    assert pairs >= 1900 and joined < 100 * pairs < 0.1 * 2000 * 10_000


def test_typo_repair_keeps_its_rows(spark):
    known = spark.createDataFrame([(k,) for k in ("a.b.title", "a.b.titel", "a.b.subtitle", "a.c.title", "noprefix")], "key string")
    broken = spark.createDataFrame([(k,) for k in ("a.b.titl", "a.c.titel", "a.d.title", "noprefiy", "a.b.subtitleee")], "key string")
    got = {r.key: (r.repair, r.distance) for r in joins.typo_repair(broken, known).collect()}
    assert got == {"a.b.titl": ("a.b.titel", 1), "a.c.titel": ("a.c.title", 2), "noprefiy": ("noprefix", 1), "a.b.subtitleee": ("a.b.subtitle", 2)}


@pytest.mark.parametrize("least", [0.6, 0.75])
def test_best_alike_against_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    part = lambda: rng.choice(["title", "titles", "save", "load", "text", "error", "ok", "x", "buttonLabel", "button_label", "name", "names", str(rng.randrange(300))])
    keys = {".".join([rng.choice(["a", "b"]), *(part() for _ in range(rng.choice([0, 1, 2, 2, 2, 3, 3, 4, 6])))]) for _ in range(260)}
    keys |= {"a.one.two.three", "a.two.one.three", "a.1.2.3.4.5.6", "a.1.2.3.4.5", "a.1.2.3.4.5.7", "c.alone", "a"}
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: (r.other, r.score) for r in fuzzy.best_alike(df, least).collect()}
    both = df.crossJoin(df.withColumnRenamed("key", "other")).where("key <> other and split_part(key, '.', 1) = split_part(other, '.', 1)")
    want = {}
    for r in both.withColumn("score", F.round(key_likeness(F.col("key"), F.col("other")), 6)).where(F.col("score") >= least).collect():
        if r.key not in want or (-r.score, r.other) < (-want[r.key][1], want[r.key][0]):
            want[r.key] = (r.other, r.score)
    assert got == want and len(got) > 3
    assert {(r.key, r.other) for r in fuzzy.alike(df, df, least).collect()} == {(r.key, r.other) for r in both.where(F.round(key_likeness(F.col("key"), F.col("other")), 6) >= least).collect()}


# ---- ranges ----


def test_points_outside_ranges(spark):
    rng = random.Random(4)
    ranges = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 7, 60, 900, 40_000])) for s in (rng.randrange(50_000) for _ in range(300))] + [("c", 0, 10**12), ("d", 5, 5)]
    points = [(rng.choice("abcde"), rng.randrange(100_000)) for _ in range(600)] + [("c", 10**12), ("c", 10**12 - 1), ("d", 5)]
    got = joins.outside(spark.createDataFrame(points, "file string, pos long"), spark.createDataFrame(ranges, "file string, start long, end long"))
    want = sorted((f, p) for f, p in points if not any(g == f and s <= p < e for g, s, e in ranges))
    assert sorted(map(tuple, got.collect())) == want and want
    assert joins.outside(spark.createDataFrame(points, "file string, pos long"), spark.createDataFrame([], "file string, start long, end long")).count() == len(points)


def test_greedy_intervals_over_blocks(spark):
    rng = random.Random(5)
    rows = []
    for file, n, span in (("hot", 1500, 3000), ("b", 40, 50), ("c", 1, 9), ("dense", 300, 100)):
        for _ in range(n):
            s = rng.randrange(span)
            rows.append((file, s, s + rng.choice([0, 1, 3, 10, 200]), rng.choice("xyz")))
    rows += [("one", 0, 10**9, "w"), ("one", 5, 6, "w"), ("one", 10**9, 10**9 + 1, "w"), ("neg", -50, -10, "w"), ("neg", -20, 0, "w"), ("neg", -10, -10, "w")]
    got = sorted(map(tuple, chains.greedy(spark.createDataFrame(rows, "file string, start long, end long, new string"), width=16).collect()))
    want = []
    for file in {r[0] for r in rows}:
        end = -(10**12)
        for r in sorted(r for r in rows if r[0] == file):
            if r[1] >= end:
                want.append(r)
                end = r[2]
    assert got == sorted(want)


def test_greedy_intervals_far_apart(spark):
    """Files of few starts aren't cut, however far these lie apart."""
    rng = random.Random(8)
    rows = sorted({(file, s, s + rng.randrange(1, 10**8)) for file in "abc" for s in (rng.randrange(10**9) for _ in range(60))})
    found = chains.greedy(spark.createDataFrame([*rows, (None, 1, 2)], "file string, start long, end long"))
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    want, ends = [], {}
    for file, start, end in rows:
        if start >= ends.get(file, 0):
            want.append((file, start, end))
            ends[file] = end
    assert sorted(map(tuple, found.collect())) == want and len(want) < len(rows)


def test_innermost_over_blocks(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), s, s + rng.choice([0, 1, 4, 9, 70])) for s in (rng.randrange(400) for _ in range(250))] + [("c", 0, 10), ("c", 1, 20), ("c", 2, 5), ("d", 0, 10**6), ("d", 10**5, 10**5 + 1)]
    got = sorted(map(tuple, chains.innermost(spark.createDataFrame(rows, "file string, start long, end long"), width=16).collect()))
    assert got == sorted(r for i, r in enumerate(rows) if not any(j != i and o[0] == r[0] and o[1] >= r[1] and o[2] <= r[2] for j, o in enumerate(rows)))
    assert ("c", 0, 10) not in got and ("c", 2, 5) in got


def test_batches_over_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, "x" * rng.choice([0, 1, 5, 30, 200])) for i in range(900)] + [("c", 1, None), ("c", 2, "y" * 500)]
    df = spark.createDataFrame(rows, "role string, ord long, text string")
    got = {(r.role, r.ord): r.batch for r in joins.batches(df, "role", most=7, chars=120, block=20).collect()}
    want, state = {}, {}
    for role, i, text in rows:
        b, n, size = state.get(role, (0, 0, 0))
        length = len(text or "")
        if n and (n >= 7 or size + length > 120):
            b, n, size = b + 1, 0, 0
        state[role] = (b, n + 1, size + length)
        want[role, i] = b
    assert got == want and max(want.values()) > 50


def test_chains_are_followed(spark):
    edges = [("a", i, i + 3 if i + 3 < 100 else None, i) for i in range(100)] + [("b", 0, None, 1)]
    got = {(r.g, r.node): r.before for r in chains.followed(spark.createDataFrame(edges, "g string, node long, next long, weight long"), spark.createDataFrame([("a", 1), ("b", 0)], "g string, node long")).collect()}
    want, total = {("b", 0): 0}, 0
    for i in range(1, 100, 3):
        want["a", i] = total
        total += i
    assert got == want
