"""Joins of keys that are nearly equal, by deletion neighbourhoods of segments instead of all pairs of a group.

Two texts within t edits of each other: cut one into t // 2 + 1 segments, and some segment meets a stretch of the other text
with one edit at most. Two strings one edit apart share a string that is one of them or lacks one character of it. So the
index holds each segment and its one-deletion neighbours, keyed with the group; probes are the stretches of the other text
that such a segment can meet, by length and place. Candidates are verified by the edit distance itself.

Joins are sorted merges: from the size of a compressed file of keys Spark would take their many neighbours for a small table
and broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_likeness
from ..sources.scratch import stash


def _neighbours(x: Column) -> Column:
    """The string and all that lack one character of it."""
    less = F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))
    return F.array_distinct(F.concat(F.array(x), F.when(F.char_length(x) > 0, less).otherwise(F.array().cast("array<string>"))))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def _index(right: DataFrame, cuts: Column) -> DataFrame:
    """right (group, text) with a row per number of segments in cuts, segment and neighbour: key, where the segment starts and its length."""
    rows = right.withColumn("len", F.char_length("text")).withColumn("cut", F.explode(cuts)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    start, stop = _whole(F.col("part") * F.col("len") / F.col("cut")), _whole((F.col("part") + 1) * F.col("len") / F.col("cut"))
    place = F.when(F.col("cut") == 1, "whole").when(F.col("part") == 0, "first").when(F.col("part") == F.col("cut") - 1, "last").otherwise("inner")
    rows = rows.withColumns({"from": start, "size": stop - start, "place": place})
    rows = rows.withColumn("bit", F.explode(_neighbours(F.substring(F.col("text"), F.col("from") + 1, F.col("size")))))
    return rows.select(F.xxhash64("group", "cut", "place", "bit").alias("key"), F.col("group").alias("r_group"), F.col("text").alias("r_text"), F.col("from").alias("r_from"), F.col("size").alias("r_size"), F.col("len").alias("r_len"))


def _probes(left: DataFrame) -> DataFrame:
    """left (group, text, edits) with a row per stretch that a segment can meet with one edit, and neighbour."""
    rows = left.withColumn("len", F.char_length("text")).withColumn("cut", _whole(F.col("edits") / 2) + 1)
    n, t, m = F.col("len"), F.col("edits"), F.col("cut")
    least = F.greatest(_whole((n - t) / m) - 1, F.lit(0))
    most = F.least(F.ceil((n + t) / m).cast("int") + 1, n)
    sizes = F.when(m == 1, F.array(n)).when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("size", F.explode(sizes))
    at = lambda start, place: F.struct(start.cast("int").alias("from"), F.lit(place).alias("place"))
    inner = F.when(m > 2, F.transform(F.sequence(F.lit(0), n - F.col("size")), lambda i: at(i, "inner"))).otherwise(F.array().cast("array<struct<from:int,place:string>>"))
    places = F.when(m == 1, F.array(at(F.lit(0), "whole"))).otherwise(F.concat(F.array(at(F.lit(0), "first"), at(n - F.col("size"), "last")), inner))
    rows = rows.withColumn("p", F.explode(places)).withColumns({"from": F.col("p.from"), "place": F.col("p.place")})
    rows = rows.withColumn("bit", F.explode(_neighbours(F.substring(F.col("text"), F.col("from") + 1, F.col("size")))))
    return rows.select(F.xxhash64("group", "cut", "place", "bit").alias("key"), "group", "text", "edits", "from", "size", "len")


def near_pairs(left: DataFrame, right: DataFrame, edits: Column, cuts: Column) -> DataFrame:
    """(group, text, near, distance): pairs of left and right (group, text) in a group, at most edits(left) apart.

    edits: a whole number by left row; cuts: an array by right row with every edits // 2 + 1 that a left row near it can have.
    """
    a, b = _probes(left.select("group", "text").distinct().withColumn("edits", edits.cast("int"))), _index(right.select("group", "text").distinct(), cuts)
    shift = F.abs(F.col("from") - F.col("r_from")) + F.abs((F.col("len") - F.col("from") - F.col("size")) - (F.col("r_len") - F.col("r_from") - F.col("r_size")))
    fits = F.col("group").eqNullSafe(F.col("r_group")) & (F.abs(F.col("size") - F.col("r_size")) <= 1) & (shift <= F.col("edits"))
    found = a.join(b.hint("merge"), "key").where(fits).select("group", "text", F.col("r_text").alias("near"), "edits").distinct()
    return found.withColumn("distance", F.levenshtein("text", "near").cast("int")).where("distance <= edits").drop("edits")


def nearest(left: DataFrame, right: DataFrame, least: int = 2, share: int = 4) -> DataFrame:
    """(group, text, near, distance): for each left (group, text) the nearest right text of its group, the smaller of equally
    near ones, within max(least, length / share) edits. One edit is tried first, then `least`, then the rest: only texts
    without a nearer one go on.
    """
    left, right = stash(left.select("group", "text").distinct(), "fuzzy-left"), stash(right.select("group", "text").distinct(), "fuzzy-right")
    size, out = F.char_length("text"), None
    wide = _whole(size / share)
    # lengths of left texts that can lie near a right text of this length
    low, high = F.greatest(_whole(size * share / (share + 1)) - 1, F.lit(0)), F.ceil(size * share / (share - 1)).cast("int") + 2
    rounds = [(F.lit(1), F.array(F.lit(1)), None), (F.lit(least), F.array(F.lit(least // 2 + 1)), None)]
    rounds.append((wide, F.sequence(_whole(_whole(low / share) / 2) + 1, _whole(_whole(high / share) / 2) + 1), wide > least))
    for edits, cuts, only in rounds:
        some = left if only is None else left.where(only)
        if some.isEmpty():
            break
        pairs = near_pairs(some, right, edits, cuts)
        best = stash(pairs.groupBy("group", "text").agg(F.min(F.struct("distance", "near")).alias("b")).select("group", "text", "b.near", "b.distance"), "fuzzy-near")
        out = best if out is None else out.unionByName(best)
        left = stash(left.join(best.hint("merge"), ["group", "text"], "left_anti"), "fuzzy-left")
    return out if out is not None else left.select("group", "text", F.lit(None).cast("string").alias("near"), F.lit(0).alias("distance"))


# ---- likeness of dotted keys -------------------------------------------------------------------------------------

_GAP = "\u0001"


def _keys(keys: DataFrame) -> DataFrame:
    own = keys.select("key").where("key is not null").distinct().withColumn("segments", F.split("key", r"\."))
    return own.select("key", F.col("segments")[0].alias("root"), "segments", F.size("segments").alias("depth"))


def _signatures(keys: DataFrame, least: float) -> DataFrame:
    """(key, root, depth, sign, places): the first segment with each choice of as many others as keys so alike must share.

    Likeness is 0.7 of the share of common segments and 0.3 at most of the rest, and nothing of the rest if depths differ.
    """
    deep = keys.withColumn("deeper", F.explode(F.array(F.col("depth") - 1, F.col("depth"), F.col("depth") + 1))).withColumn("deeper", F.greatest("deeper", "depth")).distinct()
    same = F.ceil((least - 0.3) / 0.7 * F.col("deeper") - 1e-9)
    apart = F.ceil(least / 0.7 * F.col("deeper") - 1e-9)
    others = F.array_remove(F.array_sort(F.array_distinct("segments")), F.col("root"))
    deep = deep.withColumn("others", others).withColumn("way", F.explode(F.array(F.lit("same"), F.lit("apart")))).where("way = 'apart' or deeper = depth")
    deep = deep.withColumn("need", F.greatest(F.when(F.col("way") == "same", same).otherwise(apart).cast("int") - 1, F.lit(0))).where("need <= size(others)")
    masks = F.expr("filter(sequence(0L, shiftleft(1L, size(others)) - 1), m -> bit_count(m) = need)")
    chosen = F.expr("filter(others, (s, i) -> (shiftright(_mask, i) & 1) = 1)")
    deep = deep.withColumn("_mask", F.explode(masks)).withColumn("chosen", chosen)
    places = F.expr("transform(chosen, s -> array_position(segments, s))")
    return deep.select("key", "root", "depth", F.xxhash64("root", "deeper", "way", "chosen").alias("sign"), F.when(F.col("way") == "same", places).otherwise(F.array(F.col("depth").cast("long"))).alias("places"))


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.where("key <> other").distinct().withColumn("score", F.round(key_likeness(F.col("key"), F.col("other")), 6)).where(F.col("score") >= least)


def alike(some: DataFrame, keys: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, other, score): for each of some keys all keys at least so alike with the same first segment, verified by key_likeness.

    Candidates share the first segment and as many others as they must. Meant for a stated set of keys against all.
    """
    x, y = _signatures(_keys(some), least), _signatures(_keys(keys), least).select(F.col("key").alias("other"), F.col("root").alias("_root"), "sign")
    return _scored(x.join(y.hint("merge"), "sign").where("root = _root").select("key", "other"), least)


def _moved(keys: DataFrame, least: float) -> DataFrame:
    """(key, other): keys that share enough segments, in other places or at another depth. Most choices of segments stand in one place in all keys and drop out."""
    signs = stash(_signatures(keys, least), "fuzzy-signs")
    mixed = signs.groupBy("sign").agg(F.min("places").alias("a"), F.max("places").alias("b")).where("a <> b").select("sign")
    some = signs.join(mixed.hint("merge"), "sign", "left_semi")
    return some.join(some.select(F.col("key").alias("other"), F.col("root").alias("_root"), F.col("places").alias("_places"), "sign").hint("merge"), "sign").where("root = _root and places <> _places").select("key", "other")


def best_alike(keys: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, other, score): for each key the most alike other key with the same first segment, the smaller of equals.

    Keys that differ in one segment by one edit, then by two, come from deletion neighbourhoods; where no pair yet unseen can
    score higher, the key is done. Only the rest meet all keys that share enough segments.
    """
    own = stash(_keys(keys), "fuzzy-keys")
    found = _scored(_moved(own, least), least)
    todo = own
    for edits in (1, 2):
        gap = F.expr(f"transform(segments, (s, i) -> if(i = p, '{_GAP}', s))")
        wild = lambda df: df.where("depth > 1").withColumn("p", F.explode(F.sequence(F.lit(1), F.col("depth") - 1))).select(F.array_join(gap, ".").alias("group"), F.expr("element_at(segments, p + 1)").alias("text"))
        pairs = near_pairs(wild(todo), wild(own), F.lit(edits), F.array(F.lit(edits // 2 + 1))).where("distance > 0")
        put = lambda c: F.replace(F.col("group"), F.lit(_GAP), F.col(c))
        found = stash(found.unionByName(_scored(pairs.select(put("text").alias("key"), put("near").alias("other")), least)).distinct(), "fuzzy-found")
        longest = F.expr("array_max(transform(slice(segments, 2, depth), s -> char_length(s)))")
        one = 0.7 * (F.col("depth") - 1) / F.col("depth") + 0.3 * (1 - (edits + 1) / (F.coalesce(longest, F.lit(0)) + edits + 1))
        two = F.when(F.col("depth") > 2, 0.7 * (F.col("depth") - 2) / F.col("depth") + 0.3).otherwise(0.0)
        best = found.groupBy("key").agg(F.max("score").alias("top"))
        rest = todo.join(best.hint("merge"), "key", "left").where((F.greatest(one, two) >= least - 1e-6) & (F.coalesce("top", F.lit(0.0)) <= F.greatest(one, two) + 1e-6))
        todo = stash(rest.select(*own.columns), "fuzzy-todo")
    if not todo.isEmpty():
        found = found.unionByName(alike(todo, own, least)).distinct()
    return found.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("b")).select("key", F.col("b.other").alias("other"), (-F.col("b.s")).alias("score"))
