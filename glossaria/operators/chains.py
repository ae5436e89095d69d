"""Greedy choices in order, spread over tasks: each element knows the next one that would be chosen, chains are followed by doubling.

A greedy pass (batches that close when full, intervals that don't overlap) is sequential within its group, which may hold a
third of all rows. Here the group is cut into blocks of bounded size. A block works out, for each of its elements, where a
pass that comes in there leaves it; the passes over blocks are then a chain of pointers, followed in a number of rounds that
is the logarithm of the number of blocks; with the place where the pass enters each block known, blocks finish on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.scratch import stash

#: Rows of a block.
BLOCK = 1 << 16


def followed(edges: DataFrame, first: DataFrame, group: str = "g", node: str = "node") -> DataFrame:
    """(group, node, before) of the nodes on each group's chain from its first node; before adds up the weights up to there.

    edges: (group, node, next, weight), one row per node, next null at the end of a chain; first: (group, node), one per
    group. Round k knows the first 2^k nodes and where 2^k steps lead from any node.
    """
    reached = first.select(group, node, F.lit(0).cast("long").alias("before"))
    jump = edges.where("next is not null").select(group, node, "next", F.col("weight").cast("long").alias("weight"))
    while True:
        jump = stash(jump, "jumps")
        ahead = stash(reached.join(jump, [group, node]).select(group, F.col("next").alias(node), (F.col("before") + F.col("weight")).alias("before")), "reached")
        if ahead.isEmpty():
            return reached
        reached = reached.unionByName(ahead)
        again = jump.select(group, F.col(node).alias("next"), F.col("next").alias("_to"), F.col("weight").alias("_more"))
        jump = jump.join(again, [group, "next"]).select(group, node, F.col("_to").alias("next"), (F.col("weight") + F.col("_more")).alias("weight"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, their number from 0 in the order of their group: ranges of (group, order) are sorted in tasks of their own.

    A range counts its rows by group; only those counts are added up over ranges.
    """
    keys = [F.col(group), *map(F.col, order)]
    placed = stash(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    both = placed.withColumn("_part", part).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.select(*rows.columns, (row + F.col("_shift")).alias("idx"))


def batch_starts(lengths: np.ndarray, most: int, chars: int) -> np.ndarray:
    """For each item of a run the place of the item that opens the next batch, if a batch opens with it."""
    upto = np.concatenate([[0], np.cumsum(lengths)])
    n = np.arange(len(lengths))
    fits = np.searchsorted(upto, upto[:-1] + chars, "right") - 1  # the last place where the sum still fits
    return np.minimum(np.maximum(fits, n + 1), n + most)


def batches(items: DataFrame, group: str, most: int = 50, chars: int = 2000, block: int = BLOCK) -> DataFrame:
    """items (ord, text and others) with their batch's number by group: a batch closes before it would pass so many items or
    characters. Greedy in order of ord, equal ones by their text.

    A batch that is open at a block's end closes within the next `most` items, whose lengths the block gets as well.
    """
    at = numbered(items.withColumn("_length", F.char_length(F.coalesce("text", F.lit("")))), group, ["ord", "text"])
    thin = stash(at.select(F.col(group).cast("string").alias("g"), F.col(group).isNull().alias("gone"), "idx", F.col("_length").alias("size")), "batch-lengths")
    thin = thin.select(F.struct("gone", "g").alias("g"), "idx", "size", F.floor(F.col("idx") / block).cast("long").alias("block"))
    halo = thin.where((F.col("block") > 0) & (F.col("idx") % block < most)).withColumn("block", F.col("block") - 1)
    run = thin.unionByName(halo).groupBy("g", "block")

    def leave(x: pd.DataFrame) -> pd.DataFrame:
        """For each item that a batch may open with in this block's first items: the opening in the next block, and the batches between."""
        x = x.sort_values("idx")
        step, here = batch_starts(x["size"].to_numpy(), most, chars), int((x["idx"] // block == x["block"].iloc[0]).sum())
        base, out, hops = int(x["idx"].iloc[0]), np.zeros(here, np.int64), np.zeros(here, np.int64)
        for i in range(here - 1, -1, -1):
            j = int(step[i])
            out[i], hops[i] = (j, 1) if j >= here else (out[j], hops[j] + 1)
        n = min(here, most)
        ends = out[:n]
        own = x["g"].iloc[0]
        return pd.DataFrame({"gone": own["gone"], "g": own["g"], "node": base + np.arange(n), "next": pd.arrays.IntegerArray(ends + base, ends >= len(x)), "weight": hops[:n]})

    edges = run.applyInPandas(leave, "gone boolean, g string, node long, next long, weight long").select(F.struct("gone", "g").alias("g"), "node", "next", "weight")
    edges = stash(edges, "batch-edges")
    entered = followed(edges, edges.where("node = 0").select("g", "node"))

    def fill(x: pd.DataFrame) -> pd.DataFrame:
        """The batch of each item: from the opening in this block on; items before it belong to the batch before."""
        x = x.sort_values("idx")
        step = batch_starts(x["size"].to_numpy(), most, chars)
        number = np.zeros(len(x), np.int64)
        i, n = int(x["open"].iloc[0] - x["idx"].iloc[0]), int(x["before"].iloc[0])
        number[:i] = n - 1
        while i < len(x):
            j = min(int(step[i]), len(x))
            number[i:j] = n
            i, n = j, n + 1
        return pd.DataFrame({"gone": x["g"].iloc[0]["gone"], "_k": x["g"].iloc[0]["g"], "_idx": x["idx"], "batch": number})

    opened = entered.select(F.col("g"), F.col("node").alias("open"), "before", F.floor(F.col("node") / block).cast("long").alias("block"))
    opened = opened.groupBy("g", "block").agg(F.min_by(F.struct("open", "before"), "open").alias("o")).select("g", "block", "o.*")
    numbers = thin.join(opened, ["g", "block"]).groupBy("g", "block").applyInPandas(fill, "gone boolean, _k string, _idx long, batch long")
    out = at.join(numbers, (F.col(group).isNull() == F.col("gone")) & F.col(group).cast("string").eqNullSafe(F.col("_k")) & (F.col("idx") == F.col("_idx")))
    return out.select(*items.columns, "batch")


def _level(start: Column, end: Column) -> Column:
    """The level of a range: about the power of four that is its length, so that it meets at most three bins of that width."""
    return F.ceil(F.log(4.0, F.greatest(end - start, F.lit(1)).cast("double")) - 1e-9).cast("int")


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), level * 2)


def containing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The distinct (file, pos) of points in a range [start, end) of their file.

    Ranges lie in bins of a width near their own, at most three each; a point looks into one bin per width in use (at most 32
    widths, read from the ranges). A file with very many ranges or points is spread over its bins.
    """
    r = ranges.where("end > start").select("file", "start", "end", _level(F.col("start"), F.col("end")).alias("level"))
    r = r.select("file", "start", "end", "level", F.explode(F.sequence(_bin(F.col("start"), F.col("level")), _bin(F.col("end") - 1, F.col("level")))).alias("bin"))
    used = sorted(x.level for x in r.select("level").distinct().collect())  # powers of four of a long: at most 32
    if not used:
        return points.select("file", "pos").limit(0)
    p = points.select("file", "pos").distinct().withColumn("level", F.explode(F.array(*[F.lit(k) for k in used])))
    p = p.withColumn("bin", _bin(F.col("pos"), F.col("level")))
    return p.join(r, ["file", "level", "bin"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).select("file", "pos").distinct()


def _ahead(starts: DataFrame, stops: DataFrame, width: int) -> DataFrame:
    """(file, stop, next): for each distinct (file, stop) the first of starts (file, start) at or behind it, by bins of the position."""
    span = lambda c: F.floor(F.col(c) / width).cast("long").alias("bin")
    both = starts.select("file", F.col("start").alias("x"), F.col("start").alias("s"), span("start")).unionByName(stops.select("file", F.col("stop").alias("x"), F.lit(None).cast("long").alias("s"), span("stop")).distinct())
    in_bin = Window.partitionBy("file", "bin").orderBy(F.desc("x"), F.col("s").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("near", F.last("s", ignorenulls=True).over(in_bin)).where("s is null")
    later = Window.partitionBy("file").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy("file", "bin").agg(F.min("s").alias("least")).withColumn("far", F.last("least", ignorenulls=True).over(later)).drop("least")
    return found.join(bins, ["file", "bin"]).select("file", F.col("x").alias("stop"), F.coalesce("near", "far").alias("next"))


def _leave(x: pa.Table) -> pa.Table:
    """For each node of a stretch (file, start, stop) in a group, the first stop behind it that a pass reaches which comes in there."""
    x = x.sort_by("start")
    starts, out = x.column("start").to_numpy(), x.column("stop").to_numpy().copy()
    at = np.searchsorted(starts, out)
    for i in range(len(out) - 1, -1, -1):
        if at[i] < len(starts):
            out[i] = out[at[i]]
    return pa.table([x.column("file"), x.column("start"), pa.array(out)], names=["file", "start", "stop"])


def _walk(x: pa.Table) -> pa.Table:
    """The nodes of a stretch that a pass takes from its column `enter` on."""
    x = x.sort_by("start")
    starts = x.column("start").to_numpy()
    at, i, keep = np.searchsorted(starts, x.column("stop").to_numpy()), int(np.searchsorted(starts, x.column("enter")[0].as_py())), []
    while i < len(starts):
        keep.append(i)
        i = int(at[i])
    return x.take(keep).drop_columns(["enter", "stop", "block"])


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a pass takes, of batches (file, start, stop, pick) sorted by file and start, whole files one behind the other."""
    file, end = None, None
    for x in batches:
        keep = []
        for i, (f, start, stop) in enumerate(zip(x.column("file").to_pylist(), x.column("start").to_pylist(), x.column("stop").to_pylist(), strict=True)):
            if end is None or f != file or start >= end:
                keep.append(i)
                file, end = f, stop
        yield x.take(pa.array(keep, pa.int64())).drop_columns(["stop"])


def greedy(edits: DataFrame, width: int = BLOCK, span: int = 0) -> DataFrame:
    """Rows of edits (file, start, end and others) in order of start, then end, then the rest: each is taken unless it overlaps one already taken.

    Of equal starts the empty intervals are taken and the first other one; positions are whole numbers. A file of at most
    `width` starts is passed over in one go, however far they lie apart, with many files to a task; a larger one is cut into
    blocks of so many starts. Its ways from block to block are looked up in bins of `span` positions (`width`, if not given).
    """
    rest = [c for c in edits.columns if c not in ("file", "start", "end")]
    long = lambda c: F.col(c).cast("long")
    real = edits.where("end is not null").select("file", long("start").alias("start"), F.when(F.col("end") > F.col("start"), F.struct("end", *rest) if rest else long("end")).alias("pick")).where("file is not null and start is not null")
    nodes = real.groupBy("file", "start").agg(F.min("pick").alias("pick"))
    end = F.col("pick.end").cast("long") if rest else F.col("pick")
    nodes = stash(nodes.select("file", "start", F.coalesce(end, F.col("start") + 1).alias("stop"), "pick"), "interval-nodes")
    kept = StructType([f for f in nodes.schema.fields if f.name != "stop"])
    wide = stash(nodes.groupBy("file").agg(F.min("start").alias("node"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > width).drop("_n"), "wide-files")
    cut = not wide.isEmpty()
    narrow = nodes.join(wide, "file", "left_anti") if cut else nodes
    taken = narrow.repartition("file").sortWithinPartitions("file", "start").mapInArrow(_pass, kept)
    if cut:
        placed = stash(numbered(nodes.join(wide, "file", "left_semi"), "file", ["start"]).withColumn("block", F.floor(F.col("idx") / width).cast("long")).drop("idx"), "interval-blocks")
        own = placed.select("file", "start", "stop", "block")
        out = StructType([edits.schema["file"], StructField("start", LongType()), StructField("stop", LongType())])
        leaving = stash(own.groupBy("file", "block").applyInArrow(_leave, out), "interval-exits")
        doors = _ahead(own.select("file", "start"), leaving.select("file", "stop"), span or width)
        edges = leaving.join(doors, ["file", "stop"], "left").select("file", F.col("start").alias("node"), "next", F.lit(0).alias("weight"))
        # only nodes at which a pass can enter a block need an edge
        edges = edges.join(doors.select("file", F.col("next").alias("node")).union(wide).distinct(), ["file", "node"], "left_semi")
        reached = followed(stash(edges, "interval-edges"), wide, "file")
        entered = reached.select("file", F.col("node").alias("enter")).join(own.select("file", F.col("start").alias("enter"), "block"), ["file", "enter"])
        taken = taken.unionByName(placed.join(entered, ["file", "block"]).groupBy("file", "block").applyInArrow(_walk, kept))
    if edits.where("end <= start").isEmpty():
        empty = None
    else:
        taken = stash(taken, "interval-taken")
        empty = edits.where("end <= start").join(taken.select("file", "start"), ["file", "start"], "left_semi").select(*edits.columns)
    kind = {f.name: f.dataType for f in edits.schema.fields}
    value = lambda x: F.col("file") if x == "file" else F.col("start") if x == "start" else F.col(f"pick.{x}") if rest else F.col("pick")
    own = taken.where("pick is not null").select(*[value(x).cast(kind[x]).alias(x) for x in edits.columns])
    return own if empty is None else own.unionByName(empty)


def innermost(edits: DataFrame, width: int = BLOCK) -> DataFrame:
    """Edits (file, start, end and others) that contain no other range of their file; of ranges that are there twice, neither stays.

    A range contains another if one that starts no earlier ends no later: the least end among those behind it tells, within
    its stretch of positions by a window and beyond it by a row per stretch. Edits of no other columns aren't joined again.
    """
    ranges = edits.groupBy("file", "start", "end").agg(F.count(F.lit(1)).alias("_n")).withColumn("bin", F.floor(F.col("start") / width).cast("long"))
    behind = Window.partitionBy("file", "bin").orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = ranges.groupBy("file", "bin").agg(F.min("end").alias("_end")).withColumn("_far", F.min("_end").over(later)).drop("_end")
    least = ranges.withColumn("_near", F.min("end").over(behind)).join(bins, ["file", "bin"])
    alone = least.where("_n = 1 and end is not null and coalesce(least(_near, _far) > end, true)").select("file", "start", "end")
    if set(edits.columns) == {"file", "start", "end"}:
        return alone.select(*edits.columns)
    return edits.join(alone, ["file", "start", "end"], "left_semi").select(*edits.columns)
