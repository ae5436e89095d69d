"""Divergence of each source's term distribution from every other source of its language, by inclusion-exclusion over supports.

With p the smoothed integer probability of a term in a group (language and source) and f(p, q) = floor((p - q)^2 / q), the
divergence of group g from h sums f over all kept terms of the language. Few of them occur in both, so it is put together as

    sum over g's terms of f(p, q0)  +  sum over h's terms of f(p0, q)           one-sided: histograms of counts
    + (V - g's terms - h's terms) * f(p0, q0)                                   both zero: a constant
    + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)        corrections: joins of posting lists

where p0 and q0 belong to a count of zero. No term is priced where it doesn't occur, and all arithmetic is in integers.

Scale: texts are cut into terms in their tasks and counted there (Arrow batches), so a frequent term or a source with a
third of all rows arrives as partial counts. Counts meet by language and term, never by source. Postings are one row per
group and term; the join of postings on the term makes a row per term and pair of sources that share it. Histograms and
group totals are tiny. The ranking keeps 200 terms per group in every task before it shuffles.

Defined cases: null text, lang and source are ''; groups without terms are there, with value 0 against others where the
language has no kept terms; equal values are ranked by item; repeated rows count as documents each; an empty table gives no
rows; very long texts are cut like others; other columns are ignored. A lone source has no `pair` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stash, text_slices, words

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCUMENTS = 3
UNIT_STEPS = 3  # three steps of a thousand: probabilities are in units of 1e-9
TOP_TERMS = 200
#: Rows of partial counts that a task adds up before it passes them on.
HELD_ROWS = 1 << 19
#: Bytes that are no part of a term: controls, blanks, digits, marks and DEL of ASCII.
NO_TERM = np.zeros(256, bool)
NO_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SCHEMA = "lang string, source string, term string, n long, documents long"


def _added(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("documents", "sum")])
    return pa.table([total.column(c) for c in ("lang", "source", "term", "n_sum", "documents_sum")], names=[c.split()[0] for c in SCHEMA.split(", ")])


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term, occurrences, documents) of a task; the empty term stands for the group itself, with no occurrences."""
    held: list[pa.Table] = []
    size = base = 0
    for rows, data, at in text_slices(batches):
        h, row, start, end = words(data, at, space=NO_TERM)
        groups = [pa.array(rows.column(i).to_pylist()).dictionary_encode() if rows.num_rows else None for i in (0, 1)]
        code = np.asarray(groups[0].indices).astype(np.int64) * len(groups[1].dictionary) + np.asarray(groups[1].indices)
        group = code[row]
        order = np.lexsort((row, h, group))
        g, x, r = group[order], h[order], row[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        other = new.copy()
        other[1:] |= r[1:] != r[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        documents = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        s, z = start[order[first]], (end - start)[order[first]]
        ends = np.cumsum(z)
        picked = LOWER[data[np.repeat(s - (ends - z), z) + np.arange(ends[-1] if len(ends) else 0)]]
        terms = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(picked)])
        own = np.unique(code)  # the groups themselves
        both = np.concatenate([g[first], own])
        lang = groups[0].dictionary.take(pa.array(both // len(groups[1].dictionary)))
        source = groups[1].dictionary.take(pa.array(both % len(groups[1].dictionary)))
        held.append(pa.table([lang, source, pa.concat_arrays([terms, pa.array([""] * len(own), pa.string())]), np.concatenate([n, np.zeros(len(own), np.int64)]), np.concatenate([documents, np.zeros(len(own), np.int64)])], names=[c.split()[0] for c in SCHEMA.split(", ")]))
        size += len(both)
        if size - base >= HELD_ROWS:
            held = [_added(held)]
            size = base = held[0].num_rows
            if size > 2 * HELD_ROWS:
                yield from held[0].to_batches(1 << 14)
                held, size, base = [], 0, 0
    if held:
        yield from _added(held).to_batches(1 << 14)


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the kept terms, and a row with term '' and n = 0 for each group."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = text.mapInArrow(counts, SCHEMA).repartition("lang", "term")
    each = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    spread = F.sum("documents").over(Window.partitionBy("lang", "term"))
    return each.withColumn("_spread", spread).where((F.col("_spread") >= LEAST_DOCUMENTS) | (F.col("term") == "")).select("lang", "source", "term", "n")


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + kept)), by long division in base 1000: no product beyond 1000 * (total + kept)."""
    whole, rest, out = total + kept, n + 1, F.lit(0).cast("long")
    for _ in range(UNIT_STEPS):
        out, rest = out * 1000 + _div(rest * 1000, whole), rest * 1000 % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def chi(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1."""
    return _div((p - q) * (p - q), q)


def divergences(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the lang, part `term` the terms a source uses most beyond its lang."""
    prepare(docs.sparkSession)
    post = stash(postings(docs), "divergence-postings")
    used = post.where("term <> ''")
    # totals by group and by lang: a few numbers each
    hist = stash(used.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "divergence-histograms")
    by_term = stash(used.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "divergence-terms")
    lang = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = hist.groupBy("lang", "source").agg(F.sum("terms").alias("support"), F.sum(F.col("n") * F.col("terms")).alias("total"))
    names = post.where("term = ''").select("lang", "source")
    group = names.join(sizes, ["lang", "source"], "left").join(lang, "lang", "left").na.fill(0, ["support", "total", "v", "lang_total"])
    zero = F.when(F.col("v") > 0, probability(F.lit(0), F.col("total"), F.col("v")))
    group = stash(group.withColumn("p0", zero), "divergence-groups")

    # one-sided terms: each count of a group against the zero of every other group, in both directions
    p = probability(F.col("n"), F.col("total"), F.col("v"))
    priced = hist.join(group, ["lang", "source"]).select("lang", "source", "terms", p.alias("p"))
    other = group.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    sides = priced.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(chi(F.col("p"), F.col("q0")) * F.col("terms")).alias("from"), F.sum(chi(F.col("q0"), F.col("p")) * F.col("terms")).alias("to"))
    sides = stash(sides, "divergence-sides")
    parts = [sides.select("lang", "source", "item", F.col("from").alias("x")), sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("to").alias("x"))]

    # both zero, for all but the two supports
    right = group.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("support").alias("item_support"))
    pairs = group.join(right, "lang").where("source <> item")
    parts.append(pairs.select("lang", "source", "item", F.coalesce((F.col("v") - F.col("support") - F.col("item_support")) * chi(F.col("p0"), F.col("q0")), F.lit(0)).alias("x")))

    # corrections for the terms in both
    known = group.select("lang", "source", "total", "v", "p0")
    mine = used.join(known, ["lang", "source"]).select("lang", "term", "source", p.alias("p"), "p0")
    a, b = mine, mine.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b, ["lang", "term"]).where("source < item")
    P, Q, P0, Q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    fix = both.groupBy("lang", "source", "item").agg(F.sum(chi(P, Q) - chi(P, Q0) - chi(P0, Q) + chi(P0, Q0)).alias("there"), F.sum(chi(Q, P) - chi(Q, P0) - chi(Q0, P) + chi(Q0, P0)).alias("back"))
    ways = F.explode(F.array(F.struct("source", "item", F.col("there").alias("x")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("x")))).alias("w")
    parts.append(fix.select("lang", ways).select("lang", "w.*"))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    in_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = total.groupBy("lang", "source", "item").agg(F.sum("x").alias("value")).withColumn("rank", F.row_number().over(in_group))

    # terms that a group uses more than its lang
    all_groups = group.select("lang", "source", "total", "v", "lang_total")
    terms = used.join(by_term, ["lang", "term"]).join(all_groups, ["lang", "source"])
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = terms.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", chi(F.col("p"), F.col("q")).alias("value"))
    term = above.withColumn("rank", F.row_number().over(in_group)).where(F.col("rank") <= top)
    out = [pair.withColumn("part", F.lit("pair")), term.withColumn("part", F.lit("term"))]
    return out[0].unionByName(out[1]).select("lang", "source", "part", "item", "value", "rank")
