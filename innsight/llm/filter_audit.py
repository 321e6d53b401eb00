"""Audit of how five quality filters interact (DataFrame functions only).

Every document gets a mask: one bit for each filter that it fails. Documents
of one part (language), mask and label class are one cell, so however large
the corpus is, at most 32 masks x 4 label classes a part are left. Each cell
is then folded over the array of all 120 filter orders, a literal that goes
to every task: ``transform`` walks the orders, ``aggregate`` walks the steps of
one order, and the cell yields 600 structs weighted by its count, one for each
order and step. The structs of all cells of a part are merged by elementwise
sums.

Filters (failure conditions)
* A: under ``min_words`` words. B: 100 * distinct words < ``distinct`` * words.
* C: 100 * [A-Z] characters > ``upper`` * code points. D: holds any of #$%&*|.
* E: the text is identical to the text of any smaller doc_id.

Defined results
* Null text is empty text: it fails A only (0 < 0 is false), and E where a
  smaller doc_id has an empty or null text too. Words are maximal runs of
  other characters than ASCII white space; whole texts count, however long.
* A null doc_id is smaller than none and has no smaller one: it never fails E.
  Rows that repeat a doc_id with the same text don't make each other fail E.
* Null lang is the part "". A doc_id with several label rows counts as good or
  toxic if any of its rows says so; no label, or null: neither.
* An empty table has no parts and gives no rows. Further columns are not used.
* Ties can't occur: the result holds counts only.

Equal texts are found by their SHA-256. A text that a third of all rows share
is counted per doc_id first, then combined before the next shuffle, so no task
holds its rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.columns import quoted, written

FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
DUPLICATE = 1 << FILTERS.index("E")


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column, words: Column, min_words: int = 100, distinct: int = 80, upper: int = 10) -> Column:
    """Bits of the filters that need only the document itself (A to D)."""
    n = F.size(words).cast("long")
    fails = [n < min_words,
             100 * F.size(F.array_distinct(words)).cast("long") < distinct * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > upper * F.length(text).cast("long"),
             text.rlike(MARKS)]
    bits = [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def mask_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
               lang: str = "lang", **limits) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each cell."""
    base = docs.select(quoted(doc_id).cast("long").alias("id"), F.coalesce(quoted(lang), F.lit("")).alias("part"),
                       F.coalesce(quoted(text), F.lit("")).alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    rows = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"),
                       text_mask(F.col("text"), F.col("words"), **limits).alias("mask"))
    rows = written(rows.groupBy("key", "mask", "part", "id").agg(F.count("*").alias("n")), "masks")
    marks = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    # rows without an id meet no label: they don't gather in one partition of the join
    named = rows.filter("id IS NOT NULL").join(marks, "id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    rows = named.unionByName(rows.filter("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    copies = rows.groupBy("key", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("lo"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # a text has one row for each part and label class now
    first = F.min("lo.id").over(Window.partitionBy("key"))
    copies = copies.withColumn("own", F.col("unnamed") + F.when(F.col("lo.id") == first, F.col("lo.n")).otherwise(0))
    both = F.explode(F.array(
        F.struct(F.col("mask"), F.col("own").alias("n")),
        F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    return (copies.select("part", "good", "toxic", both.alias("x")).filter("x.n > 0")
            .groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n")))


def folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of a cell: what each step of each order does to its n documents."""
    sequence = F.lit([[FILTERS.index(f) for f in o] for o in orders()])
    weight = lambda cond: F.when(cond, n).otherwise(F.lit(0).cast("long"))
    shape = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def step(state: Column, f: Column) -> Column:
        fails = F.get(F.array(*[(mask.bitwiseAND(1 << i) != 0) for i in range(len(FILTERS))]), f)
        alone = F.get(F.array(*[mask == (1 << i) for i in range(len(FILTERS))]), f)
        alive = state["alive"]
        here = alive & fails
        found = F.struct(*[weight(c).alias(name) for name, c in zip(COUNTS, [
            alive & ~fails, here, fails & ~alive, alone, here & good, here & toxic])])
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(found)).alias("steps"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(shape).alias("steps"))
    return F.flatten(F.transform(sequence, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))


def interaction_audit(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """One row per part, order of the filters and step; ``filter`` is the step's letter."""
    cells = written(mask_cells(docs, labels, **kw), "cells")
    steps = cells.select("part", F.posexplode(folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")))
                         .alias("at", "x"))
    merged = steps.groupBy("part", "at").agg(*[F.sum(F.col(f"x.{c}")).alias(c) for c in COUNTS])
    width = len(FILTERS)
    name = F.get(F.lit(orders()), F.floor(F.col("at") / width).cast("int"))
    merged = merged.withColumn("filter_order", name).withColumn("step", (F.col("at") % width + 1).cast("int"))
    merged = merged.withColumn("filter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    # a part and filter have 120 rows here
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return merged.select("part", "filter_order", "step", "filter", *COUNTS, shapley.alias("shapley"))
