"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words. The mix's total is shared by weight; a source that would pass its maximum of
epochs is clamped there and its excess goes to the others by weight, until none is above. Sorted by cap over weight, the
clamped sources are a prefix, so the level of the water follows from running sums and needs no iteration. A source's target
is then taken as whole repetitions of all its documents plus one seeded fractional repetition: documents in the order of a
seeded hash, up to the word at which the target is met.

Native DataFrame operations only. The order within a source is never sorted as a whole: words are first summed by
(source, first hash digits), which fixes the slice in which the target is met, and only that slice is ordered. The slice
itself is found in two steps of 256 sums a source, so that a source's slices never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the hash that name a slice of a source, 16^4 slices, and those that name 16^2 of them together.
SLICE_DIGITS, COARSE_DIGITS = 4, 2
#: Sources up to which the table of sources is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A seeded hash of the id as 32 hex digits; null ids share one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    One row per source, so the two windows below order the table of sources, not documents. Sources are weighed by code
    point order, null last, with `weights` repeating. A source without words has the target 0.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.col("open"))
        # The first source, by ratio, that is not clamped sets the level; where all are, every source stops at its cap.
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def _narrowed(rows: DataFrame, met: DataFrame, known: int, digits: int) -> DataFrame:
    """(of, at, left, words): of each source, the first `digits` of the hash at which its words reach what is left to take.

    `rows`: (source, size, draw). `met`: (of, left, at), the `known` digits of each source and the words to take among the
    rows that start with them. Only those rows are ordered; sources that take none have no row.
    """
    inside = F.col("source").eqNullSafe(F.col("of")) & (F.substring("draw", 1, known) == F.col("at"))
    parts = rows.join(met, inside).groupBy("of", "left", F.substring("draw", 1, digits).alias("part")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        .select("of", F.col("part").alias("at"), (F.col("left") - F.col("before")).alias("left"), "words")
    )


def _plan(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Per source: size, target, whole repetitions, and the hash up to which documents are taken once more.

    `sized`: (source, size, draw), a written table.
    """
    slices = written(sized.groupBy("source", F.substring("draw", 1, SLICE_DIGITS).alias("draw")).agg(F.sum("size").alias("size")), "mix-slices")
    targets = water_fill(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    goals = written(
        targets.withColumn("goal", goal)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size"))
        .drop("goal"),
        "mix-goals",
    )
    coarse = slices.groupBy("source", F.substring("draw", 1, COARSE_DIGITS).alias("draw")).agg(F.sum("size").alias("size"))
    met = goals.select(F.col("source").alias("of"), F.col("rest").alias("left"), F.lit("").alias("at"))
    met = _narrowed(coarse, met, 0, COARSE_DIGITS)
    met = _narrowed(slices, met, COARSE_DIGITS, SLICE_DIGITS)
    edge = _narrowed(sized, met, SLICE_DIGITS, 32).toDF("of", "edge", "edge_left", "edge_words")
    return written(goals.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-plan")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED,
    text: str = "text", source: str = "source", doc_id: str = "doc_id",
) -> DataFrame:
    """`docs` with the columns __loom_size, __loom_source_size, __loom_target and __loom_taken added.

    taken: words that the mix takes of the row, repetitions counted; at most `max_epochs` times its size. Per source they
    add up to the target, rounded to whole words. Null texts have no words; a null source is a source. Rows with equal ids
    share a draw; where the target is met among them, each gives its share, rounded down. An empty table stays empty.
    The order of rows or partitions plays no part, so reruns agree.
    """
    own = docs.withColumns({f"{OWN}size": word_count(F.col(text)), f"{OWN}draw": draw(F.col(doc_id), seed)})
    sized = written(own.select(F.col(source).alias("source"), F.col(f"{OWN}size").alias("size"), F.col(f"{OWN}draw").alias("draw")), "mix-sizes")
    return _taken(own, _plan(sized, weights, share, max_epochs), source)


def _taken(own: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    plan = plan.select(*[F.col(c).alias(f"{OWN}{c}") for c in ("source", "source_size", "target", "whole", "rest", "edge", "edge_left", "edge_words")])
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    size, cut = F.col(f"{OWN}size"), F.col(f"{OWN}draw")
    extra = (
        F.when(F.col(f"{OWN}rest") == 0, F.lit(0))
        .when(cut < F.col(f"{OWN}edge"), size)
        .when(cut == F.col(f"{OWN}edge"), F.expr(f"({OWN}size * {OWN}edge_left) div {OWN}edge_words"))
        .otherwise(F.lit(0))
    )
    taken = (F.col(f"{OWN}whole") * size + extra).cast("long")
    return (
        own.join(plan, F.col(source).eqNullSafe(F.col(f"{OWN}source")))
        .withColumn(f"{OWN}taken", taken)
        .drop(*[f"{OWN}{c}" for c in ("source", "draw", "whole", "rest", "edge", "edge_left", "edge_words")])
    )


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row, see mix(). Texts are read once."""
    own = written(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias(f"{OWN}size"), draw(F.col(doc_id)).alias(f"{OWN}draw")),
        "mix-sizes",
    )
    sized = own.select("source", F.col(f"{OWN}size").alias("size"), F.col(f"{OWN}draw").alias("draw"))
    return _taken(own, _plan(sized, WEIGHTS, SHARE, MAX_EPOCHS), "source").select(
        "doc_id", *[F.col(f"{OWN}{c}").alias(c) for c in ("size", "source_size", "target", "taken")]
    )


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", n_chars: str = "n_chars", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each row as often as it is taken. Whole repetitions are the row; a fractional one has the text cut
    after its last word taken, and n_chars set to match. Rows without words, null texts too, are never taken; an
    empty table gives none; the rest is as in mix(). Columns stay those of `docs`."""
    size, taken = F.col(f"{OWN}size"), F.col(f"{OWN}taken")
    copies = F.expr(f"transform(sequence(1, cast(ceil({OWN}taken / {OWN}size) as int)), i -> least({OWN}size, {OWN}taken - (i - 1) * {OWN}size))")
    mixed = mix(docs, text=text, source=source, doc_id=doc_id).filter((size > 0) & (taken > 0)).withColumn(f"{OWN}words", F.explode(copies))
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(f"{OWN}words").cast("int")), "")
    whole = F.col(f"{OWN}words") == size
    columns = {text: F.when(whole, F.col(text)).otherwise(cut)}
    if n_chars in docs.columns:
        columns[n_chars] = F.when(whole, F.col(n_chars)).otherwise(F.length(cut)).cast(docs.schema[n_chars].dataType)
    return mixed.withColumns(columns).select(*docs.columns)
