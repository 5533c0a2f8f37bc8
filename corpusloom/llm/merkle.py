"""Document fingerprints as Merkle trees over sections and paragraphs.

Sections are parted by an empty line, paragraphs by a line break. A paragraph's hash covers its text, a section's the hashes
of its paragraphs, the root those of its sections, so equal roots mean equal texts. Below each paragraph the fingerprint
keeps short digests of blocks of text, finer at the paragraph's start, so branches that differ can be followed down to the
place of an edit. As a string: root:section(paragraph.length.block block block;paragraph...)section(...).

Two trees are compared by going down the branches that differ: sections at the same place, then paragraphs at the same place
in a section, then blocks. A branch that is equal counts with all its code points and isn't entered.

Native DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, written

#: Code points of the blocks of a paragraph, as (number, size) from its start; blocks of LAST follow.
FIRST = ((4, 2), (3, 8))
LAST = 32
FIRST_SPAN = sum(n * size for n, size in FIRST)
FIRST_BLOCKS = sum(n for n, _ in FIRST)
#: Hex digits of a block's, a paragraph's or section's, and the root's digest.
BLOCK_DIGITS, NODE_DIGITS, ROOT_DIGITS = 6, 8, 32
#: Ranges of ids for each shuffle partition.
RANGES = 2


def tree(text: Column) -> Column:
    """The tree: array over sections of struct(hash, n, paragraphs), a paragraph being struct(hash, n, blocks); n is the
    number of code points of the paragraphs. A null text counts as empty."""

    def paragraph(p: Column) -> Column:
        parts, at = [], 1
        for n, size in FIRST:
            parts.append(F.regexp_extract_all(F.substring(p, at, n * size), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
            at += n * size
        parts.append(F.regexp_extract_all(F.substring(p, at, 2_000_000_000), F.lit(f"(?s).{{1,{LAST}}}"), F.lit(0)))
        blocks = F.transform(F.concat(*parts), lambda b: F.substring(F.md5(b), 1, BLOCK_DIGITS))
        return F.struct(F.sha2(p, 256).alias("hash"), F.length(p).cast("long").alias("n"), blocks.alias("blocks"))

    def section(ps: Column) -> Column:
        n = F.aggregate(ps, F.lit(0).cast("long"), lambda total, p: total + p["n"])
        return F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["hash"]), ""), 256).alias("hash"), n.alias("n"), ps.alias("paragraphs"))

    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph)), section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)


def printed(sections: Column) -> Column:
    """The fingerprint of a tree() column as a string."""
    one = lambda p: F.concat(F.substring(p["hash"], 1, NODE_DIGITS), F.lit("."), p["n"].cast("string"), F.lit("."), F.array_join(p["blocks"], ""))
    body = F.transform(
        sections, lambda s: F.concat(F.substring(s["hash"], 1, NODE_DIGITS), F.lit("("), F.array_join(F.transform(s["paragraphs"], one), ";"), F.lit(")"))
    )
    return F.concat(F.substring(root(sections), 1, ROOT_DIGITS), F.lit(":"), F.array_join(body, ""))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x, F.lit(0).cast("long")))


def _equal_blocks(p: Column, q: Column) -> Column:
    """Code points under the blocks that are equal at the same place of two paragraphs."""
    same = F.zip_with(p["blocks"], q["blocks"], lambda x, y: x == y)

    def span(equal: Column, i: Column) -> Column:
        at, start, place, offset = F.when(i >= FIRST_BLOCKS, FIRST_SPAN + (i - FIRST_BLOCKS) * LAST), [], 0, 0
        size = F.when(i >= FIRST_BLOCKS, F.lit(LAST))
        for n, width in reversed(FIRST):
            first = FIRST_BLOCKS - n - sum(k for k, _ in start)
            offset = sum(k * w for k, w in FIRST[: len(FIRST) - 1 - len(start)])
            at, size = at.when(i >= first, offset + (i - first) * width), size.when(i >= first, F.lit(width))
            start.append((n, width))
        return F.when(equal, F.least(size.cast("long"), p["n"] - at))

    return _total(F.transform(same, span))


def equal_span(a: Column, b: Column) -> Column:
    """Of two tree() columns: the code points under equal branches, going down only where branches differ."""
    paragraphs = lambda p, q: F.when(p["hash"] == q["hash"], p["n"]).otherwise(_equal_blocks(p, q))
    sections = lambda s, t: F.when(s["hash"] == t["hash"], s["n"]).otherwise(_total(F.zip_with(s["paragraphs"], t["paragraphs"], paragraphs)))
    return _total(F.zip_with(a, b, sections))


def likeness(a: Column, b: Column) -> Column:
    """Of two tree() columns: 1 for equal roots, else the share of the longer one's code points under equal branches."""
    longer = F.greatest(_total(F.transform(a, lambda s: s["n"])), _total(F.transform(b, lambda s: s["n"])), F.lit(1).cast("long"))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(equal_span(a, b) / longer)


def differing_branches(a: Column, b: Column) -> Column:
    """Of two tree() columns: the places of the second's paragraphs that differ from the first's at the same place, as
    array<struct(section, paragraph)>; sections that are equal aren't entered."""
    none = F.array().cast("array<struct<section:int,paragraph:int>>")

    def within(s: Column, t: Column, i: Column) -> Column:
        at = F.zip_with(s["paragraphs"], t["paragraphs"], lambda p, q: F.when(q.isNull(), F.lit(0)).when(p["hash"].eqNullSafe(q["hash"]), F.lit(0)).otherwise(F.lit(1)))
        places = F.transform(at, lambda d, j: F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"), d.alias("differs")))
        return F.transform(F.filter(places, lambda x: x["differs"] == 1), lambda x: F.struct(x["section"], x["paragraph"]))

    pairs = F.zip_with(a, b, lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    found = F.transform(
        pairs, lambda x, i: F.when(x["t"].isNull() | x["s"]["hash"].eqNullSafe(x["t"]["hash"]), none).when(
            x["s"].isNull(), F.transform(x["t"]["paragraphs"], lambda _, j: F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))
        ).otherwise(within(x["s"], x["t"], i)),
    )
    return F.flatten(found)


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, next): each row with the text of the next one in the order of ids, nulls first, equal ids by text; the
    last row gets the first one's. Null texts come back as empty.

    Texts are shuffled once. Ids are cut at sampled quantiles into RANGES ranges for each shuffle partition; the first row of
    each range is also dealt to the range before, so a row's next one is always in its own range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = RANGES * partitions(spark)
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    # The number of cuts at or below the id, found in two steps; null ids come before all.
    width = max(1, math.isqrt(len(cuts)))
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda marks: F.size(F.filter(marks, lambda c: c <= F.col("doc_id")))
    run = below(F.array(*[F.lit(r[-1]) for r in runs]).cast("array<long>"))
    inside_run = below(F.coalesce(F.get(F.array(*[F.array(*map(F.lit, r)) for r in runs]).cast("array<array<long>>"), run), F.array().cast("array<long>")))
    of = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(run * width + inside_run)
    placed = rows.withColumn("range", of)
    # One row per range: its smallest id, and that id's smallest text.
    heads = placed.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("head"))
    heads = heads.select("range", F.col("head.doc_id").alias("head"))
    order = Window.orderBy("range")
    ends = heads.withColumn("to", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())))
    first = (
        rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("to", "doc_id").agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("guest"))
    )
    # Written, so the union below reads it from files instead of planning its scan again.
    both = placed.withColumn("guest", F.lit(0)).unionByName(written(first, "range-heads"))
    inside = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    return both.withColumn("next", F.lead("text").over(inside)).filter("guest = 0").select("doc_id", "text", "next")


def edited_text(text: str = "text", following: str = "next") -> Column:
    """The text with its last quarter, rounded down, replaced by as many first code points of the other, or all it has."""
    n = F.length(text)
    tail = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - tail), F.substring(F.col(following), F.lit(1), tail))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; see with_next()
    for the order, and for null texts, equal ids and null ids. A table of one row is its own next; an empty one stays empty."""
    found = with_next(docs, text, doc_id).withColumn("edited", edited_text())
    found = found.withColumns({f"{k}_tree": tree(F.col(k)) for k in ("text", "edited", "next")})
    own, edited, following = F.col("text_tree"), F.col("edited_tree"), F.col("next_tree")
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), printed(own).alias("fingerprint"),
        printed(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
    )
