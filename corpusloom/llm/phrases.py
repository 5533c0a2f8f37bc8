"""Phrases whose words stand together more often than chance, mined by pivot partitioning.

Every n-gram belongs to its rarest word, its pivot. Texts are cut where no frequent n-gram can go on; around each word the
stretch of words that are no rarer is what its n-grams can consist of, and only that fragment is sent to the word's part. A
part counts the n-grams that hold their pivot, longer ones only where the shorter ones in them are frequent, and emits those.
An n-gram is counted at one place of its text, where its pivot stands (the leftmost, if it comes twice), so none is counted
twice and none is missed.

Words are ordered by their counts in steps of a quarter of a doubling, which a table of bounded size holds by hash; words that
share a place in it or a step are told apart by hash and spelling, so the order is the same in every task. Parts follow the
number of words in the corpus. A word that is more frequent than a part should be deals its fragments to several parts, whose
counts are added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, partitions, written

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"

#: Places of the table that words are ordered by, one byte each.
PLACES = 1 << 22
#: Steps of the order to a doubling.
STEPS = 4
#: Words of the corpus for each part, and fragments of one word that go to one part, on average.
PART_WORDS = 1 << 20
SPLIT = 1 << 19
#: Bytes of text that a worker cuts into words at once; a longer text goes in slices that end at a delimiter.
PORTION = 4 << 20
#: Distinct words of a task that are counted before they are handed on.
WORDS_HELD = 1 << 19

#: A-Z to lower case, delimiters to full stops, tabs to spaces; words can't hold any of these.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _STOPS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(_STOPS))
_STOP = b"."


def _slices(text: bytes) -> Iterator[bytes]:
    """A translated text in slices of about PORTION bytes, cut at delimiters."""
    at = 0
    while len(text) - at > PORTION:
        end = text.find(_STOP, at + PORTION)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words and delimiters of many texts) from batches of (lang, text as bytes)."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            for part in _slices(text.translate(_PLAIN)):
                by_lang.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                if size[lang] >= PORTION:
                    yield lang, _tokens(by_lang.pop(lang))
                    size[lang] = 0
        for lang, parts in by_lang.items():
            yield lang, _tokens(parts)


def _tokens(parts: list[bytes]) -> list[bytes]:
    return _STOP.join(parts).replace(_STOP, b" . ").split()


def _places(lang: str, words: list[bytes]) -> np.ndarray:
    """A hash of each word in its language."""
    start = zlib.crc32(lang.encode() + b"\0")
    return np.fromiter((zlib.crc32(w, start) for w in words), np.int64, len(words))


def _prepared(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): how often each word occurs in the texts of a language. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for one, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                    ["lang", "word", "n"],
                )
            held.clear()

        for one, tokens in _portions(batches):
            places = dict.fromkeys(tokens)
            for i, w in enumerate(places):
                places[w] = i
            n = np.bincount(np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens)), minlength=len(places)).tolist()
            counts = held.setdefault(one, {})
            get = counts.get
            for w, k in zip(places, n, strict=True):
                counts[w] = get(w, 0) + k
            counts.pop(_STOP, None)
            if sum(map(len, held.values())) >= WORDS_HELD:
                yield from out()
        yield from out()

    return _prepared(docs, text, lang).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _order(frequent: DataFrame) -> np.ndarray:
    """The step of the most frequent word at each of PLACES places, 1 to 255, and 0 where none is. PLACES rows at most come
    to the driver, in five bytes each."""
    place = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word").cast("binary"))) % PLACES
    step = F.max(F.least(F.lit(255), 1 + F.floor(F.log2("n") * STEPS)))
    found = frequent.groupBy(place.alias("place")).agg(step.alias("step")).select(F.col("place").cast("int"), (F.col("step") - 128).cast("tinyint").alias("step")).toArrow()
    table = np.zeros(PLACES, np.uint8)
    table[found["place"].to_numpy()] = found["step"].to_numpy().astype(np.int16) + 128
    return table


def _stretches(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the stretch of each position goes to the left and to the right: over words that are no rarer, the same word only
    to the right, LONGEST - 1 of them at most. Ranks below 0 are of delimiters and of words that nothing frequent holds."""

    def reach(sign: int) -> np.ndarray:
        far, going = np.zeros(len(rank), np.int64), rank >= 0
        for d in range(1, min(LONGEST, len(rank))):
            near = np.full(len(rank), -1, rank.dtype)
            if sign < 0:
                near[d:] = rank[:-d]
                going = going & (near > rank)
            else:
                near[:-d] = rank[d:]
                going = going & (near >= rank)
            far += going
        return far

    return reach(-1), reach(1)


def _routed(docs: DataFrame, order, parts: int, text: str, lang: str) -> DataFrame:
    """(part, lang, words, data): fragments by the part of their pivot. `words` are a row's distinct words, one a line; `data`
    has, compressed, for each distinct fragment its slots (the pivot in the middle, -1 for none) as numbers of those words, and
    how often it occurs."""
    middle = LONGEST - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = order.value
        for one, tokens in _portions(batches):
            places = dict.fromkeys(tokens)
            words = list(places)
            crc = _places(one, words)
            for i, w in enumerate(words):
                places[w] = i
            step = steps[crc % PLACES].astype(np.int64)
            if _STOP in places:
                step[places[_STOP]] = 0
            good = np.flatnonzero(step)
            if not len(good):
                continue
            key = (step[good] << 32) + crc[good]
            ranked = good[np.argsort(key, kind="stable")]
            if len(np.unique(key)) < len(key):  # two words of one step and hash: by spelling
                at = dict(zip(good.tolist(), key.tolist(), strict=True))
                ranked = np.array(sorted(good.tolist(), key=lambda i: (at[i], words[i])), np.int64)
            rank = np.full(len(words), -1, np.int32)
            rank[ranked] = np.arange(len(ranked))
            ids = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
            r = rank[ids]
            left, right = _stretches(r)
            at = np.flatnonzero(left + right)
            slots = np.full((len(at), 2 * LONGEST - 1), -1, np.int32)
            slots[:, middle] = r[at]
            for d in range(1, LONGEST):
                for far, sign in ((left, -1), (right, 1)):
                    some = far[at] >= d
                    slots[some, middle + sign * d] = r[at[some] + sign * d]
            if not len(slots):
                continue
            # Equal fragments once, with how often they occur.
            seen = np.ascontiguousarray(slots).view(np.dtype((np.void, slots.shape[1] * 4))).ravel()
            _, first, times = np.unique(seen, return_index=True, return_counts=True)
            slots = slots[first]
            hashes = crc[ranked]
            most = np.power(2.0, step[ranked] / STEPS)  # upper bound of a word's count
            shares = np.maximum(1, np.ceil(most / SPLIT)).astype(np.int64)
            pivot = slots[:, middle]
            beside = np.where(slots[:, middle - 1] >= 0, hashes[slots[:, middle - 1]], 0) * 31 + np.where(slots[:, middle + 1] >= 0, hashes[slots[:, middle + 1]], 0) * 17
            beside += np.where(slots[:, middle - 2] >= 0, hashes[slots[:, middle - 2]], 0) * 7 + np.where(slots[:, middle + 2] >= 0, hashes[slots[:, middle + 2]], 0)
            share = shares[pivot]
            part = (hashes[pivot] // 7 + (beside % share) * 7919) % parts
            by = np.lexsort((pivot, part))
            slots, times, part, share = slots[by], times[by].astype(np.int64), part[by], share[by]
            cut = np.flatnonzero(np.diff(part)) + 1
            out: list[list] = [[], [], [], []]
            names = [words[i] for i in ranked.tolist()]
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
                used, local = np.unique(slots[a:z], return_inverse=True)
                local = local.reshape(z - a, -1) - (used[0] < 0)
                used = used[used >= 0]
                kind = np.int16 if len(used) < 1 << 15 else np.int32
                data = np.ascontiguousarray(local.T.astype(kind)).tobytes() + times[a:z].tobytes() + (share[a:z] > 1).tobytes()
                head = len(used).to_bytes(4, "little") + (z - a).to_bytes(4, "little")
                for x, v in zip(out, (int(part[a]), one, b"\n".join([names[i] for i in used.tolist()]), head + zlib.compress(data, 1)), strict=True):
                    x.append(v)
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["part", "lang", "words", "data"])

    return _prepared(docs, text, lang).mapInArrow(run, "part long, lang string, words binary, data binary")


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, n = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    raw = zlib.decompress(data[8:])
    kind = np.dtype(np.int16 if words < 1 << 15 else np.int32)
    width = 2 * LONGEST - 1
    size = n * width * kind.itemsize
    slots = np.frombuffer(raw[:size], kind).reshape(width, n).T.astype(np.int64)
    return slots, np.frombuffer(raw[size : size + 8 * n], np.int64), np.frombuffer(raw[size + 8 * n :], bool)


def _mined(slots: np.ndarray, times: np.ndarray, shared: np.ndarray, words: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of an n-gram's words, its count, whether other parts may have more of it) of the n-grams around the pivots.

    A window goes from a words left of the pivot to b words right of it. It is counted where both windows that are one word
    shorter and hold the pivot are frequent; those of words that several parts share are counted always.
    """
    middle = LONGEST - 1
    n = len(slots)
    group = {0: slots[:, middle]}  # by a, for windows of the last size: the number of each row's n-gram, or -1
    for size in range(1, LONGEST):
        last, group = group, {}
        for a in range(size + 1):
            b = size - a
            ok = (slots[:, middle - a] >= 0) & (slots[:, middle + b] >= 0)
            if a:
                ok &= last[a - 1] >= 0
            if b:
                ok &= last[a] >= 0
            at = np.flatnonzero(ok)
            number = group[a] = np.full(n, -1, np.int64)
            if not len(at):
                continue
            base, word = (last[a][at], slots[at, middle + b]) if b else (last[a - 1][at], slots[at, middle - a])
            _, first, inverse = np.unique(base * words + word, return_index=True, return_inverse=True)
            count = np.bincount(inverse, times[at], len(first)).astype(np.int64)
            some = shared[at[first]]
            keep = some | (count >= least)
            number[at] = np.where(keep[inverse], inverse, -1)
            kept = at[first[keep]]
            yield slots[kept, middle - a : middle + b + 1], count[keep], some[keep]


def _counted(routed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n, shared) of the n-grams that the parts own; a part's rows come one after the other."""

    def mine(lang: str, rows: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        slots, times, shared = [], [], []
        for words, data in rows:
            own = np.array([names.setdefault(w, len(names)) for w in words.split(b"\n")] + [-1], np.int64)
            s, t, h = _unpacked(data)
            slots.append(own[s].astype(np.int32))
            times.append(t)
            shared.append(h)
        listed = list(names)
        for grams, count, some in _mined(np.concatenate(slots).astype(np.int64), np.concatenate(times), np.concatenate(shared), len(listed), least):
            flat = list(map(listed.__getitem__, grams.ravel().tolist()))
            width = grams.shape[1]
            phrases = [b" ".join(flat[i : i + width]) for i in range(0, len(flat), width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(count), pa.array(some)],
                ["lang", "phrase", "n", "shared"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for part, lang, words, data in chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches):
            if (part, lang) != now:
                if rows:
                    yield from mine(now[1], rows)
                now, rows = (part, lang), []
            rows.append((words, data))
        if rows:
            yield from mine(now[1], rows)

    dealt = routed.repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(run, "lang string, phrase string, n long, shared boolean")


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, total): all word occurrences, (lang, phrase, words, n)) with every phrase of 1 to LONGEST words that occurs
    `least` times or more within pieces of a language's texts, overlaps included; both tables written.

    Null texts are empty, a null language is NO_LANG; equal and repeated rows each count. Tables without words give no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    # Words that are too rare for any phrase count for the total only: as one row a language.
    counts = word_counts(docs, text, lang).groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = counts.filter("word IS NOT NULL")
    total = totals.agg(F.sum("total")).first()[0] or 0
    parts = max(4 * partitions(spark), -(-total // PART_WORDS))
    order = spark.sparkContext.broadcast(_order(frequent))
    found = written(_counted(_routed(docs, order, parts, text, lang), least), "grams")
    sums = found.filter("shared").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    grams = found.filter("NOT shared").select("lang", "phrase", "n").unionByName(sums)
    every = frequent.select("lang", F.col("word").alias("phrase"), "n").unionByName(grams)
    phrases = written(every.withColumn("words", F.size(F.split("phrase", " "))), "phrases")
    for done in (counts, found):
        forget(done)
    return totals, phrases


def scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more, by the cut with the lowest score, ties to the
    shortest first part; without those that lie inside a phrase that is one word longer and as frequent, and so inside any.

    Exact: products of counts are decimals of 38 digits, which holds for counts under 10^16 in languages under 10^18 words.
    """
    longer = phrases.filter("words > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    places = longer.withColumn("ws", F.split("phrase", " ")).select("lang", "phrase", "words", F.col("n").alias("a"), "ws", cut.alias("k"))
    join = lambda x: F.concat_ws(" ", x)
    cuts = places.select(
        "lang", "phrase", "words", "a", "k", join(F.slice("ws", F.lit(1), F.col("k"))).alias("first"), join(F.slice("ws", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest")
    )
    known = phrases.select("lang", "phrase", F.col("n").alias("f"))
    both = cuts.join(known.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(known.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    whole = both.join(totals.withColumnRenamed("total", "n"), "lang").withColumn("over", wide("a", 16) * wide("n", 18) * F.lit(1000).cast("decimal(4,0)"))
    whole = whole.withColumn("under", wide("l", 18) * wide("r", 18)).withColumn("score", F.expr("over div under"))
    best = whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # A phrase's two parts that are one word shorter.
    inner = cuts.filter("words > 2").select("lang", "a", F.explode(F.array(F.when(F.col("k") == 1, F.col("rest")), F.when(F.col("k") == F.col("words") - 1, F.col("first")))).alias("phrase"))
    inside = inner.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    free = best.join(inside, ["lang", "phrase"], "left").filter("held IS NULL OR held < a")
    return free.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score descending, count descending and phrase.
    Nulls, empty texts, repeated rows and empty tables as in frequent_phrases()."""
    found = scored(*frequent_phrases(docs, least, text, lang))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
