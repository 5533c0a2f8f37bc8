import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import generation as G
from corpusloom.functions import paths, vectors
from corpusloom.functions import text as X
from corpusloom.functions.embed import HashedWords, unit
from corpusloom.functions.hashing import content_hash, content_hash_sql, fnv1a64, fnv1a64_many
from corpusloom.operators import chunking, ingest_status, knn, numbering
from corpusloom.sources import extract


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def values(df):
    return [r[1] for r in df.orderBy("i").collect()]


def loop_chunks(text, size, overlap):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    step, out, at = size - min(max(overlap, 0), size - 1), [], 0
    while words:
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
        at += step
    return out


@pytest.mark.parametrize(("size", "overlap"), [(250, 40), (8, 2), (1, 0), (3, 9), (5, -1)])
def test_chunks_equal_a_loop(spark, size, overlap):
    draw = random.Random(size)
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 250, 251, 460, 461)] + [" \t\n ", None]
    texts += ["".join(draw.choice("ab \t\n\x0b é") for _ in range(60)) for _ in range(20)]
    found = values(column(spark, texts).select("i", X.chunks(F.col("x"), size, overlap).alias("x")))
    assert [[c["content"] for c in one] for one in found] == [loop_chunks(t or "", size, overlap) for t in texts]
    if (size, overlap) == (250, 40):
        assert [len(one) for one in found[:6]] == [0, 1, 1, 2, 2, 3]


def test_chunk_size_below_one_gives_none(spark):
    assert values(column(spark, ["a b"]).select("i", X.chunks(F.col("x"), 0, 0).alias("x"))) == [[]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=60))
def test_fnv_of_many_equals_the_definition(data):
    assert fnv1a64_many(data) == [fnv1a64(x) for x in data]


def test_fnv_columns(spark):
    data = [b"", b"a", b"foobar", bytes(range(256)), None]
    df = column(spark, data, "binary")
    want = ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", f"{fnv1a64(bytes(range(256))):016x}", None]
    assert values(df.select("i", content_hash(F.col("x")).alias("x"))) == want
    assert values(df.select("i", content_hash_sql("x").alias("x"))) == want


def test_fnv_in_the_jvm_at_all_lengths_and_quicker_than_byte_by_byte(spark):
    draw = random.Random(11)
    data = [bytes(draw.choice((0, 127, 128, 255, draw.randrange(256))) for _ in range(n)) for n in [*range(34), 1000]]
    found = spark.createDataFrame(list(enumerate(data)), "i int, x binary").select("i", content_hash_sql("x").alias("x"))
    assert values(found) == [f"{fnv1a64(x):016x}" for x in data]
    plain = F.expr("""aggregate(transform(sequence(1, octet_length(x)), i -> cast(conv(hex(substring(x, i, 1)), 16, 10) AS bigint)),
      named_struct('hi', 3421674724L, 'lo', 2216829733L), (s, x) -> named_struct(
        'hi', (s.hi * 435L + (s.lo ^ x) * 256L + shiftright((s.lo ^ x) * 435L, 32)) & 4294967295L, 'lo', ((s.lo ^ x) * 435L) & 4294967295L),
      s -> lower(concat(lpad(hex(s.hi), 8, '0'), lpad(hex(s.lo), 8, '0'))))""")
    long = spark.createDataFrame([(i, bytes(draw.randrange(256) for _ in range(20_000))) for i in range(20)], "i int, x binary").coalesce(1).cache()
    took, same = {}, set()
    for name, hashed in [("plain", plain), ("own", content_hash_sql("x"))] * 3:
        began = time.monotonic()
        same.add(tuple(values(long.select("i", hashed.alias("x")))))
        took[name] = min(took.get(name, 1e9), time.monotonic() - began)
    assert len(same) == 1 and took["own"] < 0.7 * took["plain"]


def test_html_edges_agree_with_the_loop_free_twin(spark):
    draw = random.Random(5)
    bits = ["<p>", "</p>", "<br/>", "<script>x<y</script>", "<SCRIPT", "<style>a", "</style>", "<!-->", "<!-- a -->", "<!--", "-->", "<link>", "<pre>", "<b>", "&amp;", "&AMP;",
            "&nbsp;", "&copy;", "&", "<", ">", "text", " ", "\n", "é", "</li>", "<H2 a='>'>"]
    pages = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    pages.append('<script>no()</script><style>p{}</style><h1>Knowledge</h1><p>is &quot;power&quot; &amp; freedom&nbsp; !</p>')
    found = values(column(spark, pages).select("i", X.html_text(F.col("x")).alias("x")))
    assert found == [extract.html_text(p) for p in pages]
    assert found[-1] == 'Knowledge\nis "power" & freedom  !\n'


def test_snippets_stops_and_thinking(spark):
    one = lambda f, texts: values(column(spark, texts).select("i", f(F.col("x")).alias("x")))
    assert one(X.snippet, ["  a \n\t b ", "x" * 84, "x" * 85, "y" * 83 + "  z", ""]) == ["a b", "x" * 84, "x" * 84 + "...", "y" * 83 + "...", ""]
    assert one(X.stop_cut, ["a\nUser: b<|im_end|>", "a", "<|im_start|>"]) == ["a", "a", ""]
    assert one(X.think_strip, ["<think>a</think> \n b </think> c \n", " b\t", "x</think>"]) == ["b </think> c", " b", ""]


def test_extensions_and_paths(spark):
    names = ["a.pdf", "B.PDF", "a.b/c", "x.tar", "y.py", "none", "p.sentinal", ".md"]
    df = column(spark, names)
    kinds = values(df.select("i", paths.extension_class(F.col("x")).alias("x")))
    assert kinds == ["supported", "supported", "other", "ignored", "other", "other", "ignored", "supported"]
    raw = ['  "/a b/c.txt"  ', "'/x y' ", r"/a\ b/\'c\"\\", "~/d", "~", "~x", "", None, '"', r"a\n"]
    want = ["/a b/c.txt", "/x y", "/a b/'c\"\\", "/h/d", "/h", "~x", "", "", '"', r"a\n"]
    assert [paths.clean_path(p, "/h") for p in raw] == want
    assert values(column(spark, raw).select("i", paths.clean_path_of(F.col("x"), "/h").alias("x"))) == want
    assert paths.shell_quoted("O'Reilly's Book.epub") == "'O'\\''Reilly'\\''s Book.epub'"


def test_like_is_ascii_and_slash_safe(spark):
    df = column(spark, ["Docs/A.TXT", "docs/b_c", "a\\b", "100%"])
    hit = lambda p: values(df.select("i", X.ilike_contains(F.col("x"), p).alias("x")))
    assert hit("docs/") == [True, True, False, False]
    assert hit("a\\b") == [False, False, True, False]
    assert hit("b_c") == [False, True, False, False]


def test_normalise_and_distance(spark):
    df = column(spark, [[3.0, 4.0, 0.0], [0.0, 0.0, 0.0], [1e-13, 0.0, 0.0]], "array<float>")
    found = values(df.select("i", vectors.l2_normalize(F.col("x")).alias("x")))
    assert found[0] == pytest.approx([0.6, 0.8, 0.0]) and found[1] == [0, 0, 0] and found[2][0] == pytest.approx(1e-13)
    assert values(df.select("i", vectors.cosine_distance(F.col("x"), F.array(*[F.lit(float(v)) for v in (3, 4, 0)])).alias("x")))[:2] == [pytest.approx(0), None]
    assert unit(HashedWords(8).embed(["a b b", ""]))[1].tolist() == [0] * 8


def test_gates_references_and_reasons(spark):
    hits = spark.createDataFrame([(1, 1, 7, 0.65), (1, 2, 8, 0.64), (2, 1, 9, 0.42)], "query_id long, rank int, vec_id long, similarity double")
    assert {r["query_id"]: r["passes"] for r in knn.gate(hits).collect()} == {1: True, 2: False}
    assert [(r["ref"], r["vec_id"]) for r in knn.references(hits).collect()] == [(1, 7)]
    rows = [("x [INSUFFICIENT_DATA]", 0.1), ("", 0.1), ("a", 0.49), ("a", 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, c double")
    no, reason, text = G.stage2(F.col("a"), F.col("c"))
    found = df.select("i", no.alias("no"), reason.alias("reason"), text.alias("text")).orderBy("i").collect()
    assert [r["no"] for r in found] == [True, True, True, False]
    assert found[0]["reason"] == G.REASON_INSUFFICIENT and found[1]["reason"] == G.REASON_EMPTY
    assert found[2]["reason"] == "Stage 2 Refusal: Mean token confidence 0.49 < threshold 0.50" and found[3]["text"] == "a"
    lp = column(spark, [[1.0, 2.0, 3.0]], "array<float>").select("i", G.token_logprob(F.col("x"), F.lit(2)).alias("x"))
    assert values(lp)[0] == pytest.approx(3 - math.log(math.e + math.e**2 + math.e**3))
    assert values(column(spark, [None, -0.5], "double").select("i", G.confidence(F.col("x")).alias("x"))) == [0.0, pytest.approx(math.exp(-0.5))]


def test_neighbours_ties_zero_and_width(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [0.0, 1.0, 0.0, 0.0]), (4, None)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = spark.createDataFrame([(9, [0.99, 0.01, 0.0, 0.0])], "query_id long, embedding array<float>")
    found = knn.search(ask, corpus, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 3] and found[0]["similarity"] > 0.9 > found[1]["similarity"]
    bad = corpus.unionByName(spark.createDataFrame([(5, [1.0])], corpus.schema))
    with pytest.raises(Exception, match="another width"):
        knn.search(ask, bad, 3).collect()
    assert knn.search(ask.limit(0), corpus).count() == 0


def loop_batches(ns):
    out, batch, slots, used = [], 0, 0, 0
    for n in (min(max(n, 0), 2000) for n in ns):
        if slots >= 16 or (n > 0 and used + n > 2048 and slots > 0):
            batch, slots, used = batch + 1, 0, 0
        slots, used = slots + 1, used + n
        out.append(batch)
    return out


def test_batches_equal_a_loop(spark):
    draw = random.Random(3)
    lists = [[draw.choice([0, 1, 100, 700, 1500, 2000, 2500]) for _ in range(draw.randint(1, 40))] for _ in range(60)] + [[0] * 40]
    rows = [(k, i, n) for k, ns in enumerate(lists) for i, n in enumerate(ns)]
    found = chunking.batches(spark.createDataFrame(rows, "k int, i int, n int"), "k", "i", "n").collect()
    got = {(r["k"], r["i"]): r["batch"] for r in found}
    assert got == {(k, i): b for k, ns in enumerate(lists) for i, b in enumerate(loop_batches(ns))}


def test_batches_of_one_large_key_of_nulls_and_of_none(spark):
    """A key that spans many Arrow batches, a null key and null sizes, and an empty table."""
    draw = random.Random(4)
    ns = [draw.choice([0, 3, 300, 900]) for _ in range(25_000)]
    rows = [(7, i, n, "x") for i, n in enumerate(ns)] + [(None, i, None, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, i int, n int, batch string")
    got = {(r["k"], r["i"]): r["batch"] for r in chunking.batches(df, "k", "i", "n").collect()}
    assert got == {(7, i): b for i, b in enumerate(loop_batches(ns))} | {(None, i): i // 16 for i in range(20)}
    empty = chunking.batches(df.limit(0), "k", "i", "n")
    assert empty.columns == ["k", "i", "batch"] and empty.count() == 0


def test_paths_without_a_home():
    assert [paths.clean_path(p, "") for p in ("~/a", "~", '""', "\"a' ", r"\\ x")] == ["~/a", "~", "", "\"a'", r"\ x"]


def test_status_of_incoming(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", None)], "path string, content_hash string")
    new = [("a", "1", True), ("b", "9", True), ("c", "2", True), ("d", "5", True), ("e", "5", True), ("f", "7", False), ("n", "8", True)]
    found = ingest_status.classify(spark.createDataFrame(new, "path string, content_hash string, has_text boolean"), known)
    assert {r["path"]: r["status"] for r in found.collect()} == {
        "a": "unchanged", "b": "modified", "c": "duplicate", "d": "fresh", "e": "duplicate", "f": "failed", "n": "fresh"
    }


def test_history_keeps_changes(spark):
    lines = [(1, 0, "/help"), (1, 1, "/stats"), (1, 2, "/stats"), (1, 3, "What?")]
    assert ingest_status.drop_repeats(spark.createDataFrame(lines, "k int, n int, line string"), "k", "n", "line").count() == 3


def test_numbering_is_global(spark):
    ids = list(range(0, 5000, 7))
    random.Random(1).shuffle(ids)
    found = numbering.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", ranges=9).collect()
    assert sorted((r["id"], r["rn"]) for r in found) == [(i, k + 1) for k, i in enumerate(sorted(ids))]


def test_common_prefix(spark):
    df = spark.createDataFrame([(0, "abc", "abd"), (1, "", "a"), (2, "a", "a"), (3, "x", "y")], "i int, a string, b string")
    assert values(df.select("i", X.common_prefix(F.col("a"), F.col("b")).alias("x"))) == ["ab", "", "a", ""]


def test_best_places_equal_a_sort():
    draw = np.random.default_rng(4)
    near = np.round(draw.random((30, 200)), 1)
    ids = draw.permutation(200)
    row, col = knn.best_places(near, 5, ids)
    want = [sorted(range(200), key=lambda c: (-near[r, c], ids[c]))[:5] for r in range(30)]
    assert col.reshape(30, 5).tolist() == want and row.tolist() == np.repeat(np.arange(30), 5).tolist()
    assert len(knn.best_places(near[:, :3], 5, ids[:3])[0]) == 90
