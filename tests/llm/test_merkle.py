import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import merkle


def test_next_and_edited(spark, documents, odd_rows):
    key = lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())
    rows = sorted(odd_rows, key=key)
    want = []
    for k, r in enumerate(rows):
        text, following = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        want.append((str(r[0]), len(text), hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()))
    found = merkle.fingerprints(documents(odd_rows).repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    by = {}
    for r in found:
        assert by.setdefault((r["doc_id"], r["n_chars"]), r["fingerprint"]) == r["fingerprint"]
    assert next(r for r in found if r["doc_id"] == 6)["near_edited"] > 0.6


def test_small_tables(documents):
    assert merkle.fingerprints(documents([])).count() == 0
    one = merkle.fingerprints(documents([(3, "abcdefgh")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    alike = merkle.fingerprints(documents([(i, "same") for i in range(50)])).collect()
    assert {r["near_next"] for r in alike} == {1.0} and len({r["fingerprint"] for r in alike}) == 1


def test_differing_branches(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "a\nX\n\nc")], "x string, y string")
    found = df.select(merkle.differing_branches(merkle.tree(F.col("x")), merkle.tree(F.col("y"))).alias("d")).first()["d"]
    assert [tuple(d) for d in found] == [(0, 1)]


def plain_likeness(a, b):
    """Code points of blocks that are equal at equal places, over the longer text without line breaks."""
    sizes = [2] * 4 + [8] * 3

    def blocks(p):
        out, at = [], 0
        while at < len(p):
            n = sizes[len(out)] if len(out) < 7 else 32
            out.append(p[at : at + n])
            at += n
        return out

    paragraphs = lambda t: [s.split("\n") for s in t.split("\n\n")]
    total = lambda t: sum(len(p) for s in paragraphs(t) for p in s)
    if a == b:
        return 1.0
    same = 0
    for s, t in zip(paragraphs(a), paragraphs(b)):  # noqa: B905
        for p, q in zip(s, t):  # noqa: B905
            same += sum(len(x) for x, y in zip(blocks(p), blocks(q)) if x == y)  # noqa: B905
    return same / max(total(a), total(b), 1)


def test_likeness_equals_brute_force(spark):
    import random

    draw = random.Random(4)
    made = lambda: "".join(draw.choice(["a", "bb ", "\n", "\n\n", "word ", "é", "\n\n\n"]) * draw.randint(1, 30) for _ in range(draw.randint(0, 12)))
    pairs = [("", ""), ("", "\n"), ("ab" * 1725, "ab" * 1300 + "x" * 850), ("abcd", "abcx"), ("abcdefgh", "abcdefab"), ("a\n\nb", "a")]
    for _ in range(60):
        a = made()
        b = made()
        q = len(a) // 4
        pairs += [(a, b), (a, a[: len(a) - q] + b[:q])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    found = {r["i"]: r["x"] for r in df.select("i", merkle.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(found[i] - plain_likeness(a, b)) < 1e-12, (a, b)
    assert found[2] > 0.7 and found[3] == 0.5 and found[4] == 0.75
