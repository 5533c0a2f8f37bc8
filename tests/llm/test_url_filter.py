import random

import pytest

from corpusloom.llm import url_filter as U


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")


def test_parts_rules_and_list(spark):
    urls = [
        None, "", "no scheme", "http://A.Spam-Farm.example.com/x?y#z", "http://x.org", "https://m.example.org/es/1?x", "https://example.org/en/12", "https://example.org/en/2",
        "http://b.com/fr/", "http://b.com/de/q", "http://b.com/DE/q", "http://notexample.org/es/", "http://com/de/", "http://spam-farm.example.com.net/", "http://h?q=/fr/", "http://ÄB.com#f", "x://y://z/p",
    ]
    found = {r["page_id"]: tuple(r)[1:] for r in U.judge(pages(spark, urls)).collect()}
    assert [found[i] for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.spam-farm.example.com", "/x", None, "block"),
        ("x.org", "", None, "allow"), ("m.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"), ("b.com", "/fr/", "com/fr/", "allow"), ("b.com", "/de/q", "com/de/", "block"), ("b.com", "/DE/q", None, "allow"),
        ("notexample.org", "/es/", "org/", "allow"), ("com", "/de/", "com/de/", "block"), ("spam-farm.example.com.net", "/", None, "allow"), ("h", "", None, "allow"),
        ("Äb.com", "", None, "allow"), ("y:", "//z/p", None, "allow"),
    ]
    assert U.judge(pages(spark, [])).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    draw = random.Random(9)
    universe = [f"h{draw.randint(0, 10**9)}.net" for _ in range(5000)]
    listed = draw.sample(universe, 700) + ["only.listed"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    made = U.Cascade.build(frame(listed + [None]), frame(universe + universe[:50] + [None]))
    assert len(made.levels) > 2
    keys = frame(universe)
    found = keys.select("key", made.holds(keys["key"]).alias("x")).collect()
    assert all(r["x"] == (r["key"] in set(listed)) for r in found)
    assert not U.Cascade.build(frame([]), frame(universe)).levels


def test_levels_of_any_size_are_sharded(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 1024)
    draw = random.Random(10)
    universe = [f"h{draw.randint(0, 10**9)}.net" for _ in range(3000)]
    listed = set(draw.sample(universe, 700))
    keys = spark.createDataFrame([(k,) for k in universe], "key string")
    made = U.Cascade.build(spark.createDataFrame([(k,) for k in listed], "key string"), keys)
    assert len(made.levels[0].shards) == 5 and all(8 * len(w) <= 1024 for level in made.levels for w in level.shards)
    found = keys.select("key", made.holds(keys["key"]).alias("x")).collect()
    assert all(r["x"] == (r["key"] in listed) for r in found)


def test_level_0_grows_with_the_universe(spark):
    assert U.hashes_for(100, 50) == 4 and U.hashes_for(100, 3_300_000) == 16 and U.hashes_for(0, 0) == 4
    listed = spark.range(20).select((U.F.col("id") * 1000).cast("string").alias("key"))
    universe = spark.range(200_000).select(U.F.col("id").cast("string").alias("key"))
    made = U.Cascade.build(listed, universe)
    assert made.levels[0].hashes == 14 and sum(8 * len(w) for level in made.levels for w in level.shards) < 2000
    found = universe.filter(made.holds(U.F.col("key"))).collect()
    assert sorted(int(r["key"]) for r in found) == [1000 * i for i in range(20)]


def test_repeated_pages_and_null_ids(spark):
    rows = [(1, "http://spam-farm.example.net/"), (1, "http://spam-farm.example.net/"), (None, "http://spam-farm.example.net/"), (2, None)]
    found = U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in found) == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "block")]


def test_a_long_list_as_a_table(spark):
    """As a table; every url of a listed name and of one beside it is judged."""
    n = 250_000
    listed = spark.range(n).select(U.F.concat(U.F.lit("n"), U.F.col("id") * 3, U.F.lit(".net")))
    urls = spark.range(3_000).select(U.F.col("id").alias("page_id"), U.F.concat(U.F.lit("http://www.n"), U.F.col("id") * 499, U.F.lit(".net/x")).alias("url"))
    found = {r["page_id"]: r["verdict"] for r in U.judge(urls, listed).select("page_id", "verdict").collect()}
    assert found == {i: "block" if i * 499 % 3 == 0 and i * 499 < 3 * n else "allow" for i in range(3_000)}


def test_lists_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 1024)
    monkeypatch.setattr(U, "MAX_SHARDS", 3)
    keys = spark.range(3000).select(U.F.col("id").cast("string").alias("key"))
    with pytest.raises(ValueError, match="split the list by domain"):
        U.Cascade.build(keys, keys)
