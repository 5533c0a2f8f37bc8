import hashlib
import random

from corpusloom.llm import exact_dedup
from tests.compare import rows_of


def brute(rows):
    strip = lambda t: (t or "").translate(dict.fromkeys([32, *range(9, 14)]))
    groups = {}
    for r in rows:
        groups.setdefault(strip(r[1]), []).append(r)
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for k, r in enumerate(sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))):
            out.append((r[0], len(members), best[0], k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(documents, odd_rows):
    found = rows_of(exact_dedup.exact_dedup(documents(odd_rows)).select("doc_id", "group_size", "keep_id", "kept", "text_sha256"))
    assert found == (["doc_id", "group_size", "keep_id", "kept", "text_sha256"], brute(odd_rows))


def test_groups_over_many_partitions(spark, documents):
    draw = random.Random(4)
    rows = [(i, draw.choice(["same text"] * 6 + ["same  text", "other", f"own {i}"])) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows_of(exact_dedup.exact_dedup(documents(rows).repartition(7)).select("doc_id", "group_size", "keep_id", "kept", "text_sha256"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[1] == brute(rows)


def test_empty_table_and_columns_stay(documents, odd_rows):
    assert exact_dedup.exact_dedup(documents([])).count() == 0
    docs = documents(odd_rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in brute(odd_rows))
