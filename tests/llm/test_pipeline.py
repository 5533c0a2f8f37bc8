import random

import corpus_pipeline
from corpusloom.llm import exact_dedup
from tests.llm.test_near_dedup import kept_ids
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_print


def corpus(documents, spark):
    draw = random.Random(12)
    plain = ["river", "stone", "walks", "over", "green", "hill", "morning", "light", "house"]
    rows, labels = [], []
    for i in range(300):
        words = [draw.choice(plain) + str(draw.randint(0, 99)) for _ in range(draw.randint(20, 120))]
        if i % 6 == 0:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), "vilest")
        rows.append((i, " ".join(words), f"s{i % 4}"))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(8):  # near copies: one word of a long text is another
        base = [f"{draw.choice(plain)}{draw.randint(0, 99)}" for _ in range(120)]
        rows += [(600 + 2 * i, " ".join(base), f"s{i % 4}"), (601 + 2 * i, " ".join([*base[:60], "other", *base[61:]]), f"s{i % 4}")]
    rows += [(400 + i, rows[i * 7 + 1][1] + "\n", "s9") for i in range(10)] + [(500, None, None), (None, "lone text", "s1"), (501, "", "s0")]
    return documents(rows), rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_stages_and_run(spark, documents, tmp_path):
    import tokenizers

    from corpusloom.llm.packing import default_tokenizer

    docs, rows, labels = corpus(documents, spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == docs.columns
        seen.append(now.collect())
    toxic = {i for i in range(0, 300, 6)} | {400 + i for i in range(10) if (i * 7 + 1) % 6 == 0}
    left = [r for r in rows if r[0] not in toxic]
    assert sorted(str(r["doc_id"]) for r in seen[0]) == sorted(str(r[0]) for r in left)
    copies = {i * 7 + 1: 400 + i for i in range(10) if i * 7 + 1 not in toxic}  # the copy is longer by a line feed
    left = [r for r in left if r[0] not in copies and r[0] != 501]
    assert sorted(str(r["doc_id"]) for r in seen[1]) == sorted(str(r[0]) for r in left)
    assert {plain_print(r["text"]) for r in seen[2]} <= {plain_print(r[1]) for r in left}
    near = dict(enumerate(sorted((r["text"] or "" for r in seen[1]), key=lambda t: (len(t), t))))
    assert len(seen[2]) == len(kept_ids(near.items())) < len(seen[1])
    words = sum(len((r["text"] or "").split()) for r in seen[2])
    assert abs(sum(len(r["text"].split()) for r in seen[3]) - 1.5 * words) <= 6
    used, least = check(seen[4], [(r["doc_id"], r["text"]) for r in seen[3]], tokenizers.Tokenizer.from_file(default_tokenizer()))
    assert used == least
    ran = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ran)) == sorted(key(r)[:5] for r in seen[4])


def test_empty_table_passes_through(spark, documents, tmp_path):
    docs = documents([])
    columns = docs.columns
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and (k == 4 or docs.columns == columns)


def test_only_copies(documents):
    assert exact_dedup.drop_copies(documents([(1, "a"), (2, "a"), (3, " a ")])).first()["doc_id"] == 3
