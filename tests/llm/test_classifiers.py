import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, quality, queries, toxicity
from corpusloom.llm import labelled as labelled_module


def every_segment(scores):
    """Maximal scoring segments by their definition: repeatedly the best segment, then what lies left and right of it."""
    def part(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return part(a, i) + [(i, j)] + part(j, b)

    return part(0, len(scores))


def test_segments_equal_the_definition():
    draw = random.Random(2)
    for _ in range(300):
        scores = [draw.choice([-5, -3, -2, -1, 1, 2, 4]) + draw.random() / 8 for _ in range(draw.randint(0, 14))]
        assert [s[:2] for s in toxicity.maximal_segments(np.array(scores))] == every_segment(scores)


def test_lambda_solves_its_equation():
    s, p = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    x = toxicity.karlin_lambda(s, p)
    assert x > 0 and (p * np.exp(x * s)).sum() == pytest.approx(1)


def labelled(spark, documents, n=400):
    draw = random.Random(8)
    plain = ["river", "stone", "walks", "over", "green", "hill", "morning", "light", "house"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) + draw.choice(["", "s", "ing"]) for _ in range(draw.randint(30, 90))]
        toxic, good = int(i % 5 == 0), int(i % 3 > 0)
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(["vilest", "grubby"]) + draw.choice(["", "en", "ling"]))
        text = " ".join(words)
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, good, toxic, "x"))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_on_held_out_rows(spark, documents, odd_rows):
    docs, labels = labelled(spark, documents)
    model = toxicity.fit(docs, labels)
    scored = toxicity.with_scores(docs.drop("score"), model).join(labels.drop("text"), "doc_id").filter(common.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 40
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in scored]) > 0.95
    text = "river stone walks " * 20 + "vilest grubby vilestling " + "green hills over " * 20
    spans = model.passages(text)
    assert len(spans) == 1 and text[spans[0]["start"] : spans[0]["end"]] == "vilest grubby vilestling"
    assert toxicity.toxic_passages(documents([(1, text), (2, None)]), model).count() == 1
    odd = toxicity.with_scores(documents(odd_rows).drop("score"), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] < 0.5 for r in odd)


def test_quality_on_held_out_rows(spark, documents, odd_rows):
    docs, labels = labelled(spark, documents)
    model = quality.fit(docs, labels)
    scored = quality.with_scores(docs.drop("score"), model).join(labels.drop("text"), "doc_id").filter(common.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= quality.CUT) == bool(r["quality"]) for r in scored]) > 0.95
    odd = quality.with_scores(documents(odd_rows).drop("score"), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_documents(spark, documents, odd_rows, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one_kind):
        model = module.fit(documents(odd_rows), labels)
        assert all(0 <= r["score"] <= 1 for r in module.with_scores(documents(odd_rows).drop("score"), model).collect())
    model = module.fit(documents([]), one_kind)
    assert module.with_scores(documents([]), model, "s").count() == 0


@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op7_quality", "quality")])
def test_queries_keep_every_row(spark, sf_dir, name, label):
    found = queries.QUERIES[name](spark, sf_dir)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == common.table(spark, sf_dir, "documents").count()


def test_log_odds_equal_brute_force():
    draw = np.random.default_rng(5)
    toxic, clean, background = (draw.integers(0, 9, 40).astype(float) for _ in range(3))
    odds, z, share = toxicity.dirichlet_log_odds(toxic, clean, background, 0.1)
    prior = 0.1 * sum(toxic[i] + clean[i] for i in range(40))
    alpha = [prior * (background[i] + 0.5) / (sum(background) + 20) for i in range(40)]
    t, c = [toxic[i] + alpha[i] for i in range(40)], [clean[i] + alpha[i] for i in range(40)]
    for i in range(40):
        assert odds[i] == pytest.approx(math.log(t[i] / (sum(t) - t[i])) - math.log(c[i] / (sum(c) - c[i])))
        assert share[i] == pytest.approx(c[i] / sum(c))
        n, rate, part = toxic[i] + clean[i], sum(toxic) / (sum(toxic) + sum(clean)), 0.0
        for seen, p in ((toxic[i], rate), (clean[i], 1 - rate)):
            part += 2 * seen * math.log(seen / (n * p)) if seen else 0.0
        assert z[i] ** 2 == pytest.approx(part, abs=1e-9) and z[i] * odds[i] >= 0


def test_extreme_values_are_recovered():
    """Best segments drawn from the distribution itself, and from random walks."""
    draw = np.random.default_rng(6)
    words = draw.integers(20, 2000, 20_000).astype(float)
    best = np.maximum(0, (np.log(0.02 * words) - np.log(-np.log(draw.random(20_000)))) / 1.7)
    lam, k = toxicity.extreme_value_fit(best, words)
    assert lam == pytest.approx(1.7, rel=0.03) and k == pytest.approx(0.02, rel=0.05)
    best, p = [], 0.15
    for n in (100, 400):
        for _ in range(1500):
            s = np.where(draw.random(n) < p, 1.5, -0.5)
            best.append((max((x[2] for x in toxicity.maximal_segments(s)), default=0.0), n))
    best, words = (np.array(x, float) for x in zip(*best, strict=True))
    lam, k = toxicity.extreme_value_fit(best, words)
    assert lam == pytest.approx(toxicity.karlin_lambda(np.array([1.5, -0.5]), np.array([p, 1 - p])), rel=0.2)  # short texts have a lighter tail
    tail = 1 - np.exp(-k * words * np.exp(-lam * best))
    assert 0.003 < (tail <= 0.01).mean() < 0.025


def test_one_clean_text_in_a_hundred_has_a_significant_passage(spark, documents):
    """Held-out clean texts in which toxic words turn up by chance."""
    draw = random.Random(9)
    plain = [a + b for a in ("river", "stone", "walk", "hill", "light", "house", "green") for b in ("", "s", "ing", "ed")]
    bad = [a + b for a in ("vil", "grub", "murk") for b in ("est", "by", "ling")]
    rows, labels = [], []
    for i in range(3000):
        toxic = int(i % 6 == 0)
        words = [draw.choice(bad) if draw.random() < 0.02 else draw.choice(plain) for _ in range(draw.randint(30, 200))]
        if toxic:
            at = draw.randrange(len(words))
            words[at:at] = [draw.choice(bad) for _ in range(8)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    own = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(3000)]
    found = {kind: [bool(model.passages(t)) for (i, t), (_, _, x) in zip(rows, labels, strict=True) if own[i] and x == kind] for kind in (0, 1)}
    assert np.mean(found[0]) < 0.03 and np.mean(found[1]) > 0.9


def test_fits_have_the_least_loss():
    """No step along any weight, nor a random one, lowers the loss, which is summed here term by term."""
    draw = np.random.default_rng(7)

    def loss(rows, w, ridge):
        terms = [y * math.log1p(math.exp(-(x @ w))) + (1 - y) * math.log1p(math.exp(x @ w)) for x, y in rows]
        return sum(terms) / len(terms) + ridge / 2 * sum(v * v for v in w)

    def is_least(rows, w, ridge):
        steps = [s * e for e in np.eye(len(w)) for s in (1e-3, -1e-3)] + [1e-3 * draw.normal(size=len(w)) for _ in range(20)]
        best = loss(rows, w, ridge)
        return all(loss(rows, w + s, ridge) > best for s in steps)

    x = draw.normal(size=(80, 4))
    y = (x @ [1, -2, 0.5, 0] + draw.normal(size=80) > 0).astype(float)
    assert is_least(list(zip(x, y, strict=True)), labelled_module.logistic_fit(x, y), 1e-2)

    good, bad = draw.normal(0.6, 1, size=(15, quality._FEATURES)), draw.normal(0, 1, size=(9, quality._FEATURES))
    model = quality.fit_pairs(good, bad, seed=3)
    unit = lambda v: np.clip((v - np.vstack([good, bad]).mean(0)) / np.vstack([good, bad]).std(0), -8, 8)
    draw_again = np.random.default_rng(3)
    n = quality.PAIRS_PER_TEXT * 24
    i, j = draw_again.integers(15, size=n), draw_again.integers(9, size=n)
    pairs = [(unit(good)[a] - unit(bad)[b], 1.0) for a, b in zip(i, j, strict=True)]
    assert is_least(pairs, model.weights, 1e-3)
    raw = sorted(model.raw(np.vstack([good, bad])))
    assert raw[8] <= model.cut <= raw[9]  # as many training texts below the cut as are bad


def test_without_labels_every_text_is_kept(spark, documents, odd_rows):
    found = quality.with_scores(documents(odd_rows).drop("score"), quality.QualityModel()).collect()
    assert len(found) == len(odd_rows) and all(r["score"] == quality.CUT for r in found)


def plain_measures(text):
    """quality.measures() byte by byte."""
    raw = (text or "").encode()
    n, words, word = len(raw), [], b""
    for b in raw + b" ":
        if b in b" \t\n\x0b\f\r":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    out = [math.log(1 + n), math.log(1 + len(words))]
    if not words:
        return out + [0.0] * (quality._FEATURES - 2)
    share = lambda of: sum(b in of for b in raw) / n
    out += [share(range(48, 58)), share(range(65, 91)), share(range(97, 123)), share([10]), share([32]), share(range(128, 256))]
    lines = raw.decode("latin-1").split("\n")
    letters = lambda w: all(65 <= b <= 90 or 97 <= b <= 122 for b in w)
    cased = lambda w: any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w)
    out += [len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), max(words.count(w) for w in set(words)) / len(words)]  # noqa: B905
    out += [1 - len(set(lines)) / len(lines), math.log(1 + n / len(words)), sum(map(cased, words)) / len(words), sum(map(letters, words)) / len(words)]
    return out + [share([b]) for b in quality._SIGNS]


def test_measures_equal_a_plain_count(sf_dir, spark):
    texts = [None, "", " \n", "a", "A a A\n\nA a A\n", "ÄÖ 123 x_y! (z)", "\x0b\x0c one\ttwo \r\n", "one one one two"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    for t in texts:
        assert np.allclose(quality.measures(t), plain_measures(t), rtol=1e-12, atol=1e-15), repr(t)[:80]


def test_quality_query_equals_brute_force(spark, sf_dir):
    """The whole query against a fit on plainly measured rows and plainly computed scores."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    of = lambda k: [quality.measures(t) for t in {docs[i] for i in labels if labels[i] == k and i in docs and not held(i)}]
    by_bytes = lambda rows: np.array(sorted(rows, key=lambda v: v.tobytes()))
    model = quality.fit_pairs(by_bytes(of(1)), by_bytes(of(0)))
    found = {r["doc_id"]: r for r in queries.QUERIES["op7_quality"](spark, sf_dir).collect()}
    assert set(found) == set(docs)
    for i, text in docs.items():
        z = sum(max(-8.0, min(8.0, (x - m) / s)) * w for x, m, s, w in zip(plain_measures(text), model.mean, model.scale, model.weights, strict=True)) - model.cut
        want = 1 / (1 + math.exp(-(z + math.log(0.3 / 0.7))))
        assert found[i]["score"] == pytest.approx(want, abs=1e-9) and found[i]["held_out"] == held(i) and found[i]["predicted"] == int(found[i]["score"] >= 0.3)


def plain_segments(scores):
    """The scores of all maximal segments by their definition, over sums of prefixes."""
    total = [0.0]
    for s in scores:
        total.append(total[-1] + s)
    total, found, todo = np.array(total), [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        low = np.minimum.accumulate(total[a:b])  # the least sum before a segment that ends behind
        gain = total[a + 1 : b + 1] - low
        j = int(np.argmax(gain))
        if gain[j] <= 0:
            continue
        starts = np.flatnonzero(total[a : a + j + 1] == low[j])
        i = a + int(starts[-1])  # the shortest of equally good ones
        found.append(float(gain[j]))
        todo += [(a, i), (a + j + 1, b)]
    return found


def test_toxicity_query_equals_brute_force(spark, sf_dir):
    """Scores of the whole query against words, segments and calibration told plainly, under the model that the labels give."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest one has too few labels
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = {r["doc_id"]: r for r in queries.QUERIES["op1_toxicity"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) == set(texts)
    w, s = model.word_score.astype(float), model.stem_score.astype(float)
    strong_somewhere = 0
    for i, text in texts.items():
        words, word = [], ""
        for c in (text or "").lower() + " ":
            if c.isalnum() and not c.isnumeric():
                word += c
            else:
                words += [word] if word else []
                word = ""
        scores = []
        for k, x in enumerate(words):
            a, b = zlib.crc32(x.encode()) % (1 << 18), zlib.crc32(x[:4].encode(), 1) % (1 << 16)
            one = w[a] if abs(model.word_z[a]) >= abs(model.stem_z[b]) else s[b]
            scores.append((0.0 if k and x == words[k - 1] else one) - 0.05)
        segments = plain_segments(scores)
        strength = [model.lam * x - math.log(model.k * max(1, len(words))) for x in [0.0, *segments]]
        sure = sum(x for x in strength[1:] if x >= -math.log(0.01))
        strong_somewhere += sure > 0
        z = model.weights[0] + model.weights[1] * min(50.0, max(strength)) + model.weights[2] * math.log1p(sure)
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5), i
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.5) and found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert strong_somewhere
