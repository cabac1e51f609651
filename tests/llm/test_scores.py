"""Outliers, toxicity, language model: exact statistics, held-out accuracy, brute force."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOWER, no_docs, odd_docs, odd_rows, prose, words
from pyspark.sql import functions as F

from sparkattest.llm import katz, robust_outliers, toxicity
from sparkattest.session import shared_folder


def _statistics(text):
    text = text or ""
    w = words(text)
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("bits", [24, 3])
def test_statistics(spark, monkeypatch, bits):
    monkeypatch.setattr(robust_outliers, "LOW_BITS", bits)  # few bits force whole windows to be compared
    names = ["n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = robust_outliers.with_statistics(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert tuple(r[n] for n in names) == _statistics(r["text"])


def _mcd(x):
    """The same concentration steps in numpy."""
    ridge = np.array(robust_outliers.RIDGE)
    middle = np.percentile(x, 50, axis=0, method="inverted_cdf")
    spread = np.percentile(np.abs(x - middle), 50, axis=0, method="inverted_cdf")
    d2 = ((x - middle) ** 2 / (2.2 * spread**2 + ridge)).sum(axis=1)
    bins = lambda d: np.floor(np.log(np.maximum(d, 1e-9)) * robust_outliers.BINS)
    first = lambda b, share: np.sort(b)[int(np.ceil(share * len(b))) - 1]
    for _ in range(robust_outliers.STEPS):
        near = x[bins(d2) <= first(bins(d2), robust_outliers.SHARE)]
        mean = near.mean(axis=0)
        cov = (near.T @ near) / len(near) - np.outer(mean, mean) + np.diag(ridge)
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    return d2 / (np.exp((first(bins(d2), 0.5) + 0.5) / robust_outliers.BINS) / robust_outliers.MEDIAN)


def test_distances_against_numpy(spark):
    rng = random.Random(3)
    texts = [prose(k, rng.randrange(60, 300)) for k in range(260)] + [" ".join(f"{w}%%%$$$" for w in prose(k, 100).split()) for k in range(12)]
    docs = spark.createDataFrame([(k, t, "en", "s", "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kept string")
    rows = {r["doc_id"]: r for r in robust_outliers.judge_documents(docs).collect()}
    stats = np.array([_statistics(t) for t in texts], float)
    n = np.maximum(stats[:, 0], 1)
    x = np.c_[np.log(n), np.log(stats[:, 1] / n), np.log1p(100 * stats[:, 2] / n), np.log1p(100 * stats[:, 3] / n), np.log1p(100 * stats[:, 4] / n)]
    passed = np.array([not rows[k]["base_failed"] for k in range(len(texts))])
    expected = _mcd(x[passed])
    got = np.array([rows[k]["distance"] for k in np.flatnonzero(passed)])
    assert np.allclose(got, expected, rtol=1e-6)
    assert not any(rows[k]["kept_"] for k in range(260, 272))
    assert all(rows[k]["kept_"] for k in range(260) if not rows[k]["base_failed"])
    assert {r["kept"] for r in rows.values()} == {"x"}


def test_each_statistic_rejects_by_itself(spark):
    rng = np.random.default_rng(8)
    n = np.exp(rng.normal(5.6, 0.8, 500)).clip(50).astype(int)
    chars, symbols = n * np.exp(rng.normal(1.6, 0.15, 500)), n * np.exp(rng.normal(0, 0.6, 500)) / 100
    rows = [(k, "en", "s", int(a), int(b), int(c), 0, 0) for k, (a, b, c) in enumerate(zip(n, chars, symbols, strict=True))]
    middle = (270, 1337, 2, 0, 0)
    odd = [(500_000, 2_476_000, 5000, 0, 0), (270, 270 * 60, 2, 0, 0), (270, 1337, 270, 0, 0), (270, 1337, 2, 270, 0), (270, 1337, 2, 0, 135), middle]
    table = spark.createDataFrame(rows + [(1000 + k, "en", "s", *x) for k, x in enumerate(odd)], "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in robust_outliers.FIVE))
    got = {r["doc_id"]: r for r in robust_outliers.judge(table).collect()}
    assert [got[1000 + k]["kept"] for k in range(6)] == [False] * 5 + [True], [got[1000 + k]["distance"] for k in range(6)]


def test_outliers_odd_tables(spark):
    rows = robust_outliers.judge_documents(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        n, _, _, _, repeated = _statistics(r["text"])
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert (r["distance"] is None) == r["base_failed"]
        assert not (r["base_failed"] and r["kept_"])
    assert robust_outliers.judge_documents(no_docs(spark)).count() == 0


BAD = ["idiot", "moron", "worthless", "pathetic"]


def _labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w, y = prose(seed * 10_000 + k, rng.randrange(20, 200)).split(" "), int(k % 4 == 0)
        if y:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((k, " ".join(w), y))
    return rows


def test_toxicity_learns_and_generalises(spark):
    train = spark.createDataFrame(_labelled(400, 1), "doc_id long, text string, label int")
    model = toxicity.fit(train)
    held = spark.createDataFrame(_labelled(200, 2), "doc_id long, text string, score int")
    rows = toxicity.score(held, model).collect()
    right = sum((r["score_"] >= 0.3) == (r["score"] == 1) for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r["score_"] <= 1 for r in rows)
    clean = prose(77, 80)
    probes = spark.createDataFrame([(0, clean), (1, clean + " mooron"), (2, clean + " worthles")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(probes, model).orderBy("doc_id").collect()]
    assert scores[1] > scores[0] and scores[2] > scores[0]  # misspellings never seen


def test_toxicity_odd_tables(spark):
    model = toxicity.fit(spark.createDataFrame(_labelled(60, 3), "doc_id long, text string, label int"))
    rows = toxicity.score(odd_docs(spark), model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score_"] <= 1 for r in rows)
    assert toxicity.score(no_docs(spark), model).count() == 0
    odd = [(1, None, 1), (1, "a", 0), (None, "a", 1), (2, "", None), (3, "a b", 7)]
    toxicity.fit(spark.createDataFrame(odd, "doc_id long, text string, label int"))
    single = toxicity.fit(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, label int"))
    assert single.probability(np.zeros(2)).tolist() == [1.0, 1.0]
    nothing = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert nothing.probability(np.zeros(1)).tolist() == [0.0]


def test_toxicity_is_a_function_of_the_text_alone():
    rows = _labelled(80, 4)
    a = toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]), (1.0, 1.0))
    b = toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]), (1.0, 1.0))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def _katz(texts, train):
    pairs, uni, ctx = Counter(), Counter(), Counter()
    seqs = [[*words((t or "").translate(LOWER)), "</s>"] for t in texts]
    for s, use in zip(seqs, train, strict=True):
        if use:
            prev = ["<s>", *s[:-1]]
            uni.update(s)
            pairs.update(zip(prev, s, strict=True))
            ctx.update(prev)
    n, v = sum(uni.values()), len(uni)
    d1, d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(pairs.values()))
    cut = lambda c, d: c * d[c - 1] if c <= katz.K else c
    unseen = 1 - sum(cut(c, d1) for c in uni.values()) / n if n else 1.0
    n_all = n
    if n and unseen <= 0:
        n_all, unseen = n + 1, 1 / (n + 1)
    own = lambda w: cut(uni[w], d1) / n_all if w in uni else unseen
    mass, covered = Counter(), Counter()
    for (h, w), c in pairs.items():
        mass[h] += cut(c, d2)
        covered[h] += own(w)
    total = {h: c + (mass[h] >= c) for h, c in ctx.items()}
    back = {h: (1 - mass[h] / total[h]) / max(1 - covered[h], 1e-15) for h in ctx}
    prob = lambda h, w: cut(pairs[h, w], d2) / total[h] if (h, w) in pairs else back.get(h, 1.0) * own(w)
    for h in [*list(ctx)[:20], "never"]:
        assert abs(sum(prob(h, w) for w in uni) + back.get(h, 1.0) * unseen - 1) < 1e-9
    out = []
    for s in seqs:
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)
        out.append((len(s), sum(w in uni for w in s), base, sum(math.log10(prob(h, w)) for h, w in zip(["<s>", *s[:-1]], s, strict=True))))
    return n, out


def test_katz_against_brute_force(spark):
    rows = [(k, prose(k, 30 + k % 50, 120), k % 5 != 1) for k in range(120)] + [(500 + k, t, k % 3 != 1) for k, (_, t, *_) in enumerate(odd_rows())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train boolean, score string")
    model = katz.fit(docs, F.col("train"))
    n, expected = _katz([r[1] for r in rows], [r[2] for r in rows])
    assert model.train_tokens == n
    got = {r["doc_id"]: r for r in katz.score(docs, model).collect()}
    assert len(got) == len(rows)
    for (k, *_), (tokens, known, base, score) in zip(rows, expected, strict=True):
        r = got[k]
        assert (r["n_tokens"], r["n_known"]) == (tokens, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score_"], score, rel_tol=1e-9)
        assert r["score"] == "x"


def test_katz_scores_texts_it_never_met(spark):
    rows = [(k, prose(k, 30 + k % 50, 120), k % 5 != 1) for k in range(60)] + [(90, "Words nobody wrote w1 w2", False), (91, None, False), (92, prose(5, 30, 120), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    model = katz.fit(docs.filter("train"), F.lit(True))
    _, expected = _katz([r[1] for r in rows], [r[2] for r in rows])
    got = {r["doc_id"]: r for r in katz.score(docs, model).collect()}
    assert len(got) == len(rows)
    for (k, *_), (tokens, known, base, score) in zip(rows, expected, strict=True):
        assert (got[k]["n_tokens"], got[k]["n_known"]) == (tokens, known)
        assert math.isclose(got[k]["base_score"], base, rel_tol=1e-9) and math.isclose(got[k]["score"], score, rel_tol=1e-9)
    one = katz.score(docs.filter("doc_id = 90"), model).collect()
    assert len(one) == 1 and one[0]["score"] == got[90]["score"]


def test_katz_keeps_a_few_bytes_a_token(spark):
    docs = spark.createDataFrame([(k, prose(k, 400, 5000), k % 5 != 1) for k in range(500)], "doc_id long, text string, train boolean").repartition(2)
    kept = lambda: sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file://")).rglob("*.parquet"))
    before = kept()
    rows = katz.score(docs, katz.fit(docs, F.col("train")), fitted=True).collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert len(rows) == 500 and 500 * 400 < tokens
    assert kept() - before < 16 * tokens, (kept() - before) / tokens


def test_katz_odd_tables(spark):
    rows = katz.score(odd_docs(spark), katz.fit(odd_docs(spark), F.lit(False)))
    assert {r["score_"] for r in rows.collect()} == {0.0}  # nothing learned: every token is the unseen word
    assert katz.score(no_docs(spark), katz.fit(no_docs(spark), F.lit(True))).count() == 0
    assert rows.count() == len(odd_rows())


def test_toxicity_model_of_repeated_ids_and_bounded_bytes(spark):
    rows = [(k, f"plain words number {k} and more", 0) for k in range(60)] + [(100 + k, f"nasty slur{k % 3} here {k}", 1) for k in range(60)]
    twice = rows + [(5, "zz nasty slur1 twice", 0)]
    fits = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string, label int").repartition(n)) for r, n in ((rows, 1), (twice, 3), (twice[::-1], 2))]
    assert all(np.array_equal(fits[0].weights, m.weights) for m in fits[1:])
    small = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert not np.array_equal(toxicity.fit(small, max_bytes=1500).weights, fits[0].weights)
    assert toxicity.fit(small, max_bytes=0).weights.any() == np.False_
