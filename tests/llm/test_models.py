"""Importance resampling and toxicity grades against plain versions and labels."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokiwa.llm import queries, resampling, toxicity
from tokiwa.llm.common import table

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def test_weights_are_the_log_ratios(spark, sf):
    settings = resampling.Settings(buckets=500)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw, target, grams = Counter(), Counter(), {}
    for i, t in texts.items():
        grams[i] = Counter(resampling.ngrams(pa.array([t]), settings)[0].tolist())
        words = len(t.lower().split())
        assert sum(grams[i].values()) == max(0, 2 * words - 1)
        raw += grams[i]
        target += grams[i] if i in good else Counter()
    a, b = sum(target.values()) + 500, sum(raw.values()) + 500
    rows = resampling.resample(docs, labels, k=10**6, settings=settings).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = sum(n * (math.log((target[g] + 1) / a) - math.log((raw[g] + 1) / b)) for g, n in grams[r["doc_id"]].items())
        assert r["log_weight"] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("k", [0, 1, 7, 499, 1500, 5000])
def test_top_is_the_sorted_head(spark, k):
    rng = np.random.default_rng(k)
    keys = np.concatenate([rng.normal(size=2000), np.repeat(0.5, 1500), rng.exponential(1e6, size=500)])
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(keys)], "doc_id long, key double")
    found = sorted(((-r["key"], r["doc_id"]) for r in resampling.top(rows, k, bins=50, few=20).collect()))
    assert found == sorted((-x, i) for i, x in enumerate(keys.tolist()))[:k]


def test_sample_keeps_good_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in queries.op3_resampling(spark, SF).collect()}
    assert len(kept) == pytest.approx(1000 * sum(labels.values()) / len(labels), abs=1)
    assert np.mean([i in kept for i, q in labels.items() if q]) > 0.95 and np.mean([i in kept for i, q in labels.items() if not q]) < 0.4


def test_sample_is_the_highest_keys(spark, sf):
    """The query's sample against keys made plainly: log weight plus Gumbel noise hashed from doc_id, the k highest."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    weights = {r["doc_id"]: r["log_weight"] for r in resampling.resample(docs, labels, k=10**6).collect()}

    def gumbel(i):
        u = int(hashlib.md5(f"resample|{i}".encode()).hexdigest()[:13], 16)
        return -math.log(-math.log((u + 0.5) / 2**52))

    keys = {i: w + gumbel(i) for i, w in weights.items()}
    quality = [r["quality"] for r in labels.where("quality is not null").collect()]
    k = round(len(keys) * sum(q == 1 for q in quality) / len(quality))
    best = sorted(keys, key=lambda i: (-keys[i], i))[:k]
    found = {r["doc_id"]: r["key"] for r in queries.op3_resampling(spark, sf).collect()}
    assert found == {i: pytest.approx(keys[i], abs=1e-9) for i in best}


def test_good_rows_by_either_join(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    a, b = (sorted(map(tuple, resampling.targeted(docs, labels, resampling.Settings(most_sent=n)).select("doc_id", "target").collect())) for n in (0, 10**6))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert a == b and {i for i, t in a if t} == good


def test_resampling_odd_rows(odd, none, labels):
    rows = resampling.resample(odd, labels, k=100).collect()
    assert len(rows) == odd.count() and all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (1, 2, 3)) and len({r["key"] for r in rows if r["doc_id"] == 5}) == 1
    assert len(resampling.resample(odd, labels).collect()) == round(odd.count() * 5 / 7)  # of seven labels of quality five say good
    assert resampling.resample(none, labels).collect() == []
    assert len(resampling.resample(odd, labels.limit(0)).collect()) == odd.count()


def test_slopes_are_those_of_the_likelihood():
    """Against differences of a likelihood written out for each grade."""
    rng = np.random.default_rng(3)
    s, y, first, gaps = rng.normal(size=40), rng.integers(0, 4, size=40), 0.3, np.array([-0.5, 0.2])

    def plain(s, first, gaps):
        theta = [-math.inf, first, first + math.exp(gaps[0]), first + math.exp(gaps[0]) + math.exp(gaps[1]), math.inf]
        above = lambda t, x: 0.0 if t == math.inf else 1.0 if t == -math.inf else 1 / (1 + math.exp(t - x))
        return -sum(math.log(above(theta[g], x) - above(theta[g + 1], x)) for x, g in zip(s, y, strict=True)) / len(s)

    loss, slope, by_first, by_gaps = toxicity.likelihood(s, y, first, gaps)
    assert loss == pytest.approx(plain(s, first, gaps))
    h = 1e-6
    bumped = lambda x, i: np.where(np.arange(len(x)) == i, x + h, x)
    assert by_first == pytest.approx((plain(s, first + h, gaps) - loss) / h, abs=1e-4)
    assert by_gaps == pytest.approx([(plain(s, first, bumped(gaps, i)) - loss) / h for i in range(2)], abs=1e-4)
    assert slope / len(s) == pytest.approx([(plain(bumped(s, i), first, gaps) - loss) / h for i in range(len(s))], abs=1e-4)


def test_scores_are_sums_of_weights():
    """A row's score is the sum over its distinct features of 1 + log of how often they come, times the weight."""
    settings = toxicity.Settings(buckets=1 << 12)
    texts = ["stone water! stone Idiot", "", "light,light light"]
    w = np.random.default_rng(1).normal(size=settings.buckets)
    found = toxicity.Rows(pa.array(texts), settings).times(w)
    for text, score in zip(texts, found, strict=True):
        c = Counter(b for x in text.lower().split() for b in toxicity.word_features([x], settings)[0])
        assert score == pytest.approx(sum((1 + math.log(n)) * w[b] for b, n in c.items()), abs=1e-5)


def test_severities_come_from_labels(spark):
    rows = [(1, 0, 0), (2, 1, 1), (3, 7, 0), (4, 1, None), (5, None, 0), (None, 1, 0), (6, 0, 1), (6, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, quality int")
    found = {r["doc_id"]: r["severity"] for r in toxicity.severities(labels, toxicity.Settings()).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 1, 6: 1}
    given = {r["doc_id"]: r["severity"] for r in toxicity.severities(spark.createDataFrame([(1, 5), (2, 0), (3, None)], "doc_id long, severity int"), toxicity.Settings()).collect()}
    assert given == {1: 2, 2: 0}


def test_a_row_has_no_part_in_its_own_grade():
    """Grades are in equal parts; what one row's text is doesn't change the grades of its own half but for the ranks."""
    texts = [f"idiot {'scum ' * (i % 3)}stone{i}" if i % 4 == 0 else f"water light{i} stone" for i in range(240)]
    toxic = np.array([i % 4 == 0 for i in range(240)])
    settings = toxicity.Settings(least_z=1.0)
    grades = toxicity.cross_graded(toxicity.Rows(pa.array(texts), settings), toxic, settings)
    assert Counter(grades.tolist()) == {0: 180, 1: 30, 2: 30} and set(grades[~toxic]) == {0}
    texts[0] = "idiot " * 50
    again = toxicity.cross_graded(toxicity.Rows(pa.array(texts), settings), toxic, settings)
    same_half = [i for i in range(2, 240, 2) if toxic[i]]
    assert sum(grades[i] != again[i] for i in same_half) <= 1


def test_likelihood_of_ordered_grades():
    """The fit lowers the negative log likelihood; thresholds stay in order; severity sums the probabilities."""
    texts = ["stone water light " * 5, "idiot stone", "idiot scum moron trash", "river house green"] * 60
    grades = [0, 1, 2, 0] * 60
    model = toxicity.fit(texts, grades, toxicity.Settings())
    rows = toxicity.Rows(pa.array(texts), toxicity.Settings())
    p = model.above(rows)
    assert np.all(np.diff(model.thresholds) > 0) and np.all(p[:, 0] >= p[:, 1])
    assert max(p[0, 0], p[3, 0]) < 0.5 < min(p[1, 0], p[2, 0]) and p[2].sum() > p[1].sum() > p[0].sum()


def test_toxicity_on_held_out_labels(spark):
    labels, docs = table(spark, LARGER, "labels"), table(spark, LARGER, "documents")
    texts = docs.join(labels, "doc_id").select("doc_id", F.md5("text").alias("m"))
    train = labels.join(texts.where("conv(substr(m, 1, 4), 16, 10) % 3 <> 0"), "doc_id", "left_semi")
    truth = {r["doc_id"]: r["toxic"] for r in labels.join(train, "doc_id", "left_anti").collect()}
    found = {r["doc_id"]: r for r in toxicity.grade(docs, train).where(F.col("doc_id").isin(*truth)).collect()}
    assert np.mean([found[i]["toxic"] for i, t in truth.items() if t]) > 0.85
    assert np.mean([found[i]["toxic"] for i, t in truth.items() if not t]) < 0.02
    for r in found.values():
        assert r["expected_severity"] >= r["p_toxic"] >= 0 and r["grade"] in (0, 1, 2)


def test_toxicity_odd_rows(odd, none, labels):
    rows = toxicity.grade(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["expected_severity"] == 0 and not r["toxic"] for r in rows if not (r["text"] or "").strip())
    assert toxicity.grade(none, labels).collect() == []
    assert not any(r["toxic"] for r in toxicity.grade(odd, labels.limit(0)).collect())
