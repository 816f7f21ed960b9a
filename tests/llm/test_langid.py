"""Forward-backward against all labellings; held-out accuracy; code-switched words."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokiwa.llm import langid, queries
from tokiwa.llm.common import table


def test_marginals_are_sums_over_labellings():
    rng = np.random.default_rng(1)
    emissions, step, start = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    at, offsets = np.array([0, 1, 2, 3, 4, 4, 1, 0]), np.array([0, 4, 4, 5, 8])
    found = langid.marginals(emissions, at, offsets, step, start)
    for a, b in itertools.pairwise(offsets):
        weights = {}
        for labels in itertools.product(range(3), repeat=b - a):
            if labels:
                weights[labels] = np.exp(start[labels[0]] + sum(step[x, y] for x, y in itertools.pairwise(labels)) + sum(emissions[at[a + i], x] for i, x in enumerate(labels)))
        for i in range(b - a):
            expected = [sum(w for ls, w in weights.items() if ls[i] == x) / sum(weights.values()) for x in range(3)]
            assert found[a + i] == pytest.approx(expected, abs=1e-6)
    if len(at):
        p, _ = langid.expected(emissions, at[:7], np.array([0, 4, 7]), step, start)
        assert p == pytest.approx(langid.marginals(emissions, at[:7], np.array([0, 4, 7]), step, start), abs=1e-6)


def test_query_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op10_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_words_of_switched_text(spark, sf):
    model = langid.fit(langid.sample(table(spark, sf, "documents"), langid.Settings()), langid.Settings())
    found = langid.labelled_words(model, "the thing of and with this la des une et pour les auch und nicht die eine")
    assert [x for _, x, _ in found[:6]] == ["en"] * 6 and [x for _, x, _ in found[-4:]] == ["de"] * 4


def test_prediction_sees_only_the_text(spark, sf):
    docs = table(spark, sf, "documents").withColumn("learn", F.col("doc_id") % 2 == 0)
    shuffled = docs.withColumn("lang", F.when(F.col("learn"), F.col("lang"))).withColumn("source", F.lit("z"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, F.col("learn")).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(shuffled, F.col("learn")).collect()}
    assert a == b


def test_odd_rows(odd, none):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3) or r["text"] is None)
    assert langid.identify(none).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_emission(model, word):
    """Scores of a word for each label, from its marked bytes' n-grams, itself and its lexicon, one by one."""
    import xxhash

    data, n = b"\xfe" + word + b"\xff", model.settings.buckets
    buckets = []
    for k in (2, 3, 4):
        for i in range(len(data) - k + 1):
            code = int.from_bytes(data[i : i + k], "big") * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F
            buckets.append(((code % (1 << 64)) >> 40) % n)
    buckets.append(xxhash.xxh3_64_intdigest(word) % n)
    if word in model.lexicon:
        buckets.append(n + model.lexicon[word])
    return [sum(float(model.weights[b, label]) for b in buckets) for label in range(len(model.labels))]


def plain_prediction(model, text):
    """lang_pred and score of a text by sums over its words of marginals from log-domain forward and backward passes."""
    words = [langid.stripped(w) for w in (text or "").lower().split()]
    k = range(len(model.labels))
    if not any(words):
        return "und", 0.0
    e = [plain_emission(model, w) if w else [0.0 for _ in k] for w in words]
    logsum = lambda xs: max(xs) + np.log(sum(np.exp(x - max(xs)) for x in xs))
    forward = [[model.start[b] + e[0][b] for b in k]]
    for row in e[1:]:
        forward.append([logsum([forward[-1][a] + model.transitions[a, b] for a in k]) + row[b] for b in k])
    backward = [[0.0 for _ in k]]
    for row in e[:0:-1]:
        backward.insert(0, [logsum([model.transitions[a, b] + row[b] + backward[0][b] for b in k]) for a in k])
    sums = np.zeros(len(model.labels))
    for w, f, b in zip(words, forward, backward, strict=True):
        if w:
            p = np.exp(np.array(f) + np.array(b) - logsum([x + y for x, y in zip(f, b, strict=True)]))
            sums += p
    return model.labels[int(sums.argmax())], sums.max() / sums.sum()


def test_query_against_plain_passes(spark, sf):
    """lang_pred and score of the registered query for texts of all lengths, by plain sums and passes."""
    docs = table(spark, sf, "documents")
    model = langid.fit(langid.sample(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"), langid.Settings()), langid.Settings())
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op10_langid(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 9 = 0 and length(text) < 6000").collect()}
    assert len(texts) > 15
    for i, t in texts.items():
        lang, score = plain_prediction(model, t)
        assert found[i][0] == lang and found[i][1] == pytest.approx(score, abs=1e-4), i


def test_more_languages_than_the_bound_are_an_error(spark):
    rows = [(i, f"word number {i}", f"l{i % 5}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.sample(docs, langid.Settings(most_languages=5))) == {f"l{i}" for i in range(5)}
    with pytest.raises(ValueError):
        langid.sample(docs, langid.Settings(most_languages=4))
