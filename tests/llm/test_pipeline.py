"""The pipeline against its stages done plainly, one after the other."""

import math
from collections import Counter

import pytest
from tests.llm.test_mixing import copies
from tests.llm.test_packing import check
from tests.llm.test_secrets import all_spans, base
from tests.llm.test_simhash import brute_classes, brute_fingerprint

import corpus_pipeline
from tokiwa.llm import langid
from tokiwa.llm.common import cut, shared_folder, table


def redact(text):
    at, out = 0, ""
    for a, _, b, _ in all_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_stages_are_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    judged = {r["doc_id"]: r for r in langid.identify(docs).collect()}  # the model itself is tested in test_langid
    rows = {i: r for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, out, sf), "test-stage")
        assert out.columns == corpus_pipeline.COLUMNS
        found = Counter((r["doc_id"], r["text"], r["n_chars"], r["lang"], r["source"]) for r in out.collect())
        if name == "dedup":
            ids = sorted(rows)
            rows = {ids[i]: rows[ids[i]] for i in set(brute_classes([brute_fingerprint(rows[i]["text"]) for i in ids]))}
        if name == "secrets":
            clean = {i: redact(r["text"]) for i, r in rows.items()}
            rows = {i: r.asDict() | {"text": clean[i], "n_chars": len(clean[i]) if clean[i] != r["text"] else r["n_chars"]} for i, r in rows.items()}
            assert not any(base(r["text"]) for r in rows.values())
        expected = Counter((i, r["text"], r["n_chars"], r["lang"], r["source"]) for i, r in rows.items())
        if name == "mix":
            size = Counter()
            for r in rows.values():
                size[r["source"]] += len(r["text"])
            rate = {s: sum(size.values()) / len(size) / n for s, n in size.items()}
            expected = Counter({k: copies(k[0], k[1], rate[k[4]]) for k in expected})
            expected = +expected
        assert found == expected, name
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf).collect()
    used, least = check([(r["doc_id"], r["text"]) for r in out.collect()], packed, 4096)
    assert used <= math.ceil(1.03 * least) + 1


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    assert corpus_pipeline.language_stage(spark, docs, sf).count() >= 0.99 * docs.count()


def test_odd_rows(spark, odd, none):
    """Each stage by itself on nulls, empty and very long texts, ties, repeats and clashing names, with what it must give."""
    docs = odd
    given = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == [], name
    with_letters = [r for r in given if r[1] and any(c.isalpha() for c in r[1])]
    found = stages["language"](spark, docs, "").collect()
    assert set(map(tuple, found)) <= {r if r[2] else r[:2] + (x,) + r[3:] for r in with_letters for x in ("en", "fr", "de")} and all(r["lang"] for r in found) and len(found) >= 6
    found = [tuple(r) for r in stages["dedup"](spark, docs, "").collect()]
    classes = brute_classes([brute_fingerprint(r[1] or "") for r in given])
    expected = []
    for c in set(classes):
        expected.append(min((r for r, k in zip(given, classes, strict=True) if k == c), key=lambda r: (r[0] is None, r[0] or 0)))
    assert sorted((r[0], r[1] or "") for r in found if r[0] is not None) == sorted((r[0], r[1] or "") for r in expected if r[0] is not None) and len(found) == len(expected)
    found = Counter(tuple(r) for r in stages["secrets"](spark, docs, "").collect())
    assert found == Counter(given)  # there are no secrets
    size = Counter()
    for r in given:
        size[r[3]] += len(r[1] or "")
    rate = {s: sum(size.values()) / len(size) / n if n else 0.0 for s, n in size.items()}
    drawn = Counter()
    for r in given:
        drawn[r] += copies(r[0], r[1], rate[r[3]])
    assert Counter(tuple(r) for r in stages["mix"](spark, docs, "").collect()) == +drawn
    check([(r[0], r[1]) for r in given], stages["pack"](spark, docs, "").collect(), 4096)


def test_rows_without_ids_are_kept_one_by_one(spark):
    """Copies without a doc_id go; unlike texts of one doc_id stay; a kept text doesn't bring its doc_id's others back."""
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, text)] * 3 + [(None, other)] * 2 + [(1, text), (1, "quite another thing " * 9), (2, text), (2, "a third one of its own " * 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()), key=repr)
    assert found == sorted([(1, text), (1, "quite another thing " * 9), (2, "a third one of its own " * 9), (None, other)], key=repr)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "dedup", "secrets", "mix", "pack"]


def test_run_leaves_the_last_stage_only(spark):
    """What a stage wrote is gone once the next has been written."""
    import os

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if x.startswith("stage-")] == ["stage-mix"]
