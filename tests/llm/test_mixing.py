"""Copies against a plain inverse of the Poisson distribution; the oracle; shares near their targets."""

import hashlib
import math
from collections import Counter

import pytest

from tests.compare import oracle_rows, rows_of
from tokiwa.llm import mixing, queries


def inverse(u, rate):
    n, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        n += 1
        p *= rate / n
        c += p
    return n


def copies(doc_id, text, rate, seed="mix"):
    parts = max(1, math.ceil(rate / mixing.MOST_MEAN))
    name, digest = "null" if doc_id is None else doc_id, hashlib.md5((text or "").encode()).hexdigest()
    draw = lambda j: int(hashlib.md5(f"{seed}|{name}|{digest}|{j}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(inverse(draw(j), rate / parts) for j in range(1, parts + 1))


def test_query_is_its_oracle(spark, sf):
    df = queries.op9_mixing(spark, sf)
    columns, expected = oracle_rows(queries.oracle_sql()["op9_mixing"], sf)
    assert columns == sorted(df.columns) and rows_of(df) == expected


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}, {"tiny": 1.0}])
def test_rates_and_copies(spark, weights):
    rows = [(i, "x" * (10 + i % 7), "a" if i % 3 else "b") for i in range(900)] + [(1000, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    total, w = sum(size.values()), {s: 1.0 for s in size} if weights is None else weights
    rate = {s: w.get(s, 0.0) / sum(w.values()) * total / size[s] for s in size}
    found = Counter(r["doc_id"] for r in mixing.mix(df, weights).collect())
    for i, t, s in rows:
        assert found[i] == copies(i, t, rate[s]), (i, s)
    for s, share in w.items():
        got = sum(found[i] * len(t) for i, t, o in rows if o == s)
        assert got == pytest.approx(share / sum(w.values()) * total, rel=0.25)


def test_order_is_shuffled_and_stable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = ([tuple(r) for r in mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect()] for _ in range(2))
    assert sorted(a) == sorted(b)
    ids = [r[0] for r in a]
    assert sum(x < y for x, y in zip(ids, ids[1:], strict=False)) == pytest.approx(len(ids) / 2, rel=0.3)


def test_rows_without_ids_draw_apart(spark):
    """A third of the rows has no doc_id; their texts differ, so they don't vanish or repeat together."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i:05d}", "a" if i % 2 else "b") for i in range(900)]
    found = Counter((r["doc_id"], r["text"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert found == +Counter({(i, t): copies(i, t, 1.0) for i, t, _ in rows})
    for key in (None, 7):
        of = [found[i, t] for i, t, _ in rows if i == key]
        assert len(set(of)) > 2 and 0.8 * len(of) < sum(of) < 1.2 * len(of)


def test_odd_rows(odd, none):
    rate = {}
    size = Counter()
    given = odd.collect()
    for r in given:
        size[r["source"]] += len(r["text"] or "")
    for s, n in size.items():
        rate[s] = 3.0 * sum(size.values()) / len(size) / n if n else 0.0
    out = mixing.mix(odd, epochs=3.0)
    rows = out.collect()
    assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == [c for c in odd.columns if c != "copy"]
    expected = Counter()
    for r in given:
        expected[r["doc_id"], r["text"]] += copies(r["doc_id"], r["text"], rate[r["source"]])
    assert Counter((r["doc_id"], r["text"]) for r in rows) == +expected
    fives = Counter(r["copy"] for r in rows if r["doc_id"] == 5)
    assert all(n == 3 for n in fives.values())
    assert mixing.mix(none).collect() == []
    clash = mixing.mix(odd.withColumnRenamed("copy", "Copy"))
    assert [c.lower() for c in clash.columns].count("copy") == 1
