"""Chunk fingerprints against the plain order of documents; gear hashes against their recurrence."""

import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tokiwa.llm import chunking, queries
from tokiwa.llm.common import table

HOW = chunking.Chunking()
GEAR = HOW.gear()


@given(st.binary(min_size=1, max_size=300))
def test_gear_hash(data):
    h, expected = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        expected.append(h)
    assert chunking.gear_hashes(data, GEAR).tolist() == expected


@given(st.binary(min_size=1, max_size=4000))
def test_boundaries(data):
    """The sequential rule: least bytes, strict up to normal, loose up to most."""
    h, expected, at = chunking.gear_hashes(data, GEAR), [], 0
    while at < len(data):
        end = min(at + HOW.most, len(data))
        for i in range(at + HOW.least, end + 1):
            bits = HOW.strict if i < at + HOW.normal else HOW.loose
            if int(h[i - 1]) >> (32 - bits) == 0:
                end = i
                break
        expected.append(end)
        at = end
    assert chunking.boundaries(data, HOW, GEAR) == expected


def brute(rows):
    """rows: (doc_id, text) in order of doc_id, nulls first, then of the text's hash as a signed number, then of the text."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        a, b, c = (chunking.chunk_set(x, HOW, GEAR) for x in (t, changed, after))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), chunking.written(a), chunking.written(b), chunking.containment(a, b), chunking.containment(a, c)))
    return sorted(out, key=repr)


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.op2_chunking(spark, sf).collect()]
    assert sorted(rows, key=repr) == brute([tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()])
    halves = [r[5] for r in rows if r[1] > 1000]
    assert 0.4 < np.mean(halves) < 0.6


@pytest.mark.parametrize("per_bucket", [1, 3, 1000])
def test_buckets(spark, sf, per_bucket, monkeypatch):
    docs = table(spark, sf, "documents").select("doc_id", "text").where("doc_id % 3 <> 1 and length(text) < 900")
    plain = chunking.neighbours
    monkeypatch.setattr(chunking, "neighbours", lambda d: plain(d, per_bucket))
    assert sorted((tuple(r) for r in chunking.compare(docs).collect()), key=repr) == brute([tuple(r) for r in docs.collect()])


def test_hot_ids_are_split(spark, monkeypatch):
    """A third of the rows has one doc_id, a third has none: their buckets are as small as others', and all is as in order."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (i % 5)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in chunking.neighbours(docs, per_bucket=20).where("ahead = 0").groupBy("bucket").count().collect()]
    assert max(sizes) < 120 and len(sizes) >= 20  # a fifth of the texts is empty, 40 of these under one id
    plain = chunking.neighbours
    monkeypatch.setattr(chunking, "neighbours", lambda d: plain(d, 20))
    assert sorted((tuple(r) for r in chunking.compare(docs).collect()), key=repr) == brute(rows)


def test_odd_rows(odd, none):
    assert sorted((tuple(r) for r in chunking.compare(odd).collect()), key=repr) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert chunking.compare(none).collect() == []
    one = odd.where("doc_id = 4")
    assert chunking.compare(one).first()["near_next"] == 1.0
