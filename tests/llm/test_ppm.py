"""The byte model against a plain trie, the word model against plain counts."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from tokiwa.llm import ppm, queries
from tokiwa.llm.common import table


class Trie:
    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            s = bytes([ppm.BEFORE]) * order + t + bytes([ppm.END])
            for p in range(order, len(s)):
                for j in range(order + 1):
                    self.counts[s[p - j : p]][s[p]] += 1

    @cache
    def log(self, context, symbol):
        gone, out = set(), 0.0
        for j in range(self.order, -1, -1):
            c = self.counts.get(context[len(context) - j :] if j else b"")
            if not c:
                continue
            total, distinct = sum(n for s, n in c.items() if s not in gone), sum(s not in gone for s in c)
            if symbol in c:
                return out + math.log10((2 * c[symbol] - 1) / (2 * total))
            out += math.log10(distinct / (2 * total)) if distinct else 0
            gone |= set(c)
        return out - math.log10(256 - len(gone))

    def score(self, t):
        s = bytes([ppm.BEFORE]) * self.order + t + bytes([ppm.END])
        return sum(self.log(s[p - self.order : p], s[p]) for p in range(self.order, len(s)))


@pytest.mark.parametrize(("order", "block", "few"), [(3, 1 << 30, 1 << 20), (5, 40_000, 1 << 20), (4, 60_000, 30)])
def test_scores(spark, sf, order, block, few):
    docs = table(spark, sf, "documents").where("doc_id < 60")
    texts = {r["doc_id"]: r["text"].encode().lower() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    trie = Trie([t for i, t in texts.items() if not held[i]], order)
    words = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t), b""] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = ppm.score(docs, order=order, block_bytes=block, few_grams=few).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-6)
        assert r["score"] == pytest.approx(trie.score(texts[r["doc_id"]]), rel=1e-9)
    assert sum(10 ** trie.log(b"n the"[-order:], s) for s in range(256)) == pytest.approx(1)


def test_odd_rows(spark, odd, none):
    rows = ppm.score(odd, block_bytes=50_000).collect()
    assert len(rows) == odd.count() and all(r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    same = {(r["score"], r["base_score"]) for r in rows if r["doc_id"] == 5}
    assert len(same) == 1
    assert ppm.score(none).collect() == []


def test_pieces(monkeypatch):
    monkeypatch.setattr(ppm, "AT_ONCE", 7)
    for text in (b"", b"short", b"a longer text than one piece", b"x" * 14):
        assert np.array_equal(np.concatenate(list(ppm.pieces(text, 5))), ppm.grams([text], 5)[0])


def test_query_on_all_rows(spark, sf):
    """The registered query against the plain trie over the whole table, long texts included."""
    rows = queries.op1_ppm(spark, sf)
    assert rows.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = {r["doc_id"]: (r["text"] or "").encode().lower() for r in table(spark, sf, "documents").collect()}
    trie = Trie([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1], 5)
    found = {r["doc_id"]: r["score"] for r in rows.collect()}
    assert found == {i: pytest.approx(trie.score(t), rel=1e-9) for i, t in texts.items()}


def test_repeats_and_null_ids(spark):
    """A third of the rows is one text without an id; every row is scored, and learnt from as often as it comes."""
    texts = ["the same text again"] * 300 + [f"text {i} of many {i * i}" for i in range(600)]
    df = spark.createDataFrame([(None if i < 300 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = ppm.score(df, held_out=df.doc_id % 5 == 1, block_bytes=2_000, few_grams=20).collect()
    trie = Trie([t.encode() for i, t in enumerate(texts) if i < 300 or i % 5 != 1], 5)
    assert len(rows) == 900
    assert all(r["score"] == pytest.approx(trie.score((texts[0] if r["doc_id"] is None else texts[r["doc_id"]]).encode()), rel=1e-9) for r in rows)
