"""Pieces against the tokenizer on whole texts; plans against every rule of packing."""

import struct
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tokiwa.llm import packing, queries
from tokiwa.llm.common import table

PATH = queries.tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)


def brute_pieces(doc_id, text, capacity):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
    for at in range(0, len(ids), capacity):
        part = ids[at : at + capacity]
        yield doc_id, at // capacity, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def check(docs, found, capacity):
    expected = Counter(p for d in docs for p in brute_pieces(*d, capacity))
    assert Counter(tuple(r)[:5] for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in placed) <= 2
    return len(bins), -(-sum(p[3] * n for p, n in expected.items()) // capacity)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    used, least = check(docs, queries.op8_packing(spark, sf).collect(), 4096)
    assert used <= 1.03 * least + 1


def test_odd_rows(odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(docs, packing.pack(odd, PATH, capacity=64, rows_per_salt=3).collect(), 64)
    assert packing.pack(none, PATH).collect() == []


def fewest(counts, capacity):
    """No packing has fewer bins: by the sum of lengths, and by how many pieces of at least k fit beside the larger ones."""
    out = -(-sum(a * n for a, n in counts.items()) // capacity)
    for k in (a for a in counts if 2 * a <= capacity):
        alone = sum(n for a, n in counts.items() if 2 * a > capacity)
        beside = sum(n * ((capacity - a) // k) for a, n in counts.items() if 2 * a > capacity)
        rest = sum(n for a, n in counts.items() if k <= a and 2 * a <= capacity)
        out = max(out, alone + max(0, -(-(rest - beside) // (capacity // k))))
    return max(out, sum(n for a, n in counts.items() if 2 * a > capacity))


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), max_size=15))))
def test_plans(case):
    capacity, counts = case
    bins, seen = defaultdict(list), set()
    for length, lo, hi, copies, sequence, at in packing.plan_bins(counts, capacity):
        for r in range(lo, hi):
            assert (length, r) not in seen
            seen.add((length, r))
            bins[sequence + (r - lo) // copies].append((at + (r - lo) % copies * length, length))
    assert seen == {(length, r) for length, n in counts.items() for r in range(n)}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.34 * fewest(counts, capacity) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZéÉßñ ıİΣ.,!*'$-_\n\t0½9<|>endoftxs", max_size=40), max_size=8))
def test_words_are_the_texts(texts):
    import pyarrow as pa

    words, begin = packing.WordIds(PATH), 0
    ids, ends = words(pa.array(texts, pa.string()))
    for t, end in zip(texts, ends, strict=True):
        assert ids[begin:end].tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids
        begin = end


def test_forgetting(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "REMEMBERED", 2)
    words = packing.WordIds(PATH)
    for texts in (["one two three"], ["two four"], ["one", "five one."], ["three"]):
        ids, _ = words(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in TOKENIZER.encode(t, add_special_tokens=False).ids]
