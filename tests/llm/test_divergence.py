"""Counts and distances against plain Python over the same rows."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tokiwa.llm import divergence, queries
from tokiwa.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = [re.compile(p.replace(r"\p{L}\p{M}", r"^\W\d_")) for _, p in divergence.CHAR_CLASSES]


def counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        covered |= {i, i + 1, i + 2} if times[w] > 1 else set()
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def chars(text):
    out = []
    for p in CLASSES:
        rest = p.sub("", text)
        out.append(len(text) - len(rest))
        text = rest
    return [*out, len(text)]


def common(text):
    return Counter(w.lower() for w in WORD.findall(text) if w.lower() in divergence.COMMON_WORDS)


def js(p, q):
    both = [(a, b, (a + b) / 2) for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, sum((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0) for a, b, m in both) / 2))


def brute(rows, limits=divergence.Limits()):
    by, words, shares = defaultdict(lambda: [0] * 8), Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        by[lang] = [a + b for a, b in zip(by[lang], chars(text), strict=True)]
        words[lang] += len(WORD.findall(text))
        shares[lang] += common(text)
    out = {}
    for key, text, lang in rows:
        n, word_chars, symbols, lines, repeated = counts(text)
        total = sum(by[lang]) or 1
        char_d = js([c / len(text) for c in chars(text)], [c / total for c in by[lang]]) if text else None
        word_d = None
        if n:
            names, own = sorted(shares[lang]), common(text)
            p, q = [own[w] / n for w in names], [shares[lang][w] / words[lang] for w in names]
            word_d = js([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        failed = n < 50 or 100 * repeated > 50 * n
        noise = limits.word_noise * max(0.0, n**-0.5 - limits.least_judged_words**-0.5) if n else 0.0
        kept = not failed and (len(text) < limits.least_chars or round(char_d, 9) <= limits.most_char_distance) and round(word_d, 9) <= limits.most_word_distance + noise
        out[key] = (n, word_chars, symbols, lines, repeated, failed, kept, char_d, word_d)
    return out


def check(found, expected):
    assert len(found) == len(expected)
    for r in found:
        e = expected[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == e[:7]
        assert r["char_distance"] == (None if e[7] is None else pytest.approx(e[7], abs=2e-6))
        assert r["word_distance"] == (None if e[8] is None else pytest.approx(e[8], abs=2e-6))


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf, "documents").collect()]
    check(queries.op5_divergence(spark, sf).collect(), brute(rows))


def test_planted_rows(spark):
    plain = " ".join(f"the stone {i} of water and light" for i in range(60))
    rows = [(i, plain + f" {i} more", "en") for i in range(30)]
    rows += [(100, "THE!! STONE!! " * 80 + "x", "en"), (101, "\n".join(["same line of text"] * 40), "en"), (102, "a b c a b c", None), (103, "", "de"), (104, "w#w $x%y " * 70 + "é", "en"), (105, "a b a b a", "en")]
    expected = brute(rows)
    found = divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    check(found, expected)


def test_odd_rows(odd, none):
    rows = divergence.judge(odd).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 8, 9))
    assert divergence.judge(none).collect() == []
