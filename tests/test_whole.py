"""The token queries on rows that the closed form doesn't cover, against plain Python over the lattice alone."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tests.compare import oracle_rows, rows_of
from tokiwa.operators import dictionary, index, lattice
from tokiwa.plans import registry

TEXTS = {
    1: "the stone of the river, thing 12 by 3.14", 2: "私は東京の学生です。API開発を3時間", 3: "the key is 0123456789abcdef0123456789abcdef01234567 over", 4: "a" * 21 + " and the eau", 5: "12_34 the 5_6 thing",
    6: "ＡＢＣ the ｶﾞ 3億 500 個", 7: "the stone of a river and 50% of it! " * 1200, 8: "", 9: None, 11: "a long line without an end " * 1500, 12: "see http://a.b/c?d=e! " * 2000, 13: "3.5 mails to x@y.org? " * 2000, 10: "the " + "x_" * 20 + "y stone",
}
ITEMS = {1: "the stone and the river", 2: "東京のAPI開発", 3: "0123456789abcdef0123456789abcdef01234567", 4: "nothing_else"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    for name, key, texts in (("documents", "doc_id", TEXTS), ("benchmark", "item_id", ITEMS)):
        spark.createDataFrame(list(texts.items()), f"{key} long, text string").write.parquet(f"{out}/{name}.parquet")
    return out


def by_lattice(texts):
    engine = lattice.Analyzer()
    engine.plain = False
    return {i: [(m.surface, m.pos) for m in engine.analyze(t or "")] for i, t in texts.items()}


@pytest.fixture(scope="module")
def found():
    return by_lattice(TEXTS)


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def first_tags(tokens, kinds=None):
    return list(dict.fromkeys(s for s, pos in tokens if len(s) >= 2 and (kinds is None or pos in kinds)))


def test_tokens(spark, folder, found):
    run = lambda name: registry.queries()[name](spark, folder)
    assert tuples(run("latin_tokens"), "doc_id", "token_index", "surface") == sorted((i, k, s) for i, ts in found.items() for k, (s, _) in enumerate(ts))
    counts = Counter(s for ts in found.values() for s, _ in ts)
    assert tuples(run("token_freq_topk"), "surface", "n") == sorted(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:100])
    long = Counter(len(s) for s in counts.elements() if len(s.encode()) >= 4)
    assert tuples(run("filters_bytes_and_basic"), "n_chars", "n") == sorted(long.items())
    assert tuples(run("dict_lookup"), "entry_id") == sorted((i,) for i, (_, s, _) in enumerate(registry.DICTIONARY_ROWS) if s in counts)
    judged = spark.createDataFrame([(s,) for s in counts], "surface string").select(dictionary.trivial(registry.F.col("surface")).alias("t"))
    assert tuples(run("dict_trivial"), "is_trivial", "n") == sorted(Counter(r["t"] for r in judged.collect()).items())


def test_tags(spark, folder, found):
    ranked = sorted((i, t, k) for i, ts in found.items() for k, t in enumerate(first_tags(ts), 1))
    assert tuples(registry.tags_noun_min2_dedup(spark, folder), "doc_id", "tag", "tag_rank") == ranked
    placed = sorted((i, k, t) for i, ts in found.items() for k, t in enumerate(first_tags(ts, ("NOUN", "PRON"))[:10]))
    assert tuples(registry.tags_max_n(spark, folder), "doc_id", "place", "tag") == placed


def test_index_and_search(spark, folder, found):
    post = Counter((s, i) for i, ts in found.items() for s, _ in ts if len(s) >= 2)
    assert tuples(registry.postings_tf(spark, folder), "tag", "doc_id", "tf") == sorted((*k, n) for k, n in post.items())
    docs = defaultdict(list)
    for tag, i in sorted(post):
        docs[tag].append(i)
    digest = lambda ids: hashlib.md5(",".join(map(str, ids)).encode()).hexdigest()
    assert tuples(registry.inverted_index(spark, folder), "tag", "block", "n", "doc_ids_md5") == sorted((t, 0, len(ids), digest(ids)) for t, ids in docs.items())
    blocks = index.inverted_index(index.postings(registry.corpus_tokens(spark, folder)), width=3)
    assert sorted((r["tag"], r["block"], tuple(r["doc_ids"])) for r in blocks.collect()) == sorted((t, b, tuple(i for i in ids if i // 3 == b)) for t, ids in docs.items() for b in {i // 3 for i in ids})
    best = []
    for q, ts in by_lattice(ITEMS).items():
        score = Counter(i for tag in first_tags(ts) for i in docs.get(tag, ()))
        best += [(q, i, n, k) for k, (i, n) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10], 1)]
    asked = spark.createDataFrame([(q, t) for q, ts in by_lattice(ITEMS).items() for t in first_tags(ts)], "query_id long, tag string")
    tags = spark.createDataFrame([(i, first_tags(ts)) for i, ts in found.items()], "doc_id long, tags array<string>")
    assert tuples(index.search(asked, tags, top=10, most_sent=0), "query_id", "doc_id", "score", "search_rank") == sorted(best)
    assert any(q == 3 for q, *_ in best) and tuples(registry.search_rank(spark, folder), "query_id", "doc_id", "score", "search_rank") == sorted(best)


@pytest.mark.parametrize("name", ["latin_tokens", "search_rank"])
def test_runs_over_the_caps_are_the_oracle(spark, name):
    """sf0.01 has such runs and a text over 32 KiB, which the SQL takes by a search of its own."""
    sf = "/root/testdata/sf0.01"
    df = registry.queries()[name](spark, sf)
    columns, expected = oracle_rows(registry.oracle_sql()[name], sf)
    assert columns == sorted(df.columns) and rows_of(df) == expected


def test_closed_spans_are_the_lattice(found):
    assert {i: [(m.surface, m.pos) for m in lattice.Analyzer().analyze(t or "")] for i, t in TEXTS.items()} == found
