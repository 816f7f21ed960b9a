"""Sentences over 32 KiB give the rows of the SQL, which cuts no token."""

import os

import pytest

from tests.compare import TABLES, oracle_rows, rows_of
from tokiwa.operators import lattice
from tokiwa.plans import registry

SF = "/root/testdata/sf0.001"
TEXTS = {
    1: "einen " * 7000, 2: "anderedouou " * 4000 + "a" * 30, 3: "see http://a.b/c?dddd=e or x@y.org at 3.25% " * 1500, 4: "0123456789abcdef0123456789abcdef01234567," * 1000,
    5: "the stone of the river. " * 3, 6: "the 1.5 eau! " * 4000, 70_000: "thenheti " * 4386 + "#oueuxou " * 3000,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", out / f"{t}.parquet")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").toPandas().to_parquet(out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["all_morphemes", "dict_trivial", "filters_bytes_and_basic", "inverted_index", "latin_tokens", "postings_tf", "tags_max_n", "tags_noun_min2_dedup", "token_freq_topk"])
def test_query(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    columns, expected = oracle_rows(registry.oracle_sql()[name], folder)
    assert columns == sorted(df.columns) and rows_of(df) == expected


def test_no_run_is_cut():
    """Whatever its length and whatever stands beside it; pieces still tile the text, and only such a run is over the limit."""
    engine = lattice.Analyzer()
    for raw in ("a" * 40_000, "東" * 10_920 + "word9_x" * 4, "、" + "x1" * 20_000 + "東京", "einen " * 7000, "ＡＢＣ " * 4000, "東京" * 9000):
        pieces = engine.chunks(raw)
        assert "".join(pieces) == raw and all(len(p.encode()) <= lattice.CHUNK_BYTES or lattice.WORD.fullmatch(p) for p in pieces)
        assert not any(lattice.WORD.match(b) and lattice.WORD.match(a[-1]) for a, b in zip(pieces, pieces[1:], strict=False))
