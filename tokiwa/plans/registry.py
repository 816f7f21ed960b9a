"""The engine's own queries by name, each over whole tables of the driver's data, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokiwa.functions import pretokens, text
from tokiwa.operators import analyze, dictionary, index, rewrites, tokens
from tokiwa.plans import japanese, japanese_oracles
from tokiwa.plans.oracles import ORACLES
from tokiwa.streaming import counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rows that the dictionary queries are tried on.
DICTIONARY_ROWS = (
    (1, "the", "DET"), (1, "of", "PARTICLE"), (1, "and", "CONJ"), (1, "que", "CONJ"), (1, "der", "DET"), (2, "thing", "NOUN"), (2, "tion", "SUFFIX"), (2, "over", "ADV"),
    (2, "the", "DET"), (3, "thethe", "NOUN"), (3, "eau", "NOUN"), (3, "ción", "SUFFIX"), (3, "schen", "NOUN"), (3, "and", "NOUN"), (3, "idiot", "NOUN"), (3, "and", "NOUN"),
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def entries(spark: SparkSession) -> DataFrame:
    rows = [(layer, i, surface, pos, surface) for i, (layer, surface, pos) in enumerate(DICTIONARY_ROWS)]
    return spark.createDataFrame(rows, "layer int, entry_id int, surface string, pos string, lemma string")


# normalisation and character classes


@query
def normalize_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made full-width, folded back with letters lowered."""
    narrow = text.ASCII_DIGITS + text.ASCII_UPPER + text.ASCII_LOWER
    made = documents(spark, sf_dir).select("doc_id", F.translate("text", narrow, text.wide(narrow)).alias("text"))
    return made.select("doc_id", F.md5(text.normalize(F.col("text"), preserve_case=False)).alias("folded_md5"), text.needs_normalization(F.col("text")).alias("needs"))


@query
def char_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each class each document has."""
    classes = [*text.CLASS_RANGES, text.OTHER_CLASS]
    return documents(spark, sf_dir).select("doc_id", *[text.class_count(F.col("text"), c).alias(f"n_{c.lower()}") for c in classes])


@query
def char_type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of characters of one class: how many a document has, and the longest."""
    runs = documents(spark, sf_dir).select("doc_id", text.class_runs(F.col("text")).alias("runs"))
    return runs.select("doc_id", F.size("runs").alias("n_runs"), F.array_max(F.transform("runs", lambda r: F.length(r))).alias("longest"))


@query
def char_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the whole corpus by class, counted by the character."""
    chars = documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return chars.groupBy(text.class_column(F.col("c")).alias("char_class")).agg(F.sum("n").alias("n"))


@query
def utf8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points, bytes and validity of each text."""
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), text.valid_utf8(F.encode("text", "UTF-8")).alias("is_valid"))


# lexical extraction


def _kind_rows(kind: str, source: str, column: str, key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, F.explode(pretokens.of_kind(F.col(column), kind)).alias("surface")).groupBy(key, "surface").agg(F.count("*").alias("n"))

    run.__name__ = f"pretoken_{kind}"
    run.__doc__ = f"Every {kind} in {source}.{column}, with how often it comes in a row."
    return query(run)


for _kind, _source, _column, _key in (("url", "pages", "html", "page_id"), ("email", "documents", "text", "doc_id"), ("hashtag", "pages", "html", "page_id"), ("mention", "documents", "text", "doc_id"), ("storage", "documents", "text", "doc_id"), ("percentage", "documents", "text", "doc_id"), ("number", "documents", "text", "doc_id"), ("version", "documents", "text", "doc_id"), ("asciiseq", "documents", "text", "doc_id")):
    _kind_rows(_kind, _source, _column, _key)


@query
def pretoken_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and spans tile each text: their lengths add up to it, and they are in order."""
    found = documents(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), pretokens.pretokens(F.col("text")).alias("p"))
    sums = F.aggregate("p", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_chars", sums.alias("covered"), F.size(F.filter("p", lambda x: x["type"] == "boundary")).alias("n_boundaries"))


@query
def pretoken_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the sequential extractor over all documents, by type."""
    found = documents(spark, sf_dir).select(F.explode(pretokens.hits(F.col("text"))).alias("hit"))
    return found.groupBy(pretokens.kind_of(F.col("hit")).alias("type")).agg(F.count("*").alias("n"))


@query
def sentence_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", (F.size(F.split("text", pretokens.KINDS["boundary"], -1)) - 1).alias("n_boundaries"))


# tokens, tags, index


def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.surfaces(documents(spark, sf_dir))
    # outer, as Spark infers a filter from the other form, which would make the arrays twice
    return found.select("doc_id", F.posexplode_outer("surfaces").alias("token_index", "surface")).where(F.col("token_index").isNotNull())


@query
def latin_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents: the closed form, and the lattice for the rows that it doesn't cover."""
    return corpus_tokens(spark, sf_dir)


@query
def token_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 commonest tokens."""
    return corpus_tokens(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface").limit(100)


@query
def tags_noun_min2_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tag_rows(analyze.surfaces(documents(spark, sf_dir)))


@query
def tags_max_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten tags of each document, from the array of its morphemes, without a shuffle."""
    found = analyze.arrays(documents(spark, sf_dir))
    whole = lambda m: F.struct(m["surface"], m["pos"], m["surface"].alias("lemma"), F.lit(False).alias("is_formal_noun"), F.lit(False).alias("is_low_info"))  # noqa: E731  # without a dictionary
    made = found.select("doc_id", F.transform("morphemes", whole).alias("morphemes"))
    rows = made.select("doc_id", F.posexplode_outer(tokens.tags(F.col("morphemes"), tokens.TagOptions(max_tags=10, pos_filter=1))).alias("place", "t")).where(F.col("place").isNotNull())
    return rows.select("doc_id", "place", "t.tag", "t.pos")


@query
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag's documents by block of doc_ids: how many, and the digest of them in order."""
    found = index.inverted_index(index.postings(corpus_tokens(spark, sf_dir)))
    return found.select("tag", "block", "n", F.md5(F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",")).alias("doc_ids_md5"))


@query
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(corpus_tokens(spark, sf_dir))


@query
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark text as a query; ties by doc_id."""
    asked = analyze.morphemes(table(spark, sf_dir, "benchmark"), key="item_id").where(F.length("surface") >= 2).select(F.col("item_id").alias("query_id"), F.col("surface").alias("tag"))
    docs = analyze.surfaces(documents(spark, sf_dir)).select("doc_id", tokens.distinct_surfaces(F.col("surfaces")).alias("tags"))
    return index.search(asked, docs, top=10)


@query
def filters_bytes_and_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of at least four bytes, by length in characters."""
    return corpus_tokens(spark, sf_dir).where(F.octet_length("surface") >= 4).groupBy(F.length("surface").alias("n_chars")).agg(F.count("*").alias("n"))


# rewrites


def morpheme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes of conversations, symbols kept: letters and digits apart are nouns that compounds join."""
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), 0).alias("parts"))
    rows = found.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_key"), F.posexplode("parts").alias("token_index", "surface"))
    return rows.withColumn("pos", F.when(F.col("surface").rlike("^[A-Za-z0-9]"), "NOUN").otherwise("SYMBOL")).withColumn("lemma", F.lower("surface")).withColumn("is_formal_noun", F.length("surface") == 1)


@query
def compound_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring nouns joined, symbols then dropped."""
    return rewrites.visible(rewrites.compounds(morpheme_rows(spark, sf_dir), "doc_key"))


# dictionaries and conjugation


@query
def dict_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each dictionary entry stands anywhere in the benchmark texts."""
    found = dictionary.prefix_matches(table(spark, sf_dir, "benchmark"), entries(spark), 6, key="item_id")
    return found.groupBy("surface", "pos", "layer").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


@query
def dict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.statistics(entries(spark))


@query
def dict_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.duplicates(entries(spark))


@query
def dict_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that match a wildcard pattern."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("surface"), F.lit("NOUN").alias("pos"), F.lit(1).alias("layer"))
    return dictionary.listed(parts, pos="NOUN", pattern="*a?e*").select("surface", "pos")


@query
def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every layer that come as tokens in the documents."""
    return dictionary.lookup(entries(spark), corpus_tokens(spark, sf_dir))


@query
def dict_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = entries(spark)
    new = spark.createDataFrame([(4, 100, "the", "DET", "the"), (4, 101, "the", "NOUN", "the"), (4, 102, "leaux", "NOUN", "leaux")], old.schema)
    return dictionary.imported(old, new)


@query
def dict_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens by whether a compiled dictionary would leave them out as trivial."""
    seen = corpus_tokens(spark, sf_dir).select("surface").distinct()
    return seen.groupBy(dictionary.trivial(F.col("surface")).alias("is_trivial")).agg(F.count("*").alias("n"))


# the analyzer: every row has a place in the closed form or the lattice

@query
def lattice_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice over the benchmark texts; its SQL is that of the closed form."""
    run = analyze.analyzer()
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(run("text")).alias("token_index", "m"))
    return rows.select("item_id", "token_index", "m.surface")


@query
def all_morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes of all documents: the closed form, and the lattice for the rows that it doesn't cover."""
    return analyze.morphemes(documents(spark, sf_dir))


@query
def windowed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types counted as tokens by ten-minute windows, the batch form of the streaming query."""
    return counts.token_counts(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("text")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_rank(spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES | japanese.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | japanese_oracles.ORACLES
