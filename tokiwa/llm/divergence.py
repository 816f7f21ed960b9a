"""Quality rules with DataFrame functions only: line, word and symbol counts, and distance from language references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.llm.common import WORD, cut

# Common function words of English, French, German and Spanish.
COMMON_WORDS = (
    "a an and are as at be by for from has have in is it not of on or that the they this to was were which with you "
    "au aux avec ce dans des du elle est et il la le les ne par pas plus pour qu que qui sa se son sur un une "
    "auch auf aus bei das dass dem den der die ein eine einen es für ich im ist mit nicht sich sie und von werden wie zu "
    "al como con de del el ella en entre era los las lo más muy no para pero por si su sus también una unos y"
).split()

#: Character classes, each counted in what the ones before it leave; the rest is the last class.
CHAR_CLASSES = (
    ("lower", "[a-z]+"),
    ("blank", r"[\x20\x09-\x0D]+"),
    ("upper", "[A-Z]+"),
    ("letter", r"[\p{L}\p{M}]+"),
    ("digit", "[0-9]+"),
    ("stop", r"[.,;:!?'\"()-]+"),
    ("symbol", r"[#*$%&|<>@^~_=+/\\{}\[\]`]+"),
)


@dataclass(frozen=True)
class Limits:
    """Texts under least_words fail, and those under least_chars are not judged by character classes.

    From least_judged_words on the limit of the word distance is flat; shorter texts have more sampling noise, so below it
    the limit rises by word_noise * (1 / sqrt(n_words) - 1 / sqrt(least_judged_words)).
    """

    least_words: int = 50
    least_chars: int = 200
    least_judged_words: int = 120
    most_char_distance: float = 0.25
    most_word_distance: float = 0.28
    word_noise: float = 1.2


def covered_by_repeats(words: Column) -> Column:
    """How many words stand in a window of three words that comes twice or more in words."""
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def repeats(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))[0]
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]

    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(0))[0]


def char_counts(text: Column) -> Column:
    """Code points of text in each of CHAR_CLASSES, and of none, as an array."""

    def peel(rest: Column, classes: tuple) -> Column:
        if not classes:
            return F.array(F.length(rest))
        less = F.regexp_replace(rest, classes[0][1], "")
        return F.transform(F.array(less), lambda x: F.concat(F.array(F.length(rest) - F.length(x)), peel(x, classes[1:])))[0]

    return peel(text, CHAR_CLASSES)


def common_counts(words: Column) -> Column:
    """The common words in words with their counts, as an array of struct(word, n)."""
    common = F.transform(F.filter(words, lambda w: F.lower(w).isin(COMMON_WORDS)), lambda w: F.lower(w))
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" "))
    count = lambda j, w: ((F.length(j) - F.length(F.replace(j, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("int")
    each = lambda c, j: F.transform(F.array_distinct(c), lambda w: F.struct(w.alias("word"), count(j, w).alias("n")))
    return F.transform(F.array(common), lambda c: F.transform(F.array(joined(c)), lambda j: each(c, j))[0])[0]


def features(docs: DataFrame) -> DataFrame:
    """The columns that the rules judge by, once per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.col("lang"), text.alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0)).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    return df.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered_by_repeats(F.col("words")).cast("long").alias("n_repeat_words"),
        char_counts(F.col("text")).alias("chars"),
        common_counts(F.col("words")).alias("common"),
    )


def references(rows: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_words): shares of character classes and of common words over all rows of a language.

    Both are sums over all rows of bounded histograms, combined before the shuffle, so one row a language results.
    """
    k = len(CHAR_CLASSES) + 1
    sums = [F.sum(F.get("chars", i)).alias(f"c{i}") for i in range(k)]
    by_chars = rows.groupBy("lang").agg(*sums, F.sum("n_words").alias("all_words"))
    total = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    by_chars = by_chars.select("lang", "all_words", F.array(*[F.coalesce(F.try_divide(F.col(f"c{i}"), total), F.lit(0.0)) for i in range(k)]).alias("ref_chars"))
    by_word = rows.select("lang", F.inline("common")).groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumnRenamed("lang", "_lang")
    joined = by_chars.join(by_word, by_chars["lang"].eqNullSafe(by_word["_lang"]), "left")
    share = F.struct(F.col("word"), (F.col("n") / F.col("all_words")).alias("share"))
    words = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), share))))
    return joined.groupBy(F.col("lang").alias("ref_lang"), "ref_chars").agg(words.alias("ref_words"))


def js_term(p: Column, q: Column) -> Column:
    """One bin's part of twice the Jensen-Shannon divergence in bits."""
    middle = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))
    return part(p) + part(q)


def distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)))


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Judge every row of docs (doc_id, text, lang; other columns are ignored).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance and
    word_distance: the Jensen-Shannon distances (0 to 1) of the row's character classes and common words (with one bin
    for all other words) from those of all rows of its language, null lang being a language of its own. kept: base rules
    passed, and each distance within its limit, which for words rises as a text gets shorter. A null or empty text has no
    words and fails the base rules; its distances are null. A text of any length is judged whole, from its row's arrays.
    Repeated rows and null doc_ids are judged like others; columns of docs with clashing names don't matter, as only three
    are read; an empty table gives an empty result.
    """
    rows = cut(features(docs), "quality-features")
    refs = cut(references(rows), "quality-references")  # a row for each language; Spark broadcasts it while it is small
    df = rows.join(refs, rows["lang"].eqNullSafe(refs["ref_lang"]))
    n_chars = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    by_char = F.aggregate(F.zip_with("chars", "ref_chars", lambda c, q: js_term(c / F.col("_n"), q)), F.lit(0.0), lambda a, x: a + x)
    shares = F.transform("common", lambda x: F.struct((x["n"] / F.col("n_words")).alias("p"), F.coalesce(F.try_element_at("ref_words", x["word"]), F.lit(0.0)).alias("q")))
    add = lambda acc, x: F.struct((acc["p"] + x["p"]).alias("p"), (acc["q"] + x["q"]).alias("q"), (acc["t"] + js_term(x["p"], x["q"])).alias("t"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("t"))
    all_q = F.aggregate(F.map_values("ref_words"), F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_n", n_chars).withColumn("_sum", F.aggregate(shares, zero, add)).withColumn("_q", all_q)
    # words that the row lacks add their share in the reference; all other words are one bin
    by_word = F.col("_sum.t") + (F.col("_q") - F.col("_sum.q")) + js_term(F.greatest(1 - F.col("_sum.p"), F.lit(0.0)), F.greatest(1 - F.col("_q"), F.lit(0.0)))
    df = df.withColumn("char_distance", F.when(F.col("_n") > 0, distance(by_char))).withColumn("word_distance", F.when(F.col("n_words") > 0, distance(by_word)))
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars_ok = (F.col("_n") < limits.least_chars) | (F.round("char_distance", 9) <= limits.most_char_distance)
    noise = F.lit(limits.word_noise) * F.greatest(F.pow(F.col("n_words"), F.lit(-0.5)) - max(limits.least_judged_words, 1) ** -0.5, F.lit(0.0))
    words_ok = F.round("word_distance", 9) <= F.lit(limits.most_word_distance) + noise
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & chars_ok & words_ok).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
