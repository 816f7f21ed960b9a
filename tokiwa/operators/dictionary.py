"""Dictionaries as DataFrames (layer, entry_id, surface, pos, lemma): lookup, statistics, search, merging, compiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokiwa.functions.text import CLASS_RANGES, java_class
from tokiwa.grammar.categories import DEFAULT
from tokiwa.operators.conjugation import detect_type, entry_forms


def prefix_matches(texts: DataFrame, entries: DataFrame, longest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every entry that stands anywhere in text: (key, start, surface, pos, layer). All entries of a surface match.

    Logically "the text from here on starts with the entry". Physically an equality join: every substring of up to
    `longest` characters at every place meets the entries by surface, so no pair is tried that doesn't match.
    """
    # n-grams come from an array of characters, as a substring of a long text would be sought from its start each time
    chars = texts.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "").alias("_c"))
    grams = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct((i - 1).alias("start"), F.when(i + n - 1 <= F.size(c), F.array_join(F.slice(c, i, n), "")).alias("surface")))))
    parts = chars.select(key, F.inline(F.filter(grams(F.col("_c")), lambda g: F.length(g["surface"]) > 0)))
    return parts.join(entries.select("surface", "pos", "layer"), "surface").select(key, "start", "surface", "pos", "layer")


def lookup(entries: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Entries of every layer whose surface is wanted."""
    return entries.join(surfaces.select("surface").distinct(), "surface", "left_semi")


def statistics(entries: DataFrame) -> DataFrame:
    """(layer, pos, n)."""
    return entries.groupBy("layer", "pos").agg(F.count("*").alias("n"))


def duplicates(entries: DataFrame) -> DataFrame:
    """(surface, pos, n) of what comes more than once."""
    return entries.groupBy("surface", "pos").agg(F.count("*").alias("n")).where("n > 1")


def wildcard(pattern: str) -> str:
    """An anchored pattern of `*` (any characters) and `?` (any one)."""
    escaped = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c.isascii() else c for c in pattern)
    return f"^{escaped}$"


def listed(entries: DataFrame, pos: str | None = None, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries of a part of speech, or that match a wildcard pattern, in order of surface; limit is for reports."""
    out = entries.where(F.col("pos") == pos) if pos else entries
    out = out.where(F.col("surface").rlike(wildcard(pattern))) if pattern else out
    return out.orderBy("surface", "pos", "layer").limit(limit) if limit else out


def layered(*layers: DataFrame) -> DataFrame:
    """Layers one after the other, as they are; nothing is merged."""
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more)
    return out


def imported(entries: DataFrame, more: DataFrame) -> DataFrame:
    """entries with those of more whose surface and part of speech are new."""
    return entries.unionByName(more.join(entries.select("surface", "pos").distinct(), ["surface", "pos"], "left_anti").select(*entries.columns))


def trivial(surface: Column) -> Column:
    """At least three characters, without a blank, and of at most one class, symbols and unknown ones aside."""
    plain = [n for n in CLASS_RANGES if n != "SYMBOL"]
    bare = F.regexp_replace(surface, f"[^{java_class(*plain)}]", "")
    one = bare == ""
    for name in plain:
        one = one | bare.rlike(f"^[{java_class(name)}]+$")
    return (F.length(surface) >= 3) & ~surface.contains(" ") & one


def problems(rows: DataFrame) -> DataFrame:
    """(line, problem) of rows that can't be compiled: no surface, or the surface and part of speech of an earlier line."""
    empty = rows.where("surface is null or surface = ''").select("line", F.lit("no surface").alias("problem"))
    again = rows.withColumn("_r", F.row_number().over(Window.partitionBy("surface", "pos").orderBy("line"))).where("_r > 1 and surface <> ''").select("line", F.concat(F.lit("again: "), F.col("surface")).alias("problem"))
    return empty.union(again)


def compiled(rows: DataFrame, drop_trivial: bool = False) -> DataFrame:
    """(surface, pos, extended_pos, lemma) from dictionary rows (line, surface, pos, conj_type), one row a surface.

    Verbs and adjectives in い become the forms that a dictionary keeps; a verb without a type has the one that its ending
    suggests. Plain rows come first, then forms by line; the first of a surface stays, unless a later form has its part of
    speech and a lemma of more bytes. Ordering columns decide this, so it doesn't depend on how rows are dealt.
    """
    rows = rows.where(~trivial(F.col("surface"))) if drop_trivial else rows
    given = F.coalesce(F.col("conj_type"), F.lit(""))
    conjugates = (F.col("pos") == "VERB") | ((F.col("pos") == "ADJ") & (given == "I_ADJ"))
    na = (F.col("pos") == "ADJ") & ((given == "NA_ADJ") | ~F.col("surface").endswith("い"))
    name = F.when(na, "ADJ_NA").when(given == "FAMILY", "NOUN_姓").when(given == "GIVEN", "NOUN_名").when(given == "INTERJECTION", "INTJ")
    for pos, category in DEFAULT.items():
        name = name.when(F.col("pos") == pos, category)
    plain = rows.where(~conjugates).select(F.lit(0).alias("turn"), "line", F.lit(0).alias("form_id"), "surface", "pos", name.otherwise("OTHER").alias("extended_pos"), F.col("surface").alias("lemma"))
    typed = rows.where(conjugates).withColumn("conj_type", F.when(F.col("surface") == "いい", "NONE").when(given.isin("", "NONE"), detect_type(F.col("surface"))).otherwise(given))
    forms = entry_forms(typed).select(F.lit(1).alias("turn"), "line", "form_id", F.col("form").alias("surface"), "pos", F.coalesce("extended_pos", F.when(F.col("pos") == "VERB", "VERB_終止").otherwise("ADJ_終止")).alias("extended_pos"), F.col("surface").alias("lemma"))
    by_surface = Window.partitionBy("surface").orderBy("turn", "line", "form_id")
    seen = plain.union(forms).withColumn("_n", F.row_number().over(by_surface)).withColumn("_pos", F.first("pos").over(by_surface))
    best = Window.partitionBy("surface").orderBy(F.desc(F.octet_length("lemma")), "turn", "line", "form_id")
    return seen.where("_n = 1 or (turn = 1 and pos = _pos)").withColumn("_r", F.row_number().over(best)).where("_r = 1").select("surface", "pos", "extended_pos", "lemma")


def compiled_files(*files: DataFrame, drop_trivial: bool = False) -> DataFrame:
    """Several dictionaries compiled as one, their lines after each other; an empty or repeated row in any fails the whole."""
    rows = layered(*[f.select((F.col("line").cast("long") + F.lit(i << 40)).alias("line"), "surface", "pos", "conj_type") for i, f in enumerate(files)])
    bad = problems(rows).orderBy("line").first()
    if bad:
        raise ValueError(f"line {bad['line'] & ((1 << 40) - 1)} of dictionary {(bad['line'] >> 40) + 1}: {bad['problem']}")
    return compiled(rows, drop_trivial)


def decompiled(entries: DataFrame) -> DataFrame:
    """Compiled entries as dictionary rows again: each lemma once for each part of speech, conjugating ones with their type."""
    rows = entries.select(F.col("lemma").alias("surface"), "pos").distinct()
    kind = detect_type(F.col("surface"))
    return rows.select("surface", "pos", F.when(F.col("pos") == "VERB", kind).when((F.col("pos") == "ADJ") & (kind == "I_ADJ"), "I_ADJ").otherwise("").alias("conj_type"))


def added(entries: DataFrame, more: DataFrame) -> DataFrame:
    """entries with more at their end, as they are."""
    return entries.unionByName(more, allowMissingColumns=True)


def removed(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries without those of a surface and, where `gone` has one, part of speech."""
    keyed = gone.select("surface", F.col("pos").alias("_pos") if "pos" in gone.columns else F.lit(None).cast("string").alias("_pos")).distinct().withColumnRenamed("surface", "_surface")
    return entries.join(keyed, (F.col("surface") == F.col("_surface")) & (F.col("_pos").isNull() | (F.col("pos") == F.col("_pos"))), "left_anti")


def updated(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """entries whose part of speech is that of `changes` (surface, pos) where it has their surface."""
    new = changes.groupBy("surface").agg(F.max("pos").alias("_pos"))
    return entries.join(new, "surface", "left").withColumn("pos", F.coalesce("_pos", "pos")).drop("_pos").select(*entries.columns)


def existing(surfaces: DataFrame, entries: DataFrame, pos: str | None = None, without: str | None = None) -> DataFrame:
    """surfaces with has_entry: whether the dictionary has them, as `pos` or not as `without` if these are given."""
    wanted = entries.where(F.col("pos") == pos) if pos else entries.where(F.col("pos") != without) if without else entries
    known = wanted.select("surface").distinct().withColumn("_has", F.lit(True))
    return surfaces.join(known, "surface", "left").withColumn("has_entry", F.coalesce("_has", F.lit(False))).drop("_has")
