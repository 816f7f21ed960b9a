"""Tokens and tags of texts without kana or kanji, in closed form and inside the JVM.

For such texts the cheapest segmentation is known: inside each span between lexical tokens, a maximal run of ASCII letters
and digits is one noun, an identifier with inner underscores and a letter too, and everything else is a symbol, which is
dropped. Runs longer than the caps and texts with kana or kanji need the lattice (see `tokiwa.operators.lattice`), and long
texts with long sentences, URLs or hashtags go there too; `closed_form` says which rows those are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokiwa.functions.pretokens import KINDS, STRING_ARRAY, pieces, stretches
from tokiwa.functions.text import java_class, only

#: A word, or an identifier: underscores join only where a letter is in the run.
RUN = "[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*"
CHUNK_BYTES = 32_768
#: What a stretch with a lexical token that is a noun has: boundaries part no runs, so they needn't be looked for.
TELLING_NOUN = "[0-9０-９@#＃]|://|\\.[A-Za-z0-9]"
#: Longest runs of letters and of letters and digits that are surely one token.
MOST_LETTERS, MOST_MIXED = 20, 24


@dataclass(frozen=True)
class TagOptions:
    """Which morphemes become tags. pos_filter: 1 nouns and pronouns, 2 verbs, 4 adjectives, 8 adverbs; 0 all."""

    use_lemma: bool = True
    exclude_particles: bool = True
    exclude_auxiliaries: bool = True
    exclude_formal_nouns: bool = True
    exclude_low_info: bool = True
    remove_duplicates: bool = True
    min_tag_length: int = 2
    max_tags: int = 0
    pos_filter: int = 0
    exclude_basic: bool = False


def closed_form(text: Column) -> Column:
    """Whether the closed form holds for text."""
    odd = java_class("HIRAGANA", "KATAKANA", "KANJI") + "０-９Ａ-Ｚａ-ｚ"
    long = f"(?<![A-Za-z])[A-Za-z]{{{MOST_LETTERS + 1}}}|(?<![A-Za-z0-9_])[A-Za-z0-9_]{{{MOST_MIXED + 1}}}"  # only where a run begins
    # each costly pattern is tried only on texts that a cheap one lets through: all odd characters come from U+2F00 on
    some_odd = text.rlike(r"[\x{2F00}-\x{10FFFF}]") & text.rlike(f"[{odd}]")
    some_long = text.rlike(f"(?<![A-Za-z0-9_])[A-Za-z0-9_]{{{MOST_LETTERS + 1}}}") & text.rlike(long)
    parted = text.contains("_") & text.rlike("[0-9]_[0-9]")
    # other long texts go to the lattice, which cuts no token of theirs
    long_sentence = f"(?<![^\n!?。！？])[^\n!?。！？]{{{CHUNK_BYTES // 4}}}"  # tried where a sentence begins only
    cut_well = ~text.contains("://") & ~text.rlike("[#＃]") & ~text.rlike(long_sentence)
    return ((F.octet_length(text) <= CHUNK_BYTES) | cut_well) & ~some_odd & ~some_long & ~parted


def latin_surfaces(text: Column) -> Column:
    """The surfaces of the tokens of text, symbols removed, in order."""
    boundary = f"^{KINDS['boundary']}$"
    piece = lambda x: F.concat(F.regexp_extract_all(x["gap"], F.lit(RUN), 0), F.when(x["hit"].isNull() | x["hit"].rlike(boundary), F.expr(STRING_ARRAY)).otherwise(F.array(x["hit"])))
    searched = lambda s: F.flatten(F.transform(pieces(s), piece))
    return F.flatten(F.transform(stretches(text, "[ \n。]"), lambda s: F.when(s.rlike(TELLING_NOUN), searched(s)).otherwise(F.regexp_extract_all(s, F.lit(RUN), 0))))


# The bits of pos_filter by name, and the parts of speech that each lets through.
POS_BITS = {"noun": 1, "verb": 2, "adjective": 4, "adverb": 8}
BIT_POS = {1: ("NOUN", "PRON"), 2: ("VERB",), 4: ("ADJ",), 8: ("ADV",)}


def masked(bits: int) -> list[str]:
    """The parts of speech that a mask lets through."""
    return [p for bit, names in BIT_POS.items() if bits & bit for p in names]


def plain_tags(morphemes: list, options: TagOptions = TagOptions()) -> list[tuple[str, str]]:
    """As `tags`, of Python morphemes: for functions that hold them as such."""
    out: list[tuple[str, str]] = []
    seen: set[str] = set()
    left_out = {"CONJ", "SYMBOL"} | ({"PARTICLE"} if options.exclude_particles else set()) | ({"AUX"} if options.exclude_auxiliaries else set())
    for m in morphemes:
        if options.max_tags and len(out) >= options.max_tags:
            break
        tag = m.lemma if options.use_lemma and m.lemma else m.surface
        basic = options.exclude_basic and all("\u3040" <= c <= "\u309f" for c in m.lemma or m.surface)
        if m.pos in left_out or (options.exclude_formal_nouns and m.is_formal_noun) or (options.pos_filter and m.pos not in masked(options.pos_filter)) or basic:
            continue
        if len(tag) < options.min_tag_length or (options.remove_duplicates and tag in seen):
            continue
        seen.add(tag)
        out.append((tag, m.pos))
    return out


def tags(morphemes: Column, options: TagOptions = TagOptions()) -> Column:
    """Tags of an array of morphemes (surface, pos, lemma, is_formal_noun, is_low_info): array<struct<tag, pos>>.

    Filters, minimum length, first-wins de-duplication by tag and the limit apply in this order, inside the row.
    """
    shown = lambda m: F.when(F.lit(options.use_lemma) & (F.length(m["lemma"]) > 0), m["lemma"]).otherwise(m["surface"])

    def keep(m: Column) -> Column:
        ok = ~m["pos"].isin("CONJ", "SYMBOL")
        if options.exclude_particles:
            ok = ok & (m["pos"] != "PARTICLE")
        if options.exclude_auxiliaries:
            ok = ok & (m["pos"] != "AUX")
        if options.exclude_formal_nouns:
            ok = ok & ~F.coalesce(m["is_formal_noun"], F.lit(False))
        if options.exclude_low_info:
            ok = ok & ~F.coalesce(m["is_low_info"], F.lit(False))
        if options.pos_filter:
            ok = ok & m["pos"].isin(*masked(options.pos_filter))
        if options.exclude_basic:
            ok = ok & ~only(F.when(F.length(m["lemma"]) > 0, m["lemma"]).otherwise(m["surface"]), "HIRAGANA")
        return ok & (F.length(shown(m)) >= options.min_tag_length)

    found = F.transform(F.filter(morphemes, keep), lambda m: F.struct(shown(m).alias("tag"), m["pos"].alias("pos")))
    if options.remove_duplicates:
        # sorted by tag and place, the first of each run of one tag is its first; then back in order of place
        placed = F.array_sort(F.transform(found, lambda t, i: F.struct(t["tag"].alias("tag"), i.alias("place"), t["pos"].alias("pos"))))
        firsts = lambda ts: F.filter(ts, lambda t, i: (i == 0) | (F.get(ts, i - 1)["tag"] != t["tag"]))
        kept = F.array_sort(F.transform(F.transform(F.array(placed), firsts)[0], lambda t: F.struct(t["place"].alias("place"), t["tag"].alias("tag"), t["pos"].alias("pos"))))
        found = F.transform(kept, lambda t: F.struct(t["tag"].alias("tag"), t["pos"].alias("pos")))
    return F.slice(found, 1, options.max_tags) if options.max_tags else found


def tag_rows(docs: DataFrame, key: str = "doc_id", min_length: int = 2, max_tags: int = 0) -> DataFrame:
    """(key, tag, tag_rank) from rows (key, surfaces): each tag once a document, in order of its first place.

    All inside the row, so nothing is shuffled: array_distinct keeps the first of equals.
    """
    found = distinct_surfaces(F.col("surfaces"), min_length)
    rows = docs.select(key, F.posexplode_outer(F.slice(found, 1, max_tags) if max_tags else found).alias("_place", "tag"))
    return rows.where(F.col("_place").isNotNull()).select(key, "tag", (F.col("_place") + 1).alias("tag_rank"))


def distinct_surfaces(surfaces: Column, min_length: int = 2) -> Column:
    """The distinct ones of an array of surfaces, of at least `min_length` characters, in order of their first place."""
    return F.array_distinct(F.filter(surfaces, lambda s: F.length(s) >= min_length))
