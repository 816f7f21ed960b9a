"""Lexical extraction: URLs, addresses, dates, amounts and so on, as one pattern that the JVM runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokiwa.functions.text import ASCII_DIGITS, wide

DIGIT = "[0-9０-９]"
#: Digits of either width; a point or comma belongs to a number if an ASCII digit follows.
NUMBER = "(?:[0-9０-９]|[.,](?=[0-9]))++"
INTEGER = f"{DIGIT}++"
SIXTY = f"[0-5０-５]?{DIGIT}"
URL_CHARS = "A-Za-z0-9._~:/?#\\[\\]@!$&'()*+,;=%-"

#: What a URL may end in: points, commas, closing brackets and quotes are the sentence's.
URL_LAST = "A-Za-z0-9_~:/?#\\[\\]@!$&(*+;=%-"

#: In order of priority: the first that matches at a place takes it. Possessive where a longer run must not be given back.
KINDS: dict[str, str] = {
    "url": f"[Hh][Tt][Tt][Pp][Ss]?://[{URL_CHARS}]*[{URL_LAST}]",
    "email": "(?<![A-Za-z0-9._+@-])(?!\\.)[A-Za-z0-9._+-]++(?<!\\.)@(?![.-])(?=[A-Za-z0-9-]*\\.)[A-Za-z0-9.-]++(?<![.-])",
    "hashtag": "[#＃][A-Za-z0-9_゠-ヿ一-鿿＀-～]+",
    "mention": "@[A-Za-z0-9_]++(?!\\.[A-Za-z0-9.-])",
    "date": f"{DIGIT}{{1,4}}年(?:{DIGIT}{{1,2}}月(?:{DIGIT}{{1,2}}日)?)?",
    "time": f"(?<![0-9])(?:[01０１]?{DIGIT}|[2２][0-4０-４])時(?:{SIXTY}分(?:{SIXTY}秒)?)?",
    "currency": f"{NUMBER}[万億兆]?円",
    "storage": f"{NUMBER}[KkMmGgTt]?[Bb]",
    "percentage": f"{NUMBER}[%％]",
    "number": f"{INTEGER}(?:-{INTEGER})+",
    "version": f"[vV]?{INTEGER}(?:\\.{INTEGER})+",
    "asciiseq": "[A-Za-z0-9]++(?:\\.[A-Za-z0-9]++)+",
    "boundary": "[。！？!?\n・]",
}
PATTERN = "|".join(KINDS.values())


def of_kind(text: Column, kind: str) -> Column:
    """All that the one kind's pattern finds in text, without regard to the other kinds."""
    return F.regexp_extract_all(text, F.lit(KINDS[kind]), 0)


def kind_of(surface: Column) -> Column:
    """The kind of a whole match. Only what depends on context could differ, and no other kind has such surfaces."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(surface.rlike(f"^(?:{pattern})$") if kind != "boundary" else surface.rlike(f"^{pattern}"), kind).otherwise(out)
    return out


#: No match spans a blank or looks past one, and every match has one of these; so a text is taken apart at blanks, and
#: only stretches that have one are searched, which spares most of a text the many-sided pattern.
TELLING = "[0-9０-９@#＃。！？!?\n・]|://|\\.[A-Za-z0-9]"
STRING_ARRAY = "cast(array() as array<string>)"
PIECE = "struct<kind:string,surface:string,start:int,end:int,type:string>"


#: Marks around matches; a text that has them itself is parted by the pattern again, which compiles it for every call.
OPEN, CLOSE = "\ue001", "\ue002"


def stretches(text: Column, at: str = " ") -> Column:
    return F.split(text, at, -1)


def pieces(stretch: Column) -> Column:
    """A stretch as array<struct<gap, hit>>: what stands before each match, and the match; the last gap has no hit."""

    def paired(parts: Column) -> Column:
        gap = lambda i: F.when(i == 0, F.get(parts, i)).otherwise(F.substring_index(F.get(parts, i), CLOSE, -1))
        hit = lambda i: F.substring_index(F.get(parts, i + 1), CLOSE, 1)
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(gap(i).alias("gap"), hit(i).alias("hit")))

    marked = F.split(F.regexp_replace(stretch, f"({PATTERN})", f"{OPEN}$1{CLOSE}"), OPEN, -1)
    again = F.arrays_zip(F.split(stretch, PATTERN, -1).alias("gap"), F.regexp_extract_all(stretch, F.lit(PATTERN), 0).alias("hit"))
    return F.when(stretch.contains(OPEN) | stretch.contains(CLOSE), again).otherwise(F.transform(F.array(marked), paired)[0])


def hits(text: Column) -> Column:
    """The surfaces of all matches, in order."""
    return F.flatten(F.transform(stretches(text), lambda s: F.when(s.rlike(TELLING), F.regexp_extract_all(s, F.lit(PATTERN), 0)).otherwise(F.expr(STRING_ARRAY))))


def scanned(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of some numbers, what all before it come to by an associative operation whose neutral element is zero.

    Higher-order functions have no running sum, and an array that grows by one is copied each time. So sums run inside
    blocks of about the square root of all and over the blocks: n times its root steps, not its square.
    """
    step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    scan = lambda xs: F.aggregate(xs, F.struct(zero.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step)

    def blocked(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / size).cast("int") - 1, F.lit(0))), lambda k: scan(F.slice(xs, k * size + 1, size)))
        shifted = lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: b["at"]))["out"], lambda b, at: F.transform(b["out"], lambda x: combine(at, x))))
        return F.transform(F.array(blocks), shifted)[0]

    return F.transform(F.array(values), blocked)[0]


def running(lengths: Column) -> Column:
    """Where each of some lengths begins if they stand one after the other."""
    return scanned(lengths, F.lit(0), lambda a, b: a + b)


def parted(text: Column) -> Column:
    """text as array<struct<hit, gap, start>>: each match with what stands after it, the first without a match."""
    marked = F.array_join(F.transform(stretches(text), lambda s: F.when(s.rlike(TELLING), F.regexp_replace(s, f"({PATTERN})", f"{OPEN}$1{CLOSE}")).otherwise(s)), " ")
    cut = F.transform(F.split(marked, OPEN, -1), lambda p, i: F.struct(F.when(i > 0, F.substring_index(p, CLOSE, 1)).alias("hit"), F.when(i > 0, F.substring_index(p, CLOSE, -1)).otherwise(p).alias("gap")))
    again = lambda hits, gaps: F.transform(gaps, lambda g, i: F.struct(F.when(i > 0, F.get(hits, i - 1)).alias("hit"), g.alias("gap")))
    alone = F.transform(F.array(F.struct(F.regexp_extract_all(text, F.lit(PATTERN), 0).alias("h"), F.split(text, PATTERN, -1).alias("g"))), lambda x: again(x["h"], x["g"]))[0]
    parts = F.when(text.contains(OPEN) | text.contains(CLOSE), alone).otherwise(cut)
    length = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))
    placed = lambda ps: F.zip_with(ps, running(F.transform(ps, length)), lambda p, at: F.struct(p["hit"].alias("hit"), p["gap"].alias("gap"), at.alias("start")))
    return F.transform(F.array(parts), placed)[0]


def _token(p: Column) -> Column:
    kind = kind_of(p["hit"])
    shown = F.when(kind == "number", F.translate(p["hit"], wide(ASCII_DIGITS), ASCII_DIGITS)).otherwise(p["hit"])
    return F.struct(F.lit("token").alias("kind"), shown.alias("surface"), p["start"].alias("start"), (p["start"] + F.length(p["hit"])).alias("end"), kind.alias("type"))


def matches(text: Column) -> Column:
    """The matches as array<struct<kind, surface, start, end, type>> with kind `token`; offsets are code points.

    A number with hyphens has its digits narrowed, the only surface that differs from the source.
    """
    return F.transform(F.filter(parted(text), lambda p: p["hit"].isNotNull()), _token)


def pretokens(text: Column) -> Column:
    """array<struct<kind, surface, start, end, type>> that tiles text: the matches, and kind `span` for what is between."""

    def tiles(p: Column) -> Column:
        begin = p["start"] + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.struct(F.lit("span").alias("kind"), p["gap"].alias("surface"), begin.alias("start"), (begin + F.length(p["gap"])).alias("end"), F.lit(None).cast("string").alias("type"))
        none = F.expr(f"cast(array() as array<{PIECE}>)")
        return F.concat(F.when(p["hit"].isNotNull(), F.array(_token(p))).otherwise(none), F.when(F.length(p["gap"]) > 0, F.array(span)).otherwise(none))

    return F.flatten(F.transform(parted(text), tiles))
