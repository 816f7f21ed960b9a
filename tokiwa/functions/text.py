"""Character classes and width/kana normalisation as Column expressions, all inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of the character classes, in order of precedence.
CLASS_RANGES = {
    "HIRAGANA": [(0x3040, 0x309F)],
    "KATAKANA": [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "KANJI": [(0x3005, 0x3005), (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0xF900, 0xFAFF), (0x2F00, 0x2FDF)],
    "ALPHABET": [(0x41, 0x5A), (0x61, 0x7A), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "DIGIT": [(0x30, 0x39), (0xFF10, 0xFF19)],
    "SYMBOL": [(0x3000, 0x3004), (0x3006, 0x303F), (0xFF00, 0xFF0F), (0x20, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)],
    "EMOJI": [(0x1F1E6, 0x1F1FF), (0x1F300, 0x1F64F), (0x1F680, 0x1FAFF), (0x1FB00, 0x1FBFF), (0x2300, 0x23FF), (0x25AA, 0x25AB), (0x25B6, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B50, 0x2B55), (0x200D, 0x200D), (0xFE0E, 0xFE0F), (0x20E3, 0x20E3), (0xE0020, 0xE007F)],
}
OTHER_CLASS = "UNKNOWN"

# Half-width katakana U+FF66 to U+FF9D and their full-width forms.
HALF_KANA = "".join(map(chr, range(0xFF66, 0xFF9E)))
FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
# Kana that take a voicing mark, and what they become.
VOICED = dict(zip("カキクケコサシスセソタチツテトハヒフヘホウワ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴヷ", strict=True))
SEMI_VOICED = dict(zip("ハヒフヘホ", "パピプペポ", strict=True))
VU_ROWS = (("ヴ", "ァィゥェォ", "バビブベボ"), ("ゔ", "ぁぃぅぇぉ", "ばびぶべぼ"))
VOICE, SEMI_VOICE = "ﾞ", "ﾟ"

ASCII_DIGITS, ASCII_UPPER, ASCII_LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def wide(narrow: str) -> str:
    """The full-width forms of ASCII characters."""
    return "".join(chr(ord(c) + 0xFEE0) for c in narrow)


def java_class(*names: str) -> str:
    """The body of a Java character class of the named classes."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for name in names for a, b in CLASS_RANGES[name])


def char_class(c: str) -> str:
    """The class of one character."""
    for name, ranges in CLASS_RANGES.items():
        if any(a <= ord(c) <= b for a, b in ranges):
            return name
    return OTHER_CLASS


def class_column(c: Column) -> Column:
    """The class of a one-character column; null for null."""
    out = F.lit(OTHER_CLASS)
    for name in reversed(CLASS_RANGES):
        out = F.when(c.rlike(f"^[{java_class(name)}]"), name).otherwise(out)
    return F.when(c.isNotNull(), out)


def class_count(text: Column, name: str) -> Column:
    """How many characters of text are of the named class.

    ASCII is counted by what one `translate` leaves; patterns see only what isn't ASCII.
    """
    rest = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    if name == OTHER_CLASS:
        known = "".join(chr(c) for c in range(128) if char_class(chr(c)) != OTHER_CLASS)
        return F.length(F.translate(text, known, "")) - F.length(rest) + F.length(F.regexp_replace(rest, f"[{java_class(*CLASS_RANGES)}]+", ""))
    own = "".join(chr(c) for c in range(128) if char_class(chr(c)) == name)
    ascii_count = F.length(text) - F.length(F.translate(text, own, "")) if own else F.lit(0)
    return ascii_count + F.length(rest) - F.length(F.regexp_replace(rest, f"[{java_class(name)}]+", ""))


def class_runs(text: Column) -> Column:
    """The maximal runs of characters of one class, in order."""
    pattern = "|".join(f"[{java_class(name)}]+" for name in CLASS_RANGES) + f"|[^{java_class(*CLASS_RANGES)}]+"
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def fold_width(text: Column, preserve_case: bool = True) -> Column:
    """Full-width digits and letters to ASCII; with preserve_case off, A-Z to lower case too (and no other letters)."""
    upper = ASCII_UPPER if preserve_case else ASCII_LOWER
    source, target = wide(ASCII_DIGITS + ASCII_UPPER + ASCII_LOWER), ASCII_DIGITS + upper + ASCII_LOWER
    return F.translate(text, source if preserve_case else source + ASCII_UPPER, target if preserve_case else target + ASCII_LOWER)


def normalize(text: Column, preserve_vu: bool = True, preserve_case: bool = True) -> Column:
    """Width, half-width kana, voicing marks and, unless preserve_vu, the vu row.

    Voicing marks are joined after the kana are widened, so a mark joins any base before it. A vu made by a mark is kept
    (it was never looked at again); a private character stands for it meanwhile.
    """
    kept = "\ue000"
    out = F.translate(fold_width(text, preserve_case), HALF_KANA, FULL_KANA)
    joined = out
    for base, voiced in VOICED.items():
        joined = F.replace(joined, F.lit(base + VOICE), F.lit(kept if voiced == "ヴ" and not preserve_vu else voiced))
    for base, voiced in SEMI_VOICED.items():
        joined = F.replace(joined, F.lit(base + SEMI_VOICE), F.lit(voiced))
    out = F.when(out.rlike(f"[{VOICE}{SEMI_VOICE}]"), joined).otherwise(out)
    if preserve_vu:
        return out
    folded = out
    for vu, small, row in VU_ROWS:
        for s, r in zip(small, row, strict=True):
            folded = F.replace(folded, F.lit(vu + s), F.lit(r))
        folded = F.replace(folded, F.lit(vu), F.lit(row[2]))
    return F.when(out.rlike(f"[ヴゔ{kept}]"), F.replace(folded, F.lit(kept), F.lit("ヴ"))).otherwise(out)


def needs_normalization(text: Column) -> Column:
    """Whether some character folds; any A-Z or vu counts."""
    return text.rlike(f"[A-Z{wide('0')}-{wide('9')}{wide('A')}-{wide('Z')}{wide('a')}-{wide('z')}ｦ-{SEMI_VOICE}ヴゔ]")


def only(text: Column, *names: str) -> Column:
    """Whether text is not empty and all its characters are of the named classes."""
    return text.rlike(f"^[{java_class(*names)}]+$")


def contains(text: Column, *names: str) -> Column:
    return text.rlike(f"[{java_class(*names)}]")


def pure_hiragana(text: Column) -> Column:
    return only(text, "HIRAGANA")


def valid_utf8(data: Column) -> Column:
    """Whether binary data is valid UTF-8."""
    return F.is_valid_utf8(data.cast("string"))
