"""Conjugation tables and what follows from them: types, stems, forms, entries of a dictionary, endings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Row:
    """A row of five-step verbs: its endings, the sound change before た and て, and whether these are voiced after it."""

    kind: str
    u: str
    a: str
    i: str
    e: str
    o: str
    onbin: str
    voiced: bool

    def step(self, name: str) -> str:
        return getattr(self, name)

    @property
    def ta(self) -> str:
        return "だ" if self.voiced else "た"

    @property
    def te(self) -> str:
        return "で" if self.voiced else "て"


# The rows of the five-step verbs.
GODAN = {
    r[0]: Row(*r)
    for r in (
        ("GODAN_KA", "く", "か", "き", "け", "こ", "い", False),
        ("GODAN_GA", "ぐ", "が", "ぎ", "げ", "ご", "い", True),
        ("GODAN_SA", "す", "さ", "し", "せ", "そ", "", False),
        ("GODAN_TA", "つ", "た", "ち", "て", "と", "っ", False),
        ("GODAN_NA", "ぬ", "な", "に", "ね", "の", "ん", True),
        ("GODAN_BA", "ぶ", "ば", "び", "べ", "ぼ", "ん", True),
        ("GODAN_MA", "む", "ま", "み", "め", "も", "ん", True),
        ("GODAN_RA", "る", "ら", "り", "れ", "ろ", "っ", False),
        ("GODAN_WA", "う", "わ", "い", "え", "お", "っ", False),
    )
}
BY_ENDING = {row.u: row for row in GODAN.values()}
# Names of the types in English and Japanese.
TYPE_NAMES = {
    "ICHIDAN": ("ichidan", "一段"), "GODAN_KA": ("godan-ka", "五段・カ行"), "GODAN_GA": ("godan-ga", "五段・ガ行"), "GODAN_SA": ("godan-sa", "五段・サ行"), "GODAN_TA": ("godan-ta", "五段・タ行"), "GODAN_NA": ("godan-na", "五段・ナ行"),
    "GODAN_BA": ("godan-ba", "五段・バ行"), "GODAN_MA": ("godan-ma", "五段・マ行"), "GODAN_RA": ("godan-ra", "五段・ラ行"), "GODAN_WA": ("godan-wa", "五段・ワ行"), "SURU": ("suru", "サ変"), "KURU": ("kuru", "カ変"), "I_ADJ": ("i-adj", "形容詞"), "UNKNOWN": ("", ""),
}
# Names of the forms in English and Japanese.
FORM_NAMES = {
    "BASE": ("base", "終止形"), "MIZENKEI": ("mizenkei", "未然形"), "RENYOKEI": ("renyokei", "連用形"), "ONBINKEI": ("onbinkei", "連用形"), "KATEIKEI": ("kateikei", "仮定形"), "MEIREIKEI": ("meireikei", "命令形"), "ISHIKEI": ("ishikei", "意志形"),
}
# Kana of the い and え rows that mark a one-step verb before る.
ICHIDAN_BEFORE_RU = "べめせてけれえねげぜでへみきしちにりいひびぎじ"
# What follows the stem in the forms of each type. Five-step verbs: the step, then what follows it; T and D
# stand for た and て, voiced where the row is.
GODAN_FORMS = (
    ("u", ""), ("a", "ない"), ("a", "なかった"), ("a", "れる"), ("a", "せる"), ("i", "ます"), ("i", "ました"), ("i", "ません"), ("e", "ば"), ("o", ""), ("e", ""),
    ("onbin", "T"), ("onbin", "D"), ("onbin", "Tら"), ("onbin", "Dいる"), ("onbin", "Dいた"), ("onbin", "Dいます"), ("onbin", "Dいました"), ("onbin", "Dおく"), ("onbin", "Dある"), ("onbin", "Dしまう"), ("e", "る"),
)
GODAN_FORMS_WITHOUT_CHANGE = (("i", "T"), ("i", "D"), ("i", "Dいる"), ("i", "Dいます"))
OTHER_FORMS = {
    "ICHIDAN": "る ない なかった ます ました ません た て ている ていた ています ていました ておく てある れば よ ろ られる させる",
    "SURU": "する しない しなかった します しました しません した して している していた しています していました すれば しよ しろ せよ される させる できる",
    "KURU": "る こない こなかった きます きました きません きた きて きている きています くれば こよ こい こられる こさせる",
    "I_ADJ": "い くない くなかった かった くて ければ く さ そう",
}
# Forms that a dictionary keeps as entries, with their categories; auxiliaries after them are words apart.
GODAN_ENTRIES = (("u", "", "VERB_終止"), ("i", "", "VERB_連用"), ("a", "", "VERB_未然"), ("onbin", "", "VERB_音便"), ("a", "ん", "VERB_未然"), ("a", "ぬ", "VERB_未然"), ("e", "", "VERB_仮定"), ("o", "", "VERB_未然"), ("e", "", "VERB_命令"), ("e", "る", "VERB_終止"))
WITHOUT_IMPERATIVE = ("GODAN_KA", "GODAN_GA")
OTHER_ENTRIES = {
    "ICHIDAN": (("る", "VERB_終止"), ("", "VERB_連用"), ("ん", "VERB_未然"), ("れ", "VERB_仮定"), ("よ", "VERB_未然"), ("ろ", "VERB_命令")),
    "SURU": (("する", "VERB_終止"), ("すれば", "VERB_仮定"), ("しろ", "VERB_命令"), ("せよ", "VERB_命令"), ("しよ", "VERB_未然"), ("せん", "VERB_未然"), ("したら", "VERB_たら形")),
    "KURU": (("くる", "VERB_終止"), ("き", "VERB_連用"), ("こ", "VERB_未然"), ("くれば", "VERB_仮定"), ("こよ", "VERB_未然"), ("こい", "VERB_命令"), ("こられる", "VERB_終止"), ("これる", "VERB_終止")),
    "I_ADJ": (("い", "ADJ_終止"), ("かっ", "ADJ_かっ"), ("くない", "ADJ_終止"), ("くなかっ", "ADJ_終止"), ("くて", "ADJ_連用"), ("ければ", "ADJ_け形"), ("く", "ADJ_連用"), ("かったら", "ADJ_け形"), ("そう", "ADJ_語幹")),
}
# The stems that take auxiliaries, as (form, what follows the stem).
STEMS = {"ICHIDAN": (("BASE", "る"), ("MIZENKEI", ""), ("RENYOKEI", ""), ("ONBINKEI", "")), "SURU": (("BASE", "する"), ("RENYOKEI", "し"), ("ONBINKEI", "し"), ("MIZENKEI", "さ")), "KURU": (("BASE", "る"), ("RENYOKEI", "き"), ("ONBINKEI", "き"), ("MIZENKEI", "こ"))}
# Endings by the form that they make, for what isn't five-step: (ending, base ending, type, form).
OTHER_ENDINGS = (
    ("", "る", "ICHIDAN", "ONBINKEI"), ("", "る", "ICHIDAN", "RENYOKEI"), ("", "る", "ICHIDAN", "MIZENKEI"), ("れ", "る", "ICHIDAN", "KATEIKEI"), ("ろ", "る", "ICHIDAN", "MEIREIKEI"), ("よ", "る", "ICHIDAN", "ISHIKEI"), ("る", "る", "ICHIDAN", "BASE"),
    ("し", "する", "SURU", "ONBINKEI"), ("し", "する", "SURU", "RENYOKEI"), ("し", "する", "SURU", "MIZENKEI"), ("さ", "する", "SURU", "MIZENKEI"), ("", "する", "SURU", "MIZENKEI"), ("", "する", "SURU", "ONBINKEI"), ("すれ", "する", "SURU", "KATEIKEI"),
    ("しろ", "する", "SURU", "MEIREIKEI"), ("せよ", "する", "SURU", "MEIREIKEI"), ("しよ", "する", "SURU", "ISHIKEI"), ("する", "する", "SURU", "BASE"), ("す", "する", "SURU", "BASE"),
    ("き", "くる", "KURU", "ONBINKEI"), ("き", "くる", "KURU", "RENYOKEI"), ("こ", "くる", "KURU", "MIZENKEI"), ("くれ", "くる", "KURU", "KATEIKEI"), ("こい", "くる", "KURU", "MEIREIKEI"), ("こよ", "くる", "KURU", "ISHIKEI"), ("くる", "くる", "KURU", "BASE"),
    ("", "い", "I_ADJ", "STEM"),
)
# What may follow what, by form of a verb or kind of an auxiliary, with the cost; all else can't.
CONNECTIONS = {
    ("RENYOKEI", "ます"): 0, ("MIZENKEI", "ない"): 0, ("MIZENKEI", "れる"): 0, ("MIZENKEI", "せる"): 0, ("ONBINKEI", "た"): 0, ("ONBINKEI", "て"): 0, ("RENYOKEI", "たい"): 0,
    ("OUT_TE", "いる"): 0, ("OUT_TE", "しまう"): 0, ("OUT_TE", "おく"): 0, ("OUT_TE", "くる"): 0, ("OUT_TE", "いく"): 0, ("OUT_TE", "みる"): 0, ("OUT_TE", "もらう"): 0, ("OUT_TE", "くれる"): 0, ("OUT_TE", "あげる"): 0,
    ("OUT_BASE", "ます"): 0, ("OUT_BASE", "た"): 100, ("BASE", "EOS"): 0, ("OUT_BASE", "EOS"): 0, ("OUT_MASU", "EOS"): 0, ("OUT_TA", "EOS"): 0, ("BOS", "BASE"): 0, ("BOS", "NOUN"): 0, ("NOUN", "PARTICLE"): 0, ("PARTICLE", "BASE"): 0,
}
INFINITE = 32767


def detect_type(base: str) -> str:
    """The type that a dictionary form's ending suggests; UNKNOWN if none."""
    if base.endswith("する"):
        return "SURU"
    if base in ("来る", "くる"):
        return "KURU"
    if base.endswith("い"):
        return "I_ADJ"
    if len(base) > 1 and base.endswith("る") and base[-2] in ICHIDAN_BEFORE_RU:
        return "ICHIDAN"
    return BY_ENDING[base[-1]].kind if base and base[-1] in BY_ENDING else "UNKNOWN"


def stem(base: str, kind: str) -> str:
    """base without its conjugating ending."""
    return base[: -2 if kind == "SURU" else -1]


def suffixes(kind: str) -> list[str]:
    """What follows the stem in every form of a type."""
    row = GODAN.get(kind)
    if not row:
        return OTHER_FORMS.get(kind, "").split()
    forms = [f for f in GODAN_FORMS if row.onbin or f[0] != "onbin"]
    if not row.onbin:
        forms[-1:-1] = GODAN_FORMS_WITHOUT_CHANGE
    return [row.step(step) + more.replace("T", row.ta).replace("D", row.te) for step, more in forms]


def entry_suffixes(kind: str) -> list[tuple[str, str]]:
    """(suffix after the stem, category) of the forms of a type that a dictionary keeps."""
    row = GODAN.get(kind)
    if not row:
        return list(OTHER_ENTRIES.get(kind, ()))
    kept = [x for x in GODAN_ENTRIES if (row.onbin or x[0] != "onbin") and not (x[2] == "VERB_命令" and kind in WITHOUT_IMPERATIVE)]
    return [(row.step(step) + more, name) for step, more, name in kept]


def stems(base: str, kind: str) -> list[tuple[str, str]]:
    """(surface, form) of the stems of base that take auxiliaries."""
    row, bare = GODAN.get(kind), stem(base, kind)
    if row:
        return [(base, "BASE"), (bare + row.a, "MIZENKEI"), (bare + row.i, "RENYOKEI"), (bare + (row.onbin or row.i), "ONBINKEI")]
    return [(base if form == "BASE" else bare + more, form) for form, more in STEMS.get(kind, ())]


def endings() -> list[tuple[str, str, str, str]]:
    """(ending, base ending, type, form) of every ending of a verb; under 150 rows, from the tables above."""
    out = []
    for row in GODAN.values():
        changed = [row.onbin or row.i] + (["っ"] if row.kind == "GODAN_KA" else [])  # 行っ
        out += [(x, row.u, row.kind, "ONBINKEI") for x in changed]
        out += [(row.i, row.u, row.kind, "RENYOKEI"), (row.a, row.u, row.kind, "MIZENKEI")]
        if row.kind != "GODAN_RA":  # looks like a one-step stem
            out.append((row.e, row.u, row.kind, "POTENTIAL"))
        out += [(row.e, row.u, row.kind, "KATEIKEI"), (row.e, row.u, row.kind, "MEIREIKEI"), (row.o, row.u, row.kind, "ISHIKEI"), (row.u, row.u, row.kind, "BASE")]
    return out + list(OTHER_ENDINGS)


def verb_form(surface: str) -> str:
    """The form that a verb surface's ending shows."""
    if surface.endswith(("っ", "ん")) or (surface.endswith("い") and any("一" <= c <= "鿿" for c in surface)):
        return "VERB_音便"
    for ending, name in (("たら", "VERB_たら形"), ("だら", "VERB_たら形"), ("て", "VERB_て形"), ("で", "VERB_て形"), ("ば", "VERB_仮定"), ("た", "VERB_た形"), ("だ", "VERB_た形"), ("ろ", "VERB_命令"), ("よ", "VERB_命令"), ("る", "VERB_終止")):
        if surface.endswith(ending):
            return name
    return "VERB_連用"
