"""From a conjugated surface back to dictionary forms: auxiliaries are taken off its end, one by one, down to a stem."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from tokiwa.grammar import conjugation

# Auxiliaries that conjugate: base, type, the form that they follow. て and て's like join in the form OUT_TE.
CONJUGATING = (
    ("れる", "ICHIDAN", "MIZENKEI"), ("られる", "ICHIDAN", "MIZENKEI"), ("せる", "ICHIDAN", "MIZENKEI"), ("させる", "ICHIDAN", "MIZENKEI"), ("ない", "I_ADJ", "MIZENKEI"), ("ない", "I_ADJ", "KU"), ("たい", "I_ADJ", "RENYOKEI"), ("たがる", "GODAN_RA", "RENYOKEI"),
    ("すぎる", "ICHIDAN", "RENYOKEI"), ("すぎる", "ICHIDAN", "STEM"), ("やすい", "I_ADJ", "RENYOKEI"), ("にくい", "I_ADJ", "RENYOKEI"), ("始める", "ICHIDAN", "RENYOKEI"), ("続ける", "ICHIDAN", "RENYOKEI"), ("終わる", "GODAN_RA", "RENYOKEI"), ("終える", "ICHIDAN", "RENYOKEI"), ("出す", "GODAN_SA", "RENYOKEI"), ("直す", "GODAN_SA", "RENYOKEI"), ("かける", "ICHIDAN", "RENYOKEI"),
    ("いる", "ICHIDAN", "OUT_TE"), ("おる", "GODAN_RA", "OUT_TE"), ("ある", "GODAN_RA", "OUT_TE"), ("しまう", "GODAN_WA", "OUT_TE"), ("おく", "GODAN_KA", "OUT_TE"), ("くる", "KURU", "OUT_TE"), ("いく", "GODAN_KA", "OUT_TE"), ("みる", "ICHIDAN", "OUT_TE"),
    ("もらう", "GODAN_WA", "OUT_TE"), ("くれる", "ICHIDAN", "OUT_TE"), ("あげる", "ICHIDAN", "OUT_TE"), ("いただく", "GODAN_KA", "OUT_TE"), ("くださる", "GODAN_RA", "OUT_TE"), ("ほしい", "I_ADJ", "OUT_TE"), ("なる", "GODAN_RA", "KU"), ("なる", "GODAN_RA", "YOUNI"), ("する", "SURU", "TARI"), ("てる", "ICHIDAN", "ONBINKEI"), ("でる", "ICHIDAN", "VOICED"), ("ちゃう", "GODAN_WA", "ONBINKEI"), ("じゃう", "GODAN_WA", "VOICED"),
    ("とく", "GODAN_KA", "ONBINKEI"), ("どく", "GODAN_KA", "VOICED"),
)
# Auxiliaries and particles in fixed forms: surface, lemma, the form that they follow, the form that they make.
FIXED = (
    ("ます", "ます", "RENYOKEI", "BASE"), ("まし", "ます", "RENYOKEI", "ONBINKEI"), ("ません", "ます", "RENYOKEI", "BASE"), ("ませんでした", "ます", "RENYOKEI", "BASE"), ("ましょう", "ます", "RENYOKEI", "BASE"),
    ("た", "た", "ONBINKEI", "OUT_TA"), ("たら", "た", "ONBINKEI", "END"), ("たり", "た", "ONBINKEI", "TARI"), ("だ", "だ", "VOICED", "OUT_TA"), ("だら", "だ", "VOICED", "END"), ("だり", "だ", "VOICED", "TARI"),
    ("て", "て", "ONBINKEI", "OUT_TE"), ("で", "で", "VOICED", "OUT_TE"), ("ば", "ば", "KATEIKEI", "END"), ("う", "う", "ISHIKEI", "END"), ("そう", "そう", "RENYOKEI", "END"), ("ながら", "ながら", "RENYOKEI", "END"), ("なさい", "なさる", "RENYOKEI", "END"),
    ("ず", "ぬ", "MIZENKEI", "END"), ("ずに", "ぬ", "MIZENKEI", "END"), ("ぬ", "ぬ", "MIZENKEI", "END"), ("ん", "ぬ", "MIZENKEI", "END"), ("べき", "べし", "BASE", "END"), ("そうだ", "そう", "RENYOKEI", "END"), ("そうだ", "そう", "STEM", "END"), ("ように", "よう", "BASE", "YOUNI"), ("でした", "です", "BASE", "END"), ("ないで", "ない", "MIZENKEI", "OUT_TE"), ("ません", "ます", "RENYOKEI", "ONBINKEI"),
)
# What a form of an adjective, or of an auxiliary like one, adds to its stem.
ADJECTIVE_STEPS = (("い", "BASE"), ("く", "RENYOKEI"), ("く", "KU"), ("", "STEM"), ("かっ", "ONBINKEI"), ("けれ", "KATEIKEI"), ("くて", "OUT_TE"), ("さ", "END"), ("そう", "END"))
VOICED_ROWS = ("GODAN_GA", "GODAN_NA", "GODAN_BA", "GODAN_MA")
FINAL = ("BASE", "TARI", "OUT_TA", "OUT_TE", "END", "RENYOKEI", "KATEIKEI", "MEIREIKEI", "MIZENKEI", "ONBINKEI", "ISHIKEI")
MOST_AUXILIARIES = 8
LEAST, MOST = 0.3, 0.95


@dataclass(frozen=True)
class Inflected:
    """A reading of a surface: its dictionary form and type, the stem that stayed, and the auxiliaries' forms after it."""

    base: str
    stem: str
    suffix: str
    kind: str
    form: str
    confidence: float
    auxiliaries: tuple[str, ...] = ()


@lru_cache(maxsize=1)
def auxiliaries() -> tuple[tuple[str, str, str, str], ...]:
    """(surface, lemma, the form it follows, the form it makes) of every form of every auxiliary, longest first."""
    rows = list(FIXED)
    for base, kind, after in CONJUGATING:
        if kind == "I_ADJ":
            rows += [(base[:-1] + more, base, after, form) for more, form in ADJECTIVE_STEPS]
            continue
        own = [(e, b, f) for e, b, k, f in conjugation.endings() if k == kind and f != "POTENTIAL" and base.endswith(b)]
        rows += [(base[: len(base) - len(b)] + e, base, after, form) for e, b, form in own if e or len(base) > len(b)]
    return tuple(sorted(set(rows), key=lambda r: (-len(r[0]), r)))


@lru_cache(maxsize=1)
def verb_endings() -> dict[str, list[tuple[str, str, str]]]:
    """(ending, base ending, type) by form; VOICED is the sound change of the rows that voice た and て."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for ending, base, kind, form in conjugation.endings():
        if form == "ONBINKEI" and kind in VOICED_ROWS:
            form = "VOICED"
        out.setdefault(form, []).append((ending, base, kind))
    for more, form in ADJECTIVE_STEPS:
        out.setdefault(form, []).append((more, "い", "I_ADJ"))
    for more, form in (("", "MIZENKEI"), ("", "RENYOKEI"), ("", "ONBINKEI"), ("る", "BASE"), ("れ", "KATEIKEI"), ("い", "MEIREIKEI"), ("よ", "ISHIKEI")):
        out[form].append(("来" + more, "来る", "KURU"))
    out["POTENTIAL"] += [(e, b, k) for e, b, k in out["KATEIKEI"] if k == "GODAN_RA"]
    for form in ("MIZENKEI", "RENYOKEI", "ONBINKEI"):  # 書け- takes auxiliaries as a one-step stem does
        out[form] += [(e, b, k) for e, b, k in out["POTENTIAL"]]
    out["BASE"] += [(e + "る", b, k) for e, b, k in out["POTENTIAL"]]
    return out


SINGLE_SCRIPT = re.compile("(?:[々一-鿿㐀-䶿豈-﫿]+|[ァ-ヺー]+)$")
#: A stem that is another verb's passive or causative more likely than a verb of its own.
VOICE_STEM = re.compile("[わかがさたなばまら][れせ]$")
EXPLAINING = re.compile("(?<=[うくすつぬふむるぐぶいた])[のん]だ(?:もん)?$")
# Stems of one-step verbs of a single kanji.
BARE_ICHIDAN = "見居出寝得経着似煮射鋳干"
SURE_ICHIDAN = "べめせてけれえねげぜでへ"
KANJI = re.compile("[々一-鿿㐀-䶿豈-﫿]")


#: Of rows that share a sound change the usual one is likelier.
LESS_USUAL = {"GODAN_WA": 0.01, "GODAN_BA": 0.01, "GODAN_TA": 0.02, "GODAN_GA": 0.01}


def confidence(stem: str, ending: str, base: str, kind: str, form: str, n_auxiliaries: int) -> float:
    """How likely a reading is, from LEAST to MOST: by the stem's script and length, the type and what follows."""
    kanji, score = bool(KANJI.search(stem)), 0.6
    score += 0.1 if kanji else -0.05 * (len(stem) < 2)
    score += min(0.15, 0.05 * n_auxiliaries)
    last = stem[-1:] or "　"
    tail = re.search("[ぁ-ゟー]*$", stem)[0]
    score -= 0.1 * max(0, len(tail) - (1 if kanji else 3)) + 0.3 * bool(re.search("[っんー]", tail[-2:]))
    if kind == "ICHIDAN":
        one = stem in BARE_ICHIDAN
        score -= 0.2 * bool(VOICE_STEM.search(stem)) + 0.2 * ("て" in stem[:-1])
        score += 0.15 if last in SURE_ICHIDAN else -0.05 if last in conjugation.ICHIDAN_BEFORE_RU else 0.0 if one else -0.3
    elif kind == "SURU":
        score -= 0.4 * (kanji and not SINGLE_SCRIPT.match(stem))
        score += 0.2 if len(KANJI.findall(stem)) >= 2 else -0.25 if stem else 0.1
        score -= 0.3 * (not ending)
    elif kind == "I_ADJ":
        score += 0.1 if last == "し" else 0.0
        score -= 0.2 * (last in "てでんっをがはくな")
    elif kind == "KURU":
        score += 0.2
    else:
        score -= LESS_USUAL.get(kind, 0.0)
        score -= 0.1 * (form == "POTENTIAL") + 0.1 * (kind == "GODAN_NA" and base not in ("死ぬ", "しぬ"))
        score -= 0.15 * (last in "をがはにへのも") + 0.05 * (len(KANJI.findall(stem)) >= 2 and kind == "GODAN_SA")
        score -= 0.25 * (ending == "っ" and kind == "GODAN_KA" and base not in ("行く", "いく"))
    return round(min(MOST, max(LEAST, score)), 3)


@lru_cache(maxsize=50_000)
def inflect(surface: str) -> tuple[Inflected, ...]:
    """Readings of a surface, the likeliest first; none for fewer than two characters. A trailing のだ or んだ is left aside."""
    surface = EXPLAINING.sub("", surface)
    if len(surface) < 2:
        return ()
    found: dict[tuple[str, str], Inflected] = {}

    def walk(rest: str, need: str, chain: tuple[str, ...]) -> None:
        for ending, base_ending, kind in verb_endings().get(need, ()):
            if not rest.endswith(ending) or (not ending and not rest):
                continue
            stem = rest[: len(rest) - len(ending)]
            base = stem + base_ending
            if (not stem and kind not in ("SURU", "KURU")) or len(base) < 2 or (kind == "KURU" and base not in ("くる", "来る")):
                continue
            potential = need in ("MIZENKEI", "RENYOKEI", "ONBINKEI", "BASE") and (ending.removesuffix("る"), base_ending, kind) in verb_endings()["POTENTIAL"]
            form = "POTENTIAL" if potential else need
            got = Inflected(base, stem, surface[len(stem) :], kind, form, confidence(stem, ending, base, kind, form, len(chain)), chain)
            if (base, kind) not in found or found[base, kind].confidence < got.confidence:
                found[base, kind] = got
        if len(chain) < MOST_AUXILIARIES:
            for form, lemma, after, makes in auxiliaries():
                if makes == need and rest.endswith(form) and len(rest) > len(form):
                    walk(rest[: len(rest) - len(form)], after, (lemma, *chain))

    for need in FINAL:
        walk(surface, need, ())
    return tuple(sorted(found.values(), key=lambda x: (-x.confidence, len(x.base))))


def best(surface: str) -> Inflected | None:
    return next(iter(inflect(surface)), None)


def looks_conjugated(surface: str) -> bool:
    """Whether a surface has a likely reading that isn't its own dictionary form."""
    return any(r.base != surface and r.confidence >= 0.5 for r in inflect(surface))
