"""Words that no dictionary lists: conjugated verbs and adjectives, onomatopoeia, derived nouns and the like.

A candidate is proposed where its script and what stands after it allow its form: 書か before ない, 書い before た. What
`known` says of a dictionary form makes a reading cheaper. Every rule is a pattern anchored at a place of the text, so a
place costs a few matches whatever the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from tokiwa.grammar.conjugation import GODAN, ICHIDAN_BEFORE_RU


class Candidate(NamedTuple):
    end: int
    category: str
    cost: float
    lemma: str


K, H, T = "々一-鿿㐀-䶿豈-﫿", "ぁ-ゟ", "ァ-ヺー"
KANJI = re.compile(f"[{K}]")
# Verbs that join the stem of another verb before them to one verb.
SECOND_VERBS = (
    "込む 出す 続く 返す 返る 変わる 替わる つかる 合う 消す 直す 切る 上がる 下がる 回す 回る 抜く 掛かる 付く 巡る 飛ばす 交う 潰す 崩す 倒す 起こす 去る 開く 組む 上る 続ける つける 替える 換える 合わせる 切れる 出る 上げる 下げる "
    "抜ける 着く 取る 越す 越える 張る 叫ぶ 注ぐ 継ぐ 刺す 望む 落とす 落ちる 掛ける 付ける 入れる 分ける 立てる 広げる 受ける 降りる 締める 止める 入る"
)
# The same written in kana, as far as no other word looks alike.
SECOND_READINGS = "こむ だす つづける かえす なおす あう めぐる つぶす しめる おわる はじめる あわせる かける あげる さげる いれる"
# Stems of one-step verbs of a single kanji; kana that are particles more often than part of a verb's stem.
BARE_ICHIDAN, PARTICLE_LIKE = "見居出寝得経着似煮", "をがはにへのもでとだ"
# Pronouns of one kanji, which no verb's stem is.
ASKED_OR_NAMED = "何誰私僕俺君彼我皆"
# What stands after each form of a verb.
AFTER = {
    "a": "ない|なかっ|なけれ|なく|なきゃ|れ|せ|ず|ぬ|ん(?![でだ])|ざる|ねば|しめ",
    "i": "ます|まし|ませ|ましょ|たい|たく|たかっ|たけれ|たがる|たがっ|そう|すぎ|過ぎ|ながら|なさい|やす[いくか]|にく[いくか]|づら[いくか]|つつ|がち|っぱなし|かけ",
    "plain": "た|て|ちゃ|とく|とい|とけ|たら|たり", "voiced": "だ|で|じゃ|どく|どい|だら|だり", "e": "ば", "order": "(?:よ|！|!|。|$)", "o": "う",
}
ICHIDAN_AFTER = f"{AFTER['a'].replace('れ|せ|', 'られ|させ|')}|{AFTER['i']}|{AFTER['plain']}"
AFTER_RE = {name: re.compile(p) for name, p in AFTER.items()} | {"ichidan": re.compile(ICHIDAN_AFTER), "end": re.compile(f"$|[^{H}]"), "noun": re.compile("[のをが](?![いかくなれ])")}
NOT_AFTER_BASE = re.compile("ん(?![だでじ])")
GODAN_KANA = {x for row in GODAN.values() for x in (row.u, row.a, row.i, row.e, row.o, row.onbin) if x}
#: Of rows that share a sound change the usual one comes first.
USUAL_ROWS = {"GODAN_KA": 0.0, "GODAN_GA": 0.0, "GODAN_RA": 0.0, "GODAN_MA": 0.0, "GODAN_WA": 0.01, "GODAN_BA": 0.01}
SURE_ICHIDAN = "べめけれえねげぜせてへ"
STEM_AFTER_KANJI = re.compile(f"[{K}]{{1,3}}")
JOINED = re.compile(f"[{K}]{{1,2}}[いきぎしじちびみりえけげせぜてねべめれん](?:" + "|".join(sorted({v[0] for v in SECOND_VERBS.split() if KANJI.match(v)})) + f")|[{K}]っ[{K}]")
GODAN_BASES = [row.u for row in GODAN.values()]
SECOND = set(SECOND_VERBS.split())
SURU_STEM = re.compile(f"[{K}]{{2}}し")
FIRST_VERB = re.compile(f"[{K}]{{1,2}}[いきぎしじちびみりえけげせぜねべめれ]|[{H}]{{1,2}}[いきぎしちびみりけげせねべめれ]")
HIRAGANA_START = re.compile(f"[{H}]+")


def forms(s: str, head: int, at: int, known: Callable[[str], bool], base_cost: float, most_inner: int = 2) -> Iterator[Candidate]:
    """Forms of verbs whose stem is s[at:head] and up to `most_inner` kana; `head` is where the kana begin."""
    after = lambda name, n: AFTER_RE[name].match(s, n)
    several = head - at > 1
    for mid in range(min(most_inner, len(s) - head) + 1):
        inner = s[head : head + mid]
        if inner and (not HIRAGANA_START.fullmatch(inner) or any(c in "をっんーゃゅょ" for c in inner) or inner.startswith(("すぎ", "くな")) or "や" in inner[1:]):
            break
        stem, place = s[at : head + mid], head + mid
        last, end_kana = s[place : place + 1], inner[-1:]
        # a particle-like kana, or て, is part of a verb only if a dictionary says so
        doubtful = any(c in PARTICLE_LIKE for c in inner)
        risk = 0.2 * mid
        for row in GODAN.values() if last and last in GODAN_KANA else ():
            lemma = stem + row.u
            sure = known(lemma)
            if not sure and ((end_kana and end_kana in SURE_ICHIDAN or stem in BARE_ICHIDAN and row.kind != "GODAN_KA") and not (row.kind == "GODAN_RA" and last == "る")):
                continue
            if not sure and (doubtful or inner[1:] == "ま" and last == "す" or "て" in inner or last in "がにのだ" or (lemma.endswith("する") and last != "す") or (row.kind == "GODAN_RA" and end_kana == "い")):
                continue
            cost = 0.3 if sure else base_cost + risk + 0.6 * (row.kind == "GODAN_NA") + 1.5 * (mid > 0 and known(stem)) + 0.9 * (last == "み" and s.startswith("たい", place + 1))
            noun_and_suru = 0.8 if row.kind == "GODAN_SA" and several and not mid and not sure else 0.0
            if last == row.u and not NOT_AFTER_BASE.match(s, place + 1):
                yield Candidate(place + 1, "VERB_終止", cost + noun_and_suru + 0.5 * (inner.endswith("し") and last == "く" and not sure), lemma)
            if last == row.a and after("a", place + 1):
                yield Candidate(place + 1, "VERB_未然", cost + noun_and_suru, lemma)
            if last == row.i:
                if after("i", place + 1) or (row.kind == "GODAN_SA" and after("plain", place + 1)):
                    yield Candidate(place + 1, "VERB_連用", cost + noun_and_suru, lemma)
                elif mid < 2 and after("end", place + 1):
                    yield Candidate(place + 1, "VERB_連用", cost + 0.5 + noun_and_suru, lemma)
                elif mid < 2 and s.startswith("もの", place + 1):
                    yield Candidate(place + 1, "VERB_連用", cost + 0.2 + noun_and_suru, lemma)
                elif several and row.kind != "GODAN_SA" and after("noun", place + 1):
                    yield Candidate(place + 1, "NOUN_転成", cost + 0.2, s[at : place + 1])
            if row.onbin and last == row.onbin and after("voiced" if row.voiced else "plain", place + 1):
                yield Candidate(place + 1, "VERB_音便", cost + USUAL_ROWS.get(row.kind, 0.02), lemma)
            if last == row.e:
                if after("e", place + 1):
                    yield Candidate(place + 1, "VERB_仮定", cost, lemma)
                elif after("order", place + 1) and row.kind != "GODAN_RA":
                    yield Candidate(place + 1, "VERB_命令", cost + 0.3, lemma)
            if last == row.o and after("o", place + 1):
                yield Candidate(place + 1, "VERB_未然", cost, lemma)
        if last == "っ" and stem in ("行", "い") and after("plain", place + 1):
            yield Candidate(place + 1, "VERB_音便", 0.2, stem + "く")
        # one-step verbs
        bare = not mid and stem in BARE_ICHIDAN
        if not (end_kana and end_kana in ICHIDAN_BEFORE_RU) and not bare:
            continue
        lemma = stem + "る"
        sure = known(lemma)
        if not sure and not bare and ((doubtful and end_kana != "で") or end_kana in "しい" or (end_kana in "てで" and s[at:head] in BARE_ICHIDAN) or "て" in inner[:-1] or inner.endswith("して")):
            continue
        cost = 0.3 if sure else base_cost + risk - (0.2 if mid else 0.0) + (0.0 if bare or end_kana in SURE_ICHIDAN else 0.25)
        if after("ichidan", place):
            yield Candidate(place, "VERB_連用", cost + 0.9 * (end_kana == "み" and not sure and s.startswith("たい", place)), lemma)
        elif mid and after("end", place) and (sure or end_kana in SURE_ICHIDAN):
            yield Candidate(place, "VERB_連用", cost + 0.4, lemma)
        if last == "る" and end_kana == "て":
            yield Candidate(place + 1, "VERB_終止", cost, lemma)
        if last == "れ" and after("e", place + 1):
            yield Candidate(place + 1, "VERB_仮定", cost, lemma)
        if last == "ろ" and after("order", place + 1):
            yield Candidate(place + 1, "VERB_命令", cost, lemma)
        if last == "よ" and after("o", place + 1):
            yield Candidate(place + 1, "VERB_未然", cost, lemma)


ADJECTIVE = re.compile(f"(?P<stem>[{K}]{{1,3}}(?:し|か|き|な|さ|る|た|ら|ろ|ど|やか|らか|ずかし|かし|もし|まし|わし|ましい)?)(?:(?P<base>い)(?!て|た|だ|で|ま[すし])|(?P<ku>く)(?=な[いかけくるっりら]|て|する|し)|(?P<katt>かっ)(?=た)|(?P<ke>けれ)(?=ば)|(?=(?P<sou>そう|すぎ|過ぎ|がる|がっ|がり)))")
KATAKANA_ADJECTIVE = re.compile(f"(?P<stem>[{T}]{{2,}})(?:(?P<base>い)|(?P<ku>く)(?=な[いかけくるっり]|て|$)|(?P<katt>かっ)(?=た)|(?P<ke>けれ)(?=ば)|(?=(?P<sou>そう|すぎ)))")
HIRAGANA_ADJECTIVE = re.compile(f"(?P<stem>(?![をがはにのでとも])[{H}]{{1,3}}し)(?:(?P<base>い)(?!て|た|だ|で|ま[すし])|(?P<ku>く)(?=な[いかけくるっり]|て)|(?P<katt>かっ)(?=た)|(?P<ke>けれ)(?=ば)|(?=(?P<sou>そう)))")
KATAKANA_VERB = re.compile(f"(?P<stem>[{T}]{{2,}})(?:(?P<u>る)|(?P<t>っ)(?=た|て|ちゃ)|(?P<a>ら)(?=な[いかけ]|れ|せ|ず)|(?P<i>り)(?=ま[すし]|た[いくか]|そう|すぎ)|(?P<e>れ)(?=ば)|(?P<o>ろ)(?=う))")
# Kanji that begin an adjective in ない that isn't a verb's negation.
NAI_STEMS = "少危切汚幼拙儚"
ADJECTIVE_FORMS = {"base": ("ADJ_終止", 0.0), "ku": ("ADJ_連用", 0.0), "katt": ("ADJ_かっ", -0.1), "ke": ("ADJ_け形", 0.0), "sou": ("ADJ_語幹", 0.1)}
VERB_FORMS = {"u": "VERB_終止", "t": "VERB_音便", "a": "VERB_未然", "i": "VERB_連用", "e": "VERB_仮定", "o": "VERB_未然"}
NA_ADJECTIVE = re.compile(f"[{K}]{{1,2}}(?:やか|らか|か)(?=な(?![いかけくらり])|に(?![はもな])|だ|で|$)|[{K}]{{1,3}}(?!的)[{K}](?=な(?![いかけくらりっ])[{K}{H}{T}])")
DERIVED_NOUN = re.compile(f"[{K}]{{1,2}}[いきぎしじちにびみりえけげせてねべめれ](?:方|物|所|目|手|会|場|口)(?![{K}])")
TARU = re.compile(f"[{K}]{{1,3}}然と")
TSU = re.compile("[一二三四五六七八九幾]つ")
TWICE = re.compile(f"([{H}]{{2}})\\1|([{T}]{{2}})\\2|([{H}])\\3(?=と)")
SUDDEN = re.compile(f"[{H}{T}]っ[{H}{T}]り(?=と|[^{H}]|す|し|$)|[{H}]{{1,2}}んり|[{H}{T}][{H}{T}]?っと(?=[^{H}]|す|し|$)|([{H}]{{2}})り(?=と|[{K}])")
VOWELS = {c: v for v, row in (("あ", "あかがさざただなはばぱまやらわぁゃ"), ("い", "いきぎしじちぢにひびぴみりぃ"), ("う", "うくぐすずつづぬふぶぷむゆるぅゅ"), ("え", "えけげせぜてでねへべぺめれぇ"), ("お", "おこごそぞとどのほぼぽもよろをぉょ")) for c in row}
LONG_DRAWN = re.compile("[っッー〜～ぁぃぅぇぉァィゥェォ]+")
SPEECH = re.compile("(?:にゃ|にゅ|ぴょ|ぽよ|だぞ|ずら|だす|だに|ちゅ|っぴ|んす|やん)[ぁ-ゟー]{0,2}(?=$|[。！？!?])")
LONG_ADJECTIVE = re.compile(f"[ぁ-ゟ]{{1,4}}ー+い|[ぁ-ゟ]{{1,4}}いー+")
PLACE = re.compile(f"[{K}]{{2,3}}[県都府道市区町村](?=[{K}])|[{K}]{{2,3}}[市区町村](?![{K}])")
# Kanji that come before a noun and make one with it.
PREFIX_KANJI = "不未非無超再準副総各両全最半"
PREFIXED = re.compile(f"[{PREFIX_KANJI}][{K}]{{2,4}}(?![{K}])")
NICKNAME = re.compile(f"[{H}]{{2,4}}?(?=ちゃん|くん)")
PREFIXED_TIME = re.compile(f"[今来先昨翌毎][{K}](?![{K}])")


def joined_kana(s: str, at: int, first: re.Match, known: Callable[[str], bool]) -> Iterator[Candidate]:
    """A known verb's stem, `first`, and a second verb that is written in kana."""
    kana = first[0][-1]
    sure = KANJI.match(first[0])  # after kana, or before a reading that ends other words too, the first verb must be known
    known_first = any(known(first[0][:-1] + row.u) for row in GODAN.values() if row.i == kana) or known(first[0] + "る")
    for reading in SECOND_READINGS.split():
        stem = reading[:-1]
        if s.startswith(stem, first.end()) and (known_first or (sure and len(reading) > 2)):
            for c in forms(s, first.end() + max(1, len(stem)), at, known, 0.3, 1):
                if c.lemma == first[0] + reading:
                    yield c._replace(cost=c.cost - 0.3)


def adjectives(m: re.Match, known: Callable[[str], bool], base_cost: float) -> Iterator[Candidate]:
    lemma = m["stem"] + "い"
    sure, kanji = known(lemma), len(KANJI.findall(m["stem"]))
    if not sure and m["stem"][-1] == "な" and m["stem"][0] not in NAI_STEMS:
        return
    cost = 0.25 if sure else base_cost + 0.3 * (m["stem"][-1] in "たさ") + 0.1 * max(0, len(m["stem"]) - 2) + 0.5 * max(0, kanji - 2) + 1.0 * (kanji > 1 and known(lemma[kanji - 1 :]))
    for name, (category, more) in ADJECTIVE_FORMS.items():
        if m[name]:
            yield Candidate(m.start("sou") if name == "sou" else m.end(), category, cost + more, lemma)


def candidates(s: str, at: int, kind: str, known: Callable[[str], bool], join: bool = True) -> Iterator[Candidate]:
    """All candidates that begin at `at`, whose character is of class `kind`; known: whether a dictionary form is in a dictionary."""
    if kind == "KANJI":
        run = STEM_AFTER_KANJI.match(s, at)
        if run and run[0] not in ASKED_OR_NAMED and not KANJI.match(s[run.end() : run.end() + 1] or " "):
            head = run.end()
            known_end = head - at > 1 and any(known(s[head - 1 : head + n] + u) for n in (0, 1) for u in GODAN_BASES)
            yield from forms(s, head, at, known, 0.6 + (0.0, 0.4, 1.4)[head - at - 1] + 1.0 * known_end)
        if join:
            m = JOINED.match(s, at)
            if m and m.end() - at > 1:
                joining = lambda w: known(w) or any(w.endswith(v) for v in SECOND)
                for c in forms(s, m.end(), at, joining, 0.3) if not (m[0][1] == "し" and at and KANJI.match(s[at - 1])) else ():
                    if not SURU_STEM.match(m[0]) and ("っ" in m[0] or any(c.lemma.endswith(v) for v in SECOND)):
                        yield c._replace(cost=c.cost - 0.3)
            m = FIRST_VERB.match(s, at)
            if m:
                yield from joined_kana(s, at, m, known)
            m = DERIVED_NOUN.match(s, at)
            if m:
                yield Candidate(m.end(), "NOUN", 0.3, m[0])
        m = ADJECTIVE.match(s, at)
        if m:
            yield from adjectives(m, known, 0.55)
        for pattern, category, cost in ((NA_ADJECTIVE, "ADJ_NA", 0.6), (TARU, "ADV", 0.3), (TSU, "NOUN", 0.3), (PREFIXED_TIME, "NOUN", 0.5), (PLACE, "NOUN", 0.3), (PREFIXED, "NOUN", 0.6)):
            m = pattern.match(s, at)
            if m:
                yield Candidate(m.end(), category, cost, m[0])
    elif kind == "HIRAGANA":
        if s[at] not in "をがへのよっんーゃゅょ":
            for n in (1, 2):
                if at + n < len(s) and HIRAGANA_START.fullmatch(s[at : at + n]) and not any(c in "をっんーはが" for c in s[at : at + n]):
                    for c in forms(s, at + n, at, known, 1.4 if n == 2 else 1.6, 1):
                        if c.end - at > 1 and (known(c.lemma) or not any(x in "てでをはがにのもとだな" for x in c.lemma[:-1])):
                            yield c
            m = HIRAGANA_ADJECTIVE.match(s, at)
            if m:
                yield from adjectives(m, known, 0.9)
            m = LONG_ADJECTIVE.match(s, at)
            bare = m[0].replace("ー", "") if m else ""
            for lemma in (bare, bare + "い") if m else ():
                if known(lemma):
                    yield Candidate(m.end(), "ADJ_終止", -0.5, lemma)
            m = FIRST_VERB.match(s, at) if join else None
            if m:
                yield from joined_kana(s, at, m, known)
    elif kind == "KATAKANA":
        m = KATAKANA_ADJECTIVE.match(s, at)
        if m:
            yield from adjectives(m, known, 0.3)
        m = KATAKANA_VERB.match(s, at)
        if m:
            for name, category in VERB_FORMS.items():
                if m[name]:
                    yield Candidate(m.end(), category, 0.4, m["stem"] + "る")
    if kind in ("HIRAGANA", "KATAKANA"):
        for pattern, cost in ((TWICE, 0.1), (SUDDEN, 0.2)):
            m = pattern.match(s, at)
            if m:
                yield Candidate(m.end(), "ADV", cost, m[0])
        m = NICKNAME.match(s, at) if kind == "HIRAGANA" and not (at and HIRAGANA_START.match(s[at - 1])) else None
        if m:
            yield Candidate(m.end(), "NOUN", 0.9, m[0])
        m = SPEECH.match(s, at)
        if m:
            yield Candidate(m.end(), "UNKNOWN", 0.6, m[0])
