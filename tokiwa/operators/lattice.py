"""Minimum-cost segmentation: candidate words over a text, costs, and the cheapest path through them.

Pure Python without Spark; `tokiwa.operators.analyze` runs it on Arrow batches. Words come from the closed classes that
are built in, from the dictionary that it is given, and from candidates: runs of one character class, identifiers, numbers
or letters joined with Japanese, and conjugated words (`tokiwa.grammar.candidates`).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from tokiwa.functions import pretokens, text
from tokiwa.grammar import candidates, categories, lemmas, words

# The thirteen classes of coarse connection costs, and the costs from each (row) to each (column).
COARSE = ("NOUN", "VERB", "ADJ", "ADV", "PARTICLE", "AUX", "CONJ", "DET", "PRON", "PREFIX", "SUFFIX", "SYMBOL", "OTHER")
COARSE_COSTS = (
    (0.0, 0.5, 0.5, 0.3, 0.0, 0.0, 0.5, 0.5, 0.5, 1.0, -0.8, 0.5, 0.5),
    (0.2, 0.8, 0.8, 0.5, 0.0, 0.0, 0.5, 0.5, 0.2, 1.0, 1.5, 0.5, 0.5),
    (0.2, 0.5, 0.8, 0.3, 0.0, 0.0, 0.5, 0.5, 0.2, 1.0, 0.8, 0.5, 0.5),
    (0.0, 0.3, 0.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.0, 1.0, 0.8, 0.5, 0.5),
    (0.0, 0.2, 0.2, 0.3, 0.5, 0.5, 0.5, 0.3, 0.0, 0.3, 1.0, 0.5, 0.5),
    (0.5, 0.5, 0.5, 0.5, 0.0, 0.3, 0.5, 0.5, 0.5, 1.0, 0.8, 0.5, 0.5),
    (0.0, 0.2, 0.2, 0.2, 0.3, 0.5, 0.5, 0.2, 0.0, 0.3, 1.0, 0.3, 0.3),
    (0.0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.8, 0.0, 1.0, 1.5, 0.5, 0.5),
    (0.0, 0.5, 0.5, 0.3, 0.0, 0.2, 0.5, 0.5, 0.5, 1.0, -0.8, 0.5, 0.5),
    (-0.5, -0.5, 0.0, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
    (0.5, 0.8, 0.8, 0.5, 0.0, 0.5, 0.5, 0.5, 0.5, 1.0, 0.3, 0.5, 0.5),
    (0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.5, 0.0, 0.2),
    (0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.5, 0.5, 0.2, 0.2),
)
# The parts of speech in the order in which equal costs at the end are decided, INTJ with OTHER's costs.
ORDER = ("UNKNOWN", "NOUN", "VERB", "ADJ", "ADV", "PARTICLE", "AUX", "CONJ", "DET", "PRON", "PREFIX", "SUFFIX", "SYMBOL", "INTJ", "OTHER")
# What a word at a text's start costs, by part of speech or, on top of that, by category.
START_COSTS = {"SUFFIX": 3.0, "CONJ": -0.5}
START_CATEGORY_COSTS = {"AUX_様態": 0.5, "AUX_進行": 1.0, "AUX_過去": 2.0, "PART_終": 2.0}
# Longest runs proposed by class; the particles that end a run of hiragana; kanji that count.
LONGEST = {"KANJI": 16, "KATAKANA": 16, "HIRAGANA": 6, "ALPHABET": 20, "DIGIT": 24}
LONGEST_OTHER, LONGEST_IDENTIFIER = 12, 24
CASE_ENDS, SOFT_ENDS, NOUN_STARTS, NEVER_FIRST = "をが", "はにへのでともか", "はにへの", "ゃゅょぁぃぅぇぉっ"
COUNTERS = "円銭万億兆分秒時日月年週期世個本人台枚杯回歳才階号番匹冊件丁通発点票頭羽着足軒組曲巻畳割部面問章棟戸席食泊口束両機基隻度倍段級位種色名話連敗勝戦間紀次"

STEP, FALLBACK, BEYOND_DICTIONARY = 0.001, 5.0, 3.5
CHUNK_BYTES = 32_768
BREAKS = re.compile("[\n!?。！？]")
#: Runs that no cut may part.
WORD = re.compile("[A-Za-z0-9_０-９Ａ-Ｚａ-ｚ]+")
PRETOKENS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pretokens.KINDS.items()))
ODD_CLASS = "".join(f"{chr(a)}-{chr(b)}" for k in ("HIRAGANA", "KATAKANA", "KANJI") for a, b in text.CLASS_RANGES[k]) + "０-９Ａ-Ｚａ-ｚ"
#: What the closed form of `tokiwa.operators.tokens` doesn't cover: characters, and runs of letters, digits and underscores;
#: and the nouns or symbols of a span that it does.
ODD, LONG_RUN = re.compile(f"[{ODD_CLASS}]"), re.compile("[A-Za-z]{21}|[A-Za-z0-9_]{25}|[0-9]_[0-9]")
CLOSED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for k in ("HIRAGANA", "KATAKANA", "KANJI") for a, b in text.CLASS_RANGES[k]) + "０-９Ａ-Ｚａ-ｚ]|[A-Za-z]{21}|[A-Za-z0-9_]{25}|[0-9]_[0-9]")
CLOSED = re.compile("([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)|[^A-Za-z0-9]+")
DIGITS = str.maketrans(text.wide(text.ASCII_DIGITS), text.ASCII_DIGITS)


@dataclass(frozen=True)
class Entry:
    """A dictionary word. Without a category it has the one that its part of speech and ending suggest."""

    surface: str
    pos: str
    lemma: str = ""
    user: bool = False
    formal: bool = False
    extended_pos: str = ""

    def __post_init__(self):
        if self.pos not in ORDER or self.pos == "UNKNOWN" or not self.surface:
            raise ValueError(f"no dictionary word: {self.surface!r} as {self.pos!r}")
        if not self.extended_pos:
            object.__setattr__(self, "extended_pos", categories.category(self.surface, self.pos))
        elif self.extended_pos not in categories.COST:
            raise ValueError(f"unknown category of {self.surface!r}: {self.extended_pos!r}")


@dataclass(frozen=True)
class Options:
    """mode: normal, search (nouns compound) or split (no joining candidates).

    connection: costs between parts of speech, or between categories, that replace those built in. letters_bonus: the cost
    of letters joined with Japanese; user_bonus: what a user dictionary's word has on top of its category's cost.
    """

    mode: str = "normal"
    preserve_vu: bool = True
    preserve_case: bool = True
    remove_symbols: bool = True
    least_bytes: int = 1
    connection: dict[tuple[str, str], float] = field(default_factory=dict)
    letters_bonus: float = -0.3
    user_bonus: float = -2.0
    built_in: bool = True
    lemmatize: bool = True
    merge_compounds: bool = False

    def __post_init__(self):
        if self.mode not in ("normal", "search", "split"):
            raise ValueError(f"unknown mode: {self.mode}")


@dataclass(frozen=True)
class Edge:
    start: int
    end: int
    surface: str
    pos: str
    cost: float
    lemma: str = ""
    known: bool = False
    user: bool = False
    formal: bool = False
    extended_pos: str = ""


@dataclass(frozen=True)
class Morpheme:
    surface: str
    start: int
    end: int
    pos: str
    lemma: str
    is_dictionary: bool = False
    is_user_dict: bool = False
    is_formal_noun: bool = False
    is_unknown: bool = True
    extended_pos: str = ""
    conj_type: str | None = None
    conj_form: str | None = None


def normalized(raw: str, options: Options) -> str:
    """The same folding as `text.normalize`, for one Python string."""
    upper = text.ASCII_UPPER if options.preserve_case else text.ASCII_LOWER
    table = dict(zip(text.wide(text.ASCII_DIGITS + text.ASCII_UPPER + text.ASCII_LOWER) + text.HALF_KANA, text.ASCII_DIGITS + upper + text.ASCII_LOWER + text.FULL_KANA, strict=True))
    table |= {} if options.preserve_case else dict(zip(text.ASCII_UPPER, text.ASCII_LOWER, strict=True))
    out: list[str] = []
    vu_open = False
    for c in raw:
        c = table.get(c, c)
        joined = (text.VOICED if c == text.VOICE else text.SEMI_VOICED if c == text.SEMI_VOICE else {}).get(out[-1] if out else "")
        if joined:
            out[-1], vu_open = joined, False
            continue
        if not options.preserve_vu and vu_open:
            for vu, small, row in text.VU_ROWS:
                if out[-1] == row[2] and vu_open == vu and c in small:
                    out[-1], c = row[small.index(c)], ""
        vu_open = False
        if not options.preserve_vu and c in ("ヴ", "ゔ"):
            vu_open = c
            c = "ブ" if c == "ヴ" else "ぶ"
        if c:
            out.append(c)
    return "".join(out)


def run_cost(kind: str, n: int) -> float:
    """The cost of a run of n characters of one class."""
    # All numbers below.
    if kind == "KANJI":
        return 1.4 if n == 1 else 1.0
    if kind == "KATAKANA":
        return {1: 2.5, 2: 2.0, 3: 1.3}.get(n, 1.0 if n <= 10 else 1.3)
    if kind == "ALPHABET":
        return 1.5 if n == 1 or n > 20 else 0.9 if n >= 8 else 1.2
    if kind == "DIGIT":
        return 0.8
    if kind == "HIRAGANA":
        return 2.0 if n == 1 else 1.4 if n <= 3 else 1.5 + (n - 3) * 0.5
    return 2.5


class Analyzer:
    """Segments texts with a dictionary and options; one a worker."""

    def __init__(self, entries: list[Entry] = (), options: Options = Options()):
        self.options = options
        self.entries: dict[str, list[Entry]] = defaultdict(list)
        for surface, pos, name, lemma in words.built_in() if options.built_in else ():
            self.entries[surface].append(Entry(surface, pos, lemma, False, name == "NOUN_形式", name))
        for e in entries:
            self.entries[e.surface].append(e)
        self.conjugating = {e.lemma or e.surface for es in self.entries.values() for e in es if e.pos in ("VERB", "ADJ")}
        #: How long words are that begin with a character or two, so that no longer stretch is looked up.
        self.longest: dict[str, int] = defaultdict(int)
        for w in self.entries:
            self.longest[w[:2]] = max(self.longest[w[:2]], len(w))
        self.connections = {(a, b): COARSE_COSTS[i][j] for i, a in enumerate(COARSE) for j, b in enumerate(COARSE)}
        for p in (*COARSE, "INTJ"):
            self.connections[("INTJ", p)] = self.connections[("OTHER", p if p != "INTJ" else "OTHER")]
            self.connections[(p, "INTJ")] = self.connections[(p if p != "INTJ" else "OTHER", "OTHER")]
        self.connections |= {k: v for k, v in options.connection.items() if k in self.connections and not {*k} - set(ORDER)}
        self.links = categories.links() | {k: v for k, v in options.connection.items() if {*k} - set(ORDER)}
        self.rules = categories.surface_rules()
        self.met: dict[tuple[str, str, str, str], float] = {}
        #: Whether no entry can stand in a span of the closed form, so that spans that it covers needn't be searched.
        self.plain = options.preserve_case and all(ODD.search(w) for w in self.entries)

    def word_cost(self, e: Entry) -> float:
        contracted = 1.0 if e.extended_pos == "VERB_未然" and e.surface[-1] in "ぬん" and len(e.surface) > 1 else 0.0  # 書かぬ is 書か and ぬ
        return categories.COST[e.extended_pos] + contracted + (self.options.user_bonus if e.user else 0.0)

    def link(self, before: Edge | None, e: Edge) -> float:
        """What e costs after before, or at the start."""
        if before is None:
            return START_COSTS.get(e.pos, 0.0) + START_CATEGORY_COSTS.get(e.extended_pos, 0.0)
        return self.connections.get((before.pos, e.pos), 0.0) + self.links.get((before.extended_pos, e.extended_pos), 0.0) + self.exceptions(before, e)

    def exceptions(self, before: Edge, e: Edge) -> float:
        """What the rules on surfaces add, remembered by both surfaces and categories."""
        if before.extended_pos not in self.rules:
            return 0.0
        key = (before.extended_pos, before.surface, e.extended_pos, e.surface)
        if key not in self.met:
            if len(self.met) > 100_000:
                self.met.clear()
            self.met[key] = sum(r.cost for r in self.rules[before.extended_pos] if r.holds(before.surface, e.extended_pos, e.surface))
        return self.met[key]

    # candidates

    def runs(self, s: str, kinds: list[str], at: int) -> list[Edge]:
        """Every prefix of the run of one class that begins here, up to the class's longest."""
        kind, first = kinds[at], s[at]
        noun_start = kind == "HIRAGANA" and first in NOUN_STARTS
        if (kind == "HIRAGANA" and first in NEVER_FIRST) or (kind == "KANJI" and first == "々"):
            return []
        end, most = at + 1, LONGEST.get(kind, LONGEST_OTHER)
        while end < len(s) and end - at < most:
            c, after = s[end], kinds[end + 1] if end + 1 < len(s) else None
            same = kinds[end] == kind
            if kind == "HIRAGANA" and c == "ー":
                same = after in (None, "HIRAGANA") or s[end + 1] == "ー"
            elif kind == "KANJI" and c in "ヶケ":
                same = after == "KANJI"
            if not same or (kind == "HIRAGANA" and (c in CASE_ENDS or (not noun_start and c in SOFT_ENDS))):
                break
            end += 1
        pos = "NOUN" if kind in ("KANJI", "KATAKANA", "ALPHABET", "DIGIT") or noun_start else "OTHER" if kind == "HIRAGANA" else "SYMBOL"
        out = []
        for stop in range(at + 1, end + 1):
            word = s[at:stop]
            cost = run_cost(kind, len(word))
            if kind == "KANJI" and len(word) > 1:
                cost += 4.0 * (word[-1] in "様氏") + 2.0 * (word[0] == "御")
            out.append(Edge(at, stop, word, pos, cost))
        return out

    def identifier(self, s: str, kinds: list[str], at: int) -> list[Edge]:
        """The longest stretch of letters, digits and inner underscores, if it mixes them."""
        end, seen = at, set()
        while end < len(s) and end - at < LONGEST_IDENTIFIER:
            if kinds[end] in ("ALPHABET", "DIGIT"):
                seen.add(kinds[end])
            elif s[end] == "_" and end + 1 < len(s) and kinds[end + 1] in ("ALPHABET", "DIGIT"):
                seen.add("_")
            else:
                break
            end += 1
        if "ALPHABET" in seen and len(seen) > 1 and end > at + 1:
            return [Edge(at, end, s[at:end], "NOUN", 0.5 if "_" in seen else 0.8)]
        return []

    def mixed(self, s: str, kinds: list[str], at: int) -> list[Edge]:
        """Letters before kanji or katakana, and digits before counting kanji, as one noun."""
        kind = kinds[at]
        end = at
        while end < len(s) and kinds[end] == kind and end - at < (12 if kind == "ALPHABET" else 8):
            end += 1
        if end == len(s):
            return []
        if kind == "ALPHABET" and kinds[end] in ("KANJI", "KATAKANA"):
            stop = end
            while stop < len(s) and kinds[stop] == kinds[end] and stop - end < 8:
                stop += 1
            return [Edge(at, stop, s[at:stop], "NOUN", self.options.letters_bonus)]
        out = []
        if kind == "DIGIT" and kinds[end] == "KANJI":
            stop = end
            while stop < len(s) and kinds[stop] == "KANJI" and stop - end < 3:
                stop += 1
                word = s[end:stop]
                if all(c in COUNTERS for c in word):
                    add = (-0.2, -0.2, 0.5)[len(word) - 1]
                elif word[0] in COUNTERS and word in self.entries:
                    add = -0.8
                else:
                    continue
                out.append(Edge(at, stop, s[at:stop], "NOUN", add))
        return out

    def drawn_out(self, s: str, e: Edge) -> list[Edge]:
        """A verb, adjective or auxiliary with the small vowels, っ and ー, or its own vowel twice or more, that someone drew it out with."""
        if e.pos not in ("VERB", "AUX", "ADJ") or e.end == len(s):
            return []
        out = []
        m = candidates.LONG_DRAWN.match(s, e.end) if e.surface[-1] not in "っー" else None
        if m and not (m.end() < len(s) and text.char_class(s[m.end()]) == "HIRAGANA"):
            out.append((m.end(), e.cost + 0.3 * len(m[0])))
        vowel, stop = candidates.VOWELS.get(e.surface[-1]), e.end
        while stop < len(s) and s[stop] == vowel:
            stop += 1
        if stop > e.end + 1:
            out.append((stop, e.cost - 0.5 + 0.05 * (stop - e.end)))
        return [Edge(e.start, stop, s[e.start : stop], e.pos, cost, e.lemma or e.surface, True, e.user, extended_pos=e.extended_pos) for stop, cost in out]

    def edges(self, s: str) -> list[list[Edge]]:
        """Candidates by where they begin, in the order in which equal costs are decided."""
        return list(self.each(s))

    def each(self, s: str) -> Iterator[list[Edge]]:
        """`edges` one place at a time, as a long run's are too many to hold."""
        kinds = [text.char_class(c) for c in s]
        for at, kind in enumerate(kinds):
            most = min(len(s) - at, max(1, self.longest.get(s[at : at + 2], 1)))
            known = [e for n in range(1, most + 1) for e in self.entries.get(s[at : at + n], ())]
            here = [Edge(at, at + len(e.surface), e.surface, e.pos, self.word_cost(e), e.lemma, True, e.user, e.formal, e.extended_pos) for e in known]
            here += [x for e in here for x in self.drawn_out(s, e)]
            reach = max((len(e.surface) for e in known), default=0)
            for e in self.runs(s, kinds, at) + (self.identifier(s, kinds, at) if kind in ("ALPHABET", "DIGIT") else []):
                single = kind == "KANJI" and reach == 1  # a kanji that is a word by itself begins many compounds
                more = BEYOND_DICTIONARY if reach and e.end - e.start > reach and not single else 0.0
                here.append(Edge(e.start, e.end, e.surface, e.pos, e.cost + more, extended_pos=categories.DEFAULT[e.pos]))
            if kind in ("KANJI", "HIRAGANA", "KATAKANA"):
                made = candidates.candidates(s, at, kind, self.conjugating.__contains__, self.options.mode != "split")
                here += [Edge(at, c.end, s[at : c.end], categories.POS_OF[c.category] if c.category != "UNKNOWN" else "AUX", c.cost, c.lemma, extended_pos=c.category) for c in made]
            if kind in ("ALPHABET", "DIGIT") and self.options.mode != "split":
                here += [Edge(e.start, e.end, e.surface, e.pos, e.cost, extended_pos=categories.DEFAULT[e.pos]) for e in self.mixed(s, kinds, at)]
            yield here or [Edge(at, at + 1, s[at], "OTHER", FALLBACK, extended_pos="OTHER")]

    def valid(self, edges: list[list[Edge]]) -> bool:
        """Whether some path of candidates leads from the start to the end."""
        reached = {0}
        for at, here in enumerate(edges):
            if at in reached:
                reached |= {e.end for e in here}
        return len(edges) in reached

    # search

    def path(self, s: str) -> list[Edge]:
        """The cheapest path: one predecessor is kept for each place and part of speech, the first of equals, in 32 bits."""
        single = np.float32
        states: list[dict[str, tuple]] = [{} for _ in range(len(s) + 1)]
        states[0]["UNKNOWN"] = (single(0), None, None)
        for at, here in enumerate(self.each(s)):
            reached = sorted(states[at].items(), key=lambda x: ORDER.index(x[0]))
            for e in here if reached else ():
                cost, later = single(e.cost), states[e.end]
                for tag, (so_far, before, _) in reached:
                    total = single(single(single(so_far + cost) + single(self.link(before, e))) + single(STEP))
                    if e.pos not in later or total < later[e.pos][0]:
                        later[e.pos] = (total, e, (at, tag))
        ends = sorted(states[len(s)].items(), key=lambda x: ORDER.index(x[0]))
        if not ends:  # candidates that don't reach the end, as a subclass may propose: all of it is one noun
            return [Edge(0, len(s), s, "NOUN", 0.0, extended_pos="NOUN")] if s else []
        tag, at, out = min(ends, key=lambda x: x[1][0])[0], len(s), []
        while at:
            _, e, (at, tag) = states[at][tag]
            out.append(e)
        return out[::-1]

    def segmented(self, s: str) -> list[Edge]:
        """The cheapest path over a span; where its closed form is known, nouns as there and all between them one symbol.

        In a span without odd characters only an over-long run needs a search, of its own: no candidate reaches beyond it,
        and before and after it stands a symbol or nothing.
        """
        if not self.plain or ODD.search(s):
            return self.path(normalized(s, self.options))
        out = []
        for m in CLOSED.finditer(s):
            if m[1] and LONG_RUN.search(m[0]):
                out += [replace(e, start=e.start + m.start(), end=e.end + m.start()) for e in self.path(m[0])]
            else:
                kind = "NOUN" if m[1] else "SYMBOL"
                out.append(Edge(m.start(), m.end(), m[0], kind, 0.0, extended_pos=kind))
        return out

    # whole texts

    def chunks(self, raw: str) -> list[str]:
        """raw in pieces of at most 32 KiB, broken after a sentence's end if the piece has one, and never in a run of letters
        and digits: one that is longer than 32 KiB is a piece of its own."""
        if len(raw.encode()) <= CHUNK_BYTES:
            return [raw]
        out, at = [], 0
        while at < len(raw):
            part = raw[at : at + CHUNK_BYTES].encode()[:CHUNK_BYTES].decode(errors="ignore")
            if at + len(part) < len(raw):
                ends = [m.end() for m in BREAKS.finditer(part)]
                part = part[: ends[-1]] if ends else raw[at : uncut(raw, at, at + len(part))]
            out.append(part)
            at += len(part)
        return out

    def spans(self, chunk: str) -> list[tuple[str, str | None, int]]:
        """(surface, kind or None, start) of tokens and spans, tiling chunk."""
        out, at = [], 0
        for m in PRETOKENS.finditer(chunk):
            if m.start() > at:
                out.append((chunk[at : m.start()], None, at))
            out.append((m[0], m.lastgroup, m.start()))
            at = m.end()
        return out + ([(chunk[at:], None, at)] if at < len(chunk) else [])

    def raw_morphemes(self, raw: str) -> list[Morpheme]:
        """Tokens are looked for in the whole of raw, so that none is cut; then spans between them are parted in pieces."""
        out = []
        for surface, kind, start in self.spans(raw):
            if kind:
                shown = surface.translate(DIGITS) if kind == "number" else surface
                out.append(Morpheme(shown, start, start + len(surface), "SYMBOL" if kind == "boundary" else "NOUN", shown, is_unknown=False, extended_pos="SYMBOL" if kind == "boundary" else "NOUN"))
                continue
            for part in self.chunks(surface):
                for e in self.segmented(part):
                    out.append(Morpheme(e.surface, start + e.start, start + e.end, e.pos, e.lemma or e.surface, e.known, e.user, e.formal, not e.known, e.extended_pos))
                start += len(part)
        return out

    def analyze(self, raw: str) -> list[Morpheme]:
        """Morphemes of raw, after the rewrites."""
        found = joined_numbers(nouns_after_prefixes(self.raw_morphemes(raw)))
        if self.options.lemmatize:
            found = nouns_with_mono([lemmas.completed(m, found[i + 1] if i + 1 < len(found) else None, self.conjugating) if m.pos in ("VERB", "ADJ") else m for i, m in enumerate(found)])
        if self.options.mode == "search" or (self.options.merge_compounds and self.options.mode != "split"):
            found = joined_nouns(found)
        found = joined_bars(found)
        return [m for m in found if not (self.options.remove_symbols and m.pos == "SYMBOL") and len(m.surface.encode()) >= self.options.least_bytes]


def uncut(raw: str, at: int, end: int) -> int:
    """The last place in raw up to end, and after at, where no run of letters and digits is cut; else that run's end."""
    start = end
    if WORD.match(raw, end):
        while start > at and WORD.match(raw[start - 1]):
            start -= 1
    return start if start > at else WORD.match(raw, at).end()


NUMERIC, LARGE_END, UNIT = re.compile("^[0-9０-９]"), re.compile("[兆億万千百]$"), re.compile(f"^(?:[{COUNTERS}]|[ァ-ヿ]{{1,5}}$)")


def joined(parts: list[Morpheme], pos: str | None = None) -> Morpheme:
    surface, first = "".join(m.surface for m in parts), parts[0]
    return Morpheme(surface, first.start, parts[-1].end, pos or first.pos, surface, first.is_dictionary, first.is_user_dict, first.is_formal_noun, first.is_unknown, first.extended_pos if pos is None else pos)


def nouns_after_prefixes(ms: list[Morpheme]) -> list[Morpheme]:
    """A verb after お, ご or 御 is a noun with its surface as lemma, unless a causative follows."""
    out = []
    for i, m in enumerate(ms):
        polite = i and ms[i - 1].pos == "PREFIX" and ms[i - 1].surface in ("お", "ご", "御")
        if polite and m.pos == "VERB" and not (i + 1 < len(ms) and ms[i + 1].extended_pos == "AUX_使役"):
            m = replace(m, pos="NOUN", lemma=m.surface, extended_pos="NOUN_転成")
        out.append(m)
    return out


def nouns_with_mono(ms: list[Morpheme]) -> list[Morpheme]:
    """A verb in the form that joins and the formal noun もの after it are one noun."""
    out: list[Morpheme] = []
    for m in ms:
        if m.surface == "もの" and m.is_formal_noun and out and out[-1].pos == "VERB" and out[-1].conj_form == "RENYOKEI":
            first = out.pop()
            m = Morpheme(first.surface + m.surface, first.start, m.end, "NOUN", first.surface + m.surface, is_unknown=first.is_unknown, extended_pos="NOUN")
        out.append(m)
    return out


def joined_numbers(ms: list[Morpheme]) -> list[Morpheme]:
    """Large numbers with what continues them, numbers with units, 間半目 after numbers, 数幾何 with a suffix; left to right."""
    out, i = [], 0
    while i < len(ms):
        m, after = ms[i], ms[i + 1] if i + 1 < len(ms) else None
        number = m.pos == "NOUN" and bool(NUMERIC.match(m.surface))
        if number and LARGE_END.search(m.surface):
            stop = i + 1
            while stop < len(ms) and ms[stop].pos == "NOUN" and NUMERIC.match(ms[stop].surface):
                stop += 1
                if not LARGE_END.search(ms[stop - 1].surface):
                    break
            out.append(joined(ms[i:stop]) if stop > i + 1 else m)
            i = stop
            continue
        unit = after and after.pos == "NOUN" and after.surface != "対" and m.surface[-1].isdigit() and UNIT.match(after.surface)
        if number and after and (unit or (after.pos == "NOUN" and after.surface in ("間", "半", "目"))):
            out.append(joined(ms[i : i + 2]))
            i += 2
        elif after and m.pos in ("NOUN", "PRON") and m.surface in ("数", "幾", "何") and after.pos == "SUFFIX":
            out.append(joined(ms[i : i + 2], "NOUN"))
            i += 2
        else:
            out.append(m)
            i += 1
    return out


def joined_nouns(ms: list[Morpheme]) -> list[Morpheme]:
    """Maximal runs of nouns that aren't formal nouns."""
    out: list[list[Morpheme]] = []
    for m in ms:
        if m.pos == "NOUN" and not m.is_formal_noun and out and out[-1][-1].pos == "NOUN" and not out[-1][-1].is_formal_noun:
            out[-1].append(m)
        else:
            out.append([m])
    return [parts[0] if len(parts) == 1 else Morpheme("".join(p.surface for p in parts), parts[0].start, parts[-1].end, "NOUN", "".join(p.lemma for p in parts), is_unknown=parts[0].is_unknown, extended_pos="NOUN") for parts in out]


def joined_bars(ms: list[Morpheme]) -> list[Morpheme]:
    """A single ー joins the token before whatever number of tokens of ー."""
    out: list[Morpheme] = []
    open_ = False
    for m in ms:
        if m.surface.strip("ー") == "" and m.surface and out and out[-1].pos != "SYMBOL":
            p = out[-1]
            out[-1] = replace(p, end=m.end) if open_ else replace(p, surface=p.surface + "ー", end=m.end, lemma=p.lemma + "ー" if p.lemma else p.lemma)
            open_ = True
        else:
            out.append(m)
            open_ = False
    return out
