"""Dictionary forms, conjugation types and forms of verbs and adjectives, after the search has decided on their words."""

from __future__ import annotations

from collections.abc import Container
from dataclasses import replace
from typing import TYPE_CHECKING

from tokiwa.grammar import conjugation, inflection

if TYPE_CHECKING:
    from tokiwa.operators.lattice import Morpheme

# The form that each category shows.
FORM_OF = {
    "VERB_終止": "BASE", "VERB_連用": "RENYOKEI", "VERB_未然": "MIZENKEI", "VERB_音便": "ONBINKEI", "VERB_て形": "ONBINKEI", "VERB_仮定": "KATEIKEI", "VERB_命令": "MEIREIKEI", "VERB_連体": "BASE", "VERB_た形": "ONBINKEI", "VERB_たら形": "ONBINKEI",
    "ADJ_終止": "BASE", "ADJ_連用": "RENYOKEI", "ADJ_語幹": "BASE", "ADJ_かっ": "ONBINKEI", "ADJ_け形": "KATEIKEI", "ADJ_NA": "BASE", "AUX_過度": "BASE", "AUX_ガル": "BASE",
}
LEAST_KNOWN, LEAST_UNKNOWN = 0.3, 0.5


def verified(surface: str, after: str, known: Container[str]) -> str | None:
    """The likeliest dictionary form of a surface before `after`: one that the dictionary has if there is one."""
    found = [r for r in inflection.inflect(surface + after) if r.confidence > LEAST_KNOWN] if after else []
    found += [r for r in inflection.inflect(surface) if r.confidence > LEAST_KNOWN]
    for r in found:
        if r.base in known:
            return r.base
    return next((r.base for r in found if r.confidence >= LEAST_UNKNOWN), None)


def conj_form(surface: str, lemma: str, category: str, after: str | None) -> str:
    """The form of a verb or adjective; う after it makes it the form of intent."""
    if after == "う" and category == "VERB_未然":
        return "ISHIKEI"
    if surface == lemma:
        return "BASE"
    return FORM_OF.get(category, "BASE")


def completed(m: Morpheme, after: Morpheme | None, known: Container[str]) -> Morpheme:
    """m, a verb or adjective, with its lemma, conjugation type and form."""
    lemma = m.lemma
    if lemma == m.surface and not m.is_dictionary and m.extended_pos not in ("VERB_終止", "ADJ_終止", "ADJ_NA"):
        lemma = verified(m.surface, after.surface if after and after.pos in ("AUX", "PARTICLE") else "", known) or lemma
    kind = "NA_ADJ" if m.extended_pos == "ADJ_NA" else "ICHIDAN" if lemma[-1:] == "る" and lemma[:-1] and lemma[:-1] in inflection.BARE_ICHIDAN else conjugation.detect_type(lemma)
    return replace(m, lemma=lemma, conj_type=kind, conj_form=conj_form(m.surface, lemma, m.extended_pos, after.surface if after else None))
