"""Fine-grained categories: names, parts of speech, costs of words, and costs of one category after another."""

from __future__ import annotations

from dataclasses import dataclass

# The 67 categories as they are written out, by part of speech, with the cost of a word of each.
CATEGORIES: dict[str, dict[str, float]] = {
    "OTHER": {"UNKNOWN": 2.0, "OTHER": 0.8},
    "VERB": {
        "VERB_終止": 0.5, "VERB_連用": 0.4, "VERB_未然": 0.4, "VERB_音便": 0.4, "VERB_て形": 0.4, "VERB_仮定": 0.5, "VERB_命令": 0.5, "VERB_連体": 0.5, "VERB_た形": 0.5, "VERB_たら形": 0.5,
        "AUX_過度": 0.5, "AUX_ガル": 0.5,
    },
    "ADJ": {"ADJ_終止": 0.5, "ADJ_連用": 0.4, "ADJ_語幹": 0.4, "ADJ_かっ": 0.4, "ADJ_け形": 0.5, "ADJ_NA": 0.5},
    "AUX": {
        "AUX_過去": 0.2, "AUX_丁寧": 0.2, "AUX_否定": 0.3, "AUX_否定古": 0.4, "AUX_願望": 0.3, "AUX_意志": 0.3, "AUX_受身": 0.3, "AUX_使役": 0.3, "AUX_可能": 0.3, "AUX_継続": 0.3, "AUX_完了": 0.3,
        "AUX_準備": 0.3, "AUX_試行": 0.3, "AUX_進行": 0.3, "AUX_接近": 0.3, "AUX_様態": 0.4, "AUX_推定": 0.4, "AUX_みたい": 0.4, "AUX_断定": 0.2, "AUX_丁寧断定": 0.2, "AUX_尊敬": 0.3, "AUX_丁重": 0.4,
    },
    "PARTICLE": {"PART_格": 0.2, "PART_係": 0.2, "PART_終": 0.3, "PART_接続": 0.3, "PART_引用": 0.3, "PART_副": 0.3, "PART_準体": 0.2, "PART_係結": 0.3},
    "NOUN": {"NOUN": 0.5, "NOUN_形式": 0.4, "NOUN_転成": 0.5, "NOUN_固有": 0.5, "NOUN_姓": 0.3, "NOUN_名": 0.3, "NOUN_数": 0.4},
    "PRON": {"PRON": 0.4, "PRON_疑問": 0.4},
    "ADV": {"ADV": 0.5, "ADV_引用": 0.4},
    "CONJ": {"CONJ": 0.4}, "DET": {"DET": 0.4}, "PREFIX": {"PREFIX": 0.5}, "SUFFIX": {"SUFFIX": 0.5}, "SYMBOL": {"SYMBOL": 0.3}, "INTJ": {"INTJ": 0.5},
}
COST = {name: cost for group in CATEGORIES.values() for name, cost in group.items()}
POS_OF = {name: pos for pos, group in CATEGORIES.items() for name in group}
# The category of a word of which only the part of speech is known.
DEFAULT = {
    "NOUN": "NOUN", "VERB": "VERB_終止", "ADJ": "ADJ_終止", "ADV": "ADV", "PARTICLE": "PART_格", "AUX": "AUX_過去", "CONJ": "CONJ", "DET": "DET", "PRON": "PRON", "PREFIX": "PREFIX", "SUFFIX": "SUFFIX",
    "SYMBOL": "SYMBOL", "INTJ": "INTJ", "OTHER": "OTHER",
}
# The scale of costs between categories.
NEVER, SEVERE, VERY_RARE, STRONG, RARE, MINOR, UNCOMMON, LITTLE = 3.0, 2.5, 1.8, 1.5, 1.0, 0.5, 0.4, 0.2
SLIGHT, MODERATE, GOOD, BETTER, BEST, CERTAIN, NOUN_NEXT = -0.25, -0.5, -0.8, -1.0, -1.6, -2.0, -2.5

VERBS = "VERB_終止 VERB_連用 VERB_未然 VERB_音便 VERB_仮定 VERB_命令 VERB_た形 VERB_たら形"
ASPECTS = "AUX_継続 AUX_完了 AUX_準備 AUX_試行 AUX_進行 AUX_接近"
PARTICLES = " ".join(CATEGORIES["PARTICLE"])
COPULAS = "AUX_断定 AUX_丁寧断定"

#: What one category before another adds: (those before, those after, cost). A later rule overrides an earlier one.
RULES: tuple[tuple[str, str, float], ...] = (
    # the form of a verb asks for its auxiliary
    ("VERB_連用", "AUX_丁寧 AUX_願望 AUX_尊敬 AUX_否定 AUX_受身 AUX_可能 AUX_準備 AUX_完了 SUFFIX", GOOD),
    ("VERB_連用", "AUX_否定古 PART_接続 AUX_使役 AUX_過度", MODERATE),
    ("VERB_連用 VERB_終止", "PART_副", SLIGHT),
    ("VERB_連用", "AUX_様態", BEST),
    ("VERB_連用", "VERB_音便", LITTLE),
    ("VERB_未然", "AUX_否定 AUX_否定古 AUX_受身 AUX_使役 AUX_意志 VERB_未然", MODERATE),
    ("VERB_未然", "CONJ PART_終", VERY_RARE),
    ("VERB_音便", "AUX_過去 AUX_完了 PART_接続", GOOD),
    ("VERB_音便", "AUX_準備", MODERATE),
    ("VERB_て形", ASPECTS, MODERATE),
    ("VERB_て形", "AUX_継続", UNCOMMON),
    ("VERB_終止", "PART_準体 AUX_様態 AUX_みたい AUX_意志", GOOD),
    ("VERB_終止", "AUX_推定", MODERATE),
    ("VERB_終止", "PART_終", SLIGHT),
    ("VERB_終止", "AUX_丁寧 AUX_願望 AUX_過去", NEVER),
    ("VERB_仮定 ADJ_け形", "PART_接続", GOOD),
    ("VERB_仮定", "ADJ_終止", GOOD),
    ("VERB_連用 VERB_た形 ADJ_終止 AUX_断定", "VERB_未然", VERY_RARE),
    # adjectives
    ("ADJ_連用", "AUX_否定", CERTAIN),
    ("ADJ_連用", "PART_接続 VERB_連用", GOOD),
    ("ADJ_連用", "VERB_音便", MODERATE),
    ("ADJ_かっ", "AUX_過去", GOOD),
    ("ADJ_終止", "AUX_丁寧断定 PART_終 NOUN NOUN_形式 AUX_みたい", MODERATE),
    ("ADJ_終止", "PART_接続 PART_準体", SLIGHT),
    ("ADJ_終止", "AUX_推定", GOOD),
    ("ADJ_語幹", "AUX_みたい AUX_推定 ADJ_終止 VERB_連用 VERB_終止 VERB_未然 VERB_た形 VERB_たら形 AUX_継続 AUX_否定 OTHER", NEVER),
    ("ADJ_語幹", "AUX_様態", BEST),
    ("ADJ_語幹 ADJ_NA", "AUX_過度", MODERATE),
    ("ADJ_語幹", "AUX_ガル", MODERATE),
    ("ADJ_語幹", "SUFFIX", GOOD),
    ("ADJ_NA", COPULAS, GOOD),
    ("ADJ_NA", "AUX_継続", NEVER),
    # auxiliaries after auxiliaries
    ("AUX_丁寧 AUX_断定 AUX_丁寧断定 AUX_否定 AUX_受身", "AUX_過去 AUX_意志", GOOD),
    ("AUX_丁寧", "AUX_否定古", GOOD),
    ("AUX_断定 AUX_受身 AUX_継続 AUX_丁重", "AUX_丁寧", GOOD),
    ("AUX_断定", "NOUN NOUN_形式 AUX_断定 PART_接続", GOOD),
    ("AUX_断定", "PART_係 AUX_否定 AUX_丁重", MODERATE),
    ("AUX_断定", "AUX_接近", NEVER),
    ("AUX_断定", "VERB_音便", MINOR),
    ("AUX_断定", "VERB_連用 VERB_終止", MINOR),
    ("AUX_使役", "AUX_受身", GOOD),
    ("AUX_受身", "AUX_否定 AUX_願望", GOOD),
    ("AUX_受身", "PART_接続", MODERATE),
    ("AUX_可能", "AUX_否定", BETTER),
    ("AUX_否定", "PART_準体 PART_接続", GOOD),
    ("AUX_否定古", "AUX_過去 AUX_丁寧断定 PART_係", GOOD),
    ("AUX_願望 AUX_準備", "AUX_過去", GOOD),
    ("AUX_願望", "AUX_否定", MODERATE),
    ("AUX_継続", "AUX_過去 AUX_受身", MODERATE),
    ("AUX_継続", "VERB_終止", RARE),
    ("AUX_準備", "AUX_意志 PART_引用", VERY_RARE),
    ("AUX_完了", "AUX_様態", GOOD),
    ("AUX_みたい", "AUX_断定", GOOD),
    ("AUX_意志", "PART_格", SLIGHT),
    ("AUX_意志", "PART_接続", STRONG),
    ("AUX_過去", "VERB_音便 VERB_た形 VERB_たら形 AUX_過去 AUX_丁寧 AUX_否定 AUX_否定古 AUX_接近", NEVER),
    ("AUX_過去", "AUX_丁寧断定 NOUN PRON", MODERATE),
    ("AUX_過去", "DET", SEVERE),
    ("AUX_過去 AUX_丁寧 AUX_断定 AUX_丁寧断定", "PART_終", SLIGHT),
    # nouns and what belongs to them
    ("NOUN PRON NOUN_形式", "PART_副", GOOD),
    ("NOUN", "PART_係", SLIGHT),
    ("NOUN", "ADJ_NA AUX_推定", GOOD),
    ("NOUN", "VERB_連用 AUX_断定 AUX_丁寧断定 AUX_否定 AUX_みたい", MODERATE),
    ("NOUN", "AUX_使役 AUX_受身", STRONG),
    ("NOUN", "AUX_継続", RARE),
    ("NOUN", "AUX_接近", 5.0),
    ("NOUN_形式", "AUX_断定 AUX_否定", MODERATE),
    ("NOUN_形式", "AUX_丁寧断定", GOOD),
    ("NOUN_形式", "ADJ_終止", BEST),
    ("PRON", "PART_格 AUX_丁寧断定", MODERATE),
    ("PRON", "ADV", RARE),
    ("PRON PART_格", "DET", STRONG),
    ("DET", "NOUN NOUN_形式 NOUN_固有 PART_準体 ADJ_終止 ADJ_連用", NOUN_NEXT),
    ("PREFIX", "NOUN VERB_連用", GOOD),
    ("SUFFIX", "AUX_様態 PART_格 VERB_連用 VERB_終止 NOUN", MODERATE),
    ("SUFFIX", "AUX_断定", GOOD),
    ("SUFFIX", "CONJ", RARE),
    ("SUFFIX", "ADV", VERY_RARE),
    # particles
    ("PART_接続", ASPECTS, GOOD),
    ("PART_接続", "ADJ_終止", MODERATE),
    ("PART_接続", "VERB_終止 OTHER", UNCOMMON),
    ("PART_準体", "AUX_丁寧断定 AUX_断定 NOUN", GOOD),
    ("PART_準体", "AUX_過去", NEVER),
    ("PART_格", "ADV OTHER", RARE),
    ("PART_格", "PRON", SLIGHT),
    ("PART_格", "PART_格", VERY_RARE),
    ("PART_副", "PART_格 PART_準体", BEST),
    ("PART_副", "VERB_連用 VERB_終止", GOOD),
    ("PART_係", "PRON", MODERATE),
    ("PART_係", "VERB_連用 ADJ_終止", SLIGHT),
    ("PART_係", "PART_接続 PART_格 OTHER", RARE),
    ("PART_係", "PART_係", VERY_RARE),
    ("PART_終", "VERB_終止 VERB_未然", VERY_RARE),
    ("PART_終", "VERB_音便", RARE),
    ("PART_終", "PART_終", SLIGHT),
    ("PART_終", "PART_準体", MODERATE),
    ("PART_終", "OTHER", RARE),
    ("PART_格 PART_副 PART_係 OTHER PART_引用", "AUX_様態", MINOR),
    ("PART_格 PART_副 PART_係 PART_終 PART_接続 PART_準体 PART_引用", "INTJ", NEVER),
    # the rest
    ("ADV", COPULAS, RARE),
    ("ADV", "INTJ ADJ_終止 ADJ_連用 ADJ_NA ADJ_かっ", GOOD),
    ("ADV", "PART_係", SLIGHT),
    ("ADV", "NOUN VERB_連用 VERB_終止 VERB_た形", MODERATE),
    ("ADV", "ADJ_語幹", VERY_RARE),
    ("CONJ", "AUX_否定", VERY_RARE),
    ("CONJ", "PART_終", RARE),
    ("CONJ", "VERB_終止 VERB_連用 ADJ_終止 ADJ_語幹 ADJ_連用", GOOD),
    ("INTJ", "AUX_丁重", GOOD),
    ("OTHER", "AUX_進行", RARE),
)


@dataclass(frozen=True)
class SurfaceRule:
    """What is added between two words by category and surface. Empty: any; a leading ! : any but these."""

    before: str
    surfaces_before: str
    after: str
    surfaces_after: str
    cost: float

    @staticmethod
    def among(surface: str, surfaces: str) -> bool:
        return not surfaces or (surface in surfaces.strip("!").split()) != surfaces.startswith("!")

    def holds(self, surface_before: str, after: str, surface_after: str) -> bool:
        return (not self.after or after in self.after.split()) and self.among(surface_before, self.surfaces_before) and self.among(surface_after, self.surfaces_after)


#: Exceptions that hang on surfaces, on top of RULES.
SURFACE_RULES = (
    SurfaceRule("VERB_連用", "", "ADJ_終止 ADJ_連用 ADJ_かっ", "やすい やすく やすかっ にくい にくく にくかっ づらい づらく", CERTAIN),
    SurfaceRule("VERB_連用", "", "AUX_受身 AUX_使役", "れ れる せ せる", -CERTAIN),
    SurfaceRule("PART_準体", "", "", "で", STRONG),
    SurfaceRule("PART_接続", "!て で", "AUX_継続 AUX_接近 AUX_完了", "", -CERTAIN),
    SurfaceRule("PART_接続", "", "AUX_継続", "て てる", -CERTAIN),
    SurfaceRule("PART_接続", "", "PART_接続", "", RARE),
    SurfaceRule("AUX_否定古", "ず", "PART_格", "に", -GOOD),
    SurfaceRule("ADJ_終止 ADJ_連用", "", "AUX_継続", "", STRONG),
    SurfaceRule("NOUN NOUN_形式 NOUN_数", "", "AUX_断定", "で", 0.6),
    SurfaceRule("NOUN NOUN_形式", "", "PART_接続", "し", RARE),
    SurfaceRule("AUX_断定", "で", "VERB_終止 VERB_連用 VERB_音便 VERB_未然", "ある あり あっ あろ", CERTAIN),
    SurfaceRule("AUX_断定", "で", "ADJ_終止 AUX_否定", "ない なかっ", MODERATE),
    SurfaceRule("AUX_断定", "で", "NOUN NOUN_形式 NOUN_数 PRON PREFIX", "", -GOOD),
    SurfaceRule("PART_接続", "て で", "VERB_連用", "い", -GOOD),
    SurfaceRule("VERB_音便", "", "PART_接続", "たら だら", -MODERATE),
)


def surface_rules() -> dict[str, list[SurfaceRule]]:
    """SURFACE_RULES by the category before."""
    out: dict[str, list[SurfaceRule]] = {}
    for rule in SURFACE_RULES:
        for name in rule.before.split():
            out.setdefault(name, []).append(rule)
    return out


def links() -> dict[tuple[str, str], float]:
    """RULES as (before, after) -> cost; pairs that no rule names cost nothing."""
    return {(a, b): cost for before, after, cost in RULES for a in before.split() for b in after.split()}


def category(surface: str, pos: str, conj_type: str = "") -> str:
    """The category of a dictionary row that doesn't conjugate."""
    if pos == "ADJ" and (conj_type == "NA_ADJ" or not surface.endswith("い")):
        return "ADJ_NA"
    return {"FAMILY": "NOUN_姓", "GIVEN": "NOUN_名", "INTERJECTION": "INTJ"}.get(conj_type or "", DEFAULT.get(pos, "OTHER"))
