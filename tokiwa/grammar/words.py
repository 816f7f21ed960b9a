"""The closed classes: words that every analyzer knows, whatever dictionary it is given."""

from __future__ import annotations

from tokiwa.grammar.categories import POS_OF

# Particles, single and compound, by category.
PARTICLES = {
    "PART_格": "が を に で と から まで より へ について における にて",
    "PART_係": "は も",
    "PART_係結": "こそ さえ すら",
    "PART_副": "でも しか かも ばかり だけ ほど くらい ぐらい など とか なんて",
    "PART_接続": "て で ば たら なら ながら のに ので けれど けど けども けれども し たり だり や によって により において として にとって に関して に際して に対して にわたって にわたり にあたって にあたり をめぐって をめぐり をもって",
    "PART_引用": "って",
    "PART_終": "か け な ね よ わ ぞ ぜ じゃん っけ かしら ってば ったら にゃ にゃん にゃー ゲソ げそ",
    "PART_準体": "の",
}
# Auxiliaries and the verbs and adjectives that stand as such: category, lemma, forms.
AUXILIARIES = (
    ("AUX_断定", "だ", "だ だっ で だったら な だろ じゃ じゃあ じゃろ"), ("AUX_丁寧断定", "です", "です でし でしたら でしょ"), ("VERB_終止", "ある", "ある"), ("VERB_音便", "ある", "あっ"), ("VERB_連用", "ある", "あり"), ("VERB_未然", "ある", "あろ"), ("VERB_仮定", "ある", "あれ"),
    ("AUX_丁寧", "ます", "ます まし ませ ましょ"), ("AUX_否定", "ない", "ない なかっ なけれ なかろ"), ("AUX_否定古", "ぬ", "ぬ ず ずに ずとも ざる ざれ"), ("AUX_否定古", "ん", "ん"), ("AUX_否定古", "まい", "まい"),
    ("ADV", "ごとし", "ごとく"), ("DET", "ごとし", "ごとき"), ("AUX_過去", "た", "た たら だ だら"), ("AUX_意志", "う", "う"), ("AUX_意志", "よう", "よう"), ("AUX_意志", "べし", "べき"),
    ("AUX_推定", "らしい", "らしい らしく らしかっ"), ("AUX_みたい", "みたい", "みたい"), ("AUX_様態", "そう", "そう"), ("ADJ_NA", "そう", "そう"), ("ADV", "そう", "そう"),
    ("AUX_受身", "れる", "れ れる"), ("AUX_受身", "られる", "られ られる"), ("AUX_可能", "える", "え える"), ("AUX_可能", "うる", "うる"), ("AUX_可能", "得る", "得"),
    ("VERB_連用", "する", "し"), ("VERB_終止", "する", "す"), ("VERB_未然", "する", "さ せ しよ"), ("VERB_仮定", "する", "すれ"), ("VERB_命令", "する", "しろ せよ"), ("AUX_様態", "する", "しそう"),
    ("VERB_連用", "来る", "来"), ("VERB_連用", "出る", "で"), ("AUX_使役", "せる", "せ せる せろ せよ"), ("AUX_使役", "させる", "させ させる させろ させよ"),
    ("AUX_願望", "たい", "たい たく たかっ たければ"), ("AUX_願望", "たがる", "たがる"), ("ADJ_終止", "いい", "いい"), ("ADJ_終止", "よい", "よい"), ("ADJ_け形", "よい", "よけれ"), ("ADJ_かっ", "よい", "よかっ"),
    ("ADJ_連用", "よい", "よく"), ("ADJ_語幹", "よい", "よ"), ("ADJ_終止", "ない", "ない"), ("ADJ_連用", "ない", "なく"), ("ADJ_かっ", "ない", "なかっ"), ("ADJ_語幹", "ない", "な"), ("ADJ_語幹", "無い", "無"), ("ADJ_連用", "無い", "無く"),
    ("ADJ_終止", "にくい", "にくい"), ("ADJ_連用", "にくい", "にくく"), ("ADJ_かっ", "にくい", "にくかっ"), ("ADJ_終止", "やすい", "やすい"), ("ADJ_連用", "やすい", "やすく"), ("ADJ_かっ", "やすい", "やすかっ"),
    ("ADJ_終止", "っぽい", "っぽい"), ("ADJ_連用", "っぽい", "っぽく"), ("ADJ_かっ", "っぽい", "っぽかっ"),
    ("AUX_尊敬", "なさる", "なさい"), ("AUX_丁重", "ござる", "ござい"), ("VERB_音便", "ござる", "ござっ"), ("VERB_連用", "ござる", "ござい"), ("VERB_連用", "いたす", "いたし"), ("VERB_連用", "いただく", "いただき"),
    ("VERB_連用", "くださる", "ください"), ("VERB_連用", "下さる", "下さい"), ("VERB_終止", "くださる", "くださいませ"), ("VERB_連用", "いらっしゃる", "いらっしゃい"), ("VERB_連用", "なさる", "なさい"), ("VERB_連用", "おっしゃる", "おっしゃい"),
    ("AUX_継続", "いる", "い いる"), ("AUX_継続", "おる", "おる おり"), ("AUX_接近", "くれる", "くれる くれ"), ("AUX_過度", "すぎる", "すぎる すぎ"), ("AUX_ガル", "がる", "がる がら がり がっ がれ がろ"),
    ("AUX_完了", "しまう", "しまう しまっ しまい"), ("AUX_継続", "てる", "てる て でる"), ("AUX_準備", "とく", "とく とい"), ("AUX_準備", "どく", "どく どい"), ("VERB_終止", "ちゃう", "ちゃう"), ("VERB_音便", "ちゃう", "ちゃっ"),
    ("VERB_連用", "ちゃう", "ちゃい"), ("VERB_終止", "じゃう", "じゃう"), ("VERB_音便", "じゃう", "じゃっ"), ("VERB_連用", "じゃう", "じゃい"), ("VERB_終止", "いく", "いく"), ("VERB_未然", "いく", "いか"),
    ("VERB_終止", "ゆく", "ゆく"), ("VERB_連用", "ゆく", "ゆき"), ("VERB_未然", "ゆく", "ゆか"), ("VERB_命令", "ゆく", "ゆけ"), ("AUX_接近", "くる", "くる き"),
)
# What characters of fiction, dialects and the old days end a sentence in: lemma, forms.
SPEECH = (
    ("ある", "ありんす ありんした ありんせん ざんす ざんせん"), ("だ", "でありんす でありんした ぴょん ピョン ござる でござる ナリ なり でナリ でなり ぜよ だべ やんけ や やねん だっちゃ ばい だわ"), ("ます", "なんし なんした ますの マス"), ("だよ", "だにゃ だにゃん"),
    ("ですよ", "ですにゃ ですにゃん"), ("です", "ですわ ですの っす でございます デス"), ("でした", "っした"), ("ですか", "っすか"), ("だった", "ござった でござった"), ("ではない", "ござらぬ ござらん"), ("のだ", "のじゃ"),
)
PREFIXES = "お ご 御"
SUFFIXES = "さ さん ちゃん くん さま たん にゃん っ娘 たち ら ごと まみれ だらけ っぱなし"
# Conjunctions, words before nouns, pronouns, adverbs, nouns without a meaning of their own, interjections.
CONJUNCTIONS = (
    "従って 故に そして それから それで だから そのため したがって=従って しかし だが けれども だけど ところが それでも でも だって どころか ものの 又 及び 並びに 且つ かつ=且つ 更に 次に しかも そのうえ 或いは 若しくは または それとも "
    "あるいは=或いは もしくは=若しくは 即ち 例えば 但し 尚 つまり たとえば なぜなら ちなみに まして さて ところで それでは のみならず いわば=言わば 言わば さもないと さもなければ それにしても いずれにしても いずれにせよ"
)
DETERMINERS = "この その あの どの こんな そんな あんな どんな ある あらゆる いかなる いわゆる おかしな 同じ こういう そういう ああいう どういう という といった っていう 大きな 小さな 我が かかる かの"
PRONOUNS = (
    "私 僕 俺 わたくし あたし あたい あちき わし おいら 我々 貴方 君 あなた お前 彼 彼女 彼氏 奴 我 われ 拙者 貴殿 某 我輩 吾輩 皆 みんな これ ここ こちら こっち そっち あっち どっち それ そこ そちら あれ あそこ あちら "
    "こいつ そいつ あいつ どいつ どれ どこ どちら 誰 何 いつ いくつ いくら"
)
ADVERBS = "ともかく どう いかが どうして なぜ かく なんと なんとか とても かなり すごく ちょっと もっと ずっと やっと きっと ちょうど まだ 改めて"
ASKING = "どう いかが"
FORMAL_NOUNS = "事=こと こと 物=もの もの 為 ところ 時 内 通り 限り 付け 付 よう ほう わけ はず つもり まま ほか 他=ほか 仕方 ありきたり たたずまい うだつ"
INTERJECTIONS = "えっ ええ あっ ああ おお うわ うわっ わあ へえ ふーん ふうん おい おーい あれ あれっ まあ ねえ はい いいえ うん ううん えーと えっと あの その"
#: Families of one category, each word with its lemma after = if that is another.
FAMILIES = (
    ("PREFIX", PREFIXES), ("SUFFIX", SUFFIXES), ("CONJ", CONJUNCTIONS), ("DET", DETERMINERS), ("PRON", PRONOUNS), ("ADV", ADVERBS), ("ADJ_NA", ASKING), ("NOUN_形式", FORMAL_NOUNS), ("INTJ", INTERJECTIONS),
)


def built_in() -> list[tuple[str, str, str, str]]:
    """(surface, part of speech, category, lemma) of every built-in word, in the order in which equal costs are decided."""
    rows = [(w, "PARTICLE", name, w) for name, words in PARTICLES.items() for w in words.split()]
    rows.append(("ん", "PARTICLE", "PART_準体", "の"))
    rows += [(w, POS_OF[name], name, lemma) for name, lemma, words in AUXILIARIES for w in words.split()]
    rows += [(w, "AUX", "UNKNOWN", lemma) for lemma, words in SPEECH for w in words.split()]
    rows += [(w.split("=")[0], POS_OF[name], name, w.split("=")[-1]) for name, words in FAMILIES for w in words.split()]
    return rows
