"""DuckDB SQL for the queries of `tokiwa.plans.japanese`: computed apart where SQL can, else lists of what is expected."""

from __future__ import annotations

from tokiwa.plans import samples

# Rows that queries over samples are expected to give, checked against the rules by hand (golden checks); cells
# are parted by |, ~ is null, T and F are true and false, \\t a tab.
EXPECTED = {
    "normalize_kana": ("sample_id INTEGER, normal VARCHAR, without_vu VARCHAR", r"""
0|ガギグ パピプ|ガギグ パピプ
1|ヴァイオリン|ヴァイオリン
2|ヴァイオリンとヴェール|バイオリンとベール
3|ABC123xyz|ABC123xyz
4|ヷ ワールド|ヷ ワールド
5|ゔぁいおりん ゔ|ばいおりん ぶ
6|アﾞ ﾟ ﾞ|アﾞ ﾟ ﾞ
7|ガギパ|ガギパ
8|ヴ ヴヮ|ブ ブヮ
9|plain text|plain text
"""),
    "utf8_validity": ("sample_id INTEGER, is_valid BOOLEAN, no_text BOOLEAN, n_chars INTEGER", r"""
0|T|F|1
1|T|F|1
2|F|T|~
3|F|T|~
4|F|T|~
5|F|T|~
6|T|F|1
7|F|T|~
8|T|F|1
9|T|F|0
"""),
    "category_table": ("category VARCHAR, pos VARCHAR, cost DOUBLE", r"""
ADJ_NA|ADJ|0.5
ADJ_かっ|ADJ|0.4
ADJ_け形|ADJ|0.5
ADJ_終止|ADJ|0.5
ADJ_語幹|ADJ|0.4
ADJ_連用|ADJ|0.4
ADV|ADV|0.5
ADV_引用|ADV|0.4
AUX_みたい|AUX|0.4
AUX_ガル|VERB|0.5
AUX_丁寧|AUX|0.2
AUX_丁寧断定|AUX|0.2
AUX_丁重|AUX|0.4
AUX_使役|AUX|0.3
AUX_受身|AUX|0.3
AUX_可能|AUX|0.3
AUX_否定|AUX|0.3
AUX_否定古|AUX|0.4
AUX_完了|AUX|0.3
AUX_尊敬|AUX|0.3
AUX_意志|AUX|0.3
AUX_接近|AUX|0.3
AUX_推定|AUX|0.4
AUX_断定|AUX|0.2
AUX_様態|AUX|0.4
AUX_準備|AUX|0.3
AUX_継続|AUX|0.3
AUX_試行|AUX|0.3
AUX_進行|AUX|0.3
AUX_過去|AUX|0.2
AUX_過度|VERB|0.5
AUX_願望|AUX|0.3
CONJ|CONJ|0.4
DET|DET|0.4
INTJ|INTJ|0.5
NOUN|NOUN|0.5
NOUN_名|NOUN|0.3
NOUN_固有|NOUN|0.5
NOUN_姓|NOUN|0.3
NOUN_形式|NOUN|0.4
NOUN_数|NOUN|0.4
NOUN_転成|NOUN|0.5
OTHER|OTHER|0.8
PART_係|PARTICLE|0.2
PART_係結|PARTICLE|0.3
PART_副|PARTICLE|0.3
PART_引用|PARTICLE|0.3
PART_接続|PARTICLE|0.3
PART_格|PARTICLE|0.2
PART_準体|PARTICLE|0.2
PART_終|PARTICLE|0.3
PREFIX|PREFIX|0.5
PRON|PRON|0.4
PRON_疑問|PRON|0.4
SUFFIX|SUFFIX|0.5
SYMBOL|SYMBOL|0.3
UNKNOWN|OTHER|2.0
VERB_たら形|VERB|0.5
VERB_た形|VERB|0.5
VERB_て形|VERB|0.4
VERB_仮定|VERB|0.5
VERB_命令|VERB|0.5
VERB_未然|VERB|0.4
VERB_終止|VERB|0.5
VERB_連体|VERB|0.5
VERB_連用|VERB|0.4
VERB_音便|VERB|0.4
"""),
    "default_categories": ("pos VARCHAR, category VARCHAR, taggable BOOLEAN", r"""
ADJ|ADJ_終止|T
ADV|ADV|T
AUX|AUX_過去|F
CONJ|CONJ|F
DET|DET|F
INTJ|INTJ|F
NOUN|NOUN|T
OTHER|OTHER|F
PARTICLE|PART_格|F
PREFIX|PREFIX|F
PRON|PRON|F
SUFFIX|SUFFIX|F
SYMBOL|SYMBOL|F
VERB|VERB_終止|T
"""),
    "pos_names": ("name VARCHAR, pos VARCHAR, pos_ja VARCHAR, is_content BOOLEAN, is_function BOOLEAN", r"""
ADJ|ADJ|形容詞|T|F
ADV|ADV|副詞|T|F
AUX|AUX|助動詞|F|T
Adjective|ADJ|形容詞|T|F
Adverb|ADV|副詞|T|F
Auxiliary|AUX|助動詞|F|T
CONJ|CONJ|接続詞|F|F
Conjunction|CONJ|接続詞|F|F
DET|DET|連体詞|F|F
Determiner|DET|連体詞|F|F
INTJ|INTJ|感動詞|F|F
Interjection|INTJ|感動詞|F|F
NOUN|NOUN|名詞|T|F
Noun|NOUN|名詞|T|F
OTHER|OTHER|その他|F|F
Other|OTHER|その他|F|F
PARTICLE|PARTICLE|助詞|F|T
PREFIX|PREFIX|接頭辞|F|F
PRON|PRON|代名詞|F|F
Particle|PARTICLE|助詞|F|T
Prefix|PREFIX|接頭辞|F|F
Pronoun|PRON|代名詞|F|F
SUFFIX|SUFFIX|接尾辞|F|F
SYMBOL|SYMBOL|記号|F|F
Suffix|SUFFIX|接尾辞|F|F
Symbol|SYMBOL|記号|F|F
VERB|VERB|動詞|T|F
Verb|VERB|動詞|T|F
nonsense|OTHER|その他|F|F
その他|OTHER|その他|F|F
代名詞|PRON|代名詞|F|F
副詞|ADV|副詞|T|F
助動詞|AUX|助動詞|F|T
助詞|PARTICLE|助詞|F|T
動詞|VERB|動詞|T|F
名詞|NOUN|名詞|T|F
形容詞|ADJ|形容詞|T|F
感動詞|INTJ|感動詞|F|F
接尾辞|SUFFIX|接尾辞|F|F
接続詞|CONJ|接続詞|F|F
接頭辞|PREFIX|接頭辞|F|F
記号|SYMBOL|記号|F|F
連体詞|DET|連体詞|F|F
"""),
    "dictionary_pos_names": ("name VARCHAR, pos VARCHAR", r"""
 NOUN |NOUN
ADJ|ADJ
ADJECTIVE|ADJ
ADNOMINAL|DET
ADV|ADV
ADVERB|ADV
AUX|AUX
AUXILIARY|AUX
CITY|~
CONJ|CONJ
CONJUNCTION|CONJ
DET|DET
DETERMINER|DET
INTERJECTION|INTJ
INTJ|INTJ
NOUN|NOUN
OTHER|OTHER
PARTICLE|PARTICLE
PHRASE|OTHER
PREFIX|PREFIX
PRON|PRON
PRONOUN|PRON
PROPER_NOUN|NOUN
PROPN|NOUN
SUFFIX|SUFFIX
SYM|SYMBOL
SYMBOL|SYMBOL
VERB|VERB
動詞|VERB
"""),
    "conjugation_names": ("name VARCHAR, en VARCHAR, ja VARCHAR, of VARCHAR", r"""
BASE|base|終止形|form
GODAN_BA|godan-ba|五段・バ行|type
GODAN_GA|godan-ga|五段・ガ行|type
GODAN_KA|godan-ka|五段・カ行|type
GODAN_MA|godan-ma|五段・マ行|type
GODAN_NA|godan-na|五段・ナ行|type
GODAN_RA|godan-ra|五段・ラ行|type
GODAN_SA|godan-sa|五段・サ行|type
GODAN_TA|godan-ta|五段・タ行|type
GODAN_WA|godan-wa|五段・ワ行|type
ICHIDAN|ichidan|一段|type
ISHIKEI|ishikei|意志形|form
I_ADJ|i-adj|形容詞|type
KATEIKEI|kateikei|仮定形|form
KURU|kuru|カ変|type
MEIREIKEI|meireikei|命令形|form
MIZENKEI|mizenkei|未然形|form
NONE|||type
NONE|base|終止形|form
ONBINKEI|onbinkei|連用形|form
RENYOKEI|renyokei|連用形|form
SURU|suru|サ変|type
UNKNOWN|||type
"""),
    "category_links": ("before VARCHAR, after VARCHAR, cost DOUBLE", r"""
ADJ_NA|AUX_断定|-0.8
ADJ_かっ|AUX_過去|-0.8
ADJ_語幹|AUX_様態|-1.6
ADJ_連用|AUX_否定|-2.0
AUX_可能|AUX_否定|-1.0
AUX_否定|AUX_過去|-0.8
AUX_過去|DET|2.5
DET|NOUN|-2.5
NOUN|AUX_接近|5.0
NOUN|PART_副|-0.8
NOUN|PART_格|0.0
NOUN_形式|ADJ_終止|-1.6
PART_接続|AUX_継続|-0.8
PART_格|PART_格|1.8
PREFIX|NOUN|-0.8
VERB_仮定|PART_接続|-0.8
VERB_未然|AUX_否定|-0.5
VERB_終止|AUX_過去|3.0
VERB_連用|AUX_丁寧|-0.8
VERB_音便|AUX_過去|-0.8
"""),
    "built_in_words": ("pos VARCHAR, category VARCHAR, n BIGINT, least VARCHAR", r"""
CONJ|CONJ|53|あるいは
DET|DET|27|ああいう
INTJ|INTJ|25|ああ
NOUN|NOUN_形式|24|ありきたり
PARTICLE|PART_係|2|は
PARTICLE|PART_係結|3|こそ
PARTICLE|PART_副|11|かも
PARTICLE|PART_引用|1|って
PARTICLE|PART_接続|31|けど
PARTICLE|PART_格|12|から
PARTICLE|PART_準体|2|の
PARTICLE|PART_終|18|か
PREFIX|PREFIX|3|お
PRON|PRON|52|あいつ
SUFFIX|SUFFIX|14|くん
"""),
    "pretoken_japanese": ("sample_id INTEGER, place INTEGER, kind VARCHAR, surface VARCHAR, start INTEGER, end INTEGER, type VARCHAR", r"""
0|0|token|2024年12月23日|0|11|date
0|1|span|に送付|11|14|~
1|0|span|1|0|1|~
1|1|token|2345年|1|6|date
2|0|token|14時30分45秒|0|9|time
2|1|span| 25時|9|13|~
3|0|span|税込|0|2|~
3|1|token|1,234円|2|8|currency
3|2|span| |8|9|~
3|3|token|3億円|9|12|currency
4|0|span|約|0|1|~
4|1|token|5GB|1|4|storage
4|2|span|使用 |4|7|~
4|3|token|5b|7|9|storage
4|4|span|anana|9|14|~
5|0|span|進捗|0|2|~
5|1|token|50%|2|5|percentage
5|2|span| |5|6|~
5|3|token|３０％|6|9|percentage
6|0|span|住所|0|2|~
6|1|token|1-2-3|2|7|number
6|2|span|です|7|9|~
7|0|token|v2.0.1|0|6|version
7|1|span|とv3|6|9|~
8|0|span|a@|0|2|~
8|1|token|b.co|2|6|asciiseq
8|2|span|. |6|8|~
8|3|token|x@y.jp|8|14|email
9|0|token|#タグ|0|3|hashtag
9|1|span| と |3|6|~
9|2|token|@user_1|6|13|mention
9|3|span| @|13|15|~
9|4|token|a.b|15|18|asciiseq
10|0|token|example.com|0|11|asciiseq
10|1|span|/x |11|14|~
10|2|token|3.14|14|18|version
11|0|span|すごい|0|3|~
11|1|token|！|3|4|boundary
11|2|span|本当|4|6|~
11|3|token|？|6|7|boundary
12|0|token|https://a.b/c|0|13|url
12|1|span|). |13|16|~
12|2|token|http://x.y/z?q=1|16|32|url
12|3|span|,|32|33|~
13|0|token|#東京2024|0|7|hashtag
13|1|span| |7|8|~
13|2|token|＃ラーメン|8|13|hashtag
14|0|token|@tanaka_taro|0|12|mention
14|1|span|に|12|13|~
"""),
    "number_parsers": ("text VARCHAR, whole BIGINT, number VARCHAR, size BIGINT", r"""
|~|~|~
1,234|1|1234|~
1,234.5円|1|1234.5|~
123|123|123|123
3.14|3|3.14|~
5.|5|5|~
7,a|7|7|~
abc|~|~|~
０.5|0|0.5|~
１２３円|123|123|~
"""),
    "detect_verb_type": ("surface VARCHAR, conj_type VARCHAR, stem VARCHAR", r"""
する|SURU|
みる|ICHIDAN|み
勉強する|SURU|勉強
帰る|GODAN_RA|帰
待つ|GODAN_TA|待
書く|GODAN_KA|書
来る|KURU|来
死ぬ|GODAN_NA|死
泳ぐ|GODAN_GA|泳
話す|GODAN_SA|話
読む|GODAN_MA|読
買う|GODAN_WA|買
飛ぶ|GODAN_BA|飛
食べる|ICHIDAN|食べ
高い|I_ADJ|高
"""),
    "auxiliary_forms": ("surface VARCHAR, lemma VARCHAR, after VARCHAR, makes VARCHAR", r"""
くれる|くれる|OUT_TE|BASE
くれれ|くれる|OUT_TE|KATEIKEI
くれろ|くれる|OUT_TE|MEIREIKEI
させる|させる|MIZENKEI|BASE
させれ|させる|MIZENKEI|KATEIKEI
させろ|させる|MIZENKEI|MEIREIKEI
すぎる|すぎる|RENYOKEI|BASE
すぎる|すぎる|STEM|BASE
すぎれ|すぎる|RENYOKEI|KATEIKEI
すぎれ|すぎる|STEM|KATEIKEI
すぎろ|すぎる|RENYOKEI|MEIREIKEI
すぎろ|すぎる|STEM|MEIREIKEI
せる|せる|MIZENKEI|BASE
せれ|せる|MIZENKEI|KATEIKEI
せろ|せる|MIZENKEI|MEIREIKEI
みる|みる|OUT_TE|BASE
みれ|みる|OUT_TE|KATEIKEI
みろ|みる|OUT_TE|MEIREIKEI
られる|られる|MIZENKEI|BASE
られれ|られる|MIZENKEI|KATEIKEI
られろ|られる|MIZENKEI|MEIREIKEI
れる|れる|MIZENKEI|BASE
れれ|れる|MIZENKEI|KATEIKEI
れろ|れる|MIZENKEI|MEIREIKEI
"""),
    "connections": ("left VARCHAR, right VARCHAR, cost INTEGER, can_connect BOOLEAN", r"""
BASE|EOS|0|T
BASE|ない|32767|F
MIZENKEI|た|32767|F
MIZENKEI|ない|0|T
ONBINKEI|た|0|T
ONBINKEI|ます|32767|F
OUT_BASE|た|100|T
OUT_TE|いる|0|T
RENYOKEI|た|32767|F
RENYOKEI|ます|0|T
X|Y|32767|F
"""),
    "verb_and_adjective_forms": ("text VARCHAR, verb_form VARCHAR, adjective_form VARCHAR, na_form VARCHAR", r"""
|VERB_終止|ADJ_終止|ADJ_NA
かい|VERB_連用|ADJ_終止|ADJ_NA
よっ|VERB_音便|ADJ_語幹|ADJ_NA
書い|VERB_音便|ADJ_終止|ADJ_NA
書いた|VERB_た形|ADJ_語幹|ADJ_NA
書いたら|VERB_たら形|ADJ_語幹|ADJ_NA
書いて|VERB_て形|ADJ_語幹|ADJ_NA
書く|VERB_連用|ADJ_連用|ADJ_NA
書けば|VERB_仮定|ADJ_語幹|ADJ_NA
読ん|VERB_音便|ADJ_語幹|ADJ_NA
読んで|VERB_て形|ADJ_語幹|ADJ_NA
食べる|VERB_終止|ADJ_語幹|ADJ_NA
食べろ|VERB_命令|ADJ_語幹|ADJ_NA
飲んだら|VERB_たら形|ADJ_語幹|ADJ_NA
高|VERB_連用|ADJ_語幹|ADJ_NA
高い|VERB_音便|ADJ_終止|ADJ_NA
高かっ|VERB_音便|ADJ_かっ|ADJ_NA
高く|VERB_連用|ADJ_連用|ADJ_NA
高けれ|VERB_連用|ADJ_け形|ADJ_NA
"""),
    "negative_patterns": ("text VARCHAR, negative BOOLEAN, voice_renyokei BOOLEAN, voice_become BOOLEAN, godan_renyokei BOOLEAN", r"""
いかなく|F|F|F|T
されなく|F|T|F|F
しない|T|F|F|F
ない|F|F|F|F
少ない|F|F|F|F
書かせなく|F|T|F|F
書かない|T|F|F|F
書かなく|F|F|F|T
書かれなくなった|F|F|T|F
食べない|T|F|F|F
食べられなく|F|T|F|F
食べられなくなった|F|F|T|F
高い|F|F|F|F
"""),
    "looks_conjugated": ("text VARCHAR, looks BOOLEAN", r"""
あ|F
書いている|T
本|F
猫|F
読めなかった|T
食べた|T
"""),
    "user_dictionary_rows": ("line INTEGER, surface VARCHAR, pos VARCHAR, lemma VARCHAR", r"""
3|東京スカイツリー|NOUN|とうきょうすかいつりー
4|a,"b"|NOUN|
5|スカイツリー|NOUN|
6|ググる|VERB|ググる
7|推し|NOUN|推し
9|バズる|VERB|
10|東京都|NOUN|
"""),
    "dictionary_rows": ("line INTEGER, surface VARCHAR, pos VARCHAR, conj_type VARCHAR", r"""
2|書く|VERB|GODAN_KA
3|本|NOUN|
4|高い|ADJ|I_ADJ
5|静か|ADJ|NA_ADJ
6|書き|NOUN|
7|食べる|VERB|
8|来る|VERB|KURU
9|優木|NOUN|FAMILY
10|ゆっくり|ADV|
11|ありがとう|OTHER|INTERJECTION
12|いい|ADJ|I_ADJ
"""),
    "dict_compile": ("surface VARCHAR, pos VARCHAR, extended_pos VARCHAR, lemma VARCHAR", r"""
ありがとう|OTHER|INTJ|ありがとう
いい|ADJ|ADJ_終止|いい
ゆっくり|ADV|ADV|ゆっくり
優木|NOUN|NOUN_姓|優木
書い|VERB|VERB_音便|書く
書か|VERB|VERB_未然|書く
書かぬ|VERB|VERB_未然|書く
書かん|VERB|VERB_未然|書く
書き|NOUN|NOUN|書き
書く|VERB|VERB_終止|書く
書け|VERB|VERB_仮定|書く
書ける|VERB|VERB_終止|書く
書こ|VERB|VERB_未然|書く
本|NOUN|NOUN|本
来き|VERB|VERB_連用|来る
来くる|VERB|VERB_終止|来る
来くれば|VERB|VERB_仮定|来る
来こ|VERB|VERB_未然|来る
来こい|VERB|VERB_命令|来る
来こよ|VERB|VERB_未然|来る
来こられる|VERB|VERB_終止|来る
来これる|VERB|VERB_終止|来る
静か|ADJ|ADJ_NA|静か
食べ|VERB|VERB_連用|食べる
食べよ|VERB|VERB_未然|食べる
食べる|VERB|VERB_終止|食べる
食べれ|VERB|VERB_仮定|食べる
食べろ|VERB|VERB_命令|食べる
食べん|VERB|VERB_未然|食べる
高い|ADJ|ADJ_終止|高い
高かっ|ADJ|ADJ_かっ|高い
高かったら|ADJ|ADJ_け形|高い
高く|ADJ|ADJ_連用|高い
高くて|ADJ|ADJ_連用|高い
高くない|ADJ|ADJ_終止|高い
高くなかっ|ADJ|ADJ_終止|高い
高ければ|ADJ|ADJ_け形|高い
高そう|ADJ|ADJ_語幹|高い
"""),
    "dict_compile_several": ("surface VARCHAR, pos VARCHAR, extended_pos VARCHAR, lemma VARCHAR", r"""
書い|VERB|VERB_音便|書く
書か|VERB|VERB_未然|書く
書かぬ|VERB|VERB_未然|書く
書かん|VERB|VERB_未然|書く
書き|NOUN|NOUN|書き
書く|VERB|VERB_終止|書く
書け|VERB|VERB_仮定|書く
書ける|VERB|VERB_終止|書く
書こ|VERB|VERB_未然|書く
食べ物|NOUN|NOUN|食べ物
"""),
    "dict_decompile": ("surface VARCHAR, pos VARCHAR, conj_type VARCHAR", r"""
ありがとう|OTHER|
いい|ADJ|I_ADJ
ゆっくり|ADV|
優木|NOUN|
書き|NOUN|
書く|VERB|GODAN_KA
本|NOUN|
来る|VERB|KURU
静か|ADJ|
食べる|VERB|ICHIDAN
高い|ADJ|I_ADJ
"""),
    "dict_validate": ("line INTEGER, problem VARCHAR", r"""
2|no surface
3|again: 本
5|no surface
6|again: 本
"""),
    "dict_edits": ("edit VARCHAR, surface VARCHAR, pos VARCHAR, layer INTEGER", r"""
added|の|PARTICLE|2
added|は|PARTICLE|1
added|木|NOUN|1
added|本|NOUN|1
added|本|VERB|2
added|森|NOUN|3
added|読む|VERB|1
layered|の|PARTICLE|2
layered|は|PARTICLE|1
layered|木|NOUN|1
layered|本|NOUN|1
layered|本|VERB|2
layered|読む|VERB|1
limited|の|PARTICLE|2
limited|は|PARTICLE|1
limited|木|NOUN|1
removed|は|PARTICLE|1
removed|木|NOUN|1
removed|読む|VERB|1
updated|の|PARTICLE|2
updated|は|PARTICLE|1
updated|木|SUFFIX|1
updated|本|NOUN|1
updated|本|VERB|2
updated|読む|VERB|1
"""),
    "dict_existing": ("surface VARCHAR, what VARCHAR, has_entry BOOLEAN", r"""
は|any|T
は|no_verb|T
は|particle|T
本|any|T
本|no_verb|T
本|particle|F
森|any|F
森|no_verb|F
森|particle|F
読む|any|T
読む|no_verb|F
読む|particle|F
"""),
    "word_scripts": ("text VARCHAR, all_kanji BOOLEAN, has_kanji BOOLEAN, has_katakana BOOLEAN, pure_hiragana BOOLEAN, pure_katakana BOOLEAN, mixed BOOLEAN, single_kanji BOOLEAN, single_hiragana BOOLEAN, verb_stem BOOLEAN, compound_auxiliary BOOLEAN, hiragana_auxiliary BOOLEAN, hiragana_auxiliary_begins BOOLEAN, particle BOOLEAN, copula BOOLEAN, formal_noun BOOLEAN, ends_a BOOLEAN, ends_i BOOLEAN, ends_e BOOLEAN, ends_onbin BOOLEAN, demonstrative BOOLEAN", r"""
|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
abc|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
々|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
から|F|F|F|T|F|F|F|F|F|F|F|F|T|F|F|T|F|F|F|F
が|F|F|F|T|F|F|F|T|F|F|F|F|T|F|F|T|F|F|F|F
し|F|F|F|T|F|F|F|F|T|F|F|F|F|F|F|F|T|F|F|F
すぎる|F|F|F|T|F|F|F|F|F|F|T|T|F|F|F|F|F|F|F|F
つづけた|F|F|F|T|F|F|F|F|F|F|F|T|F|F|F|T|F|F|F|F
でした|F|F|F|T|F|F|F|F|F|F|F|F|F|T|F|T|F|F|F|F
ひらがな|F|F|F|T|F|F|F|F|F|F|F|F|F|F|F|T|F|F|F|F
カタカナ|F|F|T|F|T|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
テスト用|F|T|T|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
人|T|T|F|F|F|F|T|F|F|F|F|F|F|F|F|F|F|F|F|F
今日|T|T|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
書く|F|T|F|F|F|T|F|F|F|F|F|F|F|F|F|F|F|F|F|F
漢字|T|T|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F|F
物|T|T|F|F|F|F|F|F|F|F|F|F|F|F|T|F|F|F|F|F
終わる|F|T|F|F|F|T|F|F|F|T|F|F|F|F|F|F|F|F|F|F
食べ|F|T|F|F|F|T|F|F|F|F|F|F|F|F|F|F|F|T|F|F
"""),
    "tag_filters": ("options VARCHAR, place INTEGER, tag VARCHAR, pos VARCHAR", r"""
auxiliaries|0|東京|NOUN
auxiliaries|1|行く|VERB
auxiliaries|2|た|AUX
auxiliaries|3|美しい|ADJ
auxiliaries|4|とても|ADV
auxiliaries|5|木|NOUN
default|0|東京|NOUN
default|1|行く|VERB
default|2|美しい|ADJ
default|3|とても|ADV
formal|0|東京|NOUN
formal|1|行く|VERB
formal|2|こと|NOUN
formal|3|美しい|ADJ
formal|4|とても|ADV
no_basic|0|東京|NOUN
no_basic|1|行く|VERB
no_basic|2|美しい|ADJ
nouns|0|東京|NOUN
nouns|1|木|NOUN
particles|0|東京|NOUN
particles|1|に|PARTICLE
particles|2|行く|VERB
particles|3|美しい|ADJ
particles|4|とても|ADV
particles|5|木|NOUN
repeats|0|東京|NOUN
repeats|1|行く|VERB
repeats|2|美しい|ADJ
repeats|3|東京|PRON
repeats|4|とても|ADV
repeats|5|行く|VERB
surface|0|東京|NOUN
surface|1|行っ|VERB
surface|2|美しく|ADJ
surface|3|とても|ADV
surface|4|行き|VERB
two|0|東京|NOUN
two|1|行く|VERB
verbs_adverbs|0|行く|VERB
verbs_adverbs|1|とても|ADV
"""),
    "prefix_verb_to_noun": ("doc_id VARCHAR, token_index INTEGER, surface VARCHAR, pos VARCHAR, lemma VARCHAR", r"""
a|0|お|PREFIX|お
a|1|願い|NOUN|願い
a|2|し|VERB|する
b|0|本|NOUN|本
b|1|読む|VERB|読む
c|0|ご|PREFIX|ご
c|1|覧|NOUN|覧
"""),
    "prolonged_sound_merge": ("doc_id VARCHAR, token_index INTEGER, surface VARCHAR, pos VARCHAR, lemma VARCHAR", r"""
a|0|すごー|ADJ|すごー
a|3|い|AUX|
b|0|。|SYMBOL|。
b|1|ー|NOUN|ー
c|0|ー|NOUN|ー
"""),
    "golden_report": ("id VARCHAR, input VARCHAR, difference VARCHAR, surfaces_right BOOLEAN, pos_right BOOLEAN, lemmas_right BOOLEAN", r"""
a1|本を読む|same|T|T|T
a2|山田先生|under-split|F|F|F
a3|図書館|same|T|T|T
a3|行く|same|T|F|F
a5|私は|over-split|F|F|F
a6|食べた|boundary|F|F|F
"""),
    "golden_counts": ("report VARCHAR, key VARCHAR, value VARCHAR", r"""
again|a3|2
basic|a1|本を読む
basic|a3|図書館
basic|a6|食べた
pos|NOUN|6
pos|OTHER|1
pos|PARTICLE|1
pos|VERB|1
pos|none|1
right|sample.json|3/2/2/6
"""),
    "tag_differences": ("id INTEGER, missing VARCHAR, extra VARCHAR", r"""
1|a,c|d
2||x
3||
"""),
    "candidate_words": ("text VARCHAR, surface VARCHAR, extended_pos VARCHAR, lemma VARCHAR", r"""
おかしい|おかしい|ADJ_終止|おかしい
ぎゅっと|ぎゅっと|ADV|ぎゅっと
びっくりした|びっくり|ADV|びっくり
わくわく|わくわく|ADV|わくわく
エモい|エモい|ADJ_終止|エモい
キモかった|キモかっ|ADJ_かっ|キモい
キラキラ|キラキラ|ADV|キラキラ
バズった|バズっ|VERB_音便|バズる
バズる|バズる|VERB_終止|バズる
一つ|一つ|NOUN|一つ
今年|今年|NOUN|今年
取り入れる|取り入れる|VERB_終止|取り入れる
寒ければ|寒けれ|ADJ_け形|寒い
寒そう|寒そ|VERB_未然|寒す
帰れば|帰れ|VERB_仮定|帰る
平然と|平然と|ADV|平然と
新しく|新しく|VERB_終止|新しく
書いた|書い|VERB_音便|書く
書かない|書か|VERB_未然|書く
死んだ|死ん|VERB_音便|死む
泳いだ|泳い|VERB_音便|泳ぐ
神奈川県横浜市|神奈川県|NOUN|神奈川県
突っ込んだ|突っ込ん|VERB_音便|突っ込む
綺麗な人|綺麗|ADJ_NA|綺麗
美しい|美しい|ADJ_終止|美しい
考える|考える|VERB_終止|考える
華やかに|華やか|ADJ_NA|華やか
落ちろ|落ちろ|VERB_命令|落ちる
行くにゃん|行く|VERB_終止|行く
行った|行っ|VERB_音便|行く
覚えて|覚え|VERB_連用|覚える
話した|話し|VERB_連用|話す
読まず|読ま|VERB_未然|読む
読み方|読み方|NOUN|読み方
買おう|買お|VERB_未然|買う
静かな|静か|ADJ_NA|静か
頑張って|頑張っ|VERB_音便|頑張る
飲み会|飲み会|NOUN|飲み会
高かった|高かっ|ADJ_かっ|高い
"""),
    "lattice_japanese": ("doc_id INTEGER, token_index INTEGER, surface VARCHAR, pos VARCHAR, start INTEGER, end INTEGER, is_dictionary BOOLEAN, extended_pos VARCHAR", r"""
0|0|私|PRON|0|1|T|PRON
0|1|は|PARTICLE|1|2|T|PART_係
0|2|東京|NOUN|2|4|F|NOUN
0|3|の|PARTICLE|4|5|T|PART_準体
0|4|学生|NOUN|5|7|F|NOUN
0|5|です|AUX|7|9|T|AUX_丁寧断定
1|0|API開発|NOUN|0|5|F|NOUN
1|1|を|PARTICLE|5|6|T|PART_格
1|2|3時間|NOUN|6|9|F|NOUN
2|0|図書館|NOUN|0|3|F|NOUN
2|1|で|PARTICLE|3|4|T|PART_格
2|2|本|NOUN|4|5|F|NOUN
2|3|を|PARTICLE|5|6|T|PART_格
2|4|読む|VERB|6|8|F|VERB_終止
3|0|新宿駅|NOUN|0|3|F|NOUN
3|1|の|PARTICLE|3|4|T|PART_準体
3|2|前|NOUN|4|5|F|NOUN
4|0|カフェ|NOUN|0|3|F|NOUN
4|1|で|PARTICLE|3|4|T|PART_格
4|2|コーヒーー|NOUN|4|9|F|NOUN
4|3|を|PARTICLE|9|10|T|PART_格
4|4|飲む|VERB|10|12|F|VERB_終止
5|0|3億5000万円|NOUN|0|8|F|NOUN
6|0|数ヶ月|NOUN|0|3|F|NOUN
7|0|２０２４年12月23日|NOUN|0|11|F|NOUN
"""),
    "lattice_modes": ("mode VARCHAR, doc_id INTEGER, surfaces VARCHAR", r"""
normal|0|私/は/東京/の/学生/です
normal|1|API開発/を/3時間
normal|2|図書館/で/本/を/読む
normal|3|新宿駅/の/前
normal|4|カフェ/で/コーヒーー/を/飲む
normal|5|3億5000万円
normal|6|数ヶ月
normal|7|２０２４年12月23日
search|0|私/は/東京/の/学生/です
search|1|API開発/を/3時間
search|2|図書館/で/本/を/読む
search|3|新宿駅/の/前
search|4|カフェ/で/コーヒーー/を/飲む
search|5|3億5000万円
search|6|数ヶ月
search|7|２０２４年12月23日
split|0|私/は/東京/の/学生/です
split|1|API/開発/を/3時間
split|2|図書館/で/本/を/読む
split|3|新宿駅/の/前
split|4|カフェ/で/コーヒーー/を/飲む
split|5|3億/5000万円
split|6|数ヶ月
split|7|２０２４年12月23日
"""),
    "morpheme_forms": ("text VARCHAR, token_index INTEGER, surface VARCHAR, lemma VARCHAR, conj_type VARCHAR, conj_form VARCHAR", r"""
勉強すれば|0|勉強|勉強|~|~
勉強すれば|1|すれ|する|SURU|KATEIKEI
書かなかった|0|書か|書く|GODAN_KA|MIZENKEI
泳いで|0|泳い|泳ぐ|GODAN_GA|ONBINKEI
行こう|0|行こ|行く|GODAN_KA|ISHIKEI
見ろ|0|見ろ|見る|ICHIDAN|MEIREIKEI
話した|0|話し|話す|GODAN_SA|RENYOKEI
静かな町|0|静か|静か|NA_ADJ|BASE
静かな町|2|町|町|~|~
食べよう|0|食べよ|食べる|ICHIDAN|ISHIKEI
飲みもの|0|飲みもの|飲みもの|~|~
高かった|0|高かっ|高い|I_ADJ|ONBINKEI
"""),
    "numbers_joined": ("text VARCHAR, surfaces VARCHAR", r"""
100票|100票
10章|10章
1万2000人|1万2000人
20メートル|20メートル
2対1|2/対/1
3人目|3人目
3億5000万円|3億5000万円
3週間半|3週/間半
5時間|5時間
何度|何度
数回|数回
第2話|第/2話
"""),
    "japanese_tags": ("doc_id INTEGER, place INTEGER, tag VARCHAR, pos VARCHAR", r"""
0|0|東京|NOUN
0|1|学生|NOUN
1|0|API開発|NOUN
1|1|3時間|NOUN
2|0|図書館|NOUN
2|1|読む|VERB
3|0|新宿駅|NOUN
4|0|カフェ|NOUN
4|1|コーヒーー|NOUN
4|2|飲む|VERB
5|0|3億5000万円|NOUN
6|0|数ヶ月|NOUN
7|0|２０２４年12月23日|NOUN
"""),
    "sql_functions": ("doc_id INTEGER, what VARCHAR, found VARCHAR", r"""
0|analyze|私 は 東京 の 学生 です
0|tags|東京 学生
0|tokenize|私 は 東京 の 学生 です
1|analyze|API開発 を 3時間
1|tags|API開発 3時間
1|tokenize|API開発 を 3時間
2|analyze|図書館 で 本 を 読む
2|tags|図書館 読む
2|tokenize|図書館 で 本 を 読む
3|analyze|新宿駅 の 前
3|tags|新宿駅
3|tokenize|新宿駅 の 前
4|analyze|カフェ で コーヒーー を 飲む
4|tags|カフェ コーヒーー 飲む
4|tokenize|カフェ で コーヒーー を 飲む
5|analyze|3億5000万円
5|tags|3億5000万円
5|tokenize|3億5000万円
6|analyze|数ヶ月
6|tags|数ヶ月
6|tokenize|数ヶ月
7|analyze|２０２４年12月23日
7|tags|２０２４年12月23日
7|tokenize|２０２４年12月23日
"""),
    "with_without_dict_diff": ("doc_id INTEGER, start INTEGER, end INTEGER, with_dictionary VARCHAR, without VARCHAR", r"""
1|0|2|~|東京
1|0|8|東京スカイツリー|~
1|2|8|~|スカイツリー
2|0|1|~|推
2|0|2|推し|~
2|1|2|~|し
"""),
    "engine_layers": ("engine VARCHAR, surfaces VARCHAR, n_entries INTEGER, n_warnings INTEGER", r"""
base|東京/スカイツリー/展望台|0|0
lenient|東京/スカイツリー/展望台|0|1
missing|東京/スカイツリー/展望台|0|1
replaced|東京/スカイツリー/展望台|1|0
search|東京スカイツリー展望台|0|0
table|東京スカイツリー/展望台|1|0
two|東京/スカイツリー/展望台|2|0
"""),
    "named_options": ("options VARCHAR, tags VARCHAR", r"""
default|Web開発 東京 頼む
merged|Web開発 東京
no_basic|Web開発 東京 頼む
nouns|Web開発 東京
one|Web開発
search|Web開発 東京 頼む
short|Web開発 東京 頼む
surface|頼ん
unknown_pos|Web開発 東京 頼む
"""),
    "scorer_configuration": ("configuration VARCHAR, surfaces VARCHAR", r"""
idle|API開発/の/田中/さん
letters|API/開発/の/田中/さん
none|API開発/の/田中/さん
suffix|API開発/の/田中/さ/ん
"""),
    "long_text_chunks": ("doc_id INTEGER, n INTEGER, last_end INTEGER, surfaces VARCHAR", r"""
0|8500|17000|東京/に/行く
1|3|5|東京/に/行く
"""),
    "lattice_explain": ("start INTEGER, n BIGINT, n_known BIGINT, furthest INTEGER", r"""
0|1|0|1
1|2|1|2
2|2|0|4
3|1|0|4
"""),
    "sinks": ("form VARCHAR, value VARCHAR", r"""
chasen|EOS
chasen|EOS
chasen|で\t*\tで\t助詞\t*\t*
chasen|です\t*\tです\t助動詞\t*\t*
chasen|の\t*\tの\t助詞\t*\t*
chasen|は\t*\tは\t助詞\t*\t*
chasen|を\t*\tを\t助詞\t*\t*
chasen|図書館\t*\t図書館\t名詞\t*\t*
chasen|学生\t*\t学生\t名詞\t*\t*
chasen|本\t*\t本\t名詞\t*\t*
chasen|東京\t*\t東京\t名詞\t*\t*
chasen|私\t*\t私\t代名詞\t*\t*
chasen|読む\t*\t読む\t動詞\t五段・マ行\t終止形
json|{"input":"図書館で本を読む","morphemes":[{"surface":"図書館","pos":"NOUN","lemma":"図書館"},{"surface":"で","pos":"PARTICLE","lemma":"で"},{"surface":"本","pos":"NOUN","lemma":"本"},{"surface":"を","pos":"PARTICLE","lemma":"を"},{"surface":"読む","pos":"VERB","lemma":"読む"}]}
json|{"input":"私は東京の学生です。","morphemes":[{"surface":"私","pos":"PRON","lemma":"私"},{"surface":"は","pos":"PARTICLE","lemma":"は"},{"surface":"東京","pos":"NOUN","lemma":"東京"},{"surface":"の","pos":"PARTICLE","lemma":"の"},{"surface":"学生","pos":"NOUN","lemma":"学生"},{"surface":"です","pos":"AUX","lemma":"です"}]}
tags|図書館\tNOUN
tags|学生\tNOUN
tags|東京\tNOUN
tags|読む\tVERB
text|で\tPARTICLE\tで
text|です\tAUX\tです
text|の\tPARTICLE\tの
text|は\tPARTICLE\tは
text|を\tPARTICLE\tを
text|図書館\tNOUN\t図書館
text|学生\tNOUN\t学生
text|本\tNOUN\t本
text|東京\tNOUN\t東京
text|私\tPRON\t私
text|読む\tVERB\t読む
tsv|で\tPARTICLE\tで\t3\t4
tsv|です\tAUX\tです\t7\t9
tsv|の\tPARTICLE\tの\t4\t5
tsv|は\tPARTICLE\tは\t1\t2
tsv|を\tPARTICLE\tを\t5\t6
tsv|図書館\tNOUN\t図書館\t0\t3
tsv|学生\tNOUN\t学生\t5\t7
tsv|本\tNOUN\t本\t4\t5
tsv|東京\tNOUN\t東京\t2\t4
tsv|私\tPRON\t私\t0\t1
tsv|読む\tVERB\t読む\t6\t8
"""),
    "files_read_back": ("what VARCHAR, key VARCHAR, value VARCHAR", r"""
again|ありがとう|ありがとう/OTHER/INTERJECTION
again|いい|いい/ADJ/I_ADJ
again|ゆっくり|ゆっくり/ADV
again|優木|優木/NOUN/FAMILY
again|書き|書き/NOUN
again|書く|書く/VERB/GODAN_KA
again|本|本/NOUN
again|来る|来る/VERB/KURU
again|静か|静か/ADJ/NA_ADJ
again|食べる|食べる/VERB
again|高い|高い/ADJ/I_ADJ
engine|1|優木/は/静か/に/本/を/書い/た
golden|a1|3
golden|a2|2
golden|a3|2
golden|a5|1
golden|a6|2
table|ADJ|11
table|ADV|1
table|NOUN|3
table|OTHER|1
table|VERB|22
whole|text|一行目です。\n二行目 line two
"""),
    "candidates_by_cost": ("edge_id INTEGER, surface VARCHAR, extended_pos VARCHAR, cost DOUBLE, reach VARCHAR", r"""
0|を|PART_格|0.2|0-5
1|ん|PART_準体|0.2|0-5
2|だ|AUX_断定|0.2|0-5
3|だ|AUX_過去|0.2|0-5
4|ん|AUX_否定古|0.4|0-5
5|読ん|VERB_音便|0.6|0-5
"""),
}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cell(value: str, kind: str) -> str:
    """A cell of a list as an SQL value of its column's type."""
    if value == "~":
        return f"CAST(NULL AS {kind})"
    if kind == "BOOLEAN":
        return "true" if value == "T" else "false"
    return f"CAST({quoted(value.replace(chr(92) + 't', chr(9)).replace(chr(92) + 'n', chr(10)))} AS {kind})"


def values(columns: str, text: str) -> str:
    """SQL for a list of rows."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    rows = [f"({', '.join(cell(v, k) for v, k in zip(line.split('|'), kinds, strict=True))})" for line in text.strip("\n").split("\n")]
    titles = ", ".join(f'"{n}"' for n in names)
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({titles})"


def listed(text: str, sep: str, a: str, b: str) -> str:
    """A table of two columns from lines `a sep b`."""
    return f"(VALUES {', '.join(f'({quoted(x)}, {quoted(y)})' for x, y in (line.split(sep) for line in text.strip().splitlines()))}) AS t({a}, {b})"


# Kana by half width, row and use, kanji that count, rows and forms of verbs, endings, code points.
HALF = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
ROWS_OF = {"a": "あかがさざただなはばぱまやらわ", "i": "いきぎしじちぢにひびぴみり", "u": "うくぐすずつづぬふぶぷむゆる", "e": "えけげせぜてでねへべぺめれ", "o": "おこごそぞとどのほぼぽもよろを"}
FLAGS = {"common_particle": "をがはにへの", "extended_particle": "をがはにへのかねよわでとも", "never_verb": "をがはにへのもや", "never_first": "をがへのよ", "never_adjective": "をがはにへのもやてで", "small": "ょゃゅぁぃぅぇぉっ"}
COUNTED = "円銭万億兆分秒時日月年週期世個本人台枚杯回歳才階号番匹冊件丁通発点票頭羽着足軒組曲巻畳割部面問章棟戸席食泊口束両機基隻度倍段級位種色名話連敗勝戦間紀次"
CLASSES = "['HIRAGANA', 'KATAKANA', 'KANJI', 'ALPHABET', 'DIGIT', 'SYMBOL', 'EMOJI', 'UNKNOWN']"
VERB_ROWS = """verbs(surface, bare, conj_type) AS (VALUES ('書く','書','GODAN_KA'),('泳ぐ','泳','GODAN_GA'),('話す','話','GODAN_SA'),('待つ','待','GODAN_TA'),('死ぬ','死','GODAN_NA'),('飛ぶ','飛','GODAN_BA'),('読む','読','GODAN_MA'),('帰る','帰','GODAN_RA'),('買う','買','GODAN_WA'),
 ('食べる','食べ','ICHIDAN'),('みる','み','ICHIDAN'),('勉強する','勉強','SURU'),('する','','SURU'),('来る','来','KURU'),('高い','高','I_ADJ')),
rows(conj_type, u, a, i, e, o, t, voiced) AS (VALUES ('GODAN_KA','く','か','き','け','こ','い',false),('GODAN_GA','ぐ','が','ぎ','げ','ご','い',true),('GODAN_SA','す','さ','し','せ','そ','',false),('GODAN_TA','つ','た','ち','て','と','っ',false),
 ('GODAN_NA','ぬ','な','に','ね','の','ん',true),('GODAN_BA','ぶ','ば','び','べ','ぼ','ん',true),('GODAN_MA','む','ま','み','め','も','ん',true),('GODAN_RA','る','ら','り','れ','ろ','っ',false),('GODAN_WA','う','わ','い','え','お','っ',false))"""
STEP = "CASE f.step WHEN 'u' THEN u WHEN 'a' THEN a WHEN 'i' THEN i WHEN 'e' THEN e WHEN 'o' THEN o ELSE t END"
VOICED = "CASE WHEN voiced AND f.step = 't' THEN CASE left(f.more, 1) WHEN 'た' THEN 'だ' ELSE 'で' END || substr(f.more, 2) ELSE f.more END"
GODAN_STEPS = "u: a:ない a:なかった a:れる a:せる i:ます i:ました i:ません e:ば o: e: t:た t:て t:たら t:ている t:ていた t:ています t:ていました t:ておく t:てある t:てしまう e:る"
SA_STEPS = "u: a:ない a:なかった a:れる a:せる i:ます i:ました i:ません e:ば o: e: i:た i:て i:ている i:ています e:る"
OTHER_SUFFIXES = {
    "ICHIDAN": "る ない なかった ます ました ません た て ている ていた ています ていました ておく てある れば よ ろ られる させる", "SURU": "する しない しなかった します しました しません した して している していた しています していました すれば しよ しろ せよ される させる できる",
    "KURU": "る こない こなかった きます きました きません きた きて きている きています くれば こよ こい こられる こさせる", "I_ADJ": "い くない くなかった かった くて ければ く さ そう",
}
KEPT = {
    "ICHIDAN": "る:終止 :連用 ん:未然 れ:仮定 よ:未然 ろ:命令", "SURU": "する:終止 すれば:仮定 しろ:命令 せよ:命令 しよ:未然 せん:未然 したら:たら形", "KURU": "くる:終止 き:連用 こ:未然 くれば:仮定 こよ:未然 こい:命令 こられる:終止 これる:終止",
}
KEPT_ADJECTIVE = "い:終止 かっ:かっ くない:終止 くなかっ:終止 くて:連用 ければ:け形 く:連用 かったら:け形 そう:語幹"
KEPT_GODAN = "u::終止 i::連用 a::未然 t::音便 a:ん:未然 a:ぬ:未然 e::仮定 o::未然 e::命令 e:る:終止"


def steps(name: str, text: str) -> str:
    return f"{name}(form_id, step, more) AS (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(b)})' for i, (a, b) in enumerate(x.split(':') for x in text.split()))})"


def suffix_rows(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', {i}, {quoted(s)})" for k, text in table.items() for i, s in enumerate(text.split()))


GODAN_FORMS = f"""WITH {VERB_ROWS}, {steps('most', GODAN_STEPS)}, {steps('sa', SA_STEPS)}, forms AS (SELECT conj_type, form_id, step, more FROM rows, most WHERE conj_type <> 'GODAN_SA' UNION ALL SELECT 'GODAN_SA', form_id, step, more FROM sa)
SELECT v.surface, v.conj_type, f.form_id::INTEGER AS form_id, v.bare || {STEP} || {VOICED} AS form FROM verbs v JOIN rows r ON v.conj_type = r.conj_type JOIN forms f ON f.conj_type = v.conj_type"""
OTHER_FORMS = f"""WITH {VERB_ROWS}, s(conj_type, form_id, suffix) AS (VALUES {suffix_rows(OTHER_SUFFIXES)})
SELECT v.surface, v.conj_type, s.form_id::INTEGER AS form_id, v.bare || s.suffix AS form FROM verbs v JOIN s ON v.conj_type = s.conj_type UNION ALL SELECT '静か', 'NA_ADJ', 0, '静か' UNION ALL SELECT '本', NULL, 0, '本'"""
KEPT_ROWS = ", ".join(f"('{k}', {quoted(x.split(':')[0])}, 'VERB_{x.split(':')[1]}')" for k, text in KEPT.items() for x in text.split()) + ", " + ", ".join(f"('I_ADJ', '{x.split(':')[0]}', 'ADJ_{x.split(':')[1]}')" for x in KEPT_ADJECTIVE.split())
GODAN_KEPT_ROWS = ", ".join(f"('{a}', '{b}', 'VERB_{c}')" for a, b, c in (x.split(":") for x in KEPT_GODAN.split()))
DICTIONARY_FORMS = f"""WITH {VERB_ROWS}, s(conj_type, suffix, extended_pos) AS (VALUES {KEPT_ROWS}), f(step, more, extended_pos) AS (VALUES {GODAN_KEPT_ROWS})
SELECT v.surface, v.bare || s.suffix AS form, s.extended_pos FROM verbs v JOIN s ON v.conj_type = s.conj_type
UNION ALL SELECT v.surface, v.bare || {STEP} || f.more, f.extended_pos FROM verbs v JOIN rows r ON v.conj_type = r.conj_type, f
WHERE NOT (f.step = 't' AND r.t = '') AND NOT (f.extended_pos = 'VERB_命令' AND v.conj_type IN ('GODAN_KA', 'GODAN_GA'))"""
STEM_FORMS = f"""WITH {VERB_ROWS} SELECT v.surface, n AS form_name, CASE n WHEN 'BASE' THEN v.surface WHEN 'MIZENKEI' THEN bare || CASE v.conj_type WHEN 'ICHIDAN' THEN '' WHEN 'SURU' THEN 'さ' WHEN 'KURU' THEN 'こ' ELSE a END
 WHEN 'RENYOKEI' THEN bare || CASE v.conj_type WHEN 'ICHIDAN' THEN '' WHEN 'SURU' THEN 'し' WHEN 'KURU' THEN 'き' ELSE i END ELSE bare || CASE v.conj_type WHEN 'ICHIDAN' THEN '' WHEN 'SURU' THEN 'し' WHEN 'KURU' THEN 'き' ELSE CASE WHEN t = '' THEN i ELSE t END END END AS form
FROM verbs v LEFT JOIN rows r ON v.conj_type = r.conj_type, (SELECT unnest(['BASE', 'MIZENKEI', 'RENYOKEI', 'ONBINKEI']) AS n) WHERE v.conj_type <> 'I_ADJ'"""
IRREGULAR = ":る:ICHIDAN:ONBINKEI :る:ICHIDAN:RENYOKEI :る:ICHIDAN:MIZENKEI れ:る:ICHIDAN:KATEIKEI ろ:る:ICHIDAN:MEIREIKEI よ:る:ICHIDAN:ISHIKEI る:る:ICHIDAN:BASE し:する:SURU:ONBINKEI し:する:SURU:RENYOKEI し:する:SURU:MIZENKEI さ:する:SURU:MIZENKEI :する:SURU:MIZENKEI :する:SURU:ONBINKEI すれ:する:SURU:KATEIKEI しろ:する:SURU:MEIREIKEI せよ:する:SURU:MEIREIKEI しよ:する:SURU:ISHIKEI する:する:SURU:BASE す:する:SURU:BASE き:くる:KURU:ONBINKEI き:くる:KURU:RENYOKEI こ:くる:KURU:MIZENKEI くれ:くる:KURU:KATEIKEI こい:くる:KURU:MEIREIKEI こよ:くる:KURU:ISHIKEI くる:くる:KURU:BASE :い:I_ADJ:STEM"
ENDINGS = f"""WITH {VERB_ROWS} SELECT CASE n WHEN 'ONBINKEI' THEN CASE WHEN t = '' THEN i ELSE t END WHEN 'RENYOKEI' THEN i WHEN 'MIZENKEI' THEN a WHEN 'ISHIKEI' THEN o WHEN 'BASE' THEN u ELSE e END AS ending, u AS base_ending, conj_type, n AS form_name
FROM rows, (SELECT unnest(['ONBINKEI', 'RENYOKEI', 'MIZENKEI', 'POTENTIAL', 'KATEIKEI', 'MEIREIKEI', 'ISHIKEI', 'BASE']) AS n) WHERE NOT (n = 'POTENTIAL' AND conj_type = 'GODAN_RA') UNION ALL SELECT 'っ', 'く', 'GODAN_KA', 'ONBINKEI'
UNION ALL SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, x.split(':'))) + ')' for x in IRREGULAR.split())}) AS v"""
TWO_KANA = "[こそあど][れこち]"
POINTS = "[[12254, 12304], [12536, 12543], [19902, 19984], [20870, 20870], [40958, 40961], [8204, 8206], [8418, 8420], [65037, 65040], [127461, 127488], [127994, 128000], [917535, 917537], [173790, 173793]]"
KANJI_SQL = "(cp BETWEEN 19968 AND 40959 OR cp BETWEEN 13312 AND 19903 OR cp BETWEEN 131072 AND 173791 OR cp BETWEEN 173824 AND 177983 OR cp BETWEEN 177984 AND 178207 OR cp BETWEEN 63744 AND 64255 OR cp BETWEEN 12032 AND 12255)"

ORACLES = {name: values(*table) for name, table in EXPECTED.items()} | {
    "normalize_chars": f"""SELECT cp::INTEGER AS cp, CASE WHEN cp BETWEEN 65 AND 90 THEN chr(cp + 32) WHEN cp BETWEEN 65313 AND 65338 THEN chr(cp - 65313 + 97) WHEN cp BETWEEN 65345 AND 65370 THEN chr(cp - 65345 + 97)
 WHEN cp BETWEEN 65296 AND 65305 THEN chr(cp - 65296 + 48) WHEN cp BETWEEN 65382 AND 65437 THEN substr('{HALF}', cp - 65382 + 1, 1) ELSE chr(cp) END AS normal
FROM (SELECT unnest(range(32, 127))::INTEGER AS cp UNION ALL SELECT unnest(range(65281, 65440))::INTEGER)""",
    "kana_rows": f"""SELECT cp, {', '.join(f"contains('{r}', c) AS row_{n}" for n, r in ROWS_OF.items())}, CASE {' '.join(f"WHEN contains('{r}', c) THEN '{r[0]}'" for r in ROWS_OF.values())} WHEN c = 'ゃ' THEN 'あ' WHEN c = 'ゅ' THEN 'う' WHEN c = 'ょ' THEN 'お' ELSE c END AS vowel,
 {', '.join(f"contains('{r}', c) AS {n}" for n, r in FLAGS.items())} FROM (SELECT cp, chr(cp) AS c FROM (SELECT unnest(range(12353, 12439))::INTEGER AS cp))""",
    "char_marks": f"""SELECT cp::INTEGER AS cp, cp = 8205 OR cp BETWEEN 65038 AND 65039 OR cp BETWEEN 127995 AND 127999 OR cp = 8419 OR cp BETWEEN 917536 AND 917631 AS emoji_modifier, cp BETWEEN 127462 AND 127487 AS regional, cp = 12293 AS iteration, cp = 12540 AS prolonged,
 {KANJI_SQL} AS kanji FROM (SELECT unnest(range(p[1], p[2] + 1)) AS cp FROM (SELECT unnest({POINTS}) AS p))""",
    "counter_kanji": f"SELECT DISTINCT c FROM (SELECT unnest(string_split('{COUNTED}', '')) AS c) WHERE c <> ''",
    "can_combine": f"SELECT a, b, a = b OR (a IN ('ALPHABET', 'DIGIT') AND b IN ('ALPHABET', 'DIGIT')) AS can_combine FROM (SELECT unnest({CLASSES}) AS a), (SELECT unnest({CLASSES}) AS b)",
    "demonstratives": "SELECT a || b AS text FROM (SELECT unnest(['こ', 'そ', 'あ', 'ど']) AS a), (SELECT unnest(['れ', 'こ', 'ち']) AS b)",
    "utf8_offset_maps": """WITH t AS (SELECT item_id, 'あé' || text AS text FROM benchmark), c AS (SELECT item_id, i, octet_length(encode(substr(text, i, 1))) AS b FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM t)),
o AS (SELECT item_id, sum(b) OVER (PARTITION BY item_id ORDER BY i) - b AS begins, b FROM c)
SELECT item_id, (count(*) + 1)::INTEGER AS n, (sum(begins) + sum(b))::BIGINT AS total, sum(b)::INTEGER AS last FROM o GROUP BY item_id""",
    "conjugate_godan": GODAN_FORMS,
    "conjugate_other": OTHER_FORMS,
    "dictionary_forms": DICTIONARY_FORMS,
    "verb_stems": STEM_FORMS,
    "verb_endings": ENDINGS,
    "golden_tokens": f"SELECT * FROM {listed(samples.GOLDEN, ' = ', 'text', 'tokens')}",
    "inflect_best": f"SELECT text, base, true AS any FROM {listed(samples.INFLECTED, ' ', 'text', 'base')}",
    "inflect_confidence": f"SELECT text, true AS falling, true AS in_bounds, length(text) > 1 AS any FROM (SELECT text FROM {listed(samples.INFLECTED, ' ', 'text', 'base')} UNION ALL SELECT unnest(['あ', '']))",
}
