"""Samples that queries on Japanese run over, as the driver's tables have no Japanese text. Fixed values throughout."""

from __future__ import annotations

# Texts and what they are expected to be parted into, without a dictionary: surface/part of speech.
GOLDEN = """
冷たくなかった = 冷たく/ADJ なかっ/AUX た/AUX
すぎて = すぎ/VERB て/PARTICLE
この本は読みやすい = この/DET 本/NOUN は/PARTICLE 読み/VERB やすい/ADJ
甘いもの = 甘い/ADJ もの/NOUN
辛いもの = 辛い/ADJ もの/NOUN
よさ = よ/ADJ さ/SUFFIX
美味しそう = 美味し/ADJ そう/AUX
よかった = よかっ/ADJ た/AUX
よかったです = よかっ/ADJ た/AUX です/AUX
よくない = よく/ADJ ない/AUX
よく分かる = よく/ADJ 分かる/VERB
大嫌い = 大嫌い/ADJ
理性的に = 理性的/NOUN に/PARTICLE
溌剌と = 溌剌/NOUN と/PARTICLE
同じ事を = 同じ/DET 事/NOUN を/PARTICLE
じめじめした = じめじめ/ADV し/VERB た/AUX
行かない = 行か/VERB ない/AUX
消えぬ炎 = 消え/VERB ぬ/AUX 炎/NOUN
今日は天気です = 今日/NOUN は/PARTICLE 天気/NOUN です/AUX
いいですね = いい/ADJ です/AUX ね/PARTICLE
教師だそうだ = 教師/NOUN だ/AUX そう/ADJ だ/AUX
あ = あ/OTHER
にもかかわらず = に/PARTICLE も/PARTICLE かかわら/VERB ず/AUX
立ち去った = 立ち去っ/VERB た/AUX
乗り越えた = 乗り越え/VERB た/AUX
これは本です = これ/PRON は/PARTICLE 本/NOUN です/AUX
神だった = 神/NOUN だっ/AUX た/AUX
胡散臭い団体 = 胡散臭い/ADJ 団体/NOUN
お買い物 = お/PREFIX 買い物/NOUN
2024年12月23日付けで = 2024年12月23日/NOUN 付け/NOUN で/PARTICLE
はずだ = はず/NOUN だ/AUX
わくわくする = わくわく/ADV する/VERB
キラキラ光る = キラキラ/ADV 光る/VERB
食べたりする = 食べ/VERB たり/PARTICLE する/VERB
飲んだり食べたりする = 飲ん/VERB だり/PARTICLE 食べ/VERB たり/PARTICLE する/VERB
私は = 私/PRON は/PARTICLE
吾輩は猫でゲソ = 吾輩/PRON は/PARTICLE 猫/NOUN で/AUX ゲソ/PARTICLE
彼女は学生です = 彼女/PRON は/PARTICLE 学生/NOUN です/AUX
雨が降っている = 雨/NOUN が/PARTICLE 降っ/VERB て/PARTICLE いる/AUX
ないのにこれはおかしい = ない/AUX のに/PARTICLE これ/PRON は/PARTICLE おかしい/ADJ
行きますか = 行き/VERB ます/AUX か/PARTICLE
行くよ = 行く/VERB よ/PARTICLE
行くのだ = 行く/VERB の/PARTICLE だ/AUX
食べるんだ = 食べる/VERB ん/PARTICLE だ/AUX
行っちゃった = 行っ/VERB ちゃっ/VERB た/AUX
やっとく = やっ/VERB とく/AUX
してる = し/VERB てる/AUX
見てた = 見/VERB て/AUX た/AUX
という = という/DET
太郎という名前 = 太郎/NOUN という/DET 名前/NOUN
お水 = お/PREFIX 水/NOUN
お店 = お/PREFIX 店/NOUN
あなた = あなた/PRON
私たち = 私/PRON たち/SUFFIX
解決し得ない = 解決/NOUN し/VERB 得/AUX ない/AUX
解決し得る = 解決/NOUN し/VERB 得る/VERB
減った = 減っ/VERB た/AUX
学生たち = 学生/NOUN たち/SUFFIX
田中さん = 田中/NOUN さん/SUFFIX
本当にそうなの = 本当/NOUN に/PARTICLE そう/ADJ な/AUX の/PARTICLE
ラーメン食べたい = ラーメン/NOUN 食べ/VERB たい/AUX
壊されちゃうよ = 壊さ/VERB れ/AUX ちゃう/VERB よ/PARTICLE
取っちゃうぞ = 取っ/VERB ちゃう/VERB ぞ/PARTICLE
Web開発の基礎 = Web開発/NOUN の/PARTICLE 基礎/NOUN
APIリクエスト処理 = APIリクエスト/NOUN 処理/NOUN
Meetingがある = Meeting/NOUN が/PARTICLE ある/VERB
emailを送る = email/NOUN を/PARTICLE 送る/VERB
行かざるを得ない = 行か/VERB ざる/AUX を/PARTICLE 得/VERB ない/AUX
書かざるを得ない = 書か/VERB ざる/AUX を/PARTICLE 得/VERB ない/AUX
眠らせて = 眠らせ/VERB て/PARTICLE
食べすぎて = 食べ/VERB すぎ/VERB て/PARTICLE
食べすぎてしまいそう = 食べ/VERB すぎ/VERB て/PARTICLE しまい/AUX そう/AUX
APIを呼ぶ = API/NOUN を/PARTICLE 呼ぶ/VERB
getUserDataを呼ぶ = getUserData/NOUN を/PARTICLE 呼ぶ/VERB
相次ぐ事件 = 相次ぐ/VERB 事件/NOUN
泳いで = 泳い/VERB で/PARTICLE
行けば分かる = 行け/VERB ば/PARTICLE 分かる/VERB
行かなければ = 行か/VERB なけれ/AUX ば/PARTICLE
毎朝コーヒーを飲みながら新聞を読む = 毎朝/NOUN コーヒー/NOUN を/PARTICLE 飲み/VERB ながら/PARTICLE 新聞/NOUN を/PARTICLE 読む/VERB
飲みそう = 飲み/VERB そう/AUX
食べるにゃん = 食べる/VERB にゃん/PARTICLE
食べるもの = 食べる/VERB もの/NOUN
いたします = いたし/VERB ます/AUX
話しそう = 話し/VERB そう/AUX
間違う = 間違う/VERB
行います = 行い/VERB ます/AUX
ございます = ござい/VERB ます/AUX
いただきます = いただき/VERB ます/AUX
食べる = 食べる/VERB
食べて = 食べ/VERB て/PARTICLE
言われる = 言わ/VERB れる/AUX
言われます = 言わ/VERB れ/AUX ます/AUX
確認してください = 確認/NOUN し/VERB て/PARTICLE ください/VERB
勉強しています = 勉強/NOUN し/VERB て/PARTICLE い/AUX ます/AUX
棄てた物を拾う = 棄て/VERB た/AUX 物/NOUN を/PARTICLE 拾う/VERB
よくて = よく/ADJ て/PARTICLE
食べて寝る = 食べ/VERB て/PARTICLE 寝る/VERB
書こうとしている = 書こ/VERB う/AUX と/PARTICLE し/VERB て/PARTICLE いる/AUX
食べようとしている = 食べよ/VERB う/AUX と/PARTICLE し/VERB て/PARTICLE いる/AUX"""
# Conjugated surfaces and their dictionary forms.
INFLECTED = """
書いて 書く
読んだ 読む
食べている 食べる
見られた 見る
書かせた 書く
食べさせられた 食べる
いってしまった いく
美しかった 美しい
美しくない 美しい
作ってみた 作る
いらっしゃった いらっしゃる
なさった なさる
食べないでいた 食べる
勉強しないでいた 勉強する
分割し 分割する
頑張れば 頑張る
開催されなかった 開催する
行こう 行く
食べよう 食べる
飲みそう 飲む
来なかった 来る
食べたくなかった 食べる
食べちゃった 食べる
読んじゃった 読む
書くんだ 書く
食べるんだもん 食べる
書いたりした 書く
書きながら 書く
食べすぎている 食べる
難しすぎる 難しい
書きやすい 書く
食べにくかった 食べる
書き終わった 書く
食べ続けた 食べる
書ける 書ける
食べられなくて 食べる
すれば する
忘れてしまった 忘れる
準備しておいた 準備する
教えてもらっている 教える
食べさせられてしまった 食べる
書いてほしかった 書く
増えてきている 増える
"""
# Texts for lexical extraction.
LEXICAL = (
    "2024年12月23日に送付", "12345年", "14時30分45秒 25時", "税込1,234円 3億円", "約5GB使用 5banana", "進捗50% ３０％", "住所1-2-3です", "v2.0.1とv3", "a@b.co. x@y.jp", "#タグ と @user_1 @a.b", "example.com/x 3.14", "すごい！本当？",
    "https://a.b/c). http://x.y/z?q=1,", "#東京2024 ＃ラーメン", "@tanaka_taroに",
)
VERBS = ("書く", "泳ぐ", "話す", "待つ", "死ぬ", "飛ぶ", "読む", "帰る", "買う", "食べる", "勉強する", "高い", "来る", "みる", "する")
# Dictionaries as lines of files.
USER_LINES = ("# names", "", "東京スカイツリー,NOUN,100,とうきょうすかいつりー", '"a,""b""",Noun', "スカイツリー\tNOUN", "ググる\tVERB\tググる", "推し\t名詞\t0\t推し", "only", "バズる\tVERB\tGODAN_RA", "東京都\tPROPN")
COMPILED_LINES = ("# words", "書く\tVERB\tGODAN_KA", "本\tNOUN", "高い\tADJECTIVE\tI_ADJ", "静か\tADJECTIVE\tNA_ADJ", "書き\tNOUN", "食べる\tVERB", "来る\tVERB\tKURU", "優木\tPROPN\tFAMILY", "ゆっくり\tADVERB", "ありがとう\tOTHER\tINTERJECTION", "いい\tADJECTIVE\tI_ADJ")
# Words whose candidates are looked at, with what makes them so after them.
CANDIDATES = (
    "書かない", "書いた", "泳いだ", "話した", "死んだ", "読まず", "帰れば", "買おう", "考える", "覚えて", "落ちろ", "行った", "頑張って", "取り入れる", "突っ込んだ", "走りだした", "美しい", "高かった", "新しく", "寒ければ", "寒そう",
    "おかしい", "エモい", "キモかった", "バズる", "バズった", "静かな", "華やかに", "綺麗な人", "読み方", "飲み会", "平然と", "一つ", "今年", "神奈川県横浜市", "わくわく", "キラキラ", "びっくりした", "ぎゅっと", "行くにゃん",
)
GOLDEN_JSON = """{"version":"1.0","cases":[
{"id":"a1","input":"本を読む","expected":[{"surface":"本","pos":"Noun","lemma":"本"},{"surface":"を","pos":"Particle"},{"surface":"読む","pos":"Verb","lemma":"読む"}],"tags":["basic","verb"]},
{"id":"a2","input":"山田先生","expected":[{"surface":"山田","pos":"Noun"},{"surface":"先生","pos":"Noun"}],"tags":["noun"]},
{"id":"a3","input":"図書館","expected":[{"surface":"図書","pos":"Noun"},{"surface":"館","pos":"Noun"}],"own_expected":[{"surface":"図書館","pos":"Noun"}],"tags":["noun","basic"]},
{"id":"a3","input":"行く","expected":[{"surface":"行く","pos":"Noun"}]},
{"id":"a5","input":"私は","expected":[{"surface":"私は"}],"tags":[]},
{"id":"a6","input":"食べた","expected":[{"surface":"食","pos":"Noun"},{"surface":"べた","pos":"Other"}],"tags":["basic"]}]}"""
