"""Fixed values that results depend on: word lists, character ranges, patterns and tables of the public rules.

Patterns are in the syntax that Java, RE2 and Python share, but for those that say so.
"""

# Character ranges.
KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}"
KANJI = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3005}\x{3006}"
KATAKANA = r"\x{30A0}-\x{30FF}"
HANGUL = r"\x{AC00}-\x{D7AF}"

# Words and characters that say little.
STOP_WORDS = (
    "a an the of to in on at for and or but is are was were be been being am do does did "
    "i you he she it we they me him her us them my your his its our their this that these those "
    "whom whose not no yes so if then than too very can could "
    "will would shall should may might must have has had with without from by as about into over "
    "up down out off just also there here"
).split()
STOP_KANA = "はがのをにへとでもやかなねよねぇーっぁぃぅぇぉゃゅょわ"

# Words, runs and phrases.
WORD = rf"[A-Za-z0-9_'’]+|[{KANA}]|[{KANJI}]|[{HANGUL}]|[^\sA-Za-z0-9_'’{KANA}{KANJI}{HANGUL}]"
LATIN = r"[a-z0-9][a-z0-9_'’]*"
CJK_RUN = rf"[{KANA}{KANJI}{HANGUL}]+"
KANJI_KATAKANA_RUN = rf"[{KANJI}{KATAKANA}]+"
PHRASE = rf"[{KANJI}{KATAKANA}]{{2,}}|[a-z][a-z0-9_'’]{{2,}}"
PHRASE_RUN = rf"[{KANJI}{KATAKANA}]+|[a-z][a-z0-9_'’]*"

# Sentence ends.
MARKS = "。！？!?"
CLOSERS_AFTER_MARK = "」』）)】"
CLOSERS_LEADING = "」』）)"
ABBREVIATIONS = ("Mr", "Mrs", "Dr", "Ms", "St", "No", "vs", "etc", "Jr", "Prof", "Inc", "Ltd")

# Junk and quality.
JUNK_CHARACTERS = r"[\[\]{}|<>=_*#@^~\\]"
QUALITY_DEFINITION = "とは|である|です|のこと|を指す|is a|is an|is the|refers to|was a|は、"
QUALITY_PHRASE = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{30A0}-\x{30FF}]{2,}|[A-Za-z][A-Za-z0-9]{2,}"
MISSING_FIELD = ("nan", "none", "null", "undefined")

# Personal data, hollow replies, replies about a passage, small talk, continuations, garbled text.
PERSONAL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+|\+?[0-9][0-9\-() ]{8,}[0-9]"
HOLLOW = r"(以下|次|下記)の(ような|とおり|点|よう)|以下に|ご紹介します|説明します$|挙げます$"
HOLLOW_TAIL = r"(以下|次|下記)の(ような|とおり|点|よう|もの)[^。]*。?$|以下に[^。]*。?$|ご紹介します。?$|(を|について)?説明します。?$|(を)?挙げます。?$"
CHAT = (
    r"こんにちは|こんばんは|おはよう|やあ|ありがとう|ありがと|よろしく|おやすみ|またね|さようなら"
    r"|元気|疲れ|つかれ|眠い|ねむい|しんどい|つらい|辛い|悲し|嬉し|うれし|楽し|たのし|寂し|さびし|不安|心配"
    r"|けんか|喧嘩|失恋|落ち込|むかつ|腹が立|hello|hi\b|thanks|thank you|good morning|good night"
)
MORE = r"^(もっと|詳しく|もっと詳しく|続けて|続き|他には|ほかには|それで|それから|more|tell me more|continue|go on|and\??)[。!！?？]*$"
FOLLOW_UP = r"^(それ|これ|あれ|そこ|そいつ|彼|彼女|it|that|this|they|he|she)"
GARBLED = r"[?？!！][^。！？!?]{2,}|」[^「]*」|\)[^(]*\)|<unk>|[、,]{2}|[。.]{2}"
NOT_TOPICS = ("http", "https", "www", "com", "html", "wiki", "wikipedia", "inbox", "sources", "feeds")

# Questions.
QUESTION_TAILS = ("か", "かな", "の", "何", "なに", "誰", "どこ", "いつ", "なぜ", "どう", "どれ", "教えて", "って")
QUESTION_WORDS = ("what", "who", "when", "where", "why", "how", "which", "is", "are", "do", "does", "can", "tell")
QUESTION_TYPES = (
    ("when", r"いつ|何年|何月|何日|何世紀|\bwhen\b|what year"),
    ("where", r"どこ|何処|どちら|\bwhere\b"),
    ("howmany", r"いくつ|いくら|何人|何個|何回|何歳|どれくらい|どのくらい|高さ|長さ|広さ|人口|距離|面積|重さ|速さ|how (many|much|tall|long|far|old|big|fast)"),
    ("who", r"誰|だれ|\bwho\b"),
    ("why", r"なぜ|何故|どうして|\bwhy\b"),
    ("definition", r"とは|って何|ってなに|とは何|何ですか|なんですか|何のこと|意味|what is|what are|what's|define|explain|教えて"),
)
BONUS_YEAR = r"[0-9]{3,4}\s*年|[0-9]+\s*世紀|\b1[0-9]{3}\b|\b20[0-9]{2}\b|年代|月|日"
BONUS_PLACE = r"[都道府県市区町村国島湾山川洲]|に位置|にある|located|\bin\b"
BONUS_NUMBER = r"[0-9][0-9,.]*\s*(m|km|メートル|キロ|人|個|km2|km²|平方|トン|kg|グラム|秒|分|時間|年|歳|倍|%|パーセント|円|ドル|億|万|千)"
BONUS_WHO = r"氏|さん|博士|教授|作家|学者|者|創業|設立|発明|開発|by\b|founded|invented"
BONUS_WHY = r"ため|から|ので|理由|原因|because|due to"
BONUS_DEFINITION = r"とは|である|です|のこと|を指す|refers to|is a|is the|は、"

# Facts.
SUBJECT = r"([A-Za-z0-9][A-Za-z0-9 .'’\-]{1,30}|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{30A0}-\x{30FF}A-Za-z0-9々]{2,24})"
OBJECT = r"(.{2,80}?)"
LEAD_IN = r"^(?:[^、。]{0,8}[、]\s*)?"
ATTRIBUTE = r"(?:[\x{3040}-\x{309F}]{0,2}[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{30A0}-\x{30FF}]+[\x{3040}-\x{309F}]{0,2}){1,3}"
JA_TAIL = r"(である|です|だ|を指す|をいう|と呼ばれる|に位置する|にある|に属する|された|した|生まれた|設立|創業|発明|完成|開業|公開|になる|となる)[。.!?]?$"
EN_VERB = r"(?i)\b(is|are|was|were)\b"
BAD_SUBJECT = r"(?i)^(これ|それ|あれ|この|その|あの|ここ|そこ|以下|以上|一方|また|なお|ただし|しかし|そして|同|各|本項|本記事|上記|下記|前者|後者|this|that|these|those|it|there|here|he|she|they|we|you|i)$"
RELATION_ALIASES = {
    "definition": ("とは", "定義", "意味", "what", "definition"),
    "is": ("とは", "何", "what"),
    "location": ("場所", "所在地", "位置", "どこ", "where", "本社", "所在"),
    "event": ("いつ", "年", "設立", "誕生", "創業", "when", "founded", "born", "built", "created", "established"),
}
ATTRIBUTE_SYNONYMS = (
    ("creator", "author", "作者", "開発者", "創始者", "考案者", "設計者", "著者", "作った人"),
    ("founder", "創業者", "創設者", "設立者"),
    ("capital", "首都"),
    ("height", "高さ", "標高", "身長"),
    ("population", "人口"),
    ("area", "面積", "広さ"),
    ("length", "長さ", "全長"),
    ("president", "ceo", "社長", "代表", "代表者"),
    ("headquarters", "本社", "本部", "所在地"),
    ("birthday", "誕生日", "生年月日"),
    ("name", "名前", "名称"),
    ("advantage", "利点", "長所", "メリット"),
    ("purpose", "目的", "用途"),
)

# Units: dimension and factor (temperatures: 0 Celsius, 1 Fahrenheit).
UNITS = {
    "km": ("length", 1000.0), "キロ": ("length", 1000.0), "キロメートル": ("length", 1000.0), "m": ("length", 1.0), "メートル": ("length", 1.0),
    "cm": ("length", 0.01), "センチ": ("length", 0.01), "mm": ("length", 0.001), "ミリ": ("length", 0.001),
    "マイル": ("length", 1609.344), "mile": ("length", 1609.344), "miles": ("length", 1609.344), "フィート": ("length", 0.3048), "ft": ("length", 0.3048),
    "インチ": ("length", 0.0254), "inch": ("length", 0.0254), "ヤード": ("length", 0.9144),
    "kg": ("mass", 1.0), "キログラム": ("mass", 1.0), "g": ("mass", 0.001), "グラム": ("mass", 0.001), "ポンド": ("mass", 0.45359237), "lb": ("mass", 0.45359237),
    "オンス": ("mass", 0.028349523), "トン": ("mass", 1000.0), "t": ("mass", 1000.0),
    "l": ("volume", 1.0), "リットル": ("volume", 1.0), "ml": ("volume", 0.001), "ガロン": ("volume", 3.785411784),
    "℃": ("temp", 0.0), "°c": ("temp", 0.0), "度": ("temp", 0.0), "摂氏": ("temp", 0.0), "°f": ("temp", 1.0), "華氏": ("temp", 1.0), "f": ("temp", 1.0),
    "時間": ("time", 3600.0), "分": ("time", 60.0), "秒": ("time", 1.0), "日": ("time", 86400.0),
}
MULTIPLIERS = {"億": 1e8, "万": 1e4, "千": 1e3}

# Search, n-grams, vectors.
K1, B, PHRASE_BONUS, STOP_RATIO, STOP_FLOOR = 1.4, 0.6, 1.5, 0.2, 50
DISCOUNT = 0.75
DIMENSIONS, NONZERO, WINDOW = 128, 8, 3

# Runs of characters that may name the subject of a request, and nouns that name none.
KEY_RUN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]{2,}|[\x{30A0}-\x{30FF}]{2,}|[a-z0-9]{3,}"
GENERIC_KEYS = ("作り方", "仕組み", "意味", "方法", "理由", "違い", "使い方", "特徴", "説明", "定義", "種類", "場所", "時間", "関係")
