"""Language and utterance classification, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeezed, trimmed

#: The lists that the rules go by.
KAZAKH_LETTERS = "ӘәҒғҚқҢңӨөҰұҮүҺһІі"
KAZAKH_HINTS = (
    "салем", "сәлем", "рахмет", "рақмет", "калай", "қалай", "каласыз", "қаласыз", "ия", "иә", "жок", "жоқ", "сау", "болыңыз",
    "көмек", "кужат", "құжат", "жумыс", "жұмыс", "орталык", "орталық", "аркылы", "арқылы", "және", "қызмет",
)
STOP_PHRASES = (
    "stop", "stop speaking", "stop talking", "pause", "cancel", "enough", "stop please", "стоп", "стоп пожалуйста", "остановись",
    "остановитесь", "прекрати", "прекратите", "хватит", "достаточно", "тоқта", "тоқтаңыз", "тоқтатыңыз", "жетер", "болды", "停", "停止",
)
STOP_WORDS = ("стоп", "stop", "тоқта")
ALIASES = {
    "en": "en", "eng": "en", "en-us": "en", "en-gb": "en", "ru": "ru", "rus": "ru", "ru-ru": "ru", "kk": "kk", "kaz": "kk", "kk-kz": "kk",
    "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "yue": "zh", "zh-cn": "zh", "zh-tw": "zh", "zh-hans": "zh", "zh-hant": "zh",
}
NOISE_PHRASES = (
    "noise", "noises", "background noise", "microphone noise", "mic noise", "ambient noise", "static", "white noise",
    "background chatter", "chatter", "background speech", "background talking", "background voices", "crosstalk", "cross talk",
    "conversation", "music", "applause", "clapping", "laughter", "laughing", "silence", "silent", "inaudible", "unintelligible",
    "mumbling", "rustling", "typing", "keyboard", "beep", "beeping", "clicking", "cough", "coughing", "breathing", "echo", "humming",
    "шум", "фоновый шум", "шум микрофона", "музыка", "аплодисменты", "смех", "тишина", "неразборчиво", "не слышно", "фоновые голоса",
    "разговоры", "шу", "фондық шу", "микрофон шуы", "күлкі", "тыныштық", "түсініксіз", "естілмейді", "фондағы дауыс",
    "噪音", "背景噪音", "麦克风噪音", "音乐", "掌声", "笑声", "静音", "听不清", "背景人声", "背景说话", "杂音",
)
NOISE_WORDS = (
    "background", "microphone", "mic", "ambient", "room", "noise", "noises", "sound", "sounds", "chatter", "speech", "voices", "voice",
    "talking", "conversation", "conversations", "music", "applause", "clapping", "laughter", "laughing", "silence", "silent", "inaudible",
    "unintelligible", "mumbling", "static", "rustling", "typing", "keyboard", "beep", "beeping", "click", "clicking", "cough", "coughing",
    "breath", "breathing", "echo", "hum", "humming", "crosstalk", "cross", "talk",
    "шум", "фоновый", "фоновые", "фон", "микрофона", "музыка", "аплодисменты", "смех", "тишина", "неразборчиво", "слышно", "голоса",
    "разговоры", "шу", "фондық", "микрофон", "шуы", "күлкі", "тыныштық", "түсініксіз", "естілмейді", "фондағы", "дауыс",
)
FILLERS = (
    "", "uh", "um", "hmm", "mm", "mmm", "ah", "eh", "uhh", "эм", "мм", "м", "ээ", "ага", "а", "э", "эээ", "ммм", "хм", "хмм", "е", "ей", "аа",
    "ым", "мхм", "嗯", "啊", "呃",
)
CUES = ("help", "question", "repeat", "помогите", "повтори", "вопрос", "көмек", "қайтала", "сұрақ", "重复")
QUERY_WORDS = (
    "what", "how", "why", "when", "where", "which", "who", "can", "could", "should", "need", "explain", "tell", "show", "apply", "submit",
    "find", "search", "document", "documents", "requirement", "requirements", "permit", "visa", "fintech", "lab", "portal", "register",
    "registration", "license", "licence", "cost", "fee", "deadline", "process", "steps", "help", "question", "repeat",
    "что", "как", "почему", "когда", "где", "какой", "какая", "какие", "кто", "могу", "можно", "нужно", "объясни", "объясните", "расскажи",
    "расскажите", "покажи", "покажите", "подать", "документ", "документы", "требование", "требования", "разрешение", "виза", "финтех",
    "лаборатория", "портал", "регистрация", "лицензия", "стоимость", "срок", "процесс", "шаги", "помогите", "вопрос", "повтори", "повторите",
    "не", "қалай", "неге", "қашан", "қайда", "қандай", "кім", "мүмкін", "керек", "қажет", "түсіндір", "түсіндіріңіз", "айт", "айтыңыз",
    "көрсет", "көрсетіңіз", "өтініш", "құжат", "құжаттар", "талап", "талаптар", "рұқсат", "зертхана", "тіркеу", "баға", "төлем", "мерзім",
    "қадам", "көмек", "сұрақ", "қайтала", "қайталаңыз",
)
HAN_QUERY_TERMS = (
    "什么", "怎么", "如何", "为什么", "什么时候", "哪里", "哪个", "请问", "解释", "告诉", "申请", "文件", "要求", "许可证", "签证", "金融科技", "实验室", "门户",
    "注册", "牌照", "费用", "截止", "流程", "步骤", "帮助", "问题", "重复",
)
INTERNAL_PHRASES = (
    "internal policy", "internal document", "internal docs", "internal memo", "staff policy", "employee policy", "employee benefits",
    "human resources", "sick leave", "access request", "service desk", "help desk", "внутренний документ", "внутренняя политика",
    "кадровая политика", "больничный лист", "служебная записка", "ішкі құжат", "ішкі саясат", "еңбек демалысы", "қызметкер саясаты",
)
INTERNAL_STEMS = (
    "internal", "employee", "staff", "hr", "payroll", "salary", "salaries", "leave", "vacation", "timesheet", "intranet", "onboarding",
    "offboarding", "procurement", "confidential", "private", "benefits", "expense", "reimbursement", "invoice", "vendor", "nda", "helpdesk",
    "vpn", "внутрен", "сотрудник", "персонал", "кадр", "зарплат", "оклад", "отпуск", "больнич", "табел", "интранет", "закуп", "служеб",
    "конфиденц", "ішкі", "қызметкер", "жалақы", "демалыс", "құпия", "шығын", "өтемақы", "сатып",
)
STOP_TOKENS = (
    "a", "an", "and", "are", "can", "could", "do", "does", "for", "from", "how", "in", "is", "it", "me", "of", "on", "or", "please", "tell",
    "that", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with", "you", "your",
)
SUFFIXES = ("ing", "tion", "sion", "ions", "ed", "es", "s")
HAN = r"一-鿿"
LETTER = rf"A-Za-zА-Яа-яЁё{KAZAKH_LETTERS}"
#: The same letters for Java's patterns, which try a class's parts in order: two tests for an ASCII letter, three for a blank.
JAVA_LETTER = rf"A-Za-z[\u0400-\u04ff&&[{LETTER}]]"
OTHER_SCRIPTS = r"[؀-ۿ֐-׿ऀ-ൿ฀-๿぀-ヿ가-힯]"
LATIN_EXTENDED = r"[À-ÖØ-öø-ÿĀ-ž]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
WRAPPED = r"^\s*[\[\(（]\s*(.*?)\s*[\]\)）]\s*[.!?。！？]*\s*$"
MAX_RATIO, MIN_LOGPROB = 0.66, -1.9


def array(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def words(text: Column) -> Column:
    """Lower-case runs of letters, and single Han characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{JAVA_LETTER}]+|[{HAN}])"), F.lit(1))


def bare_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(trimmed(text)), NOT_WORD, -1), lambda x: x != "")


def contains_any(text: Column, items: tuple[str, ...]) -> Column:
    return let(text, lambda t: F.exists(array(items), lambda x: F.contains(t, x)))


def alias(code: Column) -> Column:
    """The language that a code stands for, null if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.try_element_at(pairs, F.lower(trimmed(code)))


def detect_language(text: Column) -> Column:
    """zh, kk (by hint words anywhere, or its letters), ru, else en."""
    return (
        F.when(text.rlike(f"[{HAN}]"), "zh").when(contains_any(F.lower(text), KAZAKH_HINTS), "kk")
        .when(text.rlike(f"[{KAZAKH_LETTERS}]"), "kk").when(text.rlike("[А-Яа-яЁё]"), "ru").otherwise("en")
    )


def is_supported(text: Column) -> Column:
    """Neither blank nor with other scripts or Latin letters with marks."""
    t = trimmed(text)
    return F.coalesce((t != "") & ~t.rlike(OTHER_SCRIPTS) & ~t.rlike(LATIN_EXTENDED), F.lit(False))


def supported_language(text: Column) -> Column:
    """As detect_language; null for blank texts, other scripts and Latin letters with marks."""
    return F.when(is_supported(text), detect_language(trimmed(text)))


def heard(text: Column) -> Column:
    """What the rules on utterances look at, as a struct: lower case (low), whether it is in brackets (wrapped), its words as
    words() (w), without Han (a), and as bare_words() (bare), those of what is said, out of brackets (said, as text: phrase)."""
    bare = lambda x: F.filter(F.split(x, NOT_WORD, -1), lambda y: y != "")

    def inside(x: Column) -> Column:
        return F.when(x["wrapped"], bare(F.regexp_extract(x["low"], WRAPPED, 1))).otherwise(x["bare"])

    def split(low: Column) -> Column:
        return F.struct(low.alias("low"), low.rlike(WRAPPED).alias("wrapped"), words(low).alias("w"), bare(low).alias("bare"))

    def joined(x: Column) -> Column:
        # A Han character is a word by itself, behind all other letters.
        a = F.filter(x["w"], lambda y: y < HAN[0])
        return F.struct(*[x[c].alias(c) for c in ("low", "wrapped", "w", "bare")], a.alias("a"), inside(x).alias("said"))

    def named(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("low", "wrapped", "w", "bare", "a", "said")], F.array_join(x["said"], " ").alias("phrase"))

    return let(let(let(F.lower(trimmed(text)), split), joined), named)


def _only_sounds(p: Column) -> Column:
    return (F.size(p["said"]) > 0) & F.forall(p["said"], lambda w: w.isin(*NOISE_WORDS))


def _stop(p: Column) -> Column:
    return squeezed(p["low"]).isin(*STOP_PHRASES) | F.arrays_overlap(p["w"], array(STOP_WORDS))


def _noise(p: Column) -> Column:
    return (p["low"] != "") & (p["low"].isin(*NOISE_PHRASES) | p["phrase"].isin(*NOISE_PHRASES) | _only_sounds(p))


def _ratio(p: Column) -> Column:
    hit = F.filter(p["bare"], lambda x: x.isin(*NOISE_WORDS) | x.isin(*NOISE_PHRASES) | x.contains("noise") | x.contains("background") | x.contains("фон"))
    return F.when(F.size(p["bare"]) > 0, F.size(hit) / F.size(p["bare"])).otherwise(0.0)


def _signal(p: Column) -> Column:
    cue = (F.size(p["a"]) == 1) & F.arrays_overlap(p["a"], array(CUES))
    return (p["low"] != "") & (F.arrays_overlap(p["w"], array(QUERY_WORDS)) | cue | contains_any(p["low"], HAN_QUERY_TERMS))


def _background(p: Column) -> Column:
    return _noise(p) | (~_signal(p) & (_ratio(p) >= MAX_RATIO))


def _meaningful(p: Column) -> Column:
    tag = p["phrase"].isin(*NOISE_PHRASES) | (p["wrapped"] & _only_sounds(p))
    return (p["low"] != "") & ~tag & ~F.array_join(p["bare"], " ").isin(*FILLERS)


def is_stop_command(text: Column) -> Column:
    return let(heard(text), _stop)


def is_noise_utterance(text: Column) -> Column:
    """A tag or words that stand for sounds, not speech."""
    return let(heard(text), _noise)


def non_speech_ratio(text: Column) -> Column:
    return let(heard(text), _ratio)


def has_query_signal(text: Column) -> Column:
    return let(heard(text), _signal)


def is_background(text: Column) -> Column:
    return let(heard(text), _background)


def _lettered(text: Column) -> Column:
    """Two letters or a Han character. Looking for two is cheaper than counting all, which makes a string of each."""
    t = trimmed(text)
    return t.rlike(f"(?s)[{JAVA_LETTER}{HAN}].*?[{JAVA_LETTER}{HAN}]") | t.rlike(f"[{HAN}]")


def is_meaningful(text: Column) -> Column:
    """Two letters or a Han character, and neither filler nor a sound's tag."""
    return _lettered(text) & let(heard(text), _meaningful)


def is_speech(text: Column, at_once: Column, enough: Column) -> Column:
    """No noise, and either to be taken at once or enough of meaningful words in a supported language."""
    may = enough & _lettered(text) & is_supported(text)
    return let(heard(text), lambda p: ~_noise(p) & (at_once | (may & _meaningful(p))))


def _with_may(text: Column, rule) -> Column:
    """The rule over what is heard and whether it may be speech in a supported language by its letters."""
    return let(F.struct(heard(text).alias("p"), (_lettered(text) & is_supported(text)).alias("may")), lambda x: rule(x["p"], x["may"]))


def _letters(p: Column) -> Column:
    return F.aggregate(p["a"], F.lit(0), lambda n, x: n + F.length(x))


def _han(p: Column) -> Column:
    return F.size(p["w"]) - F.size(p["a"])


def is_new_query(text: Column) -> Column:
    """Whether a partial transcript asks something new."""
    def new(p: Column, may: Column) -> Column:
        asks = F.arrays_overlap(p["a"], array(QUERY_WORDS)) | p["low"].rlike("[?？]") | contains_any(p["low"], HAN_QUERY_TERMS)
        enough = (_han(p) >= 3) | ((F.size(p["a"]) >= 2) & (_letters(p) >= 6)) | ((F.size(p["a"]) == 1) & F.arrays_overlap(p["a"], array(CUES)))
        return _stop(p) | (may & asks & enough & ~_background(p) & _meaningful(p))

    return _with_may(text, new)


def is_interrupt(text: Column, logprob: Column) -> Column:
    """Whether a partial transcript should interrupt; a low average log-probability never does."""
    def strong(p: Column) -> Column:
        several = (_letters(p) >= 10) & ~F.arrays_overlap(p["a"], array(FILLERS[1:]))
        return F.when(F.size(p["w"]) == 0, False).when(F.size(p["a"]) < 2, (F.size(p["a"]) == 1) & F.arrays_overlap(p["a"], array(CUES))).otherwise(
            several | contains_any(p["low"], HAN_QUERY_TERMS)
        )

    def cuts(p: Column, may: Column) -> Column:
        return ~_noise(p) & (_stop(p) | (may & _meaningful(p) & ~_background(p) & (_signal(p) | p["low"].rlike("[?？]") | strong(p))))

    return (text != "") & F.coalesce(logprob >= MIN_LOGPROB, F.lit(True)) & _with_may(text, cuts)


def is_internal_query(text: Column) -> Column:
    t = squeezed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"([{LETTER}0-9]+)"), F.lit(1))
    long_stems = tuple(x for x in INTERNAL_STEMS if len(x) >= 5)
    return (t != "") & (contains_any(t, INTERNAL_PHRASES + long_stems) | F.arrays_overlap(tokens, array(INTERNAL_STEMS)))


def token_forms(token: Column) -> Column:
    """A word and its plain stems, all longer than two letters."""
    n = F.length(token)
    forms = [token, F.when(token == "center", "centre").when(token == "centre", "center")]
    forms.append(F.when(token.endswith("ies") & (n > 5), F.concat(token.substr(F.lit(1), n - 3), F.lit("y"))))
    forms += [F.when(token.endswith(s) & (n > len(s) + 3), token.substr(F.lit(1), n - len(s))) for s in SUFFIXES]
    forms.append(F.when(token.endswith("e") & (n > 4), token.substr(F.lit(1), n - 1)))
    return F.filter(F.array_distinct(F.array(*forms)), lambda x: x.isNotNull() & (F.length(x) > 2))


def stemmed_tokens(text: Column) -> Column:
    """Sorted distinct words of three letters or more, with their stems."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"([{LETTER}0-9]+)"), F.lit(1)), lambda x: F.length(x) > 2)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(found), token_forms))))


def important_tokens(text: Column) -> Column:
    """Stemmed tokens without stop words, or all if nothing else is left."""
    def choose(t: Column) -> Column:
        left = F.array_except(t, array(STOP_TOKENS))
        return F.when(F.size(left) > 0, left).otherwise(t)

    return let(stemmed_tokens(text), choose)


def coverage(query: Column, answer: Column) -> Column:
    """Part of the query's important tokens that the answer has; 1 for a query without any."""
    def part(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.size(F.array_intersect(t, stemmed_tokens(answer))) / F.size(t)).otherwise(1.0)

    return let(important_tokens(query), part)


def adjusted_confidence(label: Column, part: Column, n: Column) -> Column:
    """A confidence label lowered where the answer covers too little of the query."""
    high, partial = F.when(n >= 2, 0.67).otherwise(1.0), F.when(n >= 2, 0.40).otherwise(1.0)
    return (
        F.when((label == "not_found") | (n <= 0) | (part >= high), label)
        .when(part >= partial, F.when(label == "high", "partial").otherwise(label)).otherwise("not_found")
    )
