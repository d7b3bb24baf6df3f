"""Numbers in words, as SQL expressions made of lookups: a number is cut into groups of three digits, and each group
into hundreds and a rest. The dialect says how an engine looks up a list and divides whole numbers."""

from __future__ import annotations

from typing import NamedTuple

from .spoken import SPOKEN


class Dialect(NamedTuple):
    array: str
    at: str
    div: str


SPARK = Dialect("array({})", "element_at({}, cast({} + 1 AS int))", "({} div {})")
DUCKDB = Dialect("[{}]", "list_extract({}, {} + 1)", "({} // {})")

#: The number words, from zero on; tens and hundreds from one on.
EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "ten twenty thirty forty fifty sixty seventy eighty ninety".split()
RU = (
    "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать "
    "семнадцать восемнадцать девятнадцать"
).split()
RU_TENS = "десять двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
KK = "нөл бір екі үш төрт бес алты жеті сегіз тоғыз".split()
KK_TENS = "он жиырма отыз қырық елу алпыс жетпіс сексен тоқсан".split()
ZH = "零 一 二 三 四 五 六 七 八 九".split()
MINUS = {"en": "minus", "ru": "минус", "kk": "теріс"}
SCALES = {"en": ("million", "thousand"), "kk": ("миллион", "мың")}
RU_SCALES = (("миллион", "миллиона", "миллионов"), ("тысяча", "тысячи", "тысяч"))
LIMIT = 1_000_000_000


def _look(d: Dialect, words: list[str], index: str) -> str:
    return d.at.format(d.array.format(", ".join(f"'{w}'" for w in words)), index)


def _by_digit(words: list[str], x: str, blank: str) -> str:
    """The digits of a number one by one."""
    out = f"cast({x} AS {{text}})"
    for k, w in enumerate(words[:10]):
        out = f"replace({out}, '{k}', '{w}{blank}')"
    return f"trim({out})"


def _group(d: Dialect, lang: str, x: str, feminine: bool = False) -> str:
    """Words of a number from 1 to 999; those of zero are null."""
    h, r = d.div.format(x, 100), f"({x} % 100)"
    tens, ones = d.div.format(r, 10), f"({r} % 10)"
    if lang == "kk":
        hundreds = f"concat({_look(d, KK, h)}, ' жүз')"
        rest = f"CASE WHEN {r} BETWEEN 10 AND 19 THEN concat('он ', {_look(d, KK, ones)}) WHEN {r} >= 20 THEN concat_ws(' ', {_look(d, KK_TENS, f'({tens} - 1)')}, CASE WHEN {ones} > 0 THEN {_look(d, KK, ones)} END) WHEN {r} > 0 THEN {_look(d, KK, r)} END"
    else:
        small, big = (EN, EN_TENS) if lang == "en" else (RU, RU_TENS)
        if feminine:
            small = ["ноль", "одна", "две", *RU[3:]]
        hundreds = f"concat({_look(d, EN, h)}, ' hundred')" if lang == "en" else _look(d, RU_HUNDREDS, f"({h} - 1)")
        rest = f"CASE WHEN {r} >= 20 THEN concat_ws(' ', {_look(d, big, f'({tens} - 1)')}, CASE WHEN {ones} > 0 THEN {_look(d, small, ones)} END) WHEN {r} > 0 THEN {_look(d, small, r)} END"
    return f"concat_ws(' ', CASE WHEN {h} > 0 THEN {hundreds} END, {rest})"


def _ru_form(n: str, forms: tuple[str, str, str]) -> str:
    return f"CASE WHEN {n} % 100 BETWEEN 11 AND 19 THEN '{forms[2]}' WHEN {n} % 10 = 1 THEN '{forms[0]}' WHEN {n} % 10 BETWEEN 2 AND 4 THEN '{forms[1]}' ELSE '{forms[2]}' END"


def spelled(lang: str, x: str, d: Dialect = SPARK) -> str:
    """SQL for the words of the whole number x in en, ru, kk or zh."""
    text = "string" if d is SPARK else "VARCHAR"
    if lang == "zh":
        t, o, h, r = d.div.format(x, 10), f"({x} % 10)", d.div.format(x, 100), f"({x} % 100)"
        w = lambda i: _look(d, ZH, i)
        below = lambda y, t: f"concat(CASE WHEN {t} > 1 THEN {w(t)} ELSE '' END, '十', CASE WHEN {y} % 10 > 0 THEN {w(f'({y} % 10)')} ELSE '' END)"
        return (
            f"CASE WHEN {x} < 10 THEN {w(x)} WHEN {x} < 100 THEN {below(x, t)} WHEN {x} < 1000 THEN concat({w(h)}, '百', "
            f"CASE WHEN {r} = 0 THEN '' WHEN {r} < 10 THEN concat('零', {w(r)}) ELSE {below(r, d.div.format(r, 10))} END) "
            f"ELSE {_by_digit(ZH, x, '').format(text=text)} END"
        )
    a = f"abs({x})"
    m, k, u = d.div.format(a, 1_000_000), f"({d.div.format(a, 1000)} % 1000)", f"({a} % 1000)"
    units = [f"'{s}'" for s in SCALES[lang]] if lang in SCALES else [_ru_form(m, RU_SCALES[0]), _ru_form(k, RU_SCALES[1])]
    parts = [
        f"CASE WHEN {x} < 0 THEN '{MINUS[lang]}' END", f"CASE WHEN {m} > 0 THEN concat({_group(d, lang, m)}, ' ', {units[0]}) END",
        f"CASE WHEN {k} > 0 THEN concat({_group(d, lang, k, feminine=lang == 'ru')}, ' ', {units[1]}) END",
        f"CASE WHEN {u} > 0 THEN {_group(d, lang, u)} WHEN {a} = 0 THEN '{({'en': EN, 'ru': RU, 'kk': KK})[lang][0]}' END",
    ]
    digits = _by_digit({"en": EN, "ru": RU, "kk": KK}[lang], a, " ").format(text=text)
    return f"CASE WHEN {a} < {LIMIT} THEN concat_ws(' ', {', '.join(parts)}) ELSE concat_ws(' ', {parts[0]}, {digits}) END"


#: The words for a decimal point, for percent (before and after the number) and for a time of day.
POINT = {"en": "point", "ru": "запятая", "kk": "үтір", "zh": "点"}
PERCENT = {"en": ("", " percent"), "ru": ("", " процентов"), "kk": ("", " пайыз"), "zh": ("百分之 ", "")}
TIME = {"en": (" ", ""), "ru": (" ", " минут"), "kk": (" минут ", ""), "zh": (" 点 ", "")}
#: Percentages, times of day and numbers within a text; digits inside a word are no number.
_OUTSIDE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PERCENT_RE = rf"{_OUTSIDE}[0-9]+(?:[.,][0-9]+)?[\s\p{{Z}}]*%"
TIME_RE = rf"{_OUTSIDE}[0-9]{{1,2}}:[0-9]{{2}}{_END}"
NUMBER_RE = rf"(?<![{SPOKEN}0-9])[+-]?(?:[0-9]{{1,3}}(?:[.,][0-9]{{3}})*|[0-9]+)(?:[.,][0-9]+)?(?![{SPOKEN}0-9])"


def _named(name: str, value: str, body: str) -> str:
    """SQL for a body that uses a value by name, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _each(text: str, pattern: str, body: str) -> str:
    """SQL for a text in which every match m of the pattern gives way to the body's value."""
    pieces = f"split(t, r'{pattern}', -1), regexp_extract_all(t, r'{pattern}', 0)"
    return _named("t", text, f"array_join(zip_with({pieces}, (gap, m) -> concat(gap, CASE WHEN m IS NULL THEN '' ELSE {body} END)), '')")


def _digits(lang: str, x: str, blank: str = " ") -> str:
    words = {"en": EN, "ru": RU, "kk": KK, "zh": ZH}[lang][:10]
    return f"array_join(transform(regexp_extract_all({x}, '[0-9]', 0), digit -> {_look(SPARK, words, 'int(digit)')}), '{blank}')"


def _signed(lang: str, x: str) -> str:
    """Words of a whole number given as text, of any length and sign; zh leaves a minus and its digits as they are."""
    zh = lang == "zh"
    minus = f"CASE WHEN whole LIKE '-%' THEN '{'-' if zh else MINUS[lang] + ' '}' ELSE '' END"
    spelt = f"CASE WHEN n < 0 THEN string(n) ELSE {spelled(lang, 'n')} END" if zh else spelled(lang, "n")
    long = f"concat({minus}, {_digits(lang, 'whole', '' if zh else ' ')})"
    body = _named("n", "CASE WHEN length(whole) <= 18 THEN bigint(whole) END", f"CASE WHEN n IS NULL THEN {long} ELSE {spelt} END")
    return _named("whole", rf"regexp_replace({x}, r'^[+]?(-?)0*(?=[0-9])', '$1')", body)


def _decimal(lang: str, x: str) -> str:
    """Words of a number given as text: the whole part, and the digits after the first full stop one by one."""
    first = f"substring_index({x}, '.', 1)"
    tail = f"CASE WHEN rest RLIKE '[0-9]' THEN concat(' {POINT[lang]} ', {_digits(lang, 'rest')}) ELSE '' END"
    return f"concat({_signed(lang, first)}, {_named('rest', f'substring({x}, length({first}) + 1)', tail)})"


def spoken(lang: str, x: str) -> str:
    """SQL for the text x with its numbers in words: percentages, then times, then numbers, then digits inside words,
    which get no blanks of their own (CO2 becomes COtwo); white space is squeezed. Null text is empty.

    Of a full stop and commas the commas part thousands; commas alone do so if three digits follow the last, else
    that one is the decimal point."""
    before, after = PERCENT[lang]
    between, last = TIME[lang]
    share = _named("v", "regexp_extract(m, '[0-9.,]+', 0)", f"CASE WHEN contains(v, '.') THEN {_decimal(lang, 'v')} ELSE v END")
    hour, minute = (_signed(lang, f"substring_index(m, ':', {k})") for k in (1, -1))
    tail = "substring_index(m, ',', -1)"
    comma = f"concat(replace(left(m, length(m) - length({tail})), ',', ''), '.', {tail})"
    plain = f"CASE WHEN contains(m, '.') OR NOT contains(m, ',') OR length({tail}) = 3 THEN replace(m, ',', '') ELSE {comma} END"
    t = _each(x, PERCENT_RE, f"concat('{before}', {share}, '{after}')")
    t = _each(t, TIME_RE, f"concat({hour}, '{between}', {minute}, '{last}')")
    t = _each(_each(t, NUMBER_RE, _named("v", plain, _decimal(lang, "v"))), "[0-9]", _digits(lang, "m"))
    return rf"coalesce(trim(regexp_replace(CASE WHEN {x} RLIKE '[0-9]' THEN {t} ELSE {x} END, r'[\s\p{{Z}}]+', ' ')), '')"
