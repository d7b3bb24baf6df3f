"""Text scalars and predicates over lines, chunks and addresses, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that make a useful word, lines and openings that are navigation, and other rules' lists.
LETTERS = "A-Za-zА-Яа-яӘәҒғҚқҢңӨөҰұҮүҺһІі"
CAPITALS = "A-ZА-ЯӘҒҚҢӨҰҮІ"
#: The same letters for Java's patterns, which try a class's parts in order: two tests for an ASCII letter, three for a blank.
LETTER = f"[A-Za-z[\u0400-\u04ff&&[{LETTERS}]]]"
NAV_LINES = (
    "home", "about", "contacts", "contact", "apply now", "calculate fee", "general enquiries", "privacy policy", "procurement",
    "careers", "management", "news", "alerts", "annual reports", "history management ecosystem annual reports",
    "rankings recognition membership", "book an appointment", "join the association",
)
NAV_OPENINGS = (
    r"\.breadcrumbs$", r"filter\b", r"share\b", r"print\b", r"subscribe\b", r"stay current\b", r"by submitting this form\b",
    r"submit a request\b", r"not sure which course suits you best\b", r"our partners:?$", r"trusted by:?$",
    r"we will answer all questions:?$", r"read more$", r"learn more$", r"download$", r"previous$", r"next$",
    r"all rights reserved", r"cookie",
)
LOW_LINES = ("home", ".breadcrumbs", "download", "read more", "learn more", "apply now", "calculate fee", "book an appointment")
LOW_OPENINGS = (
    "SITE:", "SITE_GROUP:", "LANGUAGE:", "SOURCE_TYPE:", "BREADCRUMB:", "HEADINGS:", "ATTACHMENTS:", "DOWNLOADED_FILES:",
    "CONTENT_HASH:", "CRAWLED_AT:",
)
LINK_WORDS = ("and", "or", "to", "of", "for", "from", "in", "on", "with")
KEPT_QUERY_KEYS = ("id", "p", "page", "search", "s")


def let(value: Column, body) -> Column:
    """Use a value several times in an expression and compute it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))


def single_blanks(x: Column) -> Column:
    """Every run of white space as one blank. Most texts have none to change, and looking is cheaper than replacing."""
    return F.when(x.contains("  ") | x.rlike(r"[\t\n\x0b\f\r]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)


def squeezed(x: Column) -> Column:
    return trimmed(single_blanks(x))


def token_estimate(x: Column) -> Column:
    """A token for every four characters, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(x) / 4))


def useful_word_count(x: Column) -> Column:
    """Words of three letters or more."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(f"{LETTER}{{3,}}")).cast("bigint")


def line_key(x: Column) -> Column:
    """What makes two lines the same: no bullet, single blanks, lower case."""
    return F.lower(single_blanks(F.regexp_replace(trimmed(x), r"^\s*[-*]\s+", "")))


def token_set(x: Column) -> Column:
    """Sorted distinct lower-case words of letters and digits."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+)"), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def count_of(x: Column, part: str) -> Column:
    """How often a fixed string comes in x, without overlap."""
    return (F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)


def is_rule_line(s: Column) -> Column:
    return s.rlike(r"^[-_=]{5,}$")


def _where(cheap: Column, dear: Column) -> Column:
    """dear, looked at only where cheap holds; of `&` Spark computes parts that come twice for every row."""
    return F.when(cheap, dear).otherwise(False)


#: What a line that is_noise_line takes for navigation by its key looks like, at least.
NAV_LIKE = r"(?iu)^(?:[-*]\s+)?(?:" + "|".join(x.replace(" ", r"\s+") for x in NAV_LINES) + ")$"


def is_noise_line(line: Column) -> Column:
    """Blank, navigation, rules, lone page numbers, image and form tags, attachment lists, placeholder cells."""
    s = trimmed(line)
    return (
        (s == "")
        | _where(s.rlike(NAV_LIKE), line_key(s).isin(*NAV_LINES))
        | s.rlike("(?i)^(?:" + "|".join(NAV_OPENINGS) + ")")
        | _where(s.contains("...."), useful_word_count(s) < 12)
        | is_rule_line(s)
        | s.rlike(r"^\d{1,4}$")
        | s.rlike(r"(?i)^\[\s*image:.*\]$")
        | s.startswith("[IMAGE:")
        | (s.startswith("<") & s.rlike(r"(?i)\b(form|input|div|script|style)\b"))
        | s.startswith("ATTACHMENTS:")
        | s.startswith("DOWNLOADED_FILES:")
        | _where(s.contains("(data)"), (count_of(s, "(data)") >= 2) | (useful_word_count(s) <= 6))
        | _where(s.rlike("(?i)download"), count_of(F.lower(s), "download") >= 3)
    )


def is_nav_prefix(line: Column, heading_key: Column) -> Column:
    """A line before the content: noise, the heading again, or a short line that ends no sentence."""
    s = trimmed(line)
    open_end = ~s.rlike(r"[.!?;:。！？]$")
    n = useful_word_count(s)
    return (
        (s == "") | ((heading_key != "") & (line_key(s) == heading_key)) | is_noise_line(s)
        | (s.startswith("- ") & (n <= 12) & open_end) | ((n <= 3) & open_end)
    )


def is_orphan_fragment(line: Column) -> Column:
    s = trimmed(line)
    return (
        (s != "") & ~(s.startswith("[H") | s.startswith("-") | s.startswith("|"))
        & (line_key(s).isin(*LINK_WORDS) | ((useful_word_count(s) <= 1) & (F.length(s) <= 8) & ~s.rlike(r"\d")))
    )


def is_contents_line(line: Column) -> Column:
    """A line of a table of contents."""
    s = trimmed(line)
    return s.rlike(r"\.{4,}\s*\d+\s*$") | s.rlike(r"(?i)^(PART|Schedule|Chapter)\s+\d+.+\s+\d{1,3}$")


def is_low_value_line(line: Column) -> Column:
    s = trimmed(line)
    opening = F.lit(False)
    for x in LOW_OPENINGS:
        opening = opening | s.startswith(x)
    return (
        (s == "") | F.lower(single_blanks(s)).isin(*LOW_LINES) | opening
        | (s.startswith("<") & s.rlike(r"(?i)\b(form|script|style|input|div|a)\b")) | is_rule_line(s)
        | _where(s.contains("...."), useful_word_count(s) < 12)
        | _where(s.contains("(data)"), (count_of(s, "(data)") >= 2) | (useful_word_count(s) <= 6))
        | _where(s.rlike("(?i)download"), count_of(F.lower(s), "download") >= 3)
        | s.contains("/http:/") | s.contains("/https:/")
    )


def is_junk_chunk(text: Column) -> Column:
    """Short chunks of numbers, of numbered stubs, or of fewer than three words."""
    bare = trimmed(F.regexp_replace(text, r"\b(PART|Schedule)\s+\d+[.:]?\s*", ""))
    lines = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != "")
    stubs = F.size(F.filter(lines, lambda x: x.rlike(r"^\d+\.?$")))
    return (token_estimate(text) <= 50) & (
        bare.rlike(r"^[\d\s.]+$") | ((F.size(lines) >= 3) & (stubs / F.size(lines) > 0.5))
        | (F.regexp_count(text, F.lit(r"[a-zA-Zа-яА-Я]{3,}")) < 3)
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """One form for an address: https, lower-case host, single slashes, no slash at the end, no fragment, and of the
    query only the keys that choose content."""
    u = trimmed(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(path_of(u), "/{2,}", "/")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(
        F.split(query_of(u), "&", -1), lambda p: F.substring_index(p, "=", 1).isin(*KEPT_QUERY_KEYS) & p.rlike("^[^=]+=.")
    )
    query = F.array_join(pairs, "&")
    return F.when(u == "", "").otherwise(
        F.concat(
            F.when(scheme.isin("http", "https"), "https").otherwise(scheme), F.lit("://"), host_of(u), path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        )
    )


def is_bad_url(url: Column) -> Column:
    return (url == "") | ~url.rlike(r"(?i)^https?://[^/?#]+") | path_of(url).rlike("/https?:/")


def site_label(site: Column, url: Column) -> Column:
    """The site's name, else the first label of the host, else `general`."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(trimmed(site) != "", trimmed(site)).when(F.split(host, r"\.")[0] == "", "general").otherwise(F.split(host, r"\.")[0])


def strip_placeholder_cells(line: Column) -> Column:
    """Table cells that a scraper filled with `(data)`, taken out."""
    bare = lambda x: trimmed(F.regexp_replace(x, r"\s*\(data\)\s*", " "))
    cells = F.filter(F.transform(F.split(line, r"\|", -1), bare), lambda c: (c != "") & ~line_key(c).isin("data", "(data)"))
    return F.when(~line.contains("(data)"), line).when(line.contains("|"), F.array_join(cells, " | ")).otherwise(bare(line))


def _halves(t: Column, choose) -> Column:
    """choose(words of t, first half, second half as words)."""
    def cut(w: Column) -> Column:
        half = (F.size(w) / 2).cast("int")
        return let(
            F.struct(w.alias("w"), F.slice(w, 1, half).alias("a"), F.slice(w, half + 1, half).alias("b")),
            lambda x: choose(x["w"], x["a"], x["b"]),
        )

    return let(F.split(t, " "), cut)


def collapse_repeated_phrase(text: Column) -> Column:
    """A phrase said twice in a row, said once."""
    said = lambda words: F.array_join(words, " ")
    return let(
        squeezed(text),
        lambda t: _halves(
            t, lambda w, a, b: F.when((F.size(w) >= 2) & (F.size(w) % 2 == 0) & (line_key(said(a)) == line_key(said(b))), said(a)).otherwise(t)
        ),
    )


def clean_heading(text: Column) -> Column:
    """Marks off a heading's front, dot leaders off its end."""
    t = trimmed(F.regexp_replace(text, r"^#+\s*", ""))
    return trimmed(F.regexp_replace(t, r"\.{3,}.*$", ""))


def clean_heading_line(line: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(trimmed(line), r"^\[H[1-6]\]\s*", ""), r"^#{1,6}\s+", "")
    return collapse_repeated_phrase(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ -]+|[ -]+$", ""))


#: What a line begins with that is_heading takes for a heading: marks and blanks, then a part's name, a number or four letters
#: of which none is a small one.
HEADING_LIKE = (
    rf"(?i)^\s*(?:\[H[1-6]\]\s*)?(?:#{{1,6}}\s+)?[\s-]*(?:PART|Schedule|Chapter|\d)|(?-i)^\s*(?:\[H[1-6]\])?(?:[^{LETTERS}]*+[{CAPITALS}Һ]){{4}}"
)


def is_heading(line: Column) -> Column:
    def holds(s: Column) -> Column:
        letters = F.regexp_replace(s, f"[^{LETTERS}]", "")
        return (s != "") & (F.length(s) <= 140) & (
            s.rlike(r"(?i)^(PART|Schedule|Chapter)\s+\d+") | s.rlike(rf"^\d+(?:\.\d+)*\.?\s+[{CAPITALS}]")
            | ((F.length(letters) >= 4) & (F.upper(letters) == letters))
        )

    # Most lines are none by their first letters, and cleaning them is dear.
    return F.when(line.rlike(HEADING_LIKE), let(clean_heading_line(line), holds)).when(line.isNotNull(), False)


def source_slug(name: Column) -> Column:
    """A file name as a short safe slug with four digits of its SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "[^a-zA-Z0-9а-яА-ЯёЁ]+", "-"), "^-+|-+$", "")
    return F.concat(F.left(slug, F.lit(35)), F.lit("-"), F.left(F.sha1(name.cast("binary")), F.lit(4)))


def chunk_id(domain: Column, slug: Column, index: Column) -> Column:
    return F.concat_ws("-", domain, slug, F.lpad(index.cast("string"), 5, "0"))


def dedupe_transcript(text: Column) -> Column:
    """A transcript whose two halves, in words or else in characters, are the same: one half."""
    said = lambda words: F.array_join(words, " ")

    def choose(t: Column) -> Column:
        n = (F.length(t) / 2).cast("int")
        first, second = trimmed(F.substring(t, F.lit(1), n)), trimmed(F.substring(t, n + 1, n))
        return _halves(
            t,
            lambda w, a, b: F.when((F.size(w) > 1) & (F.size(w) % 2 == 0) & (F.lower(said(a)) == F.lower(said(b))), said(a))
            .when((F.length(t) > 1) & (F.length(t) % 2 == 0) & (F.lower(first) == F.lower(second)), first)
            .otherwise(t),
        )

    return let(squeezed(text), choose)


def query_signature(text: Column) -> Column:
    """Lower case, blanks for punctuation, single blanks."""
    return squeezed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def safe_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-")


def strip_speech_hints(text: Column) -> Column:
    """`42 [forty two]` becomes `42`."""
    return F.regexp_replace(text, r"(\d[\d\s,./-]*)\s*\[([^\]\[]+)\]", "$1")


def sentences(text: Column) -> Column:
    """Parts that end in a sentence mark followed by white space."""
    parts = F.split(text, r"(?<=[.!?。！？])\s+", -1)
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def no_repeated_sentences(text: Column) -> Column:
    """Sentences that equal the one before, dropped."""
    key = lambda x: F.regexp_replace(F.lower(squeezed(x)), "^[.!?。！？]+|[.!?。！？]+$", "")
    s = sentences(text)
    kept = F.transform(
        F.array(s), lambda a: F.filter(a, lambda x, i: (i == 0) | (key(x) != key(F.coalesce(F.get(a, i - 1), F.lit("")))))
    )
    return F.array_join(F.get(kept, 0), " ")


def _replaced_where(needs: str, pattern: str, stand_in: str):
    return lambda v: F.when(v.contains(needs), F.regexp_replace(v, pattern, stand_in)).otherwise(v)


def clean_chunk_text(text: Column) -> Column:
    """A chunk without page numbers, forms, broken links, download rows, running headers and lines of low value."""
    block, tag = "form|script|style|input|div|a", "form|script|style|div|a"
    t = F.replace(trimmed(text), F.lit("\ufffd"), F.lit("."))
    # Each pattern with a text that it can't do without: where that is missing, nothing is searched.
    for needs, pattern, stand_in in (
        ("", r"^\d{1,3}\n", ""), ("<", rf"(?is)<(?:{block})\b[^>]*>.*?</(?:{tag})>", " "), ("<", rf"(?is)<(?:{block})\b[^>]*>", " "), ("/http", r"(?md)^.*?/https?:/.*$", ""),
        ("|", r"(?mdi)^.*\bDownload\b.*\|\s*\bDownload\b.*$", ""), ("(data)", r"(?md)^.*(?:\(data\).*){2,}$", ""), ("(data)", r"\s*\(data\)\s*", " "), ("", r"(?md)^[A-Z][A-Z\s]{7,59}$", ""),
        ("", r"(?md)^[A-Z][A-Z\s]{7,59}\s+\d+\s+", ""),
    ):
        t = let(t, _replaced_where(needs, pattern, stand_in))
    lines = F.filter(F.transform(F.split(t, "\n", -1), trimmed), lambda x: (x == "") | ~is_low_value_line(x))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
