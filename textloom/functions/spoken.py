"""Text for speech and answers made of chunks, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, sentences, squeezed, trimmed

#: Letters that are spoken, stage directions, and labels of lines that carry no answer.
SPOKEN = "A-Za-zА-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі一-鿿"
CYRILLIC = "А-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі"
DIRECTIONS = "laughs|giggles|whispers|sighs|pause|sarcastically|smiles?|breathes?"
MARKS = ".,;:!?"
#: Patterns and what stands for them, in order, before punctuation is set.
CUTS = (
    (r"\[\[/?[a-z_]+\]\]|\[\[[^\]]+\]\]|<[^>]+>", " "),
    (rf"\[(?:[A-Za-z][^\]]{{0,40}}|[{CYRILLIC}][^\]]{{0,40}}|[一-鿿][^\]]{{0,20}})\]", " "),
    (rf"(?i)\((?:{DIRECTIONS})\)", " "),
)


def sanitized(text: Column, keep_digits: bool = False) -> Column:
    """What can be spoken: no control tags, stage directions or odd signs, one mark of punctuation at a time, a blank
    after it unless a number goes on."""
    t = trimmed(text)
    for pattern, stand_in in CUTS:
        t = F.regexp_replace(t, pattern, stand_in)
    t = F.regexp_replace(t, rf"[^{'0-9' if keep_digits else ''}{SPOKEN}\s{MARKS}%/'’-]", " ")
    t = F.regexp_replace(F.regexp_replace(t, rf"([{MARKS}]){{2,}}", "$1"), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, rf"\s+([{MARKS}])", "$1"), rf"(?<!\d)([{MARKS}])(?=[^\s{MARKS}\d])", "$1 ")
    return F.regexp_replace(t, r"^[ \n\t-]+|[ \n\t-]+$", "")


def is_speakable(text: Column) -> Column:
    return sanitized(text).rlike(f"[{SPOKEN}]")


def needs_rewrite(text: Column) -> Column:
    """Whether the spoken form is other than the text."""
    return let(sanitized(text), lambda c: (c != "") & (c != trimmed(text)))


def sentence_key(x: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "))


def remaining_suffix(final: Column, streamed: Column) -> Column:
    """The final text's sentences that have not been streamed."""
    keys = F.filter(F.transform(sentences(streamed), sentence_key), lambda k: k != "")
    rest = lambda said: F.array_join(F.filter(sentences(final), lambda s: ~F.array_contains(said, sentence_key(s))), " ")
    return F.when(trimmed(streamed) == "", trimmed(final)).otherwise(let(keys, rest))


def answer_body(text: Column) -> Column:
    """A chunk's text without headings, tables, labels and metadata lines; the text itself if nothing is left."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != "")
    inline = lambda x: F.when(x.rlike(r"(?i)^(Category|Question)\s*:") & x.contains("Answer:"), trimmed(F.regexp_replace(x, r"(?s)^.*?Answer:", ""))).otherwise(x)
    bare = F.transform(F.transform(lines, inline), lambda x: trimmed(F.regexp_replace(x, r"(?i)^(?:Answer|FAQ-A)\s*:\s*", "")))
    kept = F.filter(bare, lambda x: (x != "") & ~x.rlike(r"(?i)^(URL|Title|Section|Category|Question)\s*:") & ~x.rlike(r"^(#|\[PDF|\|)"))
    return let(F.array_join(kept, " "), lambda body: F.when(trimmed(body) != "", trimmed(body)).otherwise(trimmed(text)))


def capped(text: Column, most: int) -> Column:
    """The first words of a text; a cut one ends in a full stop."""
    return let(
        F.split(trimmed(text), r"\s+"),
        lambda w: F.when(F.size(w) > most, F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, most), " "), "[ ,;:]+$", ""), F.lit("."))).otherwise(trimmed(text)),
    )
