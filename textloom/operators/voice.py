"""Chunks of text for speech, cut as early as they sound whole, from a text that is still being written.

A text is read one character at a time, the last read being looked at only to tell whether what stands before it is over.
So the chunks hang on the text alone, not on how it was cut into deltas.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .folds import Transition

#: Letters of a word, what joins two halves of one, and marks that end a sentence.
LETTERS = re.compile("[A-Za-zА-Яа-яЁёӘәҒғҚқҢңӨөҰұҮүҺһІі0-9一-鿿]")
CAPITALS = re.compile("[A-ZА-ЯЁӘҒҚҢӨҰҮҺІ一-鿿]")
HAN = re.compile("[一-鿿]")
JOINERS = "'’-"
ENDS = ".!?。！？"
MOST_WORDS = 18


class Profile(NamedTuple):
    """Characters of the first chunk, of others, at most, and of the shortest sentence that is a chunk."""

    first: int
    least: int
    most: int
    short: int


HAN_PROFILE, WORD_PROFILE = Profile(18, 24, 44, 14), Profile(48, 80, 220, 40)


def next_cut(text: str, pos: int, number: int, profile: Profile) -> int | None:
    """Where the chunk that begins at pos (not white space) ends, or None if the text so far doesn't tell.

    The first character read after which one of these is known decides, the earliest of them if several are: the end of a
    sentence of `short` characters or more (a line feed; or an end mark before white space, a capital or a Han character);
    the end of a word at the least length or after; the 18th word's end, with the end mark behind it; or, beyond the most,
    the last word's end within it. With Han characters the least and the most lengths are cuts themselves."""
    least = profile.first if number == 0 else profile.least
    han = in_word = joined = False
    words, filled, late_end, max_end = 0, pos, None, None
    waiting: int | None = None  # the end of the 18th word, while white space follows it
    joiner: int | None = None  # a joiner that may lead on to the word's second half
    for k in range(pos, len(text)):
        c = text[k]
        letter = LETTERS.match(c) is not None
        ended = None
        if in_word:
            if joiner is not None:
                if letter:
                    joined = True
                else:
                    ended = joiner
                joiner = None
            elif not letter:
                if c in JOINERS and not joined:
                    joiner = k
                else:
                    ended = k
            in_word = ended is None
        if letter and not in_word:
            in_word, joined = True, False
        han = han or HAN.match(c) is not None
        if not c.isspace():
            filled = k + 1
        found = []
        if c == "\n" and len(text[pos : k + 1].strip()) >= profile.short:
            found.append(k + 1)
        elif k > pos and text[k - 1] in ENDS and k - pos >= profile.short and (c.isspace() or CAPITALS.match(c)):
            found.append(k + 1 if c.isspace() else k)
        if ended is not None:
            words += 1
            if late_end is None and ended - pos >= least:
                late_end = ended
            if ended - pos <= profile.most:
                max_end = ended
            if words == MOST_WORDS:
                waiting = ended
        if filled - pos >= least:
            if han:
                found.append(min(k + 1, pos + max(1, least)))
            elif late_end is not None:
                found.append(late_end)
        if waiting is not None and not c.isspace():
            found.append(k + 1 if c in ENDS else waiting)
        if filled - pos > profile.most:
            found.append(pos + profile.most if han or max_end is None else max_end)
        if found:
            return min(found)
    return None


def cleaned(chunk: str) -> str:
    """White space squeezed, none before an end mark; empty without a word."""
    chunk = re.sub(r"\s+", " ", chunk).strip()
    chunk = re.sub(rf"\s+([{ENDS}])", r"\1", chunk)
    return chunk if LETTERS.search(chunk) else ""


class VoiceChunks(Transition):
    """Deltas of one text (delta, language, last: nothing comes after it) in order, into numbered chunks. The state is what
    is not yet cut, the next number and whether the last delta has come."""

    rows = "chunk int, text string"

    def start(self) -> list:
        return ["", 0, False]

    def joined(self, rows: list[dict]) -> list[dict]:
        """Deltas of one language up to the last one, as one: a text is read over for each that is left."""
        out: list[list[dict]] = []
        for row in rows:
            if out and out[-1][-1]["language"] == row["language"] and not out[-1][-1]["last"]:
                out[-1].append(row)
            else:
                out.append([row])
        return [x[-1] | {"delta": "".join(r["delta"] or "" for r in x)} for x in out]

    def over(self, state: list) -> bool:
        return state[2]

    def step(self, state: list, row: dict) -> tuple[list, list[tuple]]:
        text, number = state[0] + (row["delta"] or ""), state[1]
        profile = HAN_PROFILE if row["language"] == "zh" else WORD_PROFILE
        out, pos = [], 0
        while True:
            while pos < len(text) and text[pos].isspace():
                pos += 1
            cut = next_cut(text, pos, number, profile)
            if cut is None:
                break
            number += self._give(text[pos:cut], number, out)
            pos = cut
        if row["last"]:
            number += self._give(text[pos:], number, out)
            pos = len(text)
        return [text[pos:], number, bool(row["last"])], out

    def _give(self, chunk: str, number: int, out: list) -> int:
        if chunk := cleaned(chunk):
            out.append((number, chunk))
        return len(chunk) > 0

    def end(self, state: list) -> list[tuple]:
        """A text that was broken off."""
        out: list[tuple] = []
        self._give(state[0], state[1], out)
        return out
