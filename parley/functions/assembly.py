"""Words of a service's tokens, spaced as the transcript that comes with them."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

#: Signs after which a word that begins with a letter or digit stands apart.
BOUNDARY = ",.;:!?)}]'\""


class Token(NamedTuple):
    word: str
    punctuated: str | None
    start_ms: int
    end_ms: int
    speaker: int | None


def _alphanumeric(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def spaced(tokens: list[Token], transcript: str) -> list[str]:
    """Each token with what the transcript has before it, found from left to right; a space before those that it does not have."""
    out, at = [], 0
    for t in tokens:
        text = t.word if t.punctuated is None else t.punctuated
        bare = text.strip()
        found = transcript.find(bare, at) if bare else -1
        if found >= 0:
            out.append(transcript[at:found] + bare)
            at = found + len(bare)
        else:
            out.append(text if not bare or text.startswith(" ") else " " + text)
    return out


def stands_apart(before: str, word: str) -> bool:
    """Whether a word goes not on with the text before it: a sign lies between, other than a period inside a number, a name or an abbreviation."""
    before = before.rstrip()
    if not before or before[-1] not in BOUNDARY or not word or not _alphanumeric(word[0]):
        return False
    if before[-1] != ".":
        return True
    goes_on = unicodedata.category(word[0])[0] == "N" or (word[0].islower() and len(before) > 1 and _alphanumeric(before[-2]))
    return not goes_on


def assembled(tokens: list[Token], transcript: str) -> list[dict]:
    """Words (text, start_ms, end_ms, speaker): pieces without a space before them join the word before, unless they stand apart."""
    out: list[dict] = []
    for t, text in zip(tokens, spaced(tokens, transcript), strict=True):
        bare = text.lstrip()
        if out and not text.startswith(" "):
            if not stands_apart(out[-1]["text"], bare or t.word):
                last = out[-1]
                last["text"] += text
                last["end_ms"] = t.end_ms
                last["speaker"] = t.speaker if last["speaker"] is None else last["speaker"]
                continue
            text = " " + bare
        out.append({"text": text, "start_ms": t.start_ms, "end_ms": t.end_ms, "speaker": t.speaker})
    return out
