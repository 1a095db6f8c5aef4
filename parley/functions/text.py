"""Text functions as column expressions, and the phonetic code that needs a state machine as a pandas UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean_markdown(text: Column | str) -> Column:
    """Markdown without images, link targets, emphasis, code marks, headings, list markers and doubled spaces."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[*_`~#>]+", "")
    out = F.regexp_replace(out, r"(?m)^\s*(?:[-+]|\d+[.)])\s+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_html(html: Column | str) -> Column:
    """Text of HTML: breaks and paragraph ends become new lines, other tags spaces, five entities are resolved."""
    out = F.regexp_replace(html, r"(?i)<br\s*/?>|</p>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def truncated(text: Column | str, most: int) -> Column:
    """text cut to `most` characters, at the last space where that keeps more than 60 %, with '...'."""
    c = F.col(text) if isinstance(text, str) else text
    head = F.substring(c, 1, most)
    back = F.instr(F.reverse(head), " ")  # from the end, 0 without a space
    last = F.lit(most) - back  # characters before the last space
    cut = F.when((back > 0) & (last > most * 0.6), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


#: Titles that say nothing.
GENERIC_TITLES = ("new note", "untitled")


def title_key(title: Column | str) -> Column:
    """A title for comparison: lower case, single spaces, generic titles empty."""
    key = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    return F.when(key.isin(*GENERIC_TITLES), "").otherwise(key)


def merged_content(*parts: Column | str) -> Column:
    """Trimmed parts without empty ones, joined by a space."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: F.trim(p)), lambda p: p != ""), " ")


def spaced_word(text: Column | str, is_first: Column) -> Column:
    """A word as it is put after others: no space before the first word and before closing punctuation, else one at least; blank text stays."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(text, r"^\s+", "")
    joins = bare.rlike(r"^[,.;:!?)}\]']")
    return F.when(bare == "", text).when(is_first, bare).when(F.startswith(text, F.lit(" ")), text).when(joins, bare).otherwise(F.concat(F.lit(" "), bare))


def normalised_list(terms: Column | str) -> Column:
    """Terms trimmed, single-spaced, of two characters at least, each once in any case, in order of first appearance."""
    neat = F.filter(F.transform(terms, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: F.length(t) >= 2)
    by_key = F.array_sort(F.transform(neat, lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t"))))
    before = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int,t:string>")), F.slice(by_key, 1, F.greatest(F.size(by_key) - 1, F.lit(0))))
    first = F.filter(F.zip_with(by_key, before, lambda x, y: F.when(y.isNull() | (x["k"] != y["k"]), x)), lambda x: x.isNotNull())
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))), lambda x: x["t"])


def key_facts(text: Column | str, most: int = 3) -> Column:
    """The first lines of a list without bullets and numbers, each once in any case."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*+•]|\d+[.)])\s*", "")))
    return F.slice(normalised_list(lines), 1, most)


def core_of(token: Column | str) -> tuple[Column, Column, Column]:
    """(prefix, core, suffix) of a token: punctuation around it, with hyphens and apostrophes kept inside."""
    pattern = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    return tuple(F.regexp_extract(token, pattern, i) for i in (1, 2, 3))


def _accented() -> dict[str, str]:
    """Small Latin letters that decompose into an ASCII letter and marks, with that letter."""
    small = (c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.islower())
    return {c: base for c in small if (base := unicodedata.normalize("NFD", c)[0]).isascii()}


#: Small letters without a decomposition, as search terms write them in ASCII.
_STROKED = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "ð": "d"}
_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
_PLAIN = _accented() | _STROKED


def folded(text: Column | str) -> Column:
    """A text in lower case with accented Latin letters as ASCII; other scripts stay."""
    low = F.lower(text)
    out = F.translate(low, "".join(_PLAIN), "".join(_PLAIN.values()))
    for letter, plain in _LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(out)  # texts in ASCII need no look


def folded_term(term: str) -> str:
    """What `folded` makes of one literal."""
    return term.lower().translate(str.maketrans(_PLAIN | _LIGATURES))


def ngrams(text: Column | str, most: int = 3) -> Column:
    """All runs of 1 to `most` characters of a folded text, by start and then by length; three characters are never above the 40 bytes of a term."""
    low = folded(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(i + n - 1 <= F.length(low), F.substring(low, i, n)))))
    return F.filter(grams, lambda g: g.isNotNull() & (g != ""))


def plain_words(text: Column | str) -> Column:
    """Lower-cased words of letters and digits, of 40 bytes at most."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.octet_length(w) <= 40))


def word_tokens(text: Column | str) -> Column:
    """Folded words of letters and digits, of 40 bytes at most when folded."""
    return plain_words(folded(text))


def _fnv1a(text: str) -> str:
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a over UTF-16 units, in hex; null stays null."""
    return text.map(_fnv1a, na_action="ignore")


#: Letters by their digit in the phonetic code of Cologne, where neighbours do not matter.
_DIGITS = {"A": "0", "E": "0", "I": "0", "J": "0", "O": "0", "U": "0", "Y": "0", "B": "1", "F": "3", "V": "3", "W": "3", "G": "4", "K": "4", "Q": "4", "L": "5", "M": "6", "N": "6", "R": "7", "S": "8", "Z": "8"}


def cologne(word: str) -> str:
    """The phonetic code of Cologne of one word: equal digits in a row once, zeros only in front."""
    plain = unicodedata.normalize("NFD", word.upper().replace("ß", "SS")).encode("ascii", "ignore").decode()
    s = [c for c in plain if "A" <= c <= "Z"]
    digits = []
    for i, c in enumerate(s):
        before, after = (s[i - 1] if i else ""), (s[i + 1] if i + 1 < len(s) else "")
        if c in _DIGITS:
            d = _DIGITS[c]
        elif c == "P":
            d = "3" if after == "H" else "1"
        elif c in "DT":
            d = "8" if after and after in "CSZ" else "2"
        elif c == "X":
            d = "8" if before and before in "CKQ" else "48"
        elif c == "C":
            if not before:
                d = "4" if after and after in "AHKLOQRUX" else "8"
            else:
                d = "4" if before not in "SZ" and after and after in "AHKOQUX" else "8"
        else:
            d = ""  # H
        digits.extend(d)
    single = [d for i, d in enumerate(digits) if not i or d != digits[i - 1]]
    return "".join(d for i, d in enumerate(single) if d != "0" or not i)


@F.pandas_udf(StringType())
def cologne_code(phrase: pd.Series) -> pd.Series:
    """Codes of a phrase's words joined by '-'; null stays null."""
    return phrase.map(lambda p: "-".join(cologne(w) for w in p.split()), na_action="ignore")


#: Frequent words by language.
FREQUENT = {
    "de": ("der", "die", "und", "das", "nicht", "ist", "ein", "zu", "den", "mit", "von", "auf", "für", "sich", "dem"),
    "en": ("the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "are", "this", "be", "as"),
    "es": ("el", "los", "y", "que", "de", "la", "en", "un", "por", "con", "para", "una", "su", "al", "las"),
    "fr": ("le", "les", "et", "des", "est", "dans", "un", "une", "qui", "pour", "du", "sur", "pas", "que", "la"),
}
#: Other names of these languages.
LANGUAGE_CODES = {"deu": "de", "ger": "de", "german": "de", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr"}


def frequent_word_language(text: Column | str) -> Column:
    """The language whose frequent words a text has most of, the first by code among equals; null without any."""
    own = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+")
    frequent = sorted({w for words in FREQUENT.values() for w in words})

    def best(words: Column) -> Column:
        counts = [F.struct(F.size(F.filter(words, lambda w: w.isin(*FREQUENT[code]))).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, code in enumerate(sorted(FREQUENT))]
        return F.array_max(F.array(*counts))

    # A list of one names its value, which is thereby made once for a row.
    first = F.transform(F.transform(F.array(F.filter(own, lambda w: w.isin(*frequent))), best), lambda c: F.when(c["n"] > 0, c["code"]))
    return F.get(first, F.lit(0))


def language_code(name: Column | str) -> Column:
    """A two-letter code from a code with region or a name; null where it is unknown."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"[-_].*$", "")
    known = F.create_map(*[F.lit(x) for kv in (LANGUAGE_CODES | {c: c for c in FREQUENT}).items() for x in kv])
    return F.try_element_at(known, low)
