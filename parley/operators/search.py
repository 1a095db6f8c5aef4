"""Full-text search without an index: query parts, BM25 in one scan, fuzzy terms, places in conversations, keywords. `kept_index` has what an index answers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import folded_term, word_tokens

K1, B = 1.2, 0.75
#: A hit in a title counts so many times in fuzzy and boolean queries.
TITLE_BOOST = 3.0


def parse(query: str) -> list[tuple[str, list[str]]]:
    """(sign, terms) of each part of a query: quoted parts are phrases, an open quote reaches to the end; + and - are signs; terms are folded as words are."""
    out = []
    for sign, quoted, plain in re.findall(r'([+-]?)(?:"([^"]*)"?|([^\s"]+))', query):
        terms = [w for w in re.split(r"[^\w]+", folded_term(quoted or plain)) if w]
        if terms:
            out.append((sign, terms))
    return out


def scored(docs: DataFrame, terms: Sequence[str], field: str) -> DataFrame:
    """(id, term, score): BM25 of each term in one field, without an index: only words of the query leave the scan.

    The number of documents and their mean length are two numbers of one pass;
    document frequencies are a grouped count of what matched.
    """
    words = docs.select("id", word_tokens(F.coalesce(F.col(field), F.lit(""))).alias("w"))
    n, mean = words.agg(F.count("*"), F.avg(F.size("w"))).first()
    tf = F.filter(F.transform(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf"))), lambda x: x["tf"] > 0)
    hits = words.select("id", F.size("w").alias("length"), F.explode(tf).alias("x")).select("id", "length", "x.term", "x.tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(F.broadcast(df), "term").select("id", "term", _bm25(F.col("tf"), F.col("length"), F.col("df"), n, mean or 1.0).alias("score"))


def _bm25(tf: Column, length: Column, df: Column, n: int, mean: float) -> Column:
    idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean))))


def any_of(docs: DataFrame, terms: Sequence[str], field: str = "content") -> DataFrame:
    """(id, score) of documents that have any of the terms."""
    return scored(docs, terms, field).groupBy("id").agg(F.sum("score").alias("score"))


def fuzzy_terms(docs: DataFrame, field: str, term: str, distance: int = 1) -> DataFrame:
    """(term, df): words of the field within an edit distance of a term; words of other lengths are not compared."""
    words = docs.select("id", F.explode(F.array_distinct(word_tokens(F.coalesce(F.col(field), F.lit(""))))).alias("term"))
    near = words.where(F.length("term").between(len(term) - distance, len(term) + distance))
    vocabulary = near.groupBy("term").agg(F.count("*").alias("df"))
    return vocabulary.where(swapped_distance(F.col("term"), term) <= distance)


def swapped_distance(word: Column, term: str) -> Column:
    """Edit distance to a literal in which swapping two neighbouring letters costs one: the least over the term and its swaps."""
    own = F.levenshtein(word, F.lit(term))
    swaps = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)} - {term}
    return F.least(own, *[F.levenshtein(word, F.lit(s)) + 1 for s in sorted(swaps)]) if swaps else own


def top(hits: DataFrame, limit: int = 100) -> DataFrame:
    """The best hits and, beside each, how many there were in all."""
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(F.col("score").desc(), "id").limit(limit).join(F.broadcast(total))


def overlapping_hits(rows: DataFrame, key: str, order: str, text: str, needle: str) -> DataFrame:
    """(key, order, hits): where a needle starts in the joined rows of each key, counted by row; overlapping hits all count.

    A hit lies in one row or starts in a row and goes on over the space into the
    next ones, so each row is searched together with what follows it up to the
    needle's length.
    """
    n = len(needle)
    w = Window.partitionBy(key).orderBy(order)
    after = F.array_join(F.collect_list(F.substring(text, 1, n)).over(w.rowsBetween(1, n)), " ")
    joined = F.lower(F.concat(F.col(text), F.when(after != "", F.concat(F.lit(" "), F.substring(after, 1, n - 1))).otherwise(F.lit(""))))
    found = rows.select(key, order, F.col(text).alias("own"), joined.alias("body"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("own") + 1, F.lit(1))), lambda i: F.substring(F.col("body"), i, F.lit(n)) == needle.lower())
    # `split` finds hits that do not overlap; a needle that cannot overlap itself has no others.
    overlaps = any(needle[i:] == needle[: n - i] for i in range(1, n))
    hits = F.size(starts) if overlaps else F.size(F.split(F.col("body"), re.escape(needle.lower()), -1)) - 1
    return found.select(key, order, hits.cast("long").alias("hits")).where("hits > 0")


_CODE = re.compile(r"```.*?```", re.DOTALL), re.compile(r"`[^`]+`")
_TOKENS = re.compile(r"[^ \t\n\r\f#*_~`\[\]()]+")
#: Tokens that a task remembers at most.
KNOWN_TOKENS = 200_000


def _core(token: str) -> tuple[str, bool]:
    """(core, closes): a token without signs around it, and whether those behind it end a sentence."""
    if token.isalnum():
        return token, False
    inside = [i for i, c in enumerate(token) if c.isalnum()]
    end = inside[-1] + 1 if inside else 0
    return token[inside[0] : end] if inside else "", any(c in ".!?" for c in token[end:])


def _known(token: str, stop_words: frozenset[str]) -> tuple[str, str, bool, bool, bool]:
    """(core, key, closes, everywhere, inside): a token's core as written and in lower case, and whether it is a keyword everywhere or only inside a sentence."""
    core, closes = _core(token)
    key = core.lower()
    fit = len(core) >= 2 and any(c.isalpha() for c in core)
    return core, key, closes, fit and key not in stop_words, fit and core[:1].isupper()


def _keyword_terms(text: str, named: Sequence[str | None], stop_words: frozenset[str], known: dict[str, tuple]) -> dict[str, list]:
    """Terms of two characters or more by their lower case: [first (rank, place, term), times as keyword, times as phrase] of all named terms (0), tags (1), keywords (2) and phrases (3)."""
    body = _CODE[1].sub("", _CODE[0].sub("", text))
    found: dict[str, list] = {}
    for t in [*((0, i, x) for i, x in enumerate(named) if x is not None), *((1, i, x) for i, x in enumerate(re.findall(r"#(\w+)", body)))]:
        if len(t[2]) >= 2:
            entry = found.setdefault(t[2].lower(), [t, 0, 0])
            entry[0] = min(entry[0], t)
    run: list[str] = []
    n, starts = 0, True

    def ended() -> None:
        if len(run) > 1:
            t = (3, 0, " ".join(run))
            entry = found.setdefault(t[2].lower(), [t, 0, 0])
            entry[0] = min(entry[0], t)
            entry[2] += 1
        run.clear()

    for token in _TOKENS.findall(body):
        if (of := known.get(token)) is None:
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            of = known[token] = _known(token, stop_words)
        core, key, closes, everywhere, inside = of
        if starts:
            ended()
        if everywhere or (inside and not starts):
            if (entry := found.get(key)) is None:
                found[key] = [(2, n, core), 1, 0]
            else:
                entry[1] += 1
            run.append(core)
            n += 1
        else:
            ended()
        starts = closes
    ended()
    return found


def keywords(docs: DataFrame, stop_words: Sequence[str], most: int = 50) -> DataFrame:
    """(id, term, n, place): hints of documents (id, text, named): named terms, then #tags, keywords, and phrases.

    Code goes before anything is read. Keywords are words of two characters with
    a letter that are no stop words, where a capital inside a sentence counts in
    any case; the most frequent come first, in original case; a phrase is a run
    of them inside one sentence. A term counts once in any case, under its first
    kind and spelling; terms of one character go. A document is read once in
    its task, and only its `most` terms leave it.
    """
    kind, stop = docs.schema["id"].dataType.simpleString(), frozenset(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            own, terms, counts, places = [], [], [], []
            for row, (text, named) in enumerate(zip(batch.column("text").to_pylist(), batch.column("named").to_pylist(), strict=True)):
                found = _keyword_terms(text or "", named or [], stop, known)
                ranked = sorted((t[0], -(n2 if t[0] == 2 else n3 if t[0] == 3 else 0), t[1], key, t[2]) for key, (t, n2, n3) in found.items())[:most]
                own += [row] * len(ranked)
                terms += [x[4] for x in ranked]
                counts += [-x[1] for x in ranked]
                places += range(1, len(ranked) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(places, pa.int32())], ["id", "term", "n", "place"])

    return docs.select("id", "text", "named").mapInArrow(run, f"id {kind}, term string, n long, place int")
