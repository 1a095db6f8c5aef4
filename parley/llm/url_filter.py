"""URLs allowed or blocked by rules of host and path, and by boosted trees on lexical features where no rule fits.

A rule is a host and a path, as `net/es/`. It fits a URL whose host is the rule's
or a subdomain of it and whose path starts with the rule's; the longest rule
that fits decides. Rules are looked up, not tried one by one: the endings of a
host, joined with the beginnings of its path that are as long as some rule's,
are the only names a fitting rule can have. Up to INLINE_RULES rules, with their
bytes counted, are part of the plan; more are joined, host and path pairs made
distinct first so that a frequent host is looked up once.

The method learns from labelled URLs: lexical features of each (lengths, depth,
shares of digits and other characters, entropy, counts of parameters, runs of
digits) and statistics of its endings: the smoothed odds of being blocked for
its host's last one to three labels, its first path segment and its file
ending, without the URL's own label while it trains. Trees of few levels are
boosted on them. Different URLs count once for each, weighted by their number,
so a frequent one doesn't crowd the sample out.

Defined results: null, or no `://`: host and path are empty, no rule fits and the
features are those of an empty text; an empty path does not start with `/`, so
a rule of a host and `/` does not fit it; of rules of equal length that fit, the
one with the longer host decides, of equal rules a blocking one; repeated rows
are each judged, alike; very long URLs are read whole; an empty table gives an
empty one. Without labelled URLs, or with those of one class only, the method
gives that share, and URLs are allowed at 0.5 or less. Columns named host, path,
rule, verdict or blocked stay, and the new ones get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import _labelled as L
from parley.llm import _text as X
from parley.llm._shared import checkpointed, unused
from parley.llm.toxicity import Trees, boost

#: Labelled URLs of each class that training reads at most, about.
SAMPLE_ROWS = 10_000
#: Rules, and bytes of them, that are part of the plan; beyond either they are joined.
INLINE_RULES, INLINE_BYTES = 2_000, 200_000
#: URLs that an ending must have in the sample to count, and how many URLs of the whole share its odds start from.
LEAST_URLS, PRIOR = 3, 4.0

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = (
    "length", "host_length", "path_length", "query_length", "depth", "labels", "longest_label", "digits", "host_digits", "path_digits", "digit_run", "hyphens", "dots", "capitals",
    "symbols", "escapes", "beyond_ascii", "entropy", "host_entropy", "parameters", "values", "fragment", "secure", "numeric_host", "file_ending",
    "odds_last", "odds_two", "odds_three", "odds_segment", "odds_file",
)
ENDINGS = 5
_DIGIT, _UPPER = L.DIGIT, L.UPPER
_SYMBOL = L.members("~!$'()*+,;@_=&%|{}[]^`\\")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _LETTERS, _LETTERS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def parsed_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(host, path, verdict) of rules (text, verdict); of equal ones, a blocking one."""
    known: dict[tuple[str, str], str] = {}
    for text, verdict in rules:
        host, slash, path = text.partition("/")
        key = (host.translate({ord(c): c.lower() for c in _LETTERS}), slash + path)
        known[key] = "block" if "block" in (verdict, known.get(key)) else verdict
    return [(h, p, v) for (h, p), v in sorted(known.items())]


def _names(host: Column, path: Column, depth: int, lengths: list[int]) -> Column:
    """(host, path) of every rule that can fit, the longest first and of equal length the one with the longer host."""
    labels = F.split(host, r"\.", -1)
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(endings, lambda e: F.transform(starts, lambda n: F.struct((F.length(e) + n).alias("size"), F.length(e).alias("long"), e.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))
    return F.reverse(F.array_sort(pairs))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict; the latter two are null where no rule fits."""
    host, path, rule, verdict = (unused(pages, c) for c in ("host", "path", "rule", "verdict"))
    told = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    known = parsed_rules(rules)
    if not known:
        return told.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(None).cast("string")})
    depth, lengths = max(h.count(".") + 1 for h, _, _ in known), sorted({len(p) for _, p, _ in known})
    names = _names(F.col(host), F.col(path), depth, lengths)
    if len(known) <= INLINE_RULES and sum(len((h + p).encode()) for h, p, _ in known) <= INLINE_BYTES:
        pairs = [F.lit(x) for h, p, v in known for x in (f"{h}\n{p}", v)]
        at = F.transform(names, lambda n: F.struct(F.concat(n["host"], n["path"]).alias("rule"), F.element_at(F.create_map(*pairs), F.concat(n["host"], F.lit("\n"), n["path"])).alias("verdict")))
        hit = unused(told, "hit")
        first = told.withColumn(hit, F.get(F.filter(at, lambda x: x["verdict"].isNotNull()), F.lit(0)))
        return first.withColumns({rule: F.col(f"{hit}.rule"), verdict: F.col(f"{hit}.verdict")}).drop(hit)
    table = pages.sparkSession.createDataFrame(known, "r_host string, r_path string, r_verdict string")
    wanted = told.select(F.col(host).alias("u_host"), F.col(path).alias("u_path")).distinct().withColumn("n", F.explode(_names(F.col("u_host"), F.col("u_path"), depth, lengths)))
    fits = wanted.join(table, (F.col("n.host") == F.col("r_host")) & (F.col("n.path") == F.col("r_path"))).groupBy("u_host", "u_path").agg(
        F.max(F.struct("n.size", "n.long", F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best")
    )
    joined = told.join(fits, (F.col(host) == F.col("u_host")) & (F.col(path) == F.col("u_path")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in told.columns], F.col("best.rule").alias(rule), F.col("best.verdict").alias(verdict))


def _spans(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(host begins, host ends, path ends) of each URL as byte bounds; all at its start where it has no `://`."""
    d, b = t.data, t.bounds
    marks = np.flatnonzero((d[:-2] == 58) & (d[1:-1] == 47) & (d[2:] == 47)) if len(d) > 2 else np.zeros(0, int)
    i = np.searchsorted(marks, b[:-1])
    first = np.append(marks, len(d) + 3)[i]
    has = first + 3 <= b[1:]
    begin = np.where(has, first + 3, b[:-1])
    stop = lambda byte: _find_from(d, begin, b[1:], byte)
    query = np.minimum(stop(63), stop(35))
    host_end = np.where(has, np.minimum(stop(47), query), begin)
    path_end = np.where(has, query, begin)
    return begin, host_end, path_end


def _find_from(data: np.ndarray, begin: np.ndarray, end: np.ndarray, byte: int) -> np.ndarray:
    """Where a byte first stands in each span, else the span's end."""
    at = np.flatnonzero(data == byte)
    first = np.append(at, len(data))[np.searchsorted(at, begin)]
    return np.where(first < end, first, end)


def _most(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest value of each span, 0 for an empty one."""
    cuts = np.stack([begin, end], axis=1).reshape(-1)
    return np.where(end > begin, np.maximum.reduceat(np.append(values, 0), cuts)[::2], 0) if len(begin) else np.zeros(0)


def _entropy(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits a byte of each span by its own frequencies; counted over the bytes of the span, whatever its length."""
    size = end - begin
    owner = np.repeat(np.arange(len(begin)), size)
    cell, count = np.unique(owner * 256 + data[X.ranges(begin, size)], return_counts=True)
    of = cell // 256
    p = count / np.maximum(size, 1)[of]
    return np.bincount(of, -p * np.log2(p), len(begin))[: len(begin)]


def _endings(t: X.Texts, begin: np.ndarray, host_end: np.ndarray, path_end: np.ndarray) -> np.ndarray:
    """Hashes of each URL's host from its last, second last and third last label, its first path segment and its file ending; 0 where it has none."""
    low = t.lowered()
    d, n = low.data, len(begin)
    dots = np.flatnonzero(d == 46)
    out = np.zeros((n, ENDINGS), np.uint64)

    def put(column: int, start: np.ndarray, end: np.ndarray, there: np.ndarray) -> None:
        h = X.mix(X.span_hashes(X._BYTE_CODE[d], np.minimum(start, end), end), 20 + column)
        out[:, column] = np.where(there & (end > start), np.maximum(h, np.uint64(1)), np.uint64(0))

    last = np.searchsorted(dots, host_end)
    before = np.searchsorted(dots, begin)
    for k in (1, 2, 3):
        has = last - before >= k
        start = np.where(has, np.append(dots, 0)[np.where(has, last - k, 0)] + 1, begin) if len(dots) else begin
        put(k - 1, start, host_end, last - before >= k - 1)
    segment = np.minimum(host_end + 1, path_end)
    put(3, segment, _find_from(d, segment, path_end, 47), np.ones(n, bool))
    slash = np.flatnonzero(d == 47)
    name = np.maximum(np.append(slash, 0)[np.maximum(np.searchsorted(slash, path_end) - 1, 0)] + 1 if len(slash) else host_end, host_end)
    name = np.minimum(name, path_end)
    file_dot = np.append(dots, 0)[np.maximum(np.searchsorted(dots, path_end) - 1, 0)] if len(dots) else np.zeros(n, int)
    put(4, file_dot + 1, path_end, (file_dot >= name) & (len(dots) > 0))
    return out


@dataclass
class Odds:
    """Sorted ending hashes with the weight n of their URLs and a of blocked ones, and the blocked share p of all."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    a: np.ndarray = field(default_factory=lambda: np.zeros(0))
    p: float = 0.5

    def of(self, endings: np.ndarray, y: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log odds of being blocked with an ending less those of any URL, without what a URL itself adds; 0 for unknown ones."""
        if not len(self.terms):
            return np.zeros(endings.shape)
        at = np.minimum(np.searchsorted(self.terms, endings), len(self.terms) - 1)
        known = self.terms[at] == endings
        n, a = self.n[at], self.a[at]
        if y is not None:
            n, a = n - weight[:, None], a - (weight * y)[:, None]
        n = np.maximum(n, 0)
        q = (np.clip(a, 0, n) + PRIOR * self.p) / (n + PRIOR)
        return np.where(known, np.log(q / (1 - q)) - np.log(self.p / (1 - self.p)), 0.0)


def features(column: pa.Array, odds: Odds, y: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """One row of FEATURES for each URL; with y and weight, the URLs are training rows whose own labels are left out."""
    t = X.texts_of(column)
    d, b = t.data, t.bounds
    begin, host_end, path_end = _spans(t)
    start, end = b[:-1], b[1:]
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])

    def count(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        c = total(mask)
        return c[hi] - c[lo]

    size, host, path, query = end - start, host_end - begin, path_end - host_end, end - path_end
    slash, dot, digit = d == 47, d == 46, _DIGIT[d]
    place = np.arange(len(d))
    since = lambda mask, lo: place - np.maximum(np.maximum.accumulate(np.where(mask, place, -1)), np.repeat(lo - 1, size))
    run = _most(since(~digit, start), start, end)
    labels = _most(since(dot, begin), begin, host_end)
    share = lambda mask: L.share(count(mask, start, end), size)
    ends = _endings(t, begin, host_end, path_end)
    scheme = (begin - start >= 8) & (np.append(d, [0] * 8)[np.minimum(start + 4, len(d))] == 115)
    numeric = (count(digit | dot, begin, host_end) == host) & (host > 0)
    cols = [
        size, host, path, query, count(slash, host_end, path_end), np.where(host > 0, count(dot, begin, host_end) + 1, 0), labels, share(digit), L.share(count(digit, begin, host_end), host), L.share(count(digit, host_end, path_end), path),
        run, count(d == 45, begin, host_end), count(dot, host_end, path_end), share(_UPPER[d]), share(_SYMBOL[d]), count(d == 37, start, end), share(d >= 128),
        _entropy(d, start, end), _entropy(d, begin, host_end), np.where(count(d == 63, path_end, end) > 0, count(d == 38, path_end, end) + 1, 0), count(d == 61, path_end, end), count(d == 35, path_end, end) > 0, scheme, numeric, ends[:, 4] > 0,
    ]
    return np.concatenate([np.stack([np.asarray(c, float) for c in cols], axis=1), odds.of(ends, y, weight)], axis=1)


@dataclass
class Model:
    odds: Odds
    trees: Trees

    def blocked(self, column: pa.Array) -> np.ndarray:
        return L.sigmoid(self.trees.raw(features(column, self.odds)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, url: str = "url", blocked: str = "blocked") -> Model | None:
    """Trains on URLs labelled by a boolean column, about `sample_rows` different ones of each class at most; None without any."""
    known = labelled.where(F.col(blocked).isNotNull() & F.col(url).isNotNull()).groupBy(F.col(url).alias("url"), F.col(blocked).cast("int").alias("y")).agg(F.count("*").cast("double").alias("weight"))
    known = checkpointed(known)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(11), "url"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, sample_rows / max(sizes.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample_rows / max(sizes.get(0, 0), 1))))
    rows = known.where(draw <= rate).select("url", "y", (F.col("weight") / rate).alias("weight")).toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("url", "ascending"), ("y", "ascending")])
    column = rows.column("url").combine_chunks()
    y, w = (rows.column(c).to_numpy().astype(float) for c in ("y", "weight"))
    w = np.minimum(w / w.mean(), 20.0)  # a URL of very many rows does not decide alone
    t = X.texts_of(column)
    ends = _endings(t, *_spans(t))
    p = float((w @ y + 0.5) / (w.sum() + 1))
    terms, at, n = np.unique(ends.reshape(-1), return_inverse=True, return_counts=True)
    wide = np.repeat(w, ENDINGS)
    sums = [np.bincount(at, v, len(terms)) for v in (wide, wide * np.repeat(y, ENDINGS))]
    keep = (n >= LEAST_URLS) & (terms != 0)
    odds = Odds(terms[keep], sums[0][keep], sums[1][keep], p)
    return Model(odds, boost(features(column, odds, y, w), y, w))


def scored(pages: DataFrame, model: Model | None, url: str = "url") -> DataFrame:
    """Adds blocked, the method's probability that a URL is to be blocked."""
    name = unused(pages, "blocked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch, url):
                s = model.blocked(part.column(url)) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, name])

    return pages.mapInArrow(run, pages.withColumn(name, F.lit(0.0)).schema)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: Model | None, url: str = "url") -> DataFrame:
    """Adds host, path, rule, blocked and verdict: the rule's where one fits, else block where the method's probability is above 0.5."""
    told = ruled(pages, rules, url)
    verdict, blocked = told.columns[-1], unused(told, "blocked")
    done = scored(told, model, url)
    return done.withColumn(verdict, F.coalesce(F.col(verdict), F.when(F.col(blocked) > 0.5, F.lit("block")).otherwise(F.lit("allow"))))


def rule_labels(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, blocked): the URLs that a rule decides, as labelled examples for the method."""
    told = ruled(pages.select(F.col(url).alias("url")), rules).where("verdict is not null")
    return told.select("url", (F.col("verdict") == "block").alias("blocked"))
