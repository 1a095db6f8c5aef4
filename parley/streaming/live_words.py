"""Live transcripts as keyed streaming state: late words, stitched words, partials, corrections and flush.

Each (transcript, channel) is one key with a small bounded state, so keys spread
over all state partitions. The step that a micro-batch takes is a pure function
of state and messages (`step`), which batch tests call as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions.assembly import Token, assembled

#: Gap in milliseconds within which pieces of a word join; partial words that state holds at most, their bytes and milliseconds; correction jobs that it holds, their words and bytes.
STITCH_GAP = 300
MOST_PARTIALS, MOST_PARTIAL_BYTES, LONGEST_PARTIALS = 512, 128 * 1024, 120_000
MOST_JOBS, MOST_JOB_WORDS, MOST_JOB_BYTES = 64, 4096, 256 * 1024
SENTENCE_END = (".", "!", "?")

OUTPUT = "transcript long, channel int, id string, text string, start_ms long, end_ms long, state string, replaces array<string>"
MESSAGE = "transcript long, channel int, seq long, kind string, job string, words array<struct<text: string, start_ms: long, end_ms: long>>"


def empty() -> dict[str, Any]:
    return {"watermark": -1, "held": None, "partials": [], "jobs": {}}


def _joins(held: dict, head: dict) -> bool:
    """Whether a word goes on with the next piece: no space before it, close in time, and no sentence ended."""
    return not head["text"].startswith(" ") and head["start_ms"] - held["end_ms"] <= STITCH_GAP and not held["text"].rstrip().endswith(SENTENCE_END)


def _word(w: dict, key: str, state: str, replaces: list[str] | None = None) -> dict:
    return w | {"id": f"{key}:{w['start_ms']}:{w['end_ms']}", "state": state, "replaces": replaces or []}


def _size(text: str) -> int:
    return len(text.encode())


def _stitched(state: dict, words: list[dict]) -> list[dict]:
    """Words that are whole once these follow the held one; the last becomes the held one, unless it is too long to hold."""
    out = []
    for w in words:
        held = state["held"]
        if held and _joins(held, w):
            state["held"] = held | {"text": held["text"] + w["text"], "end_ms": max(held["end_ms"], w["end_ms"])}
            continue
        if held:
            out.append(held)
        state["held"] = w
    if state["held"] and _size(state["held"]["text"]) > MOST_PARTIAL_BYTES:
        out.append(state["held"])
        state["held"] = None
    return out


def _overflow(state: dict) -> int:
    """How many of the first partials are beyond a bound of number, bytes or time."""
    partials = state["partials"]
    if not partials:
        return 0
    latest = max(p["end_ms"] for p in partials)
    old = 0
    while old < len(partials) and partials[old]["end_ms"] <= latest - LONGEST_PARTIALS:
        old += 1
    size, first = _size(state["held"]["text"]) if state["held"] else 0, len(partials)
    while first and (size := size + _size(partials[first - 1]["text"])) <= MOST_PARTIAL_BYTES:
        first -= 1
    return max(old, len(partials) - (MOST_PARTIALS - bool(state["held"])), first)


def _partial(state: dict, words: list[dict], key: str) -> list[dict]:
    late = 0
    while late < len(words) and words[late]["end_ms"] <= state["watermark"]:
        late += 1
    words = words[late:]
    if not words:
        return []
    lo, hi = words[0]["start_ms"], words[-1]["end_ms"]
    kept = [p for p in state["partials"] if p["end_ms"] <= lo or p["start_ms"] >= hi]
    state["partials"] = sorted(kept + words, key=lambda w: (w["start_ms"], w["end_ms"]))
    out = []
    while (n := _overflow(state)) > 0:
        over, state["partials"] = state["partials"][:n], state["partials"][n:]
        state["watermark"] = max(state["watermark"], *(w["end_ms"] for w in over))
        out += _stitched(state, over)
    return [_word(w, key, "final") for w in out]


def _final(state: dict, words: list[dict], key: str, label: str) -> list[dict]:
    late = 0
    while late < len(words) and words[late]["end_ms"] <= state["watermark"]:
        late += 1
    words = words[late:]
    if not words:
        return []
    before = [p for p in state["partials"] if p["end_ms"] <= words[0]["start_ms"]]
    state["partials"] = [p for p in state["partials"] if p["end_ms"] > words[0]["start_ms"] and p["start_ms"] > words[-1]["end_ms"]]
    state["watermark"] = words[-1]["end_ms"]
    return [_word(w, key, label) for w in before + _stitched(state, words)]


def _promoted(words: list[dict]) -> list[dict]:
    """Words of a job that no correction will come for: final, in place of themselves."""
    return [w | {"state": "final", "replaces": [w["id"]]} for w in words]


def _registered(state: dict, job: str, words: list[dict]) -> list[dict]:
    """Words of older jobs that become final as this one takes their name or their room."""
    jobs = state["jobs"]
    gone = jobs.pop(job, [])
    jobs[job] = words

    def full() -> bool:
        held = [w for kept in jobs.values() for w in kept]
        return len(jobs) > MOST_JOBS or len(held) > MOST_JOB_WORDS or sum(_size(w["id"]) + _size(w["text"]) for w in held) > MOST_JOB_BYTES

    while jobs and full():
        gone = gone + jobs.pop(next(iter(jobs)))
    return _promoted(gone)


def step(state: dict[str, Any], message: dict[str, Any], key: str) -> list[dict]:
    """Words that one message makes final or pending, and what the state becomes.

    final: the prefix of words that end at or before the watermark is dropped;
    partials that end before the rest come out first, overlapping ones go; the
    rest follows the held word, whose last one is held in turn. With a job the
    words are pending until their correction. partial: replaces the partials of
    its time range; what exceeds a bound comes out as final. correction: its
    words take the place of those the job sent; without words these stay, as
    final. flush: what is held comes out, and pending words become final. State
    is bounded and no word is lost to a bound.
    """
    words, job = [dict(w) for w in message["words"] or []], message["job"]
    kind = message["kind"]
    if kind == "partial":
        return _partial(state, words, key)
    if kind == "correction":
        before = state["jobs"].pop(job, None)
        if before is None:
            return []
        ids = [w["id"] for w in before]
        return [_word(w, key, "final", ids if not i else None) for i, w in enumerate(words)] or _promoted(before)
    if kind == "flush":
        out = [_word(w, key, "final") for w in ([state["held"]] if state["held"] else []) + state["partials"]]
        out += _promoted([w for kept in state["jobs"].values() for w in kept])
        state["held"], state["partials"], state["jobs"] = None, [], {}
        return out
    out = _final(state, words, key, "pending" if job else "final")
    if job:
        promoted = _registered(state, job, out)
        ids = {w["id"] for w in promoted}
        out = [w for w in out if w["id"] not in ids] + promoted
    return out


def _messages(frames: Iterable[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(frames), ignore_index=True).sort_values("seq", kind="stable")
    return [{"kind": r.kind, "job": r.job, "words": [w if isinstance(w, dict) else w.asDict() for w in (r.words if r.words is not None else [])]} for r in rows.itertuples()]


def _frame(key: tuple, words: list[dict]) -> pd.DataFrame:
    columns = ["transcript", "channel", "id", "text", "start_ms", "end_ms", "state", "replaces"]
    return pd.DataFrame([{"transcript": key[0], "channel": key[1]} | w for w in words], columns=columns)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else empty()
    out: list[dict] = []
    for message in _messages(frames):
        out += step(held, message, f"{key[0]}/{key[1]}")
    state.update((json.dumps(held),))
    yield _frame(key, out)


def live_words(messages: DataFrame) -> DataFrame:
    """Streaming words of messages (MESSAGE); state is one bounded JSON text for each channel."""
    return messages.groupBy("transcript", "channel").applyInPandasWithState(_advance, OUTPUT, "held string", "append", GroupStateTimeout.NoTimeout)


def batch_words(messages: DataFrame) -> DataFrame:
    """The same of a bounded table: a channel's messages are folded in order."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held, out = empty(), []
        for message in _messages([rows]):
            out += step(held, message, f"{key[0]}/{key[1]}")
        return _frame(key, out)

    return messages.groupBy("transcript", "channel").applyInPandas(fold, OUTPUT)


#: A service's envelope, as its JSON holds it; other fields are not read.
ENVELOPE = (
    "type string, is_final boolean, from_finalize boolean, channel struct<alternatives: array<struct<transcript: string, words: array<struct<word: string, punctuated_word: string, start: double, end: double, speaker: int>>>>>, channel_index array<int>"
)


def enveloped(lines: DataFrame, column: str = "value") -> DataFrame:
    """The other columns and the fields of ENVELOPE, from JSON; lines that are no envelope go."""
    rest = [c for c in lines.columns if c != column]
    e = lines.select(*rest, F.from_json(column, ENVELOPE).alias("e")).where("e.type is not null")
    return e.select(*rest, "e.*")


def spoken(envelopes: DataFrame) -> DataFrame:
    """MESSAGE rows from service envelopes (transcript, seq, fields of ENVELOPE), batch or stream.

    The best alternative's tokens are assembled to words spaced as its
    transcript; the first channel counts, which is 0 where none is named.
    Envelopes of other types than Results and Flush say nothing of words.
    """
    best = F.get("channel.alternatives", F.lit(0))
    kind = F.when(F.col("type") == "Flush", "flush").when(F.col("is_final"), "final").otherwise("partial")
    token = F.transform(best["words"], lambda w: F.struct(F.coalesce(w["word"], F.lit("")).alias("word"), w["punctuated_word"].alias("punctuated"), F.round(w["start"] * 1000).cast("long").alias("start_ms"), F.round(w["end"] * 1000).cast("long").alias("end_ms"), w["speaker"].alias("speaker")))
    told = envelopes.where(F.col("type").isin("Results", "Flush")).select(
        "transcript", F.coalesce(F.get("channel_index", F.lit(0)), F.lit(0)).cast("int").alias("channel"), "seq", kind.alias("kind"),
        F.coalesce(best["transcript"], F.lit("")).alias("said"), F.coalesce(token, F.array().cast("array<struct<word:string,punctuated:string,start_ms:bigint,end_ms:bigint,speaker:int>>")).alias("tokens"),
    )
    word = pa.list_(pa.struct([("text", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, tokens = (batch.column(c).to_pylist() for c in ("said", "tokens"))
            words = [[{k: w[k] for k in ("text", "start_ms", "end_ms")} for w in assembled([Token(**t) for t in own], text)] for text, own in zip(said, tokens, strict=True)]
            own = [batch.column(c) for c in ("transcript", "channel", "seq", "kind")]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(batch.num_rows, pa.string()), pa.array(words, word)], ["transcript", "channel", "seq", "kind", "job", "words"])

    return told.mapInArrow(run, MESSAGE)


def overlap_trimmed(history: list[str], words: list[str], least: int = 1) -> list[str]:
    """New words without the longest suffix of the history that they repeat as a prefix."""
    most = min(len(history), len(words))
    before, own = [h.lower() for h in history[len(history) - most :]], [w.lower() for w in words[:most]]
    for n in range(most, max(least, 1) - 1, -1):
        if before[-n] == own[0] and before[-1] == own[n - 1] and before[-n:] == own[:n]:
            return words[n:]
    return words


def collapsed(words: list[str], least: int = 6) -> list[str]:
    """Words without immediate repeats of runs of `least` words or more.

    A run can only be a repeat where its last word stood before, so a word meets
    its own earlier places, the nearest first, and no other length of run.
    """
    out: list[str] = []
    low: list[str] = []
    places: dict[str, list[int]] = {}
    for w in words:
        i, key = len(out), w.lower()
        out.append(w)
        low.append(key)
        for j in reversed(places.get(key, ())):
            n = i - j
            if 2 * n > i + 1:
                places[key].append(i)
                break
            if n >= least and (n < 2 or low[j - 1] == low[i - 1]) and low[j - n + 1 : j + 1] == low[j + 1 :]:
                for gone in reversed(low[j + 1 : i]):
                    places[gone].pop()
                del out[j + 1 :], low[j + 1 :]
                break
        else:
            places.setdefault(key, []).append(i)
    return out
