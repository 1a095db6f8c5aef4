"""Live segments of transcripts: what changed after each delta, from a bounded window of words held as state.

A delta (transcript, seq, new_words, replaced_ids, partials) takes out the words
that it replaces, adds its own, and drops the oldest words beyond the bounds of
number, bytes and time. The words and the delta's partials make segments: a word
joins the last segment of its channel if speaker and human are the same, the gap
is small and the segment is not full; a partial always takes the identity of
the last segment of its channel. Segments of a channel next to each other are
one if they have one human, or the same key with some identity. What is given
out are the segments whose revision, a hash of all they show, is new, and the
ids of those that are gone. Deltas up to the last seq that was seen are replays
and change nothing.

The stream holds a transcript's words and revisions, so its state is bounded;
the batch form runs the same step over sorted rows and holds one transcript's.
"""

from __future__ import annotations

import hashlib
from bisect import insort
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.transcript import GAP, MOST_MS, MOST_WORDS

#: Words, bytes of text and milliseconds that the window holds at most.
WINDOW_WORDS, WINDOW_BYTES, WINDOW_MS = 4_096, 64 * 1_024, 30 * 60_000
#: Fixed value: deltas that the batch form holds as Python objects at once, with what they change.
PIECE = 32

WORD = "struct<id:string,text:string,start_ms:bigint,end_ms:bigint,channel:int,speaker_index:int,human:string>"
PARTIAL = "struct<text:string,start_ms:bigint,end_ms:bigint,channel:int>"
DELTA = f"transcript long, seq long, new_words array<{WORD}>, replaced_ids array<string>, partials array<{PARTIAL}>"
CHANGE = "transcript long, seq long, change string, id string, channel int, speaker_index int, human string, start_ms long, end_ms long, n int, text string"


class Word(NamedTuple):
    start_ms: int
    id: str
    end_ms: int
    text: str
    channel: int
    speaker_index: int | None
    human: str | None


def _cut(text: str, most: int) -> str:
    """The first `most` bytes of a text, without a broken character."""
    return text if len(text) * 4 <= most else text.encode()[:most].decode(errors="ignore")


def _bytes(words: list) -> int:
    return sum(len(w.text.encode()) for w in words)


def pruned(words: list[Word], latest: int) -> list[Word]:
    """Words in order without the oldest beyond the bounds; one word stays, cut to the bytes."""
    words = [w for w in words if w.end_ms >= latest - WINDOW_MS][-WINDOW_WORDS:]
    size, first = _bytes(words), 0
    while size > WINDOW_BYTES and len(words) - first > 1:
        size -= len(words[first].text.encode())
        first += 1
    words = words[first:]
    return [words[0]._replace(text=_cut(words[0].text, WINDOW_BYTES)), *words[1:]] if words else []


def shown_partials(partials: list[Word], latest: int, words: int, size: int) -> list[Word]:
    """The latest partials in the window for which number and bytes are left; the first of them may be cut."""
    own = sorted(p for p in partials if p.end_ms >= latest - WINDOW_MS)
    out, left = [], size
    for p in reversed(own[-words:] if words > 0 else []):
        if left <= 0:
            break
        p = p._replace(text=_cut(p.text, left))
        left -= len(p.text.encode())
        out.append(p)
    return out[::-1]


def _alike(a: list, b: list) -> bool:
    """Whether two segments speak for the same: one human, or the same key with an identity."""
    if a[2] is not None and a[2] == b[2]:
        return True
    return a[:3] == b[:3] and (b[1] is not None or b[2] is not None)


def _grows(segment: list, start: int, end: int, n: int) -> bool:
    words = segment[3]
    return start - max(w.end_ms for w in words) <= GAP and len(words) + n <= MOST_WORDS and end - words[0].start_ms <= MOST_MS


def segments_of(words: list[Word], partials: list[Word]) -> list[list]:
    """[channel, speaker_index, human, words] of each segment, in order of their first words."""
    out: list[list] = []
    last: dict[int, list] = {}
    for final, w in sorted([(True, w) for w in words] + [(False, p) for p in partials], key=lambda x: (x[1].start_ms, x[1].end_ms, not x[0], x[1].id)):
        before = last.get(w.channel)
        key = before[:3] if before and not final else [w.channel, w.speaker_index, w.human]
        if before and before[:3] == key and _grows(before, w.start_ms, w.end_ms, 1):
            before[3].append(w)
        else:
            last[w.channel] = [*key, [w]]
            out.append(last[w.channel])
    kept: list[list] = []
    last = {}
    for s in out:
        before = last.get(s[0])
        if before and _alike(before, s) and _grows(before, s[3][0].start_ms, s[3][-1].end_ms, len(s[3])):
            before[3].extend(s[3])
        else:
            kept.append(s)
            last[s[0]] = s
    return kept


def shown(segment: list) -> dict[str, Any]:
    """A segment as it is given out; its id holds its key and the words at its ends."""
    channel, speaker, human, words = segment
    ends = [w.id or f"{name}:{at}" for name, w, at in (("start", words[0], words[0].start_ms), ("end", words[-1], words[-1].end_ms))]
    key = ":".join("none" if x is None else str(x) for x in (channel, speaker, human, *ends))
    return {"id": key, "channel": channel, "speaker_index": speaker, "human": human, "start_ms": words[0].start_ms, "end_ms": max(w.end_ms for w in words), "n": len(words), "text": "".join(w.text for w in words).strip()}


def revision(segment: list) -> str:
    """A hash of all that a segment shows, words and times included."""
    return hashlib.blake2b(repr([*segment[:3], [tuple(w) for w in segment[3]]]).encode(), digest_size=8).hexdigest()


class Window:
    """The state of one transcript."""

    def __init__(self, words: list[Word] | None = None, revisions: dict[str, str] | None = None, seq: int | None = None):
        self.words, self.revisions, self.seq = words or [], revisions or {}, seq

    def apply(self, seq: int, new: list[Word], replaced: list[str], partials: list[Word]) -> list[dict[str, Any]]:
        """The changes after one delta: upserts in the order of segments, then removed ids."""
        if self.seq is not None and seq <= self.seq:
            return []
        self.seq = seq
        gone = {*replaced, *(w.id for w in new)}
        self.words = [w for w in self.words if w.id not in gone]
        for w in {w.id: w for w in new}.values():
            insort(self.words, w._replace(text=_cut(w.text, WINDOW_BYTES)))
        latest = max((w.end_ms for w in [*self.words, *partials]), default=0)
        self.words = pruned(self.words, latest)
        own = shown_partials(partials, latest, WINDOW_WORDS - len(self.words), WINDOW_BYTES - _bytes(self.words))
        next_ = {(s := shown(x))["id"]: (revision(x), s) for x in segments_of(self.words, own)}
        out = [s | {"change": "upsert"} for r, s in next_.values() if self.revisions.get(s["id"]) != r]
        out += [{"id": i, "change": "remove"} for i in sorted(self.revisions) if i not in next_]
        self.revisions = {i: r for i, (r, _) in next_.items()}
        return [{"seq": seq} | c for c in out]


def _words(items: Any) -> list[Word]:
    rows = [w if isinstance(w, dict) else w.asDict() for w in (items if items is not None else [])]
    whole = lambda x: None if x is None or x != x else int(x)
    return [Word(int(w["start_ms"]), w.get("id") or "", int(w["end_ms"]), w["text"] or "", int(w["channel"] or 0), whole(w.get("speaker_index")), w.get("human")) for w in rows]


_COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(_COLUMNS, _KINDS, strict=True)], _COLUMNS)


class _Live(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getListState("words", "start_ms long, id string, end_ms long, text string, channel int, speaker_index int, human string")
        self.revisions = handle.getMapState("revisions", "id string", "revision string")
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        window = Window([Word(*w) for w in self.words.get()] if self.words.exists() else [], {k[0]: v[0] for k, v in self.revisions.iterator()} if self.revisions.exists() else {}, self.seq.get()[0] if self.seq.exists() else None)
        before, out = dict(window.revisions), []
        deltas = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for d in deltas.itertuples():
            out += window.apply(int(d.seq), _words(d.new_words), list(d.replaced_ids if d.replaced_ids is not None else []), _words(d.partials))
        self.words.put([tuple(w) for w in window.words]) if window.words else self.words.clear()
        for i in before.keys() - window.revisions.keys():
            self.revisions.removeKey((i,))
        for i, r in window.revisions.items():
            if before.get(i) != r:
                self.revisions.updateValue((i,), (r,))
        if window.seq is not None:
            self.seq.update((window.seq,))
        if out:
            yield _batch([{"transcript": int(key[0])} | c for c in out]).to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get)


def stream_changes(deltas: DataFrame) -> DataFrame:
    """CHANGE rows of a stream of DELTA rows; start it inside `alarms.keyed_state`."""
    return deltas.groupBy("transcript").transformWithStateInPandas(_Live(), CHANGE, "append", "none")


def batch_changes(deltas: DataFrame) -> DataFrame:
    """The same of a bounded log: each transcript's deltas in order, one transcript's window and PIECE deltas at a time."""
    dealt = deltas.where("transcript is not null").repartition("transcript").sortWithinPartitions("transcript", "seq").select("transcript", "seq", "new_words", "replaced_ids", "partials")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window = None, Window()
        for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            out = []
            for transcript, seq, new, replaced, partials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if transcript != last:
                    last, window = transcript, Window()
                out += [{"transcript": transcript} | c for c in window.apply(seq, _words(new), replaced or [], _words(partials))]
            yield _batch(out)

    return dealt.mapInArrow(run, CHANGE)


def current(changes: DataFrame) -> DataFrame:
    """The segments that stand after all changes: of each id the last one, if that is no removal."""
    value = [c for c in _COLUMNS if c not in ("transcript", "id")]
    last = changes.groupBy("transcript", "id").agg(F.max_by(F.struct(*value), "seq").alias("x"))
    return last.where("x.change = 'upsert'").select("transcript", "id", *[f"x.{c}" for c in value if c not in ("change", "seq")])
