"""Words assembled from tokens, and messages of envelopes."""

from __future__ import annotations

import json

from parley.functions.assembly import Token, assembled
from parley.streaming import live_words as live


def told(transcript, *words):
    tokens = [Token(w, None, i * 100, i * 100 + 90, None) if isinstance(w, str) else Token(w[0], w[1], i * 100, i * 100 + 90, None) for i, w in enumerate(words)]
    return [w["text"] for w in assembled(tokens, transcript)]


def test_spaces_come_from_the_transcript():
    assert told("Hello, world.", "Hello", ",", "world", ".") == ["Hello,", " world."]
    assert told("Hello", "Hel", "lo") == ["Hello"]
    assert told(" Hi you", "Hi", "you") == [" Hi", " you"]
    assert told("A  b", "A", "b") == ["A", "  b"]
    assert told("x", "gone", "missing") == [" gone", " missing"]  # not in the transcript
    assert told("Hello there", ("hello", "Hello"), ("there", None)) == ["Hello", " there"]
    assert told("", "") == [""] and told("anything") == []


def test_words_after_signs_stand_apart():
    assert told("One.Two,three", "One", ".", "Two", ",", "three") == ["One.", " Two,", " three"]
    assert told("3.14", "3", ".", "14") == ["3.14"]
    assert told("e.g.this", "e", ".", "g", ".", "this") == ["e.g.this"]
    assert told("wait...so", "wait", "...", "so") == ["wait...", " so"]
    assert told("a\nb", "a", "b") == ["a\nb"]
    assert told("(x)y", "(", "x", ")", "y") == ["(x)", " y"]


def test_times_and_speakers_of_joined_pieces():
    got = assembled([Token("a", None, 0, 90, None), Token(".", None, 100, 190, 4), Token("B", None, 200, 290, 5)], "a. B")
    assert got == [{"text": "a.", "start_ms": 0, "end_ms": 190, "speaker": 4}, {"text": " B", "start_ms": 200, "end_ms": 290, "speaker": 5}]


def test_envelopes_become_messages_and_words(spark):
    def results(final, index, transcript, *words):
        tokens = [{"word": w, "start": i / 10, "end": i / 10 + 0.09, "confidence": 1.0, "speaker": None, "punctuated_word": None} for i, w in enumerate(words)]
        return json.dumps({"type": "Results", "is_final": final, "channel": {"alternatives": [{"transcript": transcript, "words": tokens}, {"transcript": "worse", "words": []}]}, "channel_index": index})

    lines = [(1, 1, results(False, [0, 2], "So far", "So", "far")), (1, 2, results(True, [0, 2], "So far, so", "So", "far", ",", "so")), (1, 3, '{"type":"Flush"}'), (1, 4, '{"type":"Metadata"}'), (1, 5, "not json"), (1, 6, None), (2, 1, results(True, [1], "")), (3, 1, '{"type":"Results","is_final":true}')]
    m = live.spoken(live.enveloped(spark.createDataFrame(lines, "transcript long, seq long, value string")))
    got = {(r["transcript"], r["seq"]): (r["channel"], r["kind"], [(w["text"], w["start_ms"], w["end_ms"]) for w in r["words"]]) for r in m.collect()}
    assert got == {
        (1, 1): (0, "partial", [("So", 0, 90), (" far", 100, 190)]), (1, 2): (0, "final", [("So", 0, 90), (" far,", 100, 290), (" so", 300, 390)]), (1, 3): (0, "flush", []),
        (2, 1): (1, "final", []), (3, 1): (0, "final", []),
    }
    assert [r["text"] for r in live.batch_words(m).where("transcript = 1").orderBy("start_ms").collect()] == ["So", " far,", " so"]
