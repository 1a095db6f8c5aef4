"""Provider records as their services give them, written by hand."""

from __future__ import annotations

import json

from parley.sources import providers as R


def lines(spark, *records):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in records], "record string")


def told(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_meet(spark):
    conferences = lines(spark, {"name": "conferenceRecords/a", "startTime": "2024-05-01T10:00:00Z", "space": "spaces/x"}, {"name": " "}, "bad")
    participants = lines(spark, {"name": "conferenceRecords/a/participants/1", "signedinUser": {"displayName": " Ada "}}, {"name": "conferenceRecords/a/participants/2", "phoneUser": {"displayName": "+49"}}, {"name": "conferenceRecords/a/participants/3", "anonymousUser": {"displayName": ""}})
    at = "conferenceRecords/a/transcripts/t/entries/"
    entries = lines(
        spark, {"name": at + "2", "participant": "conferenceRecords/a/participants/2", "text": "second", "startTime": "2024-05-01T12:00:07+02:00", "endTime": "9.5s"}, {"name": at + "1", "participant": "conferenceRecords/a/participants/1", "text": " first ", "startTime": "1.25s"},
        {"name": at + "3", "participant": "conferenceRecords/a/participants/3", "text": "third", "startTime": "2024-05-01T09:00:00Z", "endTime": "soon"}, {"name": at + "4", "text": " "}, {"name": "conferenceRecords/b/transcripts/t/entries/1", "text": "no record"},
    )
    got = told(R.meet_segments(conferences, participants, entries), "pos", "speaker", "text", "start_ms", "end_ms", "meeting", "title")
    where = ("conferenceRecords/a", "spaces/x")
    assert got == [(0, "", "third", 0, 0, *where), (1, "Ada", "first", 1250, 1250, *where), (2, "+49", "second", 7000, 9500, *where)]


def test_fathom(spark):
    meetings = lines(spark, {"recording_id": "1", "title": "", "meeting_title": "Weekly", "scheduled_start_time": "s", "created_at": "c"}, {"title": "no id"}, {"recording_id": "2"})
    transcript = [{"speaker": {"display_name": "Ada L.", "name": "x"}, "text": "hi", "timestamp": "01:02:03"}, {"speaker": {"name": "Bob"}, "text": " yes ", "timestamp": "odd"}, {"text": "who"}, {"speaker": {"name": "Bob"}, "text": ""}]
    transcripts = spark.createDataFrame([("1", json.dumps({"transcript": transcript})), ("2", "{}"), ("3", json.dumps({"transcript": transcript}))], "recording_id string, record string")
    got = told(R.fathom_segments(meetings, transcripts), "meeting", "pos", "speaker", "text", "start_ms", "title", "started_at")
    assert got == [("1", 0, "Ada L.", "hi", 3_723_000, "Weekly", "s"), ("1", 1, "Bob", "yes", 0, "Weekly", "s"), ("1", 2, "", "who", 0, "Weekly", "s")]


def test_transcripts_as_vtt(spark):
    files = spark.createDataFrame([("u/1", "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nAda: hello\n\n00:00:03.000 --> 00:00:04.500\nplain"), ("u/2", "WEBVTT\n\n00:01.000 --> 00:02.000\n<v Bob>x</v>")], "path string, content string")
    webex = lines(spark, {"id": "w1", "meeting_topic": "", "meetingTopic": "T", "startTime": "s", "vttDownloadLink": " u/1 "}, {"id": "w2", "vtt_download_link": "u/2"}, {"id": "w3"}, {"vttDownloadLink": "u/1"})
    got = told(R.vtt_segments("webex", webex, files), "meeting", "pos", "title", "speaker", "text", "start_ms", "end_ms")
    assert got == [("w1", 0, "T", "Ada", "hello", 1000, 2000), ("w1", 1, "T", "", "plain", 3000, 4500), ("w2", 0, "Webex meeting", "Bob", "x", 1000, 2000)]
    teams = lines(spark, {"id": "t", "subject": "S", "start": {"dateTime": "d"}, "transcriptContentUrl": "u/2"})
    assert told(R.vtt_segments("teams", teams, files), "meeting", "title", "started_at", "speaker") == [("t", "S", "d", "Bob")]
    assert R.vtt_segments("zoom", lines(spark, {"uuid": "z", "transcript_download_url": "u/9"}), files).count() == 0


def test_vault_from_a_folder_tree(spark, tmp_path):
    """Files on a disk: kinds by place, titles from summaries, broken files as rows."""
    from parley.sources import meetings
    from parley.sources import vault as V

    tree = {
        "sessions/work/a/_meta.json": '{"title":"","participants":[{"human_id":"h"},{}],"id":"b"}', "sessions/work/a/_summary.md": "---\nid: x\n---\n\n# Found it \nmore", "sessions/work/a/transcript.json": '{"transcripts":[{"id":"t","words":[{"text":" hi","start_ms":1,"end_ms":2,"channel":0}]}]}',
        "sessions/b/_meta.json": '{"title":""}', "sessions/b/_summary.md": "# Summary\n", "sessions/b/own.md": "---\ntemplate_id: z\nposition: 7\nsession_id: c\n---\ntext", "sessions/d/_meta.json": "nope", "sessions/stray.md": "too high", "humans/h.md": "", "settings.json": "[]", "notes.txt": "no",
    }
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    files = V.classified(meetings.scan_all_files(spark, str(tmp_path)), str(tmp_path))
    assert {r["relative"]: r["kind"] for r in files.collect()} == {
        "sessions/work/a/_meta.json": "session", "sessions/work/a/_summary.md": "document", "sessions/work/a/transcript.json": "transcript", "sessions/b/_meta.json": "session", "sessions/b/_summary.md": "document", "sessions/b/own.md": "document",
        "sessions/d/_meta.json": "session", "humans/h.md": "human", "settings.json": "settings",
    }
    assert told(V.sessions(files), "session", "folder", "title", "warning") == [("a", "work", "Found it", "metadata id b differs from folder id a"), ("b", "", "", None)]
    assert told(V.participants(files), "session", "pos", "human_id", "source") == [("a", 0, "h", "")]
    assert told(V.documents(files), "session", "kind", "position", "body")[1:] == [("b", "summary", 0, "# Summary\n"), ("c", "template_output", 7, "text")]
    assert told(V.transcripts(files), "session", "transcript", "text", "start_ms") == [("a", "t", " hi", 1)]
    assert told(V.failures(files), "relative", "problem") == [("sessions/d/_meta.json", "no JSON"), ("settings.json", "no object")]
    assert meetings.scan_all_files(spark, str(tmp_path), "*.json").count() == 5
    assert told(meetings.scan_files(spark, str(tmp_path), "*.txt"), "content") == [("no",)] and meetings.scan_files(spark, str(tmp_path), "*.json").count() == 2
