"""Meetings of providers, from the records as their services give them, to segments of one shape.

Every record is a JSON text in a column `record`, one row each, as a page's list
is exploded; what belongs together is joined by the ids that the records carry.
All give SEGMENT rows: (provider, meeting, title, started_at, pos, speaker,
text, start_ms, end_ms). Blank values count as missing; entries without text
are left out; records without an id are left out; a meeting without a title has
the provider's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.times import clock_ms
from parley.sources.meetings import vtt_cues

COLUMNS = ["provider", "meeting", "title", "started_at", "pos", "speaker", "text", "start_ms", "end_ms"]


def _first(*paths: str) -> Column:
    """The first of some fields of the record that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object("record", p)), F.lit("")) for p in paths])


def moment_ms(text: Column, origin_ms: Column) -> Column:
    """Milliseconds of seconds with an `s`, or of a time of day after an origin, none below 0; 0 for anything else."""
    t = F.trim(text)
    seconds = F.when(t.rlike(r"^-?\d+(\.\d+)?s$"), F.regexp_replace(t, "s$", "").try_cast("double"))
    after = F.unix_millis(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), t))) - F.coalesce(origin_ms, F.lit(0))
    known = F.coalesce(F.round(seconds * 1000).cast("long"), after)
    return F.greatest(known, F.lit(0)).cast("long")  # the greatest of null and 0 is 0


def _origin(text: Column) -> Column:
    return F.coalesce(F.greatest(F.unix_millis(F.try_to_timestamp(text)), F.lit(0)), F.lit(0))


def _placed(rows: DataFrame, provider: str, title: str, *order: str) -> DataFrame:
    """SEGMENT rows in order within each meeting."""
    place = F.row_number().over(Window.partitionBy("meeting").orderBy(*order)) - 1
    return rows.withColumns({"provider": F.lit(provider), "title": F.coalesce("title", F.lit(title)), "pos": place}).select(*COLUMNS)


def meet_segments(conferences: DataFrame, participants: DataFrame, entries: DataFrame) -> DataFrame:
    """Segments of conference records, participants and transcript entries, whose names hold the record they belong to.

    A speaker is the display name of a signed-in, an anonymous or a phone user.
    """
    c = conferences.select(_first("$.name").alias("meeting"), _first("$.space").alias("title"), _first("$.startTime").alias("started_at")).where("meeting is not null")
    named = _first("$.signedinUser.displayName", "$.anonymousUser.displayName", "$.phoneUser.displayName")
    p = participants.select(_first("$.name").alias("who"), named.alias("speaker")).where("who is not null").groupBy("who").agg(F.first("speaker", True).alias("speaker"))
    name = _first("$.name")
    e = entries.select(
        name.alias("entry"), F.nullif(F.regexp_extract(name, r"^(conferenceRecords/[^/]+)/", 1), F.lit("")).alias("meeting"), _first("$.participant").alias("who"), _first("$.text").alias("text"),
        F.get_json_object("record", "$.startTime").alias("begins"), F.get_json_object("record", "$.endTime").alias("ends"),
    ).where("text is not null")
    j = e.join(c, "meeting").join(p, "who", "left")
    origin = _origin(F.col("started_at"))
    start = moment_ms(F.col("begins"), origin)
    rows = j.withColumns({"start_ms": start, "end_ms": F.when(F.col("ends").isNull(), start).otherwise(moment_ms(F.col("ends"), origin)), "speaker": F.coalesce("speaker", F.lit(""))})
    return _placed(rows, "meet", "Google Meet", "start_ms", "entry")


def fathom_segments(meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Segments of meetings and of transcripts (recording_id, record), which the service gives by recording."""
    m = meetings.select(
        _first("$.recording_id").alias("meeting"), _first("$.title", "$.meeting_title").alias("title"), _first("$.recording_start_time", "$.scheduled_start_time", "$.created_at").alias("started_at")
    ).where("meeting is not null")
    item = "array<struct<speaker: struct<display_name: string, name: string>, text: string, timestamp: string>>"
    t = transcripts.select(F.col("recording_id").alias("meeting"), F.posexplode(F.from_json(F.get_json_object("record", "$.transcript"), item)).alias("place", "i"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    start = F.coalesce(clock_ms(F.trim("i.timestamp")), F.lit(0)).cast("long")
    t = t.select("meeting", "place", F.coalesce(blank("i.speaker.display_name"), blank("i.speaker.name"), F.lit("")).alias("speaker"), blank("i.text").alias("text"), start.alias("start_ms"), start.alias("end_ms")).where("text is not null")
    return _placed(t.join(m, "meeting"), "fathom", "Fathom meeting", "place")


#: Where the services that give transcripts as WebVTT hold a meeting's id, title, start and the file's address, and what a meeting without a title is called.
VTT_FIELDS = {
    "teams": (("$.id",), ("$.subject",), ("$.startDateTime", "$.start.dateTime"), ("$.transcriptContentUrl",), "Teams meeting"),
    "webex": (("$.id",), ("$.meeting_topic", "$.meetingTopic"), ("$.start_time", "$.startTime"), ("$.vtt_download_link", "$.vttDownloadLink"), "Webex meeting"),
    "zoom": (("$.uuid", "$.id"), ("$.topic",), ("$.start_time",), ("$.transcript_download_url",), "Zoom meeting"),
}


def vtt_segments(provider: str, records: DataFrame, files: DataFrame) -> DataFrame:
    """Segments of records whose transcript is a WebVTT file (path, content) at the address that the record names."""
    ids, titles, starts, links, untitled = VTT_FIELDS[provider]
    r = records.select(_first(*ids).alias("meeting"), _first(*titles).alias("title"), _first(*starts).alias("started_at"), _first(*links).alias("path")).where("meeting is not null and path is not null")
    cues = vtt_cues(files).where("text <> ''").withColumn("speaker", F.coalesce("speaker", F.lit("")))
    return _placed(cues.join(r, "path"), provider, untitled, "cue")
