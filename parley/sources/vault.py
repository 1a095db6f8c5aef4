"""Old vaults: a folder tree of sessions, people and tables as files, read as tables.

A vault is files (path, content), as `meetings.scan_all_files` gives them; the place
of a file in the tree says what it is. What a session's folder holds is joined
by that folder. Files that are not as they should be are rows of `failures`, and
stop nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.meetings import front_matter

#: Tables at the top of a vault, and titles that say nothing.
TOP_FILES = {"calendars.json": "calendar", "events.json": "event", "templates.json": "template", "tasks.json": "tasks", "daily_notes.json": "daily_notes", "settings.json": "settings"}
GENERIC_HEADINGS = ("summary", "untitled", "untitled note")


def classified(files: DataFrame, root: str) -> DataFrame:
    """(relative, kind, session, folder, name, content): the files of a vault that mean something.

    session is the name of the folder that a session's file lies in, folder what
    stands between it and `sessions`; both are null for other files.
    """
    base = root.rstrip("/") + "/"
    at = F.instr("path", base)
    relative = F.when(at > 0, F.substr("path", at + len(base)))
    parts = F.split("relative", "/")
    name, first, deep = F.element_at(parts, -1), F.get(parts, F.lit(0)), F.size(parts) >= 3
    top = F.when(F.size(parts) == 1, F.create_map(*[F.lit(x) for kv in TOP_FILES.items() for x in kv])[name])
    inside = (first == "sessions") & deep
    kind = (
        F.when(top.isNotNull(), top).when((first == "humans") & name.endswith(".md"), "human").when((first == "organizations") & name.endswith(".md"), "organization").when((first == "chats") & (name == "messages.json"), "chat")
        .when(inside & F.array_contains(parts, "attachments"), "attachment").when(inside & (name == "_meta.json"), "session").when(inside & (name == "transcript.json"), "transcript").when(inside & name.endswith(".md"), "document")
    )
    own = kind.isin("session", "transcript", "document")
    folder = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    rows = files.withColumn("relative", relative).withColumns({"kind": kind, "session": F.when(own, F.element_at(parts, -2)), "folder": F.when(own, folder), "name": name})
    return rows.where("kind is not null").select("relative", "kind", "session", "folder", "name", "content")


def _text(path: str) -> Column:
    return F.coalesce(F.get_json_object("content", path), F.lit(""))


def _objects(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.col("kind") == kind).where(F.schema_of_variant(F.try_parse_json("content")).startswith("OBJECT"))


def sessions(files: DataFrame) -> DataFrame:
    """(session, folder, title, created_at, started_at, ended_at, event_id, external_event_id, series_id, warning) of classified files.

    A blank title is recovered from the first line of the folder's _summary.md
    where that is a heading that says something. warning names an id inside the
    file that is not the folder's.
    """
    meta = _objects(files, "session").select(
        "session", "folder", _text("$.title").alias("own"), _text("$.id").alias("id"), _text("$.created_at").alias("created_at"), _text("$.event.started_at").alias("started_at"), _text("$.event.ended_at").alias("ended_at"),
        _text("$.event_id").alias("event_id"), _text("$.event.tracking_id").alias("external_event_id"), _text("$.event.recurrence_series_id").alias("series_id"),
    )
    line = F.regexp_extract(F.ltrim(front_matter("content")[1]), r"^\s*# ([^\n]*)", 1)
    heading = files.where("kind = 'document' and name = '_summary.md'").select("session", "folder", F.trim(line).alias("heading")).where((F.col("heading") != "") & ~F.lower("heading").isin(*GENERIC_HEADINGS))
    j = meta.join(heading, ["session", "folder"], "left")
    title = F.when(F.trim("own") == "", F.coalesce("heading", "own")).otherwise(F.col("own"))
    warning = F.when((F.col("id") != "") & (F.col("id") != F.col("session")), F.concat(F.lit("metadata id "), "id", F.lit(" differs from folder id "), "session"))
    return j.select("session", "folder", title.alias("title"), "created_at", "started_at", "ended_at", "event_id", "external_event_id", "series_id", warning.alias("warning"))


def participants(files: DataFrame) -> DataFrame:
    """(session, pos, human_id, source) of the people that sessions name; those without a human_id are left out."""
    item = "array<struct<human_id: string, source: string>>"
    rows = _objects(files, "session").select("session", F.posexplode(F.from_json(F.get_json_object("content", "$.participants"), item)).alias("pos", "p"))
    return rows.where("p.human_id <> ''").select("session", "pos", "p.human_id", F.coalesce("p.source", F.lit("")).alias("source"))


def documents(files: DataFrame) -> DataFrame:
    """(id, session, kind, template_id, title, position, body): notes, summaries and what templates made.

    The file's header may name another session and an id; without one the id is
    a digest of session and file name.
    """
    header, body = front_matter("content")
    d = files.where("kind = 'document'").select("session", "name", header.alias("h"), body.alias("body"))
    field = lambda k: F.coalesce(F.try_element_at("h", F.lit(k)), F.lit(""))
    session = F.coalesce(F.nullif(field("session_id"), F.lit("")), F.col("session"))
    kind = F.when(F.col("name") == "_memo.md", "note").when((F.col("name") != "_summary.md") & (field("template_id") != ""), "template_output").otherwise("summary")
    id_ = F.coalesce(F.nullif(field("id"), F.lit("")), F.sha2(F.concat(session, F.lit(":document:"), "name"), 256))
    return d.select(id_.alias("id"), session.alias("session"), kind.alias("kind"), field("template_id").alias("template_id"), field("title").alias("title"), F.coalesce(field("position").try_cast("long"), F.lit(0)).alias("position"), "body")


def transcripts(files: DataFrame) -> DataFrame:
    """(session, transcript, pos, text, start_ms, end_ms, channel): words of the transcripts of each session."""
    word = "array<struct<id: string, words: array<struct<text: string, start_ms: long, end_ms: long, channel: int>>>>"
    t = _objects(files, "transcript").select("session", F.explode(F.from_json(F.get_json_object("content", "$.transcripts"), word)).alias("t"))
    return t.select("session", F.col("t.id").alias("transcript"), F.posexplode("t.words").alias("pos", "w")).select("session", "transcript", "pos", "w.text", "w.start_ms", "w.end_ms", "w.channel")


def failures(files: DataFrame) -> DataFrame:
    """(relative, problem): JSON files that are no JSON objects, or no lists where one is due."""
    shape = F.schema_of_variant(F.try_parse_json("content"))
    due = F.when(F.col("kind").isin("session", "transcript", "chat", "settings"), "OBJECT").when(F.col("kind").isin(*set(TOP_FILES.values())), "")
    problem = F.when(shape.isNull(), "no JSON").when((due != "") & ~shape.startswith(due), "no object")
    return files.where(due.isNotNull()).select("relative", problem.alias("problem")).where("problem is not null")
