"""Sessions as wholes: their search documents, their creation from events, promotion of voice candidates, speech chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import jsonx
from parley.functions.text import merged_content

#: Speech that makes a chunk long enough, and the bounds of the gap over which a short one merges, in milliseconds.
LEAST_SPEECH, LEAST_GAP, MOST_GAP = 200, 100, 250


def _child_texts(children: DataFrame, order: list[str], text: Column, name: str) -> DataFrame:
    """(session, name): the texts of a session's children in order, trimmed and joined; a session's own children are few."""
    rows = children.select("session", *order, text.alias("_t"))
    held = F.array_sort(F.collect_list(F.struct(*order, "_t")))
    texts = F.filter(F.transform(held, lambda x: F.trim(x["_t"])), lambda t: t.isNotNull() & (t != ""))
    return rows.groupBy("session").agg(F.array_join(texts, " ").alias(name))


def search_documents(sessions: DataFrame, documents: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(id, action, title, content, created_at): one search document for each session.

    sessions: (id, title, locked, deleted, created_at, apps); documents: (session,
    id, kind, body, sort_order, created_at); transcripts: (session, id, words,
    started_at_ms). The content is the note (the one with the session's id, else
    the oldest), the summaries, chat, transcripts and source apps, in that order;
    a locked session has its title only, and a deleted one is removed. Children
    of each kind are grouped once and joined, so no session asks for its own.
    """
    note = documents.where("kind = 'note'").withColumn("_other", (F.col("id") != F.col("session")).cast("int"))
    first = note.groupBy("session").agg(F.min(F.struct("_other", "created_at", "id", "body")).alias("n")).select("session", jsonx.plain_text("n.body").alias("note"))
    order = ["sort_order", "created_at", "id"]
    parts = [
        first,
        _child_texts(documents.where("kind in ('summary', 'template_output')"), order, jsonx.plain_text("body"), "summaries"),
        _child_texts(documents.where("kind = 'meeting_chat'"), order, jsonx.flat_chat("body"), "chat"),
        _child_texts(transcripts, ["started_at_ms", "id"], jsonx.flat_transcript("words"), "spoken"),
    ]
    out = sessions.withColumnRenamed("id", "session")
    for part in parts:
        out = out.join(part, "session", "left")
    content = merged_content(*[F.coalesce(c, F.lit("")) for c in ("note", "summaries", "chat", "spoken")], F.coalesce(jsonx.flat_apps("apps"), F.lit("")))
    gone = F.col("deleted")
    return out.select(
        F.col("session").alias("id"), F.when(gone, "remove").otherwise("upsert").alias("action"),
        F.when(~gone, F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))).alias("title"),
        F.when(~gone, F.when(F.col("locked"), "").otherwise(content)).alias("content"), F.when(~gone, F.col("created_at")).alias("created_at"),
    )


def created_once(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Those of the events (event, external, ...) for which no session (event, external) has either key: two anti joins, as an OR would compare all pairs."""
    by_external = sessions.where("external <> ''").select("external").distinct()
    return events.join(sessions.select("event").distinct(), "event", "left_anti").join(by_external, "external", "left_anti")


def participants_once(invited: DataFrame, humans: DataFrame) -> DataFrame:
    """(event, email, human, is_new): each invited (event, pos, email, name) once for an event by lower-cased address, with the human (human, email) who has it or a new one by a hash of it."""
    key = F.lower(F.trim("email"))
    known = humans.groupBy(key.alias("email")).agg(F.min("human").alias("human"))
    first = invited.where(F.coalesce(key, F.lit("")) != "").groupBy("event", key.alias("email")).agg(F.min_by("name", "pos").alias("name"))
    return first.join(known, "email", "left").select("event", "email", F.coalesce("human", F.sha2("email", 256)).alias("human"), F.coalesce(F.nullif("name", F.lit("")), F.col("email")).alias("name"), F.col("human").isNull().alias("is_new"))


def promoted(candidates: DataFrame, wanted: DataFrame, humans: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(exemplars, candidates): wanted (id, human, confidence) turns active candidates (id, deleted_at, ...) into exemplars of humans that exist; those candidates get the tombstone.

    Confidence outside 0 to 1 and unknown candidates or humans promote nothing.
    """
    good = wanted.where("confidence between 0 and 1 and not isnan(confidence)").join(humans.select("human").distinct(), "human", "left_semi")
    good = good.groupBy("id").agg(F.max_by("human", F.struct("confidence", "human")).alias("human"), F.max("confidence").alias("confidence"))
    exemplars = candidates.where("deleted_at is null").join(good, "id").drop("deleted_at")
    marked = candidates.join(good.select("id", F.lit(True).alias("_taken")), "id", "left")
    return exemplars, marked.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_taken"), at))).drop("_taken")


def merged_chunks(chunks: DataFrame, redemption_ms: int) -> DataFrame:
    """(recording, start_ms, end_ms, speech_ms, n): speech chunks with short ones merged into the next one that begins soon enough.

    A chunk of less than LEAST_SPEECH waits; if the next one begins within the
    gap both merge, and wait on if still short; if not, the next one waits in its
    place. The fold runs over one recording's chunks, which a meeting bounds.
    """
    gap = min(max(redemption_ms, LEAST_GAP), MOST_GAP)
    kind = "struct<start_ms: bigint, end_ms: bigint, speech_ms: bigint, n: bigint>"
    held = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms", "speech_ms")], F.lit(1).cast("long").alias("n"))))
    none = F.lit(None).cast(kind)
    state = lambda done, waits: F.struct(done.alias("done"), waits.alias("waits"))

    def step(s: Column, x: Column) -> Column:
        p, done = s["waits"], s["done"]
        both = F.struct(p["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), (p["speech_ms"] + x["speech_ms"]).alias("speech_ms"), (p["n"] + 1).alias("n"))
        near = F.greatest(x["start_ms"] - p["end_ms"], F.lit(0)) <= gap
        add = lambda one: F.concat(done, F.array(one))
        idle = F.when(x["speech_ms"] < LEAST_SPEECH, state(done, x)).otherwise(state(add(x), none))
        merged = F.when(both["speech_ms"] < LEAST_SPEECH, state(done, both)).otherwise(state(add(both), none))
        return F.when(p.isNull(), idle).when(near, merged).otherwise(state(add(p), x))

    folded = F.aggregate("held", state(F.array().cast(f"array<{kind}>"), none), step, lambda s: F.filter(F.concat(s["done"], F.array(s["waits"])), lambda x: x.isNotNull()))
    return chunks.groupBy("recording").agg(held.alias("held")).select("recording", F.inline(folded))
