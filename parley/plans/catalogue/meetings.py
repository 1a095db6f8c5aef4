"""Sources and sinks, over records made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import jsonx
from parley.operators import transcript as P
from parley.operators.graph import shared_folder
from parley.plans.catalog import query
from parley.plans.catalogue.transcripts import words
from parley.sources import meetings as S
from parley.sources import providers as R
from parley.sources import vault as V
from parley.sources.tables import load


@query(
    "vtt_round_trip",
    r"""WITH w AS (SELECT conv_id AS transcript, turn, unnest(string_split_regex(trim(text), '\s+')) AS t, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 AS pos FROM conversations)
    SELECT transcript, count(*) AS cues, min(turn * 900000 + pos * 300)::BIGINT AS first_ms, max(turn * 900000 + pos * 300 + 250)::BIGINT AS last_ms, sum(length(t))::BIGINT AS chars FROM w GROUP BY 1""",
    covers="src_vtt src_subtitle sink_vtt",
)
def vtt_round_trip(spark, sf):
    files = P.subtitles(words(spark, sf)).select(F.col("transcript").alias("path"), F.col("body").alias("content"))
    return S.vtt_cues(files).groupBy(F.col("path").alias("transcript")).agg(F.count("*").alias("cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.sum(F.length("text")).alias("chars"))


@query(
    "front_matter",
    "SELECT page_id, url, length(html) AS body_chars FROM pages",
    covers="src_frontmatter",
)
def front_matter(spark, sf):
    p = load(spark, sf, "pages").select("page_id", S.with_front_matter(F.create_map(F.lit("url"), F.col("url"), F.lit("id"), F.col("page_id").cast("string")), F.col("html")).alias("content"))
    header, body = S.front_matter("content")
    return p.select(header["id"].cast("long").alias("page_id"), header["url"].alias("url"), F.length(body).alias("body_chars"))


@query("calendar_records", "SELECT event_id::VARCHAR AS id, event_type AS title, event_id % 2 = 0 AS all_day, event_id % 3 = 0 AS recurring FROM events", covers="src_calendar")
def calendar_records(spark, sf):
    e = load(spark, sf, "events")
    start = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("date"), F.col("ts").cast("date").cast("string"))).otherwise(F.create_map(F.lit("dateTime"), F.col("ts").cast("string")))
    r = e.select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("summary"), start.alias("start"), F.when(F.col("event_id") % 3 == 0, "r").alias("recurringEventId"))).alias("record"))
    return S.calendar_events(r).select("id", "title", F.coalesce("all_day", F.lit(False)).alias("all_day"), "recurring")


@query(
    "import_json",
    """SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_-]', '-', 'g') AS file, CASE WHEN c_custkey % 3 = 0 THEN '{"name":"' || c_name || '"}' ELSE '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' END AS body FROM customer""",
    covers="sink_import_json",
)
def import_json(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    return c.select("c_custkey", S.safe_name("name").alias("file"), S.meeting_json(["name", "segment"]).alias("body"))


@query(
    "webhook_deliveries",
    """SELECT endpoint, count(*) AS n FROM (SELECT 'all' AS endpoint FROM events UNION ALL SELECT 'errors' FROM events WHERE event_type IN ('error', 'view')) GROUP BY 1""",
    covers="sink_webhook",
)
def webhook_deliveries(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    subs = spark.createDataFrame([("all", []), ("errors", ["error", "view"])], "endpoint string, kinds array<string>")
    return S.deliveries(e, subs).groupBy("endpoint").agg(F.count("*").alias("n"))


@query("attached_source", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'ASIA'", covers="src_attach u_intersect_cols")
def attached_source(spark, sf):
    """A second source joins under a name of its own, with the columns that both have."""
    from parley.sources.sql import Catalog
    from parley.sources.tables import shared_columns

    catalog = Catalog(spark, sf, ["nation"])
    region = load(spark, sf, "region")
    catalog.attach("imported", region.select(*shared_columns(region, region.withColumn("extra", F.lit(1)))))
    return catalog.execute("SELECT n.n_name, r.r_name FROM nation n JOIN imported r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = ?", ["ASIA"])


@query("rich_text", None, covers="sf_plaintext a_canonical_hash")
def rich_text(spark, sf):
    """Document trees to text, canonical hashes, and word patches."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('{"type":"doc","content":[{"type":"text","text":'), F.to_json(F.array("text")), F.lit("}]}")).alias("bad"), F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("doc"))
    return c.select("conv_id", "turn", F.length(jsonx.plain_text("doc")).alias("n"), F.sha2(jsonx.canonical("doc"), 256).alias("digest"))


@query(
    "contact_names",
    r"""SELECT page_id, len(list_distinct(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\w.+-]+@[\w-]+\.[\w.-]+'))) AS emails FROM pages""",
    covers="x_contact_extract",
)
def contact_names(spark, sf):
    plain = F.regexp_replace("html", r"<[^>]*>", " ")
    return load(spark, sf, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([\w.+-]+@[\w-]+\.[\w.-]+)"), F.lit(1)))).cast("long").alias("emails"))


_TEXTS = r"SELECT conv_id, turn::BIGINT AS turn, role, trim(text) AS text FROM conversations WHERE trim(text) <> ''"


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


@query(
    "provider_meet",
    f"""SELECT 'conferenceRecords/' || conv_id AS meeting, CASE WHEN conv_id % 2 = 0 THEN 'spaces/' || conv_id ELSE 'Google Meet' END AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
    CASE WHEN role = 'user' THEN 'Ada ' || conv_id WHEN role = 'assistant' THEN 'Guest' ELSE '' END AS speaker, text, turn * 61000 AS start_ms, CASE WHEN turn % 2 = 0 THEN turn * 61000 + 5500 ELSE turn * 61000 END AS end_ms FROM ({_TEXTS})""",
    covers="src_meet sf_rfc3339",
)
def provider_meet(spark, sf):
    """Conferences, participants and entries as three tables of records: times of day, seconds of duration, users of three kinds."""
    c = load(spark, sf, "conversations").where("trim(text) <> ''").withColumn("turn", F.col("turn").cast("long"))
    base = F.concat(F.lit("conferenceRecords/"), F.col("conv_id").cast("string"))
    day = lambda s: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    conferences = c.select("conv_id").distinct().select(_json(name=base, startTime=day(F.lit(0)), space=F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("spaces/"), F.col("conv_id").cast("string")))).alias("record"))
    who = F.concat(base, F.lit("/participants/"), "role")
    user = F.when(F.col("role") == "user", F.struct(F.concat(F.lit("Ada "), F.col("conv_id").cast("string")).alias("displayName")))
    guest = F.when(F.col("role") == "assistant", F.struct(F.lit("Guest").alias("displayName")))
    participants = c.select("conv_id", "role").distinct().select(_json(name=who, signedinUser=user, anonymousUser=guest).alias("record"))
    start = F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") * 61).cast("string"), F.lit(".0s"))).otherwise(day(F.col("turn") * 61))
    end = F.when(F.col("turn") % 2 == 0, F.concat((F.col("turn") * 61 + 5).cast("string"), F.lit(".5s")))
    entries = c.select(_json(name=F.concat(base, F.lit("/transcripts/t/entries/"), F.format_string("%05d", "turn")), participant=who, text=F.col("text"), startTime=start, endTime=end).alias("record"))
    out = R.meet_segments(conferences, participants, entries.unionByName(spark.createDataFrame([('{"name":"conferenceRecords/x/transcripts/t/entries/e"}',), ("bad",)], "record string")))
    return out.select("meeting", "title", F.col("pos").cast("long").alias("pos"), "speaker", "text", "start_ms", "end_ms")


@query(
    "provider_fathom",
    f"""SELECT 'r' || conv_id AS meeting, CASE WHEN conv_id % 2 = 0 THEN 'Talk' ELSE 'Fathom meeting' END AS title, CASE WHEN conv_id % 3 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-01-02T00:00:00Z' END AS started_at,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN role = 'user' THEN 'Ada' WHEN role = 'assistant' THEN 'bob' ELSE '' END AS speaker, text, turn * 61000 AS start_ms FROM ({_TEXTS})""",
    covers="src_fathom sf_hhmmss",
)
def provider_fathom(spark, sf):
    """Meetings, and transcripts by recording, whose speakers are objects with a display name, a name, or neither."""
    c = load(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("long"))
    id_ = F.concat(F.lit("r"), F.col("conv_id").cast("string"))
    meetings = c.select("conv_id").distinct().select(
        _json(recording_id=id_, title=F.when(F.col("conv_id") % 4 == 0, " "), meeting_title=F.when(F.col("conv_id") % 2 == 0, "Talk"), recording_start_time=F.when(F.col("conv_id") % 3 == 0, "2024-01-01T00:00:00Z"), scheduled_start_time="2024-01-02T00:00:00Z").alias("record")
    )
    speaker = F.struct(F.when(F.col("role") == "user", "Ada").otherwise(" ").alias("display_name"), F.when(F.col("role") != "tool", F.when(F.col("role") == "assistant", "bob").otherwise("")).alias("name"))
    item = F.struct("turn", F.struct(speaker.alias("speaker"), "text", F.format_string("%02d:%02d:%02d", F.floor(F.col("turn") * 61 / 3600), F.floor(F.col("turn") * 61 / 60) % 60, (F.col("turn") * 61) % 60).alias("timestamp")).alias("i"))
    transcripts = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("rows")).select(id_.alias("recording_id"), _json(transcript=F.col("rows")).alias("record"))
    out = R.fathom_segments(meetings, transcripts)
    return out.select("meeting", "title", "started_at", F.col("pos").cast("long").alias("pos"), "speaker", "text", "start_ms")


@query(
    "provider_vtt",
    """WITH t AS (SELECT conv_id, turn::BIGINT AS turn, role, trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM conversations),
    k AS (SELECT *, ['teams', 'webex', 'zoom'][conv_id % 3 + 1] AS provider FROM t WHERE text <> '')
    SELECT provider, 'm' || conv_id AS meeting, CASE WHEN conv_id % 2 = 0 THEN 'Topic' ELSE CASE provider WHEN 'teams' THEN 'Teams' WHEN 'webex' THEN 'Webex' ELSE 'Zoom' END || ' meeting' END AS title,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS speaker, text, turn * 61000 AS start_ms, turn * 61000 + 1500 AS end_ms FROM k""",
    covers="src_teams src_webex src_zoom",
)
def provider_vtt(spark, sf):
    """Records of three services, each naming the WebVTT file of its transcript."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), " +", " "))
    c = load(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", plain.alias("text"))
    stamp = lambda s, ms: F.format_string(f"%02d:%02d:%02d.{ms}", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    at = F.col("turn") * 61
    cue = F.concat(stamp(at, "000"), F.lit(" --> "), stamp(at + 1, "500"), F.lit("\n<v "), "role", F.lit(">"), "text")
    path = F.concat(F.lit("https://files/"), F.col("conv_id").cast("string"), F.lit(".vtt"))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("body")).select("conv_id", path.alias("path"), F.concat(F.lit("WEBVTT\n\n"), "body").alias("content"))
    id_, topic, start = F.concat(F.lit("m"), F.col("conv_id").cast("string")), F.when(F.col("conv_id") % 2 == 0, "Topic"), "2024-01-01T00:00:00Z"
    shapes = {
        "teams": _json(id=id_, subject=topic, startDateTime=start, transcriptContentUrl=path),
        "webex": F.when(F.col("conv_id") % 2 == 0, _json(id=id_, meetingTopic=topic, startTime=start, vttDownloadLink=path)).otherwise(_json(id=id_, meeting_topic=F.lit(""), start_time=start, vtt_download_link=path)),
        "zoom": _json(uuid=id_, topic=topic, start_time=start, transcript_download_url=path),
    }
    out = None
    for k, (name, record) in enumerate(shapes.items()):
        mine = files.where(F.col("conv_id") % 3 == k)
        got = R.vtt_segments(name, mine.select(record.alias("record")), mine.select("path", "content"))
        out = got if out is None else out.unionByName(got)
    return out.select("provider", "meeting", "title", F.col("pos").cast("long").alias("pos"), "speaker", "text", "start_ms", "end_ms")


@query("text_tables", "SELECT r_regionkey, n_nationkey, n_name FROM nation JOIN region ON r_regionkey = n_regionkey", covers="src_plaud")
def text_tables(spark, sf):
    """Nations of a region as a printed table with rules and colours, and its rows again."""
    n = load(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.struct("n_nationkey", F.concat(F.lit("| \x1b[1m"), F.col("n_nationkey").cast("string"), F.lit("\x1b[0m  | "), "n_name", F.lit(" |")).alias("line")).alias("x"))
    printed = n.groupBy("r_regionkey").agg(F.concat(F.lit("+----+----+\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("text"))
    cells = printed.select("r_regionkey", F.explode(S.table_rows(F.col("text"))).alias("c"))
    return cells.select("r_regionkey", F.col("c")[0].cast("int").alias("n_nationkey"), F.col("c")[1].alias("n_name"))


@query("checked_write", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1", covers="sink_tx")
def checked_write(spark, sf):
    """A table written twice under one name, the second time in place of the first, and read back."""
    import uuid

    from parley.operators.graph import checkpointed, shared_folder

    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    path = f"{shared_folder(spark)}/checked-{uuid.uuid4().hex}"
    S.write_checked(n, path)
    odd = n.where("n_nationkey % 2 = 1")
    S.write_checked(odd, path, odd.count())
    done = checkpointed(spark.read.parquet(path))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return done


_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in b"k3y".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query(
    "signed_webhooks",
    f"""WITH d AS (SELECT 'all' AS endpoint, * FROM events UNION ALL SELECT 'errors', * FROM events WHERE event_type IN ('error', 'view')),
    b AS (SELECT endpoint, event_id, '{{"event":' || event_id || ',"kind":"' || event_type || '","payload":"' || user_id || '"}}' AS body FROM d)
    SELECT endpoint, sha256(endpoint || ':' || event_id) AS id, 'sha256=' || sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(body)))) AS signature FROM b""",
    covers="sink_webhook sf_hmac sf_sha256",
)
def signed_webhooks(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("payload"))
    subs = spark.createDataFrame([("all", []), ("errors", ["error", "view"])], "endpoint string, kinds array<string>")
    return S.signed_deliveries(e, subs, b"k3y").select("endpoint", "id", "signature")


@query(
    "scanned_files",
    r"""WITH l AS (SELECT conv_id % 20 AS shelf, conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations)
    SELECT shelf, sha256(string_agg(line || chr(10), '' ORDER BY conv_id, turn)) AS digest, count(*) AS lines FROM l GROUP BY 1""",
    covers="src_scan_files",
)
def scanned_files(spark, sf):
    """Text files in a folder tree, written by Spark and found again by name, each as one row."""
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    lines = load(spark, sf, "conversations").select((F.col("conv_id") % 20).alias("shelf"), "conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("line"))
    lines.repartition("shelf").sortWithinPartitions("shelf", "conv_id", "turn").select("shelf", "line").write.partitionBy("shelf").text(path)
    files = S.scan_files(spark, path, "*.txt")
    shelf = F.regexp_extract("path", r"shelf=(\d+)", 1).cast("long")
    return files.select(shelf.alias("shelf"), F.sha2("content", 256).alias("digest"), (F.size(F.split("content", "\n")) - 1).cast("long").alias("lines"))


_SESSIONS = """WITH s AS (SELECT conv_id, 's' || conv_id AS session, CASE WHEN conv_id % 3 = 0 THEN 'work/2024' ELSE '' END AS folder FROM conversations GROUP BY 1)"""


def vault(spark, sf):
    """The files of a vault of conversations: a session with its turns as documents each, some of them broken."""
    c = load(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("long"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    base = F.concat(F.lit("file:/old/vault/sessions/"), F.when(F.col("conv_id") % 3 == 0, "work/2024/").otherwise(""), F.lit("s"), text(F.col("conv_id")), F.lit("/"))
    one = c.select("conv_id").distinct()
    people = F.array(F.struct(F.lit("h1").alias("human_id"), F.lit("manual").alias("source")), F.struct(F.lit("").alias("human_id"), F.lit("auto").alias("source")))
    meta = _json(id=F.when(F.col("conv_id") % 5 == 0, "other").otherwise(F.concat(F.lit("s"), text(F.col("conv_id")))), title=F.when(F.col("conv_id") % 2 == 0, " ").otherwise(F.concat(F.lit("Talk "), text(F.col("conv_id")))), event=F.struct(F.lit("t").alias("tracking_id")), participants=people)
    metas = one.select(F.concat(base, F.lit("_meta.json")).alias("path"), F.when(F.col("conv_id") % 7 == 0, "[]").when(F.col("conv_id") % 11 == 0, "broken").otherwise(meta).alias("content"))
    summary = one.where("conv_id % 4 <> 2").select(F.concat(base, F.lit("_summary.md")).alias("path"), F.concat(F.lit("---\nid: sum"), text(F.col("conv_id")), F.lit("\nposition: 3\n---\n# "), F.when(F.col("conv_id") % 8 == 0, "Untitled").otherwise(F.concat(F.lit("About "), text(F.col("conv_id")))), F.lit("\nrest")).alias("content"))
    notes = c.select(F.concat(base, F.when(F.col("turn") == 0, "_memo.md").otherwise(F.concat(F.lit("t"), text(F.col("turn")), F.lit(".md")))).alias("path"), F.concat(F.lit("---\ntemplate_id: "), "role", F.lit("\n---\n"), F.col("text")).alias("content"))
    more = spark.createDataFrame([("file:/old/vault/humans/h1.md", "x"), ("file:/old/vault/events.json", "[]"), ("file:/old/vault/tasks.json", "no"), ("file:/old/vault/sessions/x/attachments/a.md", "y"), ("file:/old/vault/other/z.md", "z"), ("file:/elsewhere/_meta.json", "{}")], "path string, content string")
    return V.classified(metas.unionByName(summary).unionByName(notes).unionByName(more), "/old/vault")


@query(
    "vault_sessions",
    f"""{_SESSIONS} SELECT session, folder, CASE WHEN conv_id % 2 = 1 THEN 'Talk ' || conv_id WHEN conv_id % 4 = 2 OR conv_id % 8 = 0 THEN ' ' ELSE 'About ' || conv_id END AS title, 't' AS external_event_id,
      CASE WHEN conv_id % 5 = 0 THEN 'metadata id other differs from folder id ' || session END AS warning, 1::BIGINT AS people FROM s WHERE conv_id % 7 <> 0 AND conv_id % 11 <> 0""",
    covers="src_legacy_vault",
)
def vault_sessions(spark, sf):
    """Sessions of an old vault with their titles, recovered from summaries where the metadata has none, and the people they name."""
    files = vault(spark, sf)
    people = V.participants(files).groupBy("session").agg(F.count("*").alias("people"))
    return V.sessions(files).join(people, "session", "left").select("session", "folder", "title", "external_event_id", "warning", F.coalesce("people", F.lit(0)).alias("people"))


@query(
    "vault_documents",
    f"""{_SESSIONS} SELECT session, 'summary' AS kind, 'sum' || conv_id AS id, 3::BIGINT AS position, '' AS template_id, '# ' || CASE WHEN conv_id % 8 = 0 THEN 'Untitled' ELSE 'About ' || conv_id END || chr(10) || 'rest' AS body FROM s WHERE conv_id % 4 <> 2
    UNION ALL SELECT session, CASE WHEN turn = 0 THEN 'note' WHEN role <> '' THEN 'template_output' ELSE 'summary' END, sha256(session || ':document:' || CASE WHEN turn = 0 THEN '_memo.md' ELSE 't' || turn || '.md' END), 0, role, text FROM s JOIN conversations USING (conv_id)""",
    covers="src_legacy_vault",
)
def vault_documents(spark, sf):
    return V.documents(vault(spark, sf)).select("session", "kind", "id", "position", "template_id", "body")


@query(
    "vault_failures",
    f"""{_SESSIONS} SELECT 'sessions/' || CASE WHEN folder = '' THEN '' ELSE folder || '/' END || session || '/_meta.json' AS relative, CASE WHEN conv_id % 7 = 0 THEN 'no object' ELSE 'no JSON' END AS problem FROM s WHERE conv_id % 7 = 0 OR conv_id % 11 = 0
    UNION ALL SELECT 'tasks.json', 'no JSON'""",
    covers="src_legacy_vault",
)
def vault_failures(spark, sf):
    return V.failures(vault(spark, sf))
