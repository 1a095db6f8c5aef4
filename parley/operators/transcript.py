"""Transcripts in batch: words to segments by channel, speaker identity, display blocks, labels and Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.times import timecode

#: Milliseconds of a gap that ends a segment, words and milliseconds of a segment at most, gap that display merges.
GAP, MOST_WORDS, MOST_MS, DISPLAY_GAP = 3_000, 512, 300_000, 40_000


def identities(words: DataFrame, hints: DataFrame) -> DataFrame:
    """Adds human: a hint for the word itself, else for its channel and speaker, else for its channel if that has one speaker only.

    words: (transcript, id, channel, speaker_index, ...); hints: (transcript,
    scope, word_id, channel, speaker_index, human) with scope word, speaker or
    channel; of several hints for one thing the greatest human is taken.
    """
    by_word = hints.where("scope = 'word'").groupBy("transcript", F.col("word_id").alias("id")).agg(F.max("human").alias("_w"))
    by_speaker = hints.where("scope = 'speaker' and speaker_index is not null").groupBy("transcript", "channel", "speaker_index").agg(F.max("human").alias("human"))
    single = words.groupBy("transcript", "channel").agg(F.countDistinct("speaker_index").alias("_k")).where("_k <= 1").drop("_k")
    by_channel = hints.where("scope = 'channel'").groupBy("transcript", "channel").agg(F.max("human").alias("human")).join(single, ["transcript", "channel"], "left_semi")
    # A recording has few speakers: their hints come to its words by one join, and the words stay together by recording.
    both = by_speaker.unionByName(by_channel.withColumn("speaker_index", F.lit(None).cast(by_speaker.schema["speaker_index"].dataType)))
    own = both.groupBy("transcript").agg(F.collect_list(F.struct("channel", "speaker_index", "human")).alias("_own"))
    told = lambda which: F.get(F.filter("_own", lambda h: (h["channel"] == F.col("channel")) & which(h["speaker_index"])), F.lit(0))["human"]
    j = words.join(by_word, ["transcript", "id"], "left").join(own, "transcript", "left")
    return j.withColumn("human", F.coalesce("_w", told(lambda s: s == F.col("speaker_index")), told(lambda s: s.isNull()))).select(*words.columns, "human")


def _capped(rows: pd.DataFrame) -> pd.Series:
    """Numbers the blocks of one island: a block is full at MOST_WORDS words or when a word would end MOST_MS after its start."""
    block, n, begin = 0, 0, None
    out = []
    for start, end in zip(rows["start_ms"], rows["end_ms"], strict=True):
        if n and (n >= MOST_WORDS or end - begin > MOST_MS):
            block, n = block + 1, 0
        if not n:
            begin = start
        n += 1
        out.append(block)
    return pd.Series(out, index=rows.index)


def _by_caps(rows: DataFrame, keys: list[str], words: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of islands within the caps, as block 0, and those of the others; islands are measured where their rows are."""
    island = Window.partitionBy(*keys)
    over = (F.sum(words).over(island) > MOST_WORDS) | (F.max("end_ms").over(island) - F.min("start_ms").over(island) > MOST_MS)
    rows = rows.withColumn("_over", F.coalesce(over, F.lit(False)))
    return rows.where("not _over").drop("_over").withColumn("_block", F.lit(0).cast("long")), rows.where("_over").drop("_over")


def segments(words: DataFrame) -> DataFrame:
    """(transcript, channel, speaker_index, human, start_ms, end_ms, last, n, text): blocks of words (transcript, channel, speaker_index, human, start_ms, end_ms, text).

    A word joins the last block of its channel if that has the same speaker and
    human and ended at most GAP before; a block that is full is cut. Gap and key
    make islands by windows; only islands that exceed a cap, and those are few,
    go on to a fold in order, island by island. last is the time of the last word.
    """
    key = F.struct("speaker_index", "human")
    w = Window.partitionBy("transcript", "channel").orderBy("start_ms", "end_ms", "text")
    lag_end = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(lag_end.isNull() | (F.col("start_ms") - lag_end > GAP) | ~F.lag(key).over(w).eqNullSafe(key), 1).otherwise(0)
    rows = words.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    keys = ["transcript", "channel", "_island"]
    short, over = _by_caps(rows, keys, F.lit(1))
    schema = short.schema

    def cut(island: pd.DataFrame) -> pd.DataFrame:
        island = island.sort_values(["start_ms", "end_ms", "text"])
        return island.assign(_block=_capped(island))[schema.names]

    long_ = over.groupBy(*keys).applyInPandas(cut, schema)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))), lambda x: x["text"])
    block = lambda part: part.groupBy(*keys, "_block").agg(
        F.first("speaker_index").alias("speaker_index"), F.first("human").alias("human"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.max(F.struct("start_ms", "end_ms")).alias("last"), F.count("*").alias("n"), F.trim(F.array_join(pieces, "")).alias("text"),
    )
    return block(short).unionByName(block(long_)).drop("_island", "_block")


def _joined(blocks: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Neighbours in order become one where they speak for the same, start in order, have a small gap and do not exceed the caps together.

    They speak for the same if they have one human, or the same channel, speaker
    and human of which at least one is known: blocks without any identity stay
    apart. Islands are made by windows; only islands that exceed a cap, and
    those are few, go on to a fold in order, island by island.
    """
    order = ["start_ms", "end_ms", "channel", "text"]
    w = Window.partitionBy(*by).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    same_key = before("speaker_index").eqNullSafe(F.col("speaker_index")) & before("human").eqNullSafe(F.col("human")) & (F.col("speaker_index").isNotNull() | F.col("human").isNotNull())
    alike = (before("channel") == F.col("channel")) & (F.coalesce(before("human") == F.col("human"), F.lit(False)) | same_key)
    near = (before("last")["start_ms"] <= F.col("start_ms")) & (F.col("start_ms") - before("last")["end_ms"] <= gap)
    rows = blocks.withColumn("_new", F.when(F.coalesce(alike & near, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    keys = [*by, "_island"]
    short, over = _by_caps(rows, keys, F.col("n"))
    names = short.columns

    def cut(island: pd.DataFrame) -> pd.DataFrame:
        island = island.sort_values(order)
        block, n, begin, out = 0, 0, None, []
        for start, last, words in zip(island["start_ms"], island["last"], island["n"], strict=True):
            if n and (n + words > MOST_WORDS or last["end_ms"] - begin > MOST_MS):
                block, n = block + 1, 0
            begin = start if not n else begin
            n += words
            out.append(block)
        return island.assign(_block=out)[names]

    long_ = over.groupBy(*keys).applyInPandas(cut, short.schema)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["text"]), " ")
    first = lambda c: F.min_by(c, F.struct(*order)).alias(c)
    block = lambda part: part.groupBy(*keys, "_block").agg(
        *([] if "channel" in by else [first("channel")]), first("speaker_index"), first("human"), text.alias("text"), F.min("start_ms").alias("_s"), F.max("end_ms").alias("end_ms"), F.max_by("last", F.struct(*order)).alias("last"), F.sum("n").alias("n"),
    )
    return block(short).unionByName(block(long_)).withColumnRenamed("_s", "start_ms").select(*blocks.columns)


def merged(blocks: DataFrame, gap: int = DISPLAY_GAP) -> DataFrame:
    """Neighbours in the order of display, over all channels of a transcript, joined."""
    return _joined(blocks, ["transcript"], gap)


def propagated(blocks: DataFrame) -> DataFrame:
    """A second pass over the blocks of each channel: those that an identity joins although their keys differ."""
    return _joined(blocks, ["transcript", "channel"], GAP)


def neutral_words(words: DataFrame, hints: DataFrame, participants: DataFrame, own: str) -> DataFrame:
    """Adds neutral: the word's label says nothing, as its transcript has one channel, one speaker and one assigned human at most though others took part, and no one assigned the word by hand.

    words: (transcript, id, channel, speaker_index); hints: (transcript, scope,
    word_id, channel, speaker_index, human, by_hand); participants: (transcript, human).
    """
    spoken = words.groupBy("transcript").agg(F.countDistinct("channel").alias("_c"), F.countDistinct(F.when(F.col("speaker_index").isNotNull(), F.struct("channel", "speaker_index"))).alias("_s"))
    machine = hints.where("not by_hand").groupBy("transcript").agg(F.countDistinct("human").alias("_h"))
    others = participants.where((F.col("human") != "") & (F.col("human") != own)).select("transcript").distinct()
    mixed = spoken.join(machine, "transcript", "left").where((F.col("_c") <= 1) & (F.col("_s") <= 1) & (F.coalesce("_h", F.lit(0)) <= 1)).select("transcript").join(others, "transcript", "left_semi")
    hand = hints.where("by_hand and human is not null")
    by_word = hand.where("scope = 'word'").select("transcript", F.col("word_id").alias("id")).distinct()
    by_speaker = hand.where("scope = 'speaker' and speaker_index is not null").select("transcript", "channel", "speaker_index").distinct()
    by_channel = hand.where("scope = 'speaker' and speaker_index is null or scope = 'channel'").select("transcript", "channel").distinct()
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    j = words.join(flag(mixed, "_mixed"), "transcript", "left").join(flag(by_word, "_w"), ["transcript", "id"], "left")
    j = j.join(flag(by_speaker, "_sp"), ["transcript", "channel", "speaker_index"], "left").join(flag(by_channel, "_ch"), ["transcript", "channel"], "left")
    no = lambda c: F.col(c).isNull()
    return j.withColumn("neutral", F.col("_mixed").isNotNull() & no("_w") & no("_sp") & no("_ch")).select(*words.columns, "neutral")


def labelled(blocks: DataFrame, names: DataFrame, own: str) -> DataFrame:
    """Adds label: the human's name, 'You' for one's own, else 'Speaker n' by first appearance in the transcript."""
    unknown = F.col("human").isNull()
    first = F.min(F.when(unknown, F.col("start_ms"))).over(Window.partitionBy("transcript", "channel", "speaker_index"))
    order = Window.partitionBy("transcript").orderBy(~unknown, "_first", "channel", F.col("speaker_index").asc_nulls_first())
    numbered = blocks.withColumn("_first", first).withColumn("_n", F.when(unknown, F.dense_rank().over(order)))
    j = numbered.join(names.select("human", "name"), "human", "left")
    return j.withColumn("label", F.coalesce("name", F.when(F.col("human") == own, "You"), F.concat(F.lit("Speaker "), F.col("_n").cast("string")), F.col("human"))).select(*blocks.columns, "label")


def segment_id(channel: Column, speaker: Column, human: Column, first: Column, last: Column) -> Column:
    """A stable id of a segment."""
    parts = [F.coalesce(c.cast("string"), F.lit("none")) for c in (channel, speaker, human, first, last)]
    return F.concat_ws(":", *parts)


def markdown(blocks: DataFrame) -> DataFrame:
    """(transcript, body, blocks): headings with time and label, and the text, in order; the number of blocks."""
    head = F.concat(F.lit("**["), timecode(F.col("start_ms")), F.lit("] "), F.col("label"), F.lit("**\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "channel", head.alias("t"))))
    return blocks.groupBy("transcript").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("body"), F.count("*").alias("blocks"))


def live_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): upsert or remove, by the hash of a segment in two snapshots."""
    values = [c for c in after.columns if c != key]
    a = after.select(key, F.xxhash64(*values).alias("_a"))
    b = before.select(key, F.xxhash64(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "remove").when(F.col("_b").isNull() | (F.col("_a") != F.col("_b")), "upsert")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def subtitles(words: DataFrame) -> DataFrame:
    """(transcript, body): WebVTT cues of words, by start, each at least a millisecond long."""
    stamp = lambda ms: F.concat(timecode(ms), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    end = F.greatest(F.col("end_ms"), F.col("start_ms") + 1)
    cue = F.concat(stamp(F.col("start_ms")), F.lit(" --> "), stamp(end), F.lit("\n"), F.trim("text"))
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", cue.alias("t"))))
    return words.groupBy("transcript").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n")).alias("body"))
