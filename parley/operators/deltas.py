"""Folding a log of transcript deltas: words that were added, replaced and added again, their partials, and the hints on them.

Deltas are (transcript, seq, new_words, replaced_ids, partials). In the order of
seq a delta takes out the words it replaces and those it brings anew, and adds
its own; of rows with one seq, which are replays, one counts. The fold needs no
order in one place: a word is there if the last delta that brought it is not
before the last that replaced it, so both are grouped maxima, combined before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hints of these scopes stay when their word goes: they speak of more than the word.
LASTING_SCOPES = ("segment", "speaker")


def _brought(deltas: DataFrame) -> DataFrame:
    """(transcript, id, seq, w): the last delta that brought each word, and the word."""
    each = deltas.select("transcript", "seq", F.explode("new_words").alias("w"))
    return each.groupBy("transcript", F.col("w.id").alias("id")).agg(F.max(F.struct("seq", "w")).alias("x")).select("transcript", "id", "x.seq", "x.w")


def _replaced(deltas: DataFrame) -> DataFrame:
    """(transcript, id, seq): the last delta that replaced each word."""
    return deltas.select("transcript", "seq", F.explode("replaced_ids").alias("id")).groupBy("transcript", "id").agg(F.max("seq").alias("seq"))


def folded_words(deltas: DataFrame) -> DataFrame:
    """(transcript, the fields of a word): the words after all deltas."""
    gone = _replaced(deltas).withColumnRenamed("seq", "gone")
    left = _brought(deltas).join(gone, ["transcript", "id"], "left").where("gone is null or seq >= gone")
    return left.select("transcript", "w.*")


def folded_partials(deltas: DataFrame) -> DataFrame:
    """(transcript, the fields of a partial): those of the last delta."""
    last = deltas.groupBy("transcript").agg(F.max_by("partials", "seq").alias("partials"))
    return last.select("transcript", F.explode("partials").alias("p")).select("transcript", "p.*")


def folded_hints(deltas: DataFrame, hints: DataFrame) -> DataFrame:
    """(transcript, word_id, kind, scope, value) after all deltas.

    hints: (transcript, seq, word_id, kind, scope, value), given after the delta
    seq. A hint goes with the next delta that replaces its word or brings it
    anew, unless its scope lasts; each word that is brought with a speaker gives
    a hint of kind provider_speaker_index.
    """
    brought = _brought(deltas)
    touched = brought.select("transcript", "id", "seq").unionByName(_replaced(deltas)).groupBy("transcript", "id").agg(F.max("seq").alias("touched"))
    own = brought.where("w.speaker_index is not null").select("transcript", "seq", F.col("id").alias("word_id"), F.lit("provider_speaker_index").alias("kind"), F.lit("word").alias("scope"), F.col("w.speaker_index").cast("string").alias("value"))
    every = hints.select(*own.columns).unionByName(own)
    j = every.join(touched.withColumnRenamed("id", "word_id"), ["transcript", "word_id"], "left")
    return j.where(F.col("scope").isin(*LASTING_SCOPES) | F.col("touched").isNull() | (F.col("touched") <= F.col("seq"))).select("transcript", "word_id", "kind", "scope", "value")


def compacted(deltas: DataFrame, upto: int) -> DataFrame:
    """The log with all deltas up to `upto` as one of that number, which folds to the same words and partials.

    What it replaced is kept, as a later row of an older journal may not bring
    such a word back.
    """
    old, rest = deltas.where(F.col("seq") <= upto), deltas.where(F.col("seq") > upto)
    word = deltas.schema["new_words"].dataType.simpleString()
    partial = deltas.schema["partials"].dataType.simpleString()
    words = folded_words(old).withColumn("w", F.struct(*[c for c in deltas.select(F.explode("new_words").alias("w")).select("w.*").columns])).groupBy("transcript").agg(F.array_sort(F.collect_list("w")).alias("new_words"))
    gone = _replaced(old).groupBy("transcript").agg(F.array_sort(F.collect_list("id")).alias("replaced_ids"))
    last = old.groupBy("transcript").agg(F.max_by("partials", "seq").alias("partials"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    one = last.join(words, "transcript", "left").join(gone, "transcript", "left").select("transcript", F.lit(upto).cast("long").alias("seq"), none("new_words", word), none("replaced_ids", "array<string>"), none("partials", partial))
    return one.unionByName(rest.select(*one.columns))
