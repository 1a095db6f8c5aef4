"""A full-text index that is kept: postings by term bucket, documents by id bucket, and manifests that name what is current.

    data/<version>-<writer>/postings/bucket=<b>/   (id, field, term, tf, positions, length), by term within a file
    data/<version>-<writer>/documents/bucket=<b>/  (id, field, length, terms)
    manifest/<version>-<writer>/                   (table, bucket, folder, state): the folder that holds each bucket, and the sums

A batch of changed documents reads the old terms of these documents from their
id buckets, and writes anew only the buckets of terms and ids that it touches;
a manifest then names them current, in one step, as a manifest counts only once
it is complete. A query reads the buckets of its terms and, within them, the
row groups that have them. A restart opens the last complete manifest; a batch
that is replayed is recognised by its number and changes nothing. Writers name
their folders apart, so two that build one version at once do not mix: the first
by name counts, and an update that finds another one beside it fails.

Documents are (id, fields); null fields count as ''; a repeated id is indexed as
one document with all its rows' postings, so callers pass an id once; documents
without words count in the number of documents. Ids may be of any type that
Parquet holds.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import folded, word_tokens
from parley.operators.graph import checkpointed
from parley.sources.tables import spread

K1, B = 1.2, 0.75
#: Buckets at least and at most, and bytes of text to a bucket between.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 16, 4096, 64_000_000
#: Words of documents that a task turns into postings at once; a longer document is a piece of its own.
PIECE_WORDS = 1 << 18
#: Changed ids up to which they are broadcast to the rows they replace, some tens of bytes each; beyond they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Files of a bucket from which an update deals its rows anew instead of leaving them where they are read.
MOST_FILES = 16

_POSTINGS = "term string, tf long, positions array<int>, length long"


def postings(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(id, field, term, tf, positions, length): one row for each term of each field; a document's words stay in its task."""
    kind = docs.schema["id"].dataType.simpleString()
    parts = [docs.select("id", F.lit(f).alias("field"), word_tokens(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = np.asarray(batch.column("w").offsets, dtype=np.int64)
            group = (offsets[1:] - offsets[0] - 1) // PIECE_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from piece(batch.slice(a, b - a))

    def piece(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("w")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        size = np.diff(offsets)
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return
        code = words.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        pos = (np.arange(len(code)) - np.repeat(offsets[:-1] - offsets[0], size)).astype(np.int32)
        order = np.lexsort((pos, code, doc))
        code, doc, pos = code[order], doc[order], pos[order]
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
        ends = np.append(at, len(code))
        own = pa.array(doc[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(own), batch.column("field").take(own), words.dictionary.take(pa.array(code[at])), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos)), pa.array(size[doc[at]])],
            ["id", "field", "term", "tf", "positions", "length"],
        )

    return reduce(DataFrame.unionByName, parts).mapInArrow(run, f"id {kind}, field string, {_POSTINGS}")


def bucket_of(c: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _named(version: int) -> str:
    return f"{version:08d}-{uuid.uuid4().hex}"


class KeptIndex:
    """The index under a folder, as its last complete manifest says."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _complete(self) -> dict[int, list[str]]:
        """Names of the complete manifests of each version, the one that counts first."""
        fs, path = self._fs()
        folder = path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        out: dict[int, list[str]] = {}
        for n in sorted(names):
            if re.fullmatch(r"\d{8}-\w+", n) and fs.exists(path(f"{self.path}/manifest/{n}/_SUCCESS")):
                out.setdefault(int(n[:8]), []).append(n)
        return out

    def versions(self) -> list[int]:
        """Versions with a complete manifest, the last at the end."""
        return sorted(self._complete())

    def manifest(self) -> dict:
        """{tables: {table: {bucket: folder}}, and the state of the last version}; at most two rows a bucket."""
        found = self._complete()
        if not found:
            raise FileNotFoundError(f"no index in {self.path}")
        last = max(found)
        rows = self.spark.read.parquet(f"{self.path}/manifest/{found[last][0]}").collect()
        tables: dict[str, dict[int, str]] = {"postings": {}, "documents": {}}
        state = {}
        for r in rows:
            if r["table"] == "state":
                state = json.loads(r["state"])
            else:
                tables[r["table"]][r["bucket"]] = r["folder"]
        return {"version": last, "tables": tables} | state

    def _commit(self, version: str, tables: dict[str, dict[int, str]], state: dict) -> bool:
        """Names a version's folders current; whether no other writer has a manifest of this version."""
        rows = [(t, b, f, None) for t, own in tables.items() for b, f in sorted(own.items())] + [("state", None, None, json.dumps(state))]
        self.spark.createDataFrame(rows, "table string, bucket int, folder string, state string").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/{version}")
        return self._complete()[int(version[:8])] == [version]

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last manifests and the data that none of these names; readers of older versions must be done."""
        fs, path = self._fs()
        found = self._complete()
        kept = [found[v][0] for v in sorted(found)[-keep:]]
        named = {r["folder"].split("/")[1] for v in kept for r in self.spark.read.parquet(f"{self.path}/manifest/{v}").where("folder is not null").select("folder").distinct().collect()}
        gone = 0
        for part, stay in (("data", named), ("manifest", set(kept))):
            for s in fs.listStatus(path(f"{self.path}/{part}")):
                if s.getPath().getName() not in stay:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone

    # Writing

    def _written(self, rows: DataFrame, version: str, table: str, buckets: int, stay: DataFrame | None = None) -> dict[int, str]:
        """Writes rows by bucket, large buckets in several files; gives the folder of each bucket that has rows.

        Rows of `stay` come from files of single buckets and are written by the
        tasks that read them, without a shuffle, unless these files are many.
        """
        key = "term" if table == "postings" else "id"
        folder = f"data/{version}/{table}"
        sorted_ = lambda df: df.sortWithinPartitions("bucket", key)
        own = lambda df: df.withColumn("bucket", bucket_of(key, buckets))
        if stay is not None and len(stay.inputFiles()) > MOST_FILES * buckets:
            rows, stay = stay.unionByName(rows), None
        if stay is not None:
            sorted_(own(stay)).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        dealt = sorted_(own(rows).hint("rebalance", "bucket"))
        dealt.write.mode("overwrite" if stay is None else "append").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))]
        return {int(n[7:]): folder for n in names if n.startswith("bucket=")}

    def _forward(self, docs: DataFrame, fields: Sequence[str]) -> DataFrame:
        """(id, field, length, terms) of documents, those without words as well; a document's words stay in its task."""
        parts = [docs.select("id", F.lit(f).alias("field"), word_tokens(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in fields]
        return reduce(DataFrame.unionByName, parts).select("id", "field", F.size("w").cast("long").alias("length"), F.array_distinct("w").alias("terms"))

    def _sums(self, forward: DataFrame, fields: Sequence[str]) -> dict[str, list[int]]:
        """{field: [documents, words]}."""
        return {f: [0, 0] for f in fields} | {r["field"]: [r["n"], r["words"]] for r in forward.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()}

    def build(self, docs: DataFrame, fields: Sequence[str] = ("title", "content"), source: str = "") -> KeptIndex:
        """A first or new version of all documents."""
        total = docs.agg(sum((F.coalesce(F.sum(F.octet_length(F.col(f))), F.lit(0)) for f in fields), F.lit(0))).first()[0]
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, total // BUCKET_BYTES))
        version = _named((self.versions() or [0])[-1] + 1)
        dealt = spread(docs)
        tables = {"postings": self._written(postings(dealt, fields), version, "postings", buckets), "documents": self._written(self._forward(dealt, fields), version, "documents", buckets)}
        kind = docs.schema["id"].dataType.simpleString()
        sums = self._sums(self._read(tables, "documents", None, kind), fields)
        self._commit(version, tables, {"buckets": buckets, "fields": list(fields), "kind": kind, "sums": sums, "source": source, "batch": -1})
        return self

    def update(self, changed: DataFrame, removed: DataFrame, batch: int | None = None) -> dict[str, int]:
        """Replaces documents (id, fields) and drops those of `removed` (id); says how many buckets were written.

        Touched buckets are known by number, of which there are at most
        MOST_BUCKETS, so only numbers reach the driver.
        """
        now = self.manifest()
        if batch is not None and batch <= now["batch"]:
            return {"postings": 0, "documents": 0}
        tables, buckets, fields, version = now["tables"], now["buckets"], now["fields"], _named(now["version"] + 1)
        ids = checkpointed(changed.select("id").unionByName(removed.select("id")).distinct())
        named = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        new = checkpointed(postings(changed, fields))
        touched = lambda df, key: {r["b"] for r in df.select(bucket_of(key, buckets).alias("b")).distinct().collect()}
        id_buckets = touched(ids, "id")
        held = self._read(tables, "documents", id_buckets, now["kind"])
        old = checkpointed(held.join(named, "id", "left_semi"))
        term_buckets = touched(old.select(F.explode("terms").alias("term")), "term") | touched(new, "term")
        forward = checkpointed(self._forward(changed, fields))
        rest = self._read(tables, "postings", term_buckets, now["kind"]).join(named, "id", "left_anti")
        written = {
            "postings": self._written(new, version, "postings", buckets, rest) if term_buckets else {},
            "documents": self._written(forward, version, "documents", buckets, held.join(named, "id", "left_anti")) if id_buckets else {},
        }
        for table, own in (("postings", term_buckets), ("documents", id_buckets)):
            tables[table] = {b: f for b, f in tables[table].items() if b not in own} | written[table]
        gone, come = self._sums(old, fields), self._sums(forward, fields)
        sums = {f: [now["sums"][f][i] - gone[f][i] + come[f][i] for i in (0, 1)] for f in fields}
        state = {k: now[k] for k in ("buckets", "fields", "kind", "source")} | {"sums": sums, "batch": now["batch"] if batch is None else batch}
        if not self._commit(version, tables, state):
            raise RuntimeError(f"another writer made version {version[:8]} of the index in {self.path}")
        return {"postings": len(term_buckets), "documents": len(id_buckets)}

    # Reading

    def _read(self, tables: dict, table: str, buckets: set[int] | None, kind: str) -> DataFrame:
        """The rows of some buckets of a table, of all where none are named."""
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(tables[table].items()) if buckets is None or b in buckets]
        schema = f"id {kind}, field string, " + (_POSTINGS if table == "postings" else "length long, terms array<string>")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Postings of some terms, or of all: only their buckets are read."""
        now = self.manifest()
        if terms is None:
            return self._read(now["tables"], "postings", None, now["kind"])
        wanted = sorted(set(terms))
        here = self.spark.createDataFrame([(t,) for t in wanted], "term string").select(bucket_of("term", now["buckets"]).alias("b")).distinct().collect() if wanted else []
        return self._read(now["tables"], "postings", {r["b"] for r in here}, now["kind"]).where(F.col("term").isin(wanted))

    def documents(self) -> DataFrame:
        now = self.manifest()
        return self._read(now["tables"], "documents", None, now["kind"])

    def scored(self, terms: Sequence[str], boosts: dict[str, float]) -> DataFrame:
        """(id, term, score): BM25 of each term in each field that has a boost, times that boost."""
        now = self.manifest()
        hits = self.postings(terms).where(F.col("field").isin(list(boosts)))
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
        rows = [(f, float(b), float(now["sums"][f][0]), now["sums"][f][1] / max(now["sums"][f][0], 1) or 1.0) for f, b in boosts.items()]
        sums = self.spark.createDataFrame(rows, "field string, boost double, n double, mean double")
        j = hits.join(F.broadcast(df.join(F.broadcast(sums), "field")), ["field", "term"])
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        score = F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return j.select("id", "term", score.alias("score"))

    def any_of(self, terms: Sequence[str], boosts: dict[str, float]) -> DataFrame:
        """(id, score) of documents with any of the terms."""
        return self.scored(terms, boosts).groupBy("id").agg(F.sum("score").alias("score"))

    def all_of(self, terms: Sequence[str], boosts: dict[str, float]) -> DataFrame:
        """(id, score) of documents with every term, in one field or another."""
        found = self.scored(terms, boosts).groupBy("id").agg(F.sum("score").alias("score"), F.countDistinct("term").alias("n"))
        return found.where(F.col("n") == len(set(terms))).drop("n")

    def phrase(self, terms: Sequence[str], field: str, slop: int = 0) -> DataFrame:
        """(id) of documents in which the terms stand in order with at most `slop` other words between them in all."""
        own = self.postings(terms).where(F.col("field") == field)
        by = own.groupBy("id").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)]).where(F.col("n") == len(set(terms)))

        def end(start: Column) -> Column:
            """The least position of the last term after the others in order; null where there is none."""
            at = start
            for i in range(1, len(terms)):
                before = at
                at = F.array_min(F.filter(f"p{i}", lambda p: p > before))  # noqa: B023
            return at

        return by.where(F.exists("p0", lambda s: F.coalesce(end(s) - s <= len(terms) - 1 + slop, F.lit(False)))).select("id")


    def snippets(self, terms: Sequence[str], field: str, docs: DataFrame, width: int = 24, lead: int = 3) -> DataFrame:
        """(id, fragment, weight, hits): of each document (id, field) with a term the `width` words in which its terms weigh most.

        A window begins at a hit; it weighs the sum of the inverse document
        frequencies of the hits in it; of equal ones the first is taken, and
        `lead` words before it are shown as well. hits are the places of the
        terms among the words of the fragment, from 0. Places come from the
        postings; only documents that are found give their texts.
        """
        now = self.manifest()
        own = self.postings(terms).where(F.col("field") == field)
        df = own.groupBy("term").agg(F.count("*").alias("df"))
        n = float(now["sums"][field][0])
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        places = own.join(F.broadcast(df), "term").select("id", F.explode("positions").alias("pos"), F.round(idf, 6).alias("w"))
        ahead = Window.partitionBy("id").orderBy("pos").rangeBetween(0, width - 1)
        best = places.select("id", "pos", F.round(F.sum("w").over(ahead), 6).alias("weight"), F.collect_list("pos").over(ahead).alias("at"))
        best = best.groupBy("id").agg(F.max(F.struct("weight", (-F.col("pos")).alias("first"), "at")).alias("b"))
        from_ = F.greatest(-F.col("b.first") - lead, F.lit(0))
        words = F.filter(F.regexp_extract_all(F.col(field), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.octet_length(folded(w)) <= 40)
        found = best.join(docs.select("id", field), "id")
        return found.select("id", F.array_join(F.slice(words, from_ + 1, F.lit(width + lead)), " ").alias("fragment"), "b.weight", F.transform("b.at", lambda p: p - from_).alias("hits"))


def source_state(docs: DataFrame) -> str:
    """Names, lengths and times of the files that a table reads from, as a digest: what tells a changed table from the same."""
    spark = docs.sparkSession
    lines = []
    for name in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        lines.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def kept(spark: SparkSession, folder: str, docs: DataFrame, fields: Sequence[str] = ("title", "content")) -> KeptIndex:
    """The index of a table's documents under a folder: opened where it was built from the same files, else built."""
    state = source_state(docs)
    index = KeptIndex(spark, f"{folder.rstrip('/')}/{state[:24]}")
    return index if index.versions() else index.build(docs, fields, state)
