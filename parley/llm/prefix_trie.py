"""The trie of conversation prefixes, by radix partitioning on dictionary-encoded turns.

Turns are encoded first: the dictionary has one id for each different pair of
role and text, met by a SHA-256 digest, so that texts are not shuffled. Ids that
make up a thousandth of all turns or more, at most a thousand, are joined by
broadcast, the others by a shuffle, so no frequent turn gathers its rows.

Sequences of ids are then made one of each: equal ones are found by a digest,
sorted by range with their conversations, so that a very frequent sequence is
spread over many tasks, each of which sums its part up; a digest over the
conversations that end with a sequence is fed by those parts, in order.

Different sequences are parted by most significant digit first, the digit being
the next turn. A bucket that holds more turns than a task should sort goes on as
a node of its own, is moved on to the end of what all its sequences share, and
is parted again; there are at most so many such buckets as bucket sizes fit into
the input, so they are broadcast. What is left in each bucket is dealt by its
digit and finished in tasks by multikey quicksort, whose recursion gives the
nodes. The sums over subtrees come up from the tasks to the buckets above them
in one step, as every bucket knows those above it.

Defined results: rows with null conv_id are left out; turns with null come
first; null role or text counts as ''; equal turns of a conversation go by the
digest of role and text, and repeated rows are turns of their own; a
conversation without turns ends in the root; a table without conversations has
no nodes; other columns are not read. Texts may be of any length; a
conversation's ids (16 bytes a turn, without texts) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import checkpointed

#: Turns at least, and parts of all turns, that a bucket may hold to be sorted in one task, and turns at most.
LEAST_BUCKET, BUCKETS, MOST_BUCKET = 1_000, 512, 2_000_000
#: Part of all turns from which a turn is frequent.
FREQUENT = 1_000
#: Conversations of a part of a digest.
DIGEST_PART = 50_000
#: Fixed value: the digest of nothing.
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turns in order, as ids of the dictionary and bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    counted = rows.groupBy("digest").agg(F.count("*").alias("n"))
    dictionary = checkpointed(counted.withColumn("id", F.monotonically_increasing_id()))
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= total
    frequent, rare = (dictionary.where(which).select("digest", "id") for which in (often, ~often))
    known = rows.join(F.broadcast(frequent), "digest").unionByName(rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").join(rare, "digest"))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "id", "size")
    whole = known.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return checkpointed(whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest and conversation, as (digest, first conversation, n, joined ids) for each run of a digest."""
    held: dict[str, list] = {}
    names = ["digest", "first", "n", "joined"]

    def out(digest: bytes, ids: list[int]) -> tuple:
        return digest, ids[0], len(ids), ",".join(map(str, ids))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    for batch in batches:
        done = []
        for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            own = held.get(digest)
            if own is None or len(own) == DIGEST_PART:
                done += [out(d, ids) for d, ids in held.items()]
                held = {digest: [conv]}
            else:
                own.append(conv)
        if done:
            yield batch_of(done)
    if held:
        yield batch_of([out(d, ids) for d, ids in held.items()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by digest and first conversation, as (first, n, sha) for each digest; no part is kept."""
    last, state = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["first", "n", "sha"])

    for batch in batches:
        done = []
        for digest, first, n, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest != last:
                if state:
                    done.append((state[0], state[1], state[2].hexdigest()))
                last, state = digest, [first, 0, hashlib.sha256()]
            elif state[1]:
                state[2].update(b",")
            state[1] += n
            state[2].update(joined.encode())
        if done:
            yield batch_of(done)
    if state:
        yield batch_of([(state[0], state[1], state[2].hexdigest())])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(first, n, sha, ids, sizes): each different sequence once, with its least conversation, their number, and the digest of all their conv_ids."""
    digest = F.unhex(F.sha2(F.array_join("ids", ",").cast("binary"), 256)).alias("digest")
    runs = sequences.select(digest, "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_parts, "digest binary, first long, n long, joined string")
    ended = runs.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_digests, "first long, n long, sha string")
    return ended.join(sequences.select(F.col("conv_id").alias("first"), "ids", "sizes"), "first")


def _shared_length(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with in common; the first array sorts before the second."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    differs = F.array_position(same, False)  # 0: nowhere
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _quicksorted(rows: list[tuple], depth: int) -> list[list[int]]:
    """Multikey quicksort from `depth`: gives [parent, depth, end, some] for each node below, parents first; end is -1 or the sequence that ends there, some is any that has the node."""
    nodes: list[list[int]] = []
    stack = [(list(range(len(rows))), depth, -1)] if rows else []
    while stack:
        own, d, parent = stack.pop()
        if len(own) == 1:
            at = own[0]
            length = len(rows[at][3])
            for k in range(d + 1, length + 1):
                nodes.append([parent, k, at if k == length else -1, at])
                parent = len(nodes) - 1
            continue
        pivot = rows[own[len(own) // 2]][3][d]
        less, same, more = [], [], []
        for at in own:
            digit = rows[at][3][d]
            (less if digit < pivot else more if digit > pivot else same).append(at)
        for part in (more, less):
            if part:
                stack.append((part, d, parent))
        ends = [at for at in same if len(rows[at][3]) == d + 1]
        nodes.append([parent, d + 1, ends[0] if ends else -1, same[0]])
        longer = [at for at in same if len(rows[at][3]) > d + 1]
        if longer:
            stack.append((longer, d + 1, len(nodes) - 1))
    return nodes


def _finishing(most: int):
    """Rows sorted by bucket and digit, finished by multikey quicksort: nodes, and one row of sums (depth null) for the bucket above."""

    def finish(bucket: tuple[int, int], rows: list[tuple]) -> list[tuple]:
        top_conv, depth = bucket
        nodes = _quicksorted(rows, depth)
        n, conv, children, leaves, saved = ([0] * len(nodes), [None] * len(nodes), [0] * len(nodes), [0] * len(nodes), [0] * len(nodes))
        sums = [0, 0, 0]
        for i in range(len(nodes) - 1, -1, -1):
            parent, d, end, some = nodes[i]
            if end >= 0:
                n[i] += rows[end][1]
                conv[i] = rows[end][0] if conv[i] is None else min(conv[i], rows[end][0])
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * rows[some][4][d - 1]
            if parent >= 0:
                n[parent] += n[i]
                conv[parent] = conv[i] if conv[parent] is None else min(conv[parent], conv[i])
                children[parent] += 1
                leaves[parent] += leaves[i]
                saved[parent] += saved[i]
            else:
                sums = [sums[0] + 1, sums[1] + leaves[i], sums[2] + saved[i]]
        out = [(conv[i], d, conv[parent] if parent >= 0 else top_conv, n[i], children[i], leaves[i], saved[i], rows[end][2] if end >= 0 else NOTHING) for i, (parent, d, end, _) in enumerate(nodes)]
        return [*out, (top_conv, None, depth, None, *sums, None)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, last = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "depth", "first", "n", "sha", "ids", "sizes")]
            for bucket, depth, *row in zip(*columns, strict=True):
                digit = (bucket, depth, row[3][depth])
                if last is not None and held and (digit[:2] != last[:2] or digit != last and turns >= most):
                    yield batch_of(finish(last[:2], held))
                    held, turns = [], 0
                held.append(tuple(row))
                turns, last = turns + len(row[3]) - depth, digit
        if held:
            yield batch_of(finish(last[:2], held))

    return run


def trie(sequences: DataFrame) -> DataFrame:
    """One row for each different prefix of sequences (conv_id, ids, sizes): NODE."""
    rest = checkpointed(distinct_sequences(sequences))
    spark = rest.sparkSession
    convs, least, turns = rest.agg(F.sum("n"), F.min("first"), F.sum(F.size("ids"))).first()
    if convs is None:
        return spark.createDataFrame([], NODE)
    most = min(MOST_BUCKET, max(LEAST_BUCKET, turns // BUCKETS))
    # A bucket is named by its least conversation and its depth; above: the buckets over it, itself last.
    path = "array<struct<bucket:long,depth:int>>"
    root = spark.createDataFrame([(least, 0, 0, None, convs, [], [(least, 0)])], f"bucket long, depth int, begins int, parent long, n long, sizes array<long>, above {path}")
    buckets, level = [root], root.select("bucket", "depth", "above")
    rest = rest.select(F.lit(least).alias("bucket"), F.lit(0).alias("depth"), "first", "n", "sha", "ids", "sizes")
    ended, small = [], []
    while True:
        ended.append(rest.where(F.size("ids") == F.col("depth")).select("bucket", "depth", "sha"))
        rest = rest.where(F.size("ids") > F.col("depth"))
        digit = F.get("ids", F.col("depth")).alias("digit")
        shared = F.when(F.col("count") > 1, _shared_length(F.col("low"), F.col("high")))
        large = (
            rest.groupBy("bucket", "depth", digit).agg(
                F.count("*").alias("count"), F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.sum("n").alias("n"), F.min("first").alias("to"), F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("sizes", "ids").alias("sizes"),
            ).where((F.col("turns") > most) & (F.col("count") > 1)).select("bucket", "depth", "digit", "n", "to", shared.alias("to_depth"), "sizes")
        )
        large = checkpointed(large.join(F.broadcast(level), ["bucket", "depth"]))
        if large.isEmpty():
            small.append(rest)
            break
        names = [F.col("to").alias("bucket"), F.col("to_depth").alias("depth")]
        found = large.select(*names, F.col("depth").alias("begins"), F.col("bucket").alias("parent"), "n", F.slice("sizes", F.col("depth") + 1, F.col("to_depth") - F.col("depth")).alias("sizes"), F.concat("above", F.array(F.struct(*names))).alias("above"))
        buckets.append(found)
        level = found.select("bucket", "depth", "above")
        routed = checkpointed(rest.withColumn("digit", digit).join(F.broadcast(large.select("bucket", "depth", "digit", "to", "to_depth")), ["bucket", "depth", "digit"], "left"))
        columns = ["first", "n", "sha", "ids", "sizes"]
        small.append(routed.where("`to` is null").select("bucket", "depth", *columns))
        rest = routed.where("`to` is not null").select(*names, *columns)
    return _joined(_union(buckets), _union(ended), _union(small), most)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _joined(buckets: DataFrame, ended: DataFrame, small: DataFrame, most: int) -> DataFrame:
    """Nodes of the tasks, and those of the buckets above with the sums of all below."""
    digit = F.get("ids", F.col("depth"))
    dealt = small.repartition("bucket", "depth", digit).sortWithinPartitions("bucket", "depth", digit)
    done = checkpointed(dealt.mapInArrow(_finishing(most), NODE))
    below = done.where("depth is null").select(F.col("conv_id").alias("bucket"), F.col("parent_conv_id").cast("int").alias("depth"), "n_children", "n_leaves", "saved_tokens")
    below = below.groupBy("bucket", "depth").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    # What a bucket adds itself: its own nodes' savings, and a leaf where nothing is below.
    own = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n") - 1)
    parents = buckets.where("parent is not null").groupBy(F.col("parent").alias("bucket"), F.col("begins").alias("depth")).agg(F.count("*").alias("large"))
    at = buckets.join(below, ["bucket", "depth"], "left").join(parents, ["bucket", "depth"], "left").join(ended, ["bucket", "depth"], "left").na.fill(0, ["n_children", "n_leaves", "saved_tokens", "large"])
    at = checkpointed(at.withColumn("n_children", F.col("n_children") + F.col("large")).withColumn("own", own))
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves"))
    up = at.select(F.explode("above").alias("a"), leaves.alias("leaves"), F.col("saved_tokens").alias("saved"), "own", "bucket", "depth")
    # A bucket's own savings count for those above it; its own chain of nodes takes its part below.
    beside = F.when((F.col("a.bucket") == F.col("bucket")) & (F.col("a.depth") == F.col("depth")), F.lit(0)).otherwise(F.col("own"))
    sums = up.groupBy(F.col("a.bucket").alias("bucket"), F.col("a.depth").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum(F.col("saved") + beside).alias("saved"))
    top = at.join(sums, ["bucket", "depth"])
    # A bucket stands for the nodes from the depth after the bucket above it to its own; the root for itself.
    chain = top.withColumn("d", F.explode(F.when(F.col("parent").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.col("begins") + 1, F.col("depth")))))
    last = F.col("d") == F.col("depth")
    from_here = F.aggregate(F.slice("sizes", F.greatest(F.col("d") - F.col("begins"), F.lit(1)), F.size("sizes") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = chain.select(
        F.col("bucket").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("begins") + 1, F.col("parent")).when(F.col("d") > 0, F.col("bucket")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + from_here * (F.col("n") - 1)).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("sha")), F.lit(NOTHING)).alias("ends_sha256"),
    )
    return nodes.unionByName(done.where("depth is not null"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations of turns (conv_id, turn, role, text)."""
    return trie(encoded(turns))
