"""Chat formatting by schema fingerprints, in DataFrame operations only.

A record is one JSON object. The paths of all its nested fields, hashed, are its
schema fingerprint; the fingerprint selects one of LAYOUTS, a declarative
mapping that says where the turns are and what their roles and texts are called.
Prompt and completion pairs, instructions with and without input, message lists
under several names and single turns all become canonical turns (conv_id, turn,
part, role, text). Records whose fingerprint no mapping has are returned by
`unmapped`, never dropped silently. A row of a typed table is a record, too: its
fingerprint is that of the JSON object with its fields, in which values are
empty, as paths do not depend on them and a text may be longer than a parsed
value can be; the texts themselves are taken from the typed columns.

Turns are formatted by a template that marks them with control strings. In
roles and texts every control string, of this template or of others in common
use, gets a backslash after its first character and every backslash is doubled,
which `unescaped` undoes exactly. The output has a row for each turn: its piece
of the conversation's text, and the span of that piece that the loss counts,
which is the text of assistant turns without any marks. Pieces of a
conversation are in order of turn, then part, role and text; `assembled` joins
them where whole texts are wanted.

Defined results: a null text is empty, a null role is the empty role; rows that
repeat a turn stay turns of their own, ties in turn and part being in order of
role and text; a null conv_id is a conversation of its own; an empty table gives
an empty table; a very long text is one turn, whole; other columns, also such as
another mapping knows, are not read. Other names of roles are translated in
records alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Control strings that may not occur in a formatted text except as marks.
CONTROL = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<s>", "</s>", "<bos>", "<eos>", "<pad>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
)
START, SEP, END = CONTROL[:3]
#: Roles whose texts the loss counts.
LEARNED = ("assistant",)


@dataclass(frozen=True)
class Layout:
    """One mapping. `items` is the path of the list of turns ('' for none); turns are (role, text): a fixed role as '=role' or the name of the field that has it."""

    name: str
    fields: tuple[str, ...]
    optional: tuple[str, ...]
    items: str
    turns: tuple[tuple[str, str], ...]

    def path_sets(self) -> list[tuple[str, ...]]:
        return [(*self.fields, *more) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


def _messages(name: str, items: str, role: str, text: str) -> Layout:
    return Layout(name, (items, f"{items}[].{role}", f"{items}[].{text}"), ("conv_id", "id"), items, ((role, text),))


LAYOUTS = (
    Layout("turn", ("conv_id", "turn", "role", "text"), (), "", (("role", "text"),)),
    _messages("messages", "messages", "role", "content"),
    _messages("dialogue", "conversations", "from", "value"),
    _messages("turns", "turns", "speaker", "text"),
    Layout("prompt_completion", ("prompt", "completion"), ("conv_id", "id", "system"), "", (("=system", "system"), ("=user", "prompt"), ("=assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("conv_id", "id", "system"), "", (("=system", "system"), ("=user", "prompt"), ("=assistant", "response"))),
    Layout("instruction", ("instruction", "output"), ("conv_id", "id", "input", "system"), "", (("=system", "system"), ("=user", "instruction"), ("=user", "input"), ("=assistant", "output"))),
    Layout("question_answer", ("question", "answer"), ("conv_id", "id"), "", (("=user", "question"), ("=assistant", "answer"))),
)
#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Types that the description of a value may name; they say nothing about the layout.
_TYPES = r": (VOID|STRING|BIGINT|DOUBLE|BOOLEAN|FLOAT|BINARY|DATE|DECIMAL\(\d+,\d+\)|VARIANT)"


def described(paths: Sequence[str]) -> str:
    """Nested field paths, such as 'messages' and 'messages[].role', as one text: names in code-point order, lists in brackets."""

    def level(under: dict) -> str:
        return "{" + ", ".join(name + (": [" + level(below) + "]" if below else "") for name, below in sorted(under.items())) + "}"

    tree: dict = {}
    for path in paths:
        at = tree
        for name in path.replace("[]", "").split("."):
            at = at.setdefault(name, {})
    return level(tree)


def description(record: Column) -> Column:
    """The same text for a JSON record, from the schema of the parsed value; null if it cannot be parsed."""
    text = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), _TYPES, "")
    for old, new in (("ARRAY<OBJECT<", "[{"), (">>", "}]"), ("OBJECT<", "{"), (">", "}"), ("`", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def fingerprint(record: Column) -> Column:
    """The hash of a record's nested field paths."""
    return F.xxhash64(description(record))


def _mappings(spark: SparkSession, layouts: Sequence[Layout]) -> DataFrame:
    """(layout, fingerprint): the mappings are a short fixed list."""
    known = [(layout.name, described(paths)) for layout in layouts for paths in layout.path_sets()]
    return spark.createDataFrame(known, "layout string, paths string").select("layout", F.xxhash64("paths").alias("fingerprint"))


def _chosen(records: DataFrame, layouts: Sequence[Layout]) -> DataFrame:
    """records with the name of their layout, null where no mapping has the fingerprint."""
    told = records.select("record", fingerprint(F.col("record")).alias("fingerprint"))
    return told.join(F.broadcast(_mappings(records.sparkSession, layouts)), "fingerprint", "left")


def unmapped(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(fingerprint, paths, n): the layouts among records (record string) that no mapping has."""
    rest = _chosen(records, layouts).where("layout is null").select("fingerprint", description(F.col("record")).alias("paths"))
    return rest.groupBy("fingerprint", "paths").agg(F.count("*").alias("n"))


def _turns(layout: Layout, at: str = "") -> Column:
    """The turns of a row as array<struct<role, text>>; `at` is the prefix of its fields."""
    kind = "array<struct<role: string, text: string>>"
    if layout.items:
        role, text = layout.turns[0]
        return F.transform(F.col(at + layout.items), lambda x: F.struct(x[role].alias("role"), x[text].alias("text"))).cast(kind)
    made = []
    for role, text in layout.turns:
        turn = F.struct((F.lit(role[1:]) if role.startswith("=") else F.col(at + role)).alias("role"), F.col(at + text).alias("text"))
        made.append(F.when(F.col(at + text).isNotNull(), turn) if text in layout.optional else turn)
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(kind)


def _unfolded(rows: DataFrame) -> DataFrame:
    """Canonical turns of rows (conv_id, turn, list of turns x)."""
    out = rows.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.coalesce(F.col("turn").try_cast("long"), F.lit(0).cast("long")).alias("turn"), F.posexplode("x").alias("part", "x"))
    return out.select("conv_id", "turn", "part", F.coalesce("x.role", F.lit("")).alias("role"), F.coalesce("x.text", F.lit("")).alias("text"))


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id long, turn long, part int, role, text) of records (record string), in one pass over them."""
    lists = sorted({layout.items for layout in layouts} - {""})
    fields = sorted({f for layout in layouts for f in (*layout.fields, *layout.optional) if "[" not in f} - set(lists) | {"conv_id", "id", "turn"})
    inner = sorted({x for layout in layouts if layout.items for turn in layout.turns for x in turn})
    shape = ", ".join([*(f"`{f}` string" for f in fields), *(f"`{f}` array<struct<{', '.join(f'`{x}`: string' for x in inner)}>>" for f in lists)])
    parsed = _chosen(records, layouts).where("layout is not null").select("layout", F.from_json("record", shape).alias("r"))
    which = F.coalesce(*[F.when(F.col("layout") == layout.name, _turns(layout, "r.")) for layout in layouts])
    turns = _unfolded(parsed.select(F.coalesce("r.conv_id", "r.id").alias("conv_id"), F.col("r.turn").alias("turn"), which.alias("x")))
    names = F.create_map(*[F.lit(v) for kv in ROLE_NAMES.items() for v in kv])
    return turns.withColumn("role", F.coalesce(F.try_element_at(names, F.col("role")), F.col("role")))


def _paths(schema: StructType, known: set[str]) -> list[str]:
    """The nested field paths of a table, of the top fields that some mapping knows."""
    out = []
    for f in schema.fields:
        if f.name in known:
            out.append(f.name)
            if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
                out += [f"{f.name}[].{g.name}" for g in f.dataType.elementType.fields]
    return out


def _outline(schema: StructType) -> Column:
    """The row as a JSON object with its fields, whose values are empty or null: a list of objects is one object with all their fields, as the type says."""

    def field(f: StructField) -> Column:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            return F.array(F.struct(*[F.lit("").alias(g.name) for g in f.dataType.elementType.fields])).alias(f.name)
        return F.when(F.col(f.name).isNotNull(), F.lit("")).alias(f.name)

    return F.to_json(F.struct(*[field(f) for f in schema.fields]), {"ignoreNullFields": "false"})


def canonical_table(table: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The same of a typed table: each row's fingerprint selects its mapping, roles stay as they are.

    The columns of the mapping with the most fields among them make the record;
    further columns are not read. ValueError if none fits.
    """
    known = {f.split("[")[0] for layout in layouts for f in (*layout.fields, *layout.optional)}
    here = set(_paths(table.schema, known))
    fits = [(len(paths), -i, paths) for i, layout in enumerate(layouts) for paths in layout.path_sets() if here.issuperset(paths)]
    if not fits:
        raise ValueError(f"no mapping has the layout {described(sorted(here))}")
    read = max(fits)[2]
    inner = {f.split("[")[0]: [g.split("].")[1] for g in read if g.startswith(f"{f}[].")] for f in read if "[" not in f}
    of_list = lambda c, own: F.transform(F.col(c), lambda x: F.struct(*[x[g].alias(g) for g in own]))
    rows = table.select(*[of_list(c, own).alias(c) if own else F.col(c) for c, own in inner.items()])
    told = rows.withColumn("fingerprint", fingerprint(_outline(rows.schema))).join(F.broadcast(_mappings(table.sparkSession, layouts)), "fingerprint", "left")
    able = [layout for layout in layouts if set(read) in map(set, layout.path_sets())]
    turns = [F.when(F.col("layout") == x.name, _turns(replace(x, turns=tuple(t for t in x.turns if t[1] not in x.optional or t[1] in read)))) for x in able]
    conv = [F.col(c) for c in ("conv_id", "id") if c in read]
    return _unfolded(told.select((F.coalesce(*conv) if conv else F.lit(None)).cast("string").alias("conv_id"), (F.col("turn") if "turn" in read else F.lit(None)).cast("string").alias("turn"), F.coalesce(*turns).alias("x")))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def escaped(text: Column) -> Column:
    """text with every backslash doubled and every control string broken by a backslash after its first character."""
    marks = "|".join(_quoted(c) for c in sorted(CONTROL, key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"(?=(?:{marks}))(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, piece, loss_start, loss_chars): a piece of the conversation's text for each canonical turn.

    The loss counts loss_chars code points of the piece from loss_start (from 0); none where loss_chars is 0.
    """
    head, body = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP)), escaped(F.col("text"))
    learned = F.col("role").isin(*LEARNED)
    made = turns.select("conv_id", "turn", "part", head.alias("head"), body.alias("body"), learned.alias("learned"))
    return made.select(
        "conv_id", "turn", "part", F.concat("head", "body", F.lit(END), F.lit("\n")).alias("piece"),
        F.when(F.col("learned"), F.length("head")).otherwise(0).alias("loss_start"), F.when(F.col("learned"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def assembled(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans array<struct<start, chars>>): whole conversations with the spans that the loss counts."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "part", "piece", "loss_start", "loss_chars")))
    grouped = pieces.groupBy("conv_id").agg(ordered.alias("p"))
    ends = F.aggregate("p", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["piece"]))))
    spans = F.filter(F.zip_with("p", F.slice(ends, 1, F.size("p")), lambda x, at: F.struct((at + x["loss_start"]).alias("start"), x["loss_chars"].alias("chars"))), lambda s: s["chars"] > 0)
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("spans"))


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text, loss_text, piece_chars) from formatted pieces alone; loss_text is what the mask covers, unescaped."""
    inner = F.substring("piece", F.lit(len(START) + 1), F.length("piece") - len(START) - len(END) - 1)
    role = F.substring_index(inner, SEP, 1)
    text = F.substring(inner, F.length(role) + len(SEP) + 1, F.length(inner))
    masked = F.substring("piece", F.col("loss_start") + 1, F.col("loss_chars"))
    return pieces.select("conv_id", "turn", "part", unescaped(role).alias("role"), unescaped(text).alias("text"), unescaped(masked).alias("loss_text"), F.length("piece").alias("piece_chars"))
