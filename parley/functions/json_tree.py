"""JSON texts as tables: a row for each value, at every depth or at the first one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

VALUE = "key string, full_key string, path string, type string, atom string, depth int, value string"
_COLUMNS = [(c.split()[0], pa.int32() if c.endswith("int") else pa.string()) for c in VALUE.split(", ")]
#: Values that a batch of output holds, about.
HELD = 20_000


class _Number(NamedTuple):
    """A number as it is written."""

    text: str
    kind: str


def _no_number(text: str) -> None:
    raise ValueError(text)


class _Object(list):
    """The fields of an object in order, each as often as it is written."""


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, parse_int=lambda s: _Number(s, "integer"), parse_float=lambda s: _Number(s, "real"), parse_constant=_no_number)


def _kind(node) -> tuple[str, str | None]:
    """(type, atom): null, true, false, integer, real and text have an atom, array and object none; that of null is null."""
    if isinstance(node, _Object):
        return "object", None
    if isinstance(node, _Number):
        return node.kind, node.text
    if isinstance(node, list):
        return "array", None
    if isinstance(node, str):
        return "text", node
    return ("null", None) if node is None else (("true", "true") if node else ("false", "false"))


def written(node) -> str:
    """A decoded value as compact JSON, numbers as they were written."""
    if isinstance(node, _Object):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v)}" for k, v in node) + "}"
    if isinstance(node, _Number):
        return node.text
    return "[" + ",".join(map(written, node)) + "]" if isinstance(node, list) else json.dumps(node, ensure_ascii=False)


def values(text: str, deep: bool = True) -> Iterator[tuple]:
    """VALUE rows of a text, a parent before its children in order; nothing for a text that is no JSON. Only the first level has each value as JSON."""
    try:
        root = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return
    stack = [(None, "$", None, root, 0)]
    while stack:
        key, full, path, node, depth = stack.pop()
        yield (key, full, path, *_kind(node), depth, None if deep else written(node))
        if not deep and depth:
            continue
        if isinstance(node, _Object):
            inside = [(k, f"{full}.{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else f'{full}."{k}"', v) for k, v in node]
        elif isinstance(node, list) and not isinstance(node, _Number):
            inside = [(str(i), f"{full}[{i}]", v) for i, v in enumerate(node)]
        else:
            continue
        stack += [(k, f, full, v, depth + 1) for k, f, v in reversed(inside)]


def _table(df: DataFrame, column: str, deep: bool, root: bool) -> DataFrame:
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in rest]
            new = [pa.array(v, k) for v, (_, k) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *new], [*rest, *(n for n, _ in _COLUMNS)])

        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(column).to_pylist()):
                for row in values(text, deep) if text is not None else ():
                    if root or row[5]:
                        at.append(i)
                        rows.append(row)
                    if len(rows) >= HELD:
                        yield out(batch, at, rows)
                        at, rows = [], []
            if rows:
                yield out(batch, at, rows)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    return df.select(*[f"`{c}`" for c in rest], f"`{column}`").mapInArrow(run, f"{kinds}, {VALUE}" if kinds else VALUE)


def json_tree(df: DataFrame, column: str) -> DataFrame:
    """The other columns and VALUE but for value, a row for each value of a column's JSON at every depth, the root first."""
    return _table(df, column, True, True).drop("value")


def json_each(df: DataFrame, column: str) -> DataFrame:
    """The other columns and VALUE, a row for each field or element of a column's JSON."""
    return _table(df, column, False, False)
