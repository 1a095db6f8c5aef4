"""Markdown as document trees of an editor, and back, in Arrow batches.

A tree is {"type": "doc", "content": [blocks]}. Blocks are heading, paragraph,
bulletList, orderedList, taskList with their items, blockquote, codeBlock,
horizontalRule; inside are text with marks (bold, italic, strike, code, link),
hardBreak and image. What is written from a tree that was read reads as the same
tree, where marks begin and end at the borders of words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*(\S*)\s*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])( +|$)(.*)$")
_TASK = re.compile(r"^\[([ xX])\](?: +|$)")
_QUOTE = re.compile(r"^ {0,3}> ?(.*)$")
_INLINE = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^\s)]*)\)|\[(?P<label>(?:[^\[\]\\]|\\.)*)\]\((?P<href>[^\s)]*)\)"
    r"|(?P<strong>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=strong)|(?P<em>\*|(?<!\w)_)(?=\S)(?P<italic>(?:\\.|[^\\])+?)(?<=\S)(?P=em)(?![*]|(?<=_)\w)|~~(?=\S)(?P<strike>.+?)(?<=\S)~~|(?P<break> {2,}\n|\\\n)|(?P<soft>\n)",
    re.DOTALL,
)
_MARKS = {"bold": "**", "italic": "*", "strike": "~~"}
_SIGNS = re.compile(r"([\\`*_\[\]~!<])")


def _text(text: str, marks: list[dict]) -> list[dict]:
    return [{"type": "text", "text": text} | ({"marks": marks} if marks else {})] if text else []


def inline(text: str, marks: list[dict] | None = None) -> list[dict]:
    """Texts with marks, images and breaks of one block's source."""
    marks, out, held, at = marks or [], [], "", 0
    for m in _INLINE.finditer(text):
        held += text[at : m.start()]
        at = m.end()
        if m["escaped"]:
            held += m["escaped"]
            continue
        if m["soft"]:
            held += " "
            continue
        out += _text(held, marks)
        held = ""
        if m["code"] is not None:
            code = m["code"]
            out += _text(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code, [*marks, {"type": "code"}])
        elif m["src"] is not None:
            out.append({"type": "image", "attrs": {"src": m["src"], "alt": m["alt"]}})
        elif m["href"] is not None:
            out += inline(m["label"], [*marks, {"type": "link", "attrs": {"href": m["href"]}}])
        elif m["break"]:
            out.append({"type": "hardBreak"})
        else:
            kind = next(k for k in _MARKS if m[k] is not None)
            out += inline(m[kind], [*marks, {"type": kind}])
    return out + _text(held + text[at:], marks)


def _begins_block(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _ITEM.match(line))


def blocks(lines: list[str]) -> list[dict]:
    """The blocks of some lines; what a quote or an item holds is read the same way."""
    out: list[dict] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.match(line):
            end = next((k for k in range(i + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[k])), len(lines))
            code = _text("\n".join(lines[i + 1 : end]), [])
            out.append({"type": "codeBlock", "attrs": {"language": m[2] or None}} | ({"content": code} if code else {}))
            i = end + 1
        elif m := _HEADING.match(line):
            out.append({"type": "heading", "attrs": {"level": len(m[1])}, "content": inline(m[2] or "")})
            i += 1
        elif _RULE.match(line):
            out.append({"type": "horizontalRule"})
            i += 1
        elif _QUOTE.match(line):
            end = next((k for k in range(i, len(lines)) if not _QUOTE.match(lines[k])), len(lines))
            out.append({"type": "blockquote", "content": blocks([_QUOTE.match(x)[1] for x in lines[i:end]])})
            i = end
        elif _ITEM.match(line):
            made, i = _list(lines, i)
            out.append(made)
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and not _begins_block(lines[end]):
                end += 1
            body = "\n".join(x.lstrip() for x in lines[i:end]).rstrip(" ")
            out.append({"type": "paragraph", "content": inline(body)})
            i = end
    return out


def _list(lines: list[str], i: int) -> tuple[dict, int]:
    """One list from line i, and the line after it: items of one kind of marker, with all that is indented below them."""
    kind = _ITEM.match(lines[i])[2][-1]
    items, first, tasks = [], _ITEM.match(lines[i])[2], []
    while i < len(lines) and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and not _RULE.match(lines[i]):
        width = len(m[1]) + len(m[2]) + (len(m[3]) if m[4] and len(m[3]) < 5 else 1)
        own, i = [m[4]], i + 1
        while i < len(lines):
            if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip(" ")) < width and (not own[-1].strip() or _begins_block(lines[i])):
                break
            own.append(lines[i][width:] if lines[i][:width].isspace() else lines[i].lstrip() if lines[i].strip() else "")
            i += 1
        task = _TASK.match(own[0])
        tasks.append(task)
        items.append([own[0][task.end() :] if task else own[0], *own[1:]])
    if kind not in ".)" and all(tasks):
        return {"type": "taskList", "content": [{"type": "taskItem", "attrs": {"checked": t[1] != " "}, "content": blocks(x)} for t, x in zip(tasks, items, strict=True)]}, i
    whole = [x if not t else [f"{t[0]}{x[0]}", *x[1:]] for t, x in zip(tasks, items, strict=True)]
    content = [{"type": "listItem", "content": blocks(x)} for x in whole]
    return ({"type": "orderedList", "attrs": {"start": int(first[:-1])}, "content": content} if kind in ".)" else {"type": "bulletList", "content": content}), i


def parsed(markdown: str) -> dict:
    return {"type": "doc", "content": blocks(markdown.replace("\r\n", "\n").replace("\t", "    ").split("\n"))}


def _written_inline(nodes: list[dict]) -> str:
    """Source of texts; marks that neighbours share are opened and closed once."""
    out, opened = [], []

    def close(to: int) -> None:
        while len(opened) > to:
            mark = opened.pop()
            out.append(f"]({mark['attrs'].get('href', '')})" if mark["type"] == "link" else sign(mark["type"]))

    def sign(kind: str) -> str:
        """Italics inside bold are written by the other sign, as three stars in a row would be read otherwise."""
        return "_" if kind == "italic" and any(m["type"] == "bold" for m in opened) else _MARKS[kind]

    for n in nodes:
        marks = [m for m in n.get("marks", []) if m["type"] in _MARKS or m["type"] == "link"]
        shared = 0
        while shared < min(len(marks), len(opened)) and marks[shared] == opened[shared]:
            shared += 1
        close(shared)
        for m in marks[shared:]:
            out.append("[" if m["type"] == "link" else sign(m["type"]))
            opened.append(m)
        if n["type"] == "hardBreak":
            out.append("\\\n")
        elif n["type"] == "image":
            out.append(f"![{n['attrs'].get('alt') or ''}]({n['attrs'].get('src', '')})")
        elif any(m["type"] == "code" for m in n.get("marks", [])):
            ticks = "`" * (max((len(x) for x in re.findall("`+", n["text"])), default=0) + 1)
            pad = " " if n["text"].startswith("`") or n["text"].endswith("`") or n["text"] != n["text"].strip() else ""
            out.append(f"{ticks}{pad}{n['text']}{pad}{ticks}")
        else:
            out.append(_SIGNS.sub(r"\\\1", n.get("text", "")))
    close(0)
    return "".join(out)


def _block_start(text: str) -> str:
    """A paragraph's line with its first sign escaped where it would begin another block."""
    return re.sub(r"^(\s*)(?:([-+#>])|(\d{1,9})([.)]))(?=\s|$|[-#>])", lambda m: f"{m[1]}\\{m[2]}" if m[2] else f"{m[1]}{m[3]}\\{m[4]}", text)


def _written(node: dict) -> list[str]:
    kind, inside = node.get("type"), node.get("content", [])
    attrs = node.get("attrs") or {}
    if kind == "heading":
        return [("#" * attrs.get("level", 1) + " " + _written_inline(inside)).rstrip()]
    if kind == "paragraph":
        return [_block_start(x) for x in _written_inline(inside).split("\n")]
    if kind == "codeBlock":
        code = "".join(n.get("text", "") for n in inside)
        fence = "`" * max(3, max((len(x) for x in re.findall("`+", code)), default=0) + 1)
        return [fence + (attrs.get("language") or ""), *(code.split("\n") if code else []), fence]
    if kind == "horizontalRule":
        return ["---"]
    if kind == "blockquote":
        return [f"> {x}".rstrip() for x in _joined(inside)]
    if kind in ("bulletList", "orderedList", "taskList"):
        out = []
        for i, item in enumerate(inside):
            mark = f"{attrs.get('start', 1) + i}." if kind == "orderedList" else "-"
            box = ("[x] " if (item.get("attrs") or {}).get("checked") else "[ ] ") if kind == "taskList" else ""
            lines = _joined(item.get("content", [])) or [""]
            out += [f"{mark} {box}{lines[0]}".rstrip(), *(" " * (len(mark) + 1) + x if x else "" for x in lines[1:])]
        return out
    return _joined(inside)


def _joined(nodes: list[dict]) -> list[str]:
    """Lines of blocks, an empty line between them."""
    out: list[str] = []
    before = None
    for n in nodes:
        if before:
            out.append("")
            if before == n.get("type") and before in ("bulletList", "orderedList", "taskList"):
                out += ["<!-- -->", ""]
        out += _written(n)
        before = n.get("type")
    return out


def written(tree: dict) -> str:
    return "\n".join(_joined(tree.get("content", [])))


@F.pandas_udf(StringType())
def tree_of(markdown: pd.Series) -> pd.Series:
    """The JSON of a Markdown text's tree; null stays null."""
    return markdown.map(lambda t: json.dumps(parsed(t), ensure_ascii=False), na_action="ignore")


@F.pandas_udf(StringType())
def markdown_of(tree: pd.Series) -> pd.Series:
    """The Markdown of a tree's JSON; null for what is no document tree."""

    def one(text: str) -> str | None:
        try:
            doc = json.loads(text)
        except ValueError:
            return None
        return written(doc) if isinstance(doc, dict) and doc.get("type") == "doc" else None

    return tree.map(one, na_action="ignore")


def nodes(tree: dict) -> Iterator[dict]:
    """All nodes of a tree, parents first."""
    stack = [tree]
    while stack:
        n = stack.pop()
        yield n
        stack += reversed(n.get("content", []))
