"""JSON as tables, and Markdown as document trees and back."""

from __future__ import annotations

from parley.functions import document_tree as D
from parley.functions.json_tree import json_each, json_tree


def test_json_tree(spark):
    texts = ['{"a":[1,{"b c":null,"d":1.50}],"a":"twice","t":true}', "[]", '"x"', "bad", "", None, "NaN", "[" * 40 + "]" * 40, "[1,", '{"é":12345678901234567890123}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = [tuple(r) for r in json_tree(df, "body").select("id", "full_key", "path", "key", "type", "atom", "depth").collect()]
    assert [g[1:] for g in got if g[0] == 0] == [
        ("$", None, None, "object", None, 0), ("$.a", "$", "a", "array", None, 1), ("$.a[0]", "$.a", "0", "integer", "1", 2), ("$.a[1]", "$.a", "1", "object", None, 2),
        ('$.a[1]."b c"', "$.a[1]", "b c", "null", None, 3), ("$.a[1].d", "$.a[1]", "d", "real", "1.50", 3), ("$.a", "$", "a", "text", "twice", 1), ("$.t", "$", "t", "true", "true", 1),
    ]
    assert {g[0] for g in got} == {0, 1, 2, 7, 9} and max(g[6] for g in got if g[0] == 7) == 39
    assert [g[1:] for g in got if g[0] == 9][1] == ('$."é"', "$", "é", "integer", "12345678901234567890123", 1)


def test_json_each(spark):
    df = spark.createDataFrame([(1, '[{"a":1.0},"x",null,[2,3]]'), (2, '{"k":{"n":[]}}'), (3, "7"), (4, "{}")], "id long, body string")
    got = [(r["id"], r["key"], r["value"], r["type"]) for r in json_each(df, "body").collect()]
    assert got == [(1, "0", '{"a":1.0}', "object"), (1, "1", '"x"', "text"), (1, "2", "null", "null"), (1, "3", "[2,3]", "array"), (2, "k", '{"n":[]}', "object")]
    assert json_tree(df.where("false"), "body").count() == 0


NOTES = [
    "# Title\n\nSome *it* and **bold _both_** text, `code` and ~~gone~~.\n\n- one\n- two\n  - inner\n\n    more\n- [x] not a task list\n\n1. a\n2. b\n\n> quoted\n> > deep\n\n```py\nx = `1`\n```\n\n---\n\n- [ ] open\n- [x] done",
    "a\\\nb  \nc\nd [link *here*](http://x.y) ![alt](i.png) \\*no\\* 2 * 3 * 4 snake_case_word", "", "####### seven\n#nospace", "5) five\n6) six\n\ntext\n- tight\n```\nopen", "> a\n\n> b", "1\\. no list\n\\- no list\n\\# no", "``a`b`` and ` `` `",
]


def test_markdown_to_trees():
    t = D.parsed(NOTES[0])
    kinds = [n["type"] for n in t["content"]]
    assert kinds == ["heading", "paragraph", "bulletList", "orderedList", "blockquote", "codeBlock", "horizontalRule", "taskList"]
    assert t["content"][0] == {"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": "Title"}]}
    assert [(x["text"], [m["type"] for m in x.get("marks", [])]) for x in t["content"][1]["content"]] == [
        ("Some ", []), ("it", ["italic"]), (" and ", []), ("bold ", ["bold"]), ("both", ["bold", "italic"]), (" text, ", []), ("code", ["code"]), (" and ", []), ("gone", ["strike"]), (".", []),
    ]
    assert [x["type"] for x in t["content"][2]["content"][1]["content"]] == ["paragraph", "bulletList"]
    assert [x["type"] for x in t["content"][2]["content"][1]["content"][1]["content"][0]["content"]] == ["paragraph", "paragraph"]
    assert [x["attrs"]["checked"] for x in t["content"][7]["content"]] == [False, True]
    assert t["content"][5]["attrs"] == {"language": "py"} and t["content"][4]["content"][1]["type"] == "blockquote"
    line = D.parsed(NOTES[1])["content"][0]["content"]
    assert [n["type"] for n in line].count("hardBreak") == 2 and line[-1]["text"].endswith("*no* 2 * 3 * 4 snake_case_word")
    assert [n["type"] for n in D.parsed(NOTES[3])["content"]] == ["paragraph"] and D.parsed(NOTES[4])["content"][0]["attrs"] == {"start": 5}


def test_markdown_comes_back():
    """What is written from a tree reads as the same tree."""
    for note in NOTES:
        t = D.parsed(note)
        assert D.parsed(D.written(t)) == t, note
    assert D.written(D.parsed("# A\n\n- x\n- y\n\n1. p\n2. q\n\n> z")) == "# A\n\n- x\n- y\n\n1. p\n2. q\n\n> z"


def test_trees_of_columns(spark):
    df = spark.createDataFrame([(n,) for n in [*NOTES, None]], "t string").withColumn("tree", D.tree_of("t")).withColumn("back", D.markdown_of("tree"))
    got = df.collect()
    assert [r["back"] for r in got] == [None if n is None else D.written(D.parsed(n)) for n in [*NOTES, None]]
    bad = spark.createDataFrame([("[]",), ("x",), ('{"type":"x"}',)], "t string")
    assert {r[0] for r in bad.select(D.markdown_of("t")).collect()} == {None}
