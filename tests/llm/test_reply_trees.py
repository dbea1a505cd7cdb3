"""op12 against plain Python: paths, ranks, the template read back."""

from __future__ import annotations

import pytest

from loomframe.llm import reply_trees

SCHEMA = "conv_id long, message_id long, parent_id long, role string, text string, score double, tree string"
ODD = ["", "\\", "\\b", "###", "####x", "#####", "</turn>", "</turn>\n", "<</turn", "</turn", "a: b\n### user: c</turn>\n", "\\l/turn>", "\\\\h##", "é😀" * 3, "ends with \\", "x" * 50_000, None]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def said(df):
    return [[(t.role, t.text) for t in r.said] for r in reply_trees.read_back(df).collect()]


def brute(rows):
    """Every root-to-leaf path: conv_id, its messages, its score, its rank among those of its root."""
    rows = sorted(rows, key=lambda r: str(r[0]))
    first = {}
    for k, r in enumerate(rows):
        if r[1] is not None:
            first.setdefault((r[0], r[1]), k)
    up = {k: first.get((r[0], r[2])) if r[2] is not None else None for k, r in enumerate(rows)}
    out: dict[int, list] = {}
    for k in set(up) - set(up.values()):
        path, seen = [k], {k}
        while up[path[-1]] is not None and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if up[path[-1]] is None:
            out.setdefault(path[-1], []).append((sum(rows[i][5] or 0 for i in path), [(rows[i][3] or "", rows[i][4] or "") for i in reversed(path)], rows[k][0]))
    return sorted((str(conv), path, score, 1 + sum(s > score for s, *_ in of)) for of in out.values() for score, path, conv in of)


TREES = [
    (1, 10, None, "user", "root", 0.0),
    (1, 11, 10, "assistant", "a", 0.5),
    (1, 12, 10, "assistant", "b", 0.75),
    (1, 13, 11, "user", "c", 1.0),
    (1, 14, 12, "user", "d", None),
    (1, 15, 13, "assistant", None, 0.25),
    (2, 10, None, "system", "other tree, same ids", 1.0),
    (2, 11, 10, None, "x", 2.0),
    (2, None, 11, "user", "nameless", 3.0),
    (2, None, 10, "user", "nameless too", 4.0),
    (3, 1, 99, "user", "orphan", 1.0),
    (3, 2, 3, "user", "cycle", 1.0),
    (3, 3, 2, "user", "cycle", 1.0),
    (3, 4, 3, "user", "below a cycle", 1.0),
    (4, 7, None, "user", "second root", 1.0),
    (4, 8, None, "user", "third root", 1.0),
    (None, 1, None, "user", "null conversation", 1.0),
    (None, 2, 1, "assistant", "", 1.0),
    *[(5, k, k - 1 if k else None, "user", f"deep {k}", 0.0) for k in range(70)],
]


@pytest.mark.parametrize("rows_of_a_tree", [100_000, 3])
def test_paths_and_ranks(spark, rows_of_a_tree, monkeypatch):
    monkeypatch.setattr(reply_trees, "TREE_ROWS", rows_of_a_tree)
    out = reply_trees.read_back(reply_trees.reply_trees(frame(spark, TREES))).collect()
    got = sorted((str(r.conv_id), [(t.role, t.text) for t in r.said], r.score, r.branch) for r in out)
    assert got == brute(TREES)


def test_best_branches_and_repeated_ids(spark):
    out = reply_trees.read_back(reply_trees.reply_trees(frame(spark, TREES[:6]), branches=1)).collect()
    assert [[t.text for t in r.said] for r in out] == [["root", "a", "c", ""]]
    twice = [(1, 1, None, "user", "p", 0.0), (1, 1, None, "user", "p", 0.0), (1, 2, 1, "assistant", "q", 0.0)]
    out = reply_trees.read_back(reply_trees.reply_trees(frame(spark, twice))).collect()
    assert sorted([t.text for t in r.said] for r in out) == [["p"], ["p", "q"]]


def test_marks_inside_texts_come_back(spark):
    roles = ["user", "assistant", "a: b", "### user", "</turn>\n", None, ""]
    rows = [(k, 1, None, role, text, 0.0) for k, (role, text) in enumerate((r, t) for r in roles for t in ODD)]
    rows += [(1000, k, k - 1 if k else None, roles[k % 7], t, 0.0) for k, t in enumerate(ODD)]
    out = reply_trees.read_back(reply_trees.reply_trees(frame(spark, rows))).collect()
    got = {r.conv_id: r for r in out}
    for conv in {r[0] for r in rows}:
        own = [(r[3] or "", r[4] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].said] == own
        assert got[conv].loss == "".join(t for role, t in own if role == "assistant")
        spans = [got[conv].formatted[t.text_start : t.text_end] for t in got[conv].turns if t.loss]
        assert len(spans) == sum(role == "assistant" for role, _ in own)
        assert got[conv].formatted.count("</turn>\n") == len(own)


def test_threads_keep_repeated_turns_and_nulls(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (1, 2, "assistant", "b"), (None, 5, None, "c"), (1, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.said] for r in reply_trees.read_back(reply_trees.threads(turns)).collect()}
    assert got == {1: [("system", ""), ("assistant", "z"), ("user", "a"), ("user", "a"), ("assistant", "b")], None: [("", "c")]}


def test_without_messages(spark):
    assert reply_trees.reply_trees(frame(spark, [])).collect() == []
    assert reply_trees.threads(frame(spark, []).selectExpr("conv_id", "message_id as turn", "role", "text")).collect() == []
