"""op13 against a walk of every document through every order."""

from __future__ import annotations

import re
from itertools import permutations

from loomframe.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text: str) -> set[str]:
    words = WORD.findall(text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def walked(docs, labels):
    """Every order walked document by document."""
    rows = []
    for i, text, lang, _ in docs:
        text = text or ""
        f = fails(text)
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs):
            f.add("E")
        rows.append((lang or "", f, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order, 1):
                hit = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                out[part, "".join(order), k] = [len(left), len(hit), sum(c in r[1] for r in own) - len(hit), sum(r[1] == {c} for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit)]
                shapley[part, c] = shapley.get((part, c), 0) + len(hit)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def got(spark, docs, labels):
    out = filter_audit.audit(filter_audit.cells(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)), "ABCDE")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}


def long(k: int, n: int = 120) -> str:
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_every_order_of_every_part(spark):
    texts = [long(1), long(1), long(2) + " # tail", "same same", "SHOUT " * 200, None, "", " \t  ", long(3, 99), long(4, 100), "é" * 9 + "A", "é" * 8 + "AB", long(5, 20_000), "a|b " + long(6)]
    docs = [(i, t, ("en", "de", None, "")[i % 4], "clash") for i, t in enumerate(texts * 2)]
    docs += [(3, "same same", "en", None), (3, "same same", "en", None), (None, long(1), "en", None), (None, long(1), "fr", None), (-5, long(4, 100), None, None)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 28, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (999, 1, 1), (7, None, None)]
    assert got(spark, docs, labels) == walked(docs, labels)


def test_a_large_group_of_copies_over_all_parts(spark):
    docs = [(i, long(1), f"l{i % 3}", None) for i in range(60)] + [(i, long(i), "l0", None) for i in range(60, 70)]
    assert got(spark, docs, []) == walked(docs, [])


def test_without_documents(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
