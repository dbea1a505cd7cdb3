"""The pipeline's near duplicates against the exact similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import near_text, simhash
from test_dedup import docs, prose


def grams(text: str | None) -> set:
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def edited() -> list:
    """60 texts, each with two copies of it that differ in a few words: similarities from about 0.5 to 1."""
    r, rows = random.Random(5), [(900, None), (901, " \n"), (902, "two words"), (903, "Two  words")]
    for k in range(60):
        words = prose(k, 200).split()
        rows.append((3 * k, " ".join(words)))
        for j in (1, 2):
            copy = list(words)
            for at in r.sample(range(200), r.randint(1, 9)):
                copy[at] = "edited" + str(at)
            rows.append((3 * k + j, " ".join(copy)))
    return rows


def brute(rows: list) -> dict:
    sets, low = {i: grams(t) for i, t in rows}, {}
    for i in sorted(sets):
        if i not in low:
            low[i], todo = i, [i]
            while todo:
                x = sets[todo.pop()]
                hit = [j for j, y in sets.items() if j not in low and 5 * len(x & y) >= 4 * len(x | y)]
                low.update(dict.fromkeys(hit, i))
                todo += hit
    return low


@pytest.mark.parametrize(("cell_rows", "block"), [(near_text.CELL, near_text.BLOCK), (1, near_text.BLOCK), (1, 2)])
def test_classes_are_those_of_all_pairs(spark, cell_rows, block):
    rows = edited()
    want = brute(rows)
    assert 70 < len(set(want.values())) < 170
    got = {r.doc_id: r.component_id for r in near_text.classes(docs(spark, rows), cell_rows, block).collect()}
    assert got == want


def test_the_stage_drops_every_copy_of_four_fifths(spark):
    rows = edited()
    out = corpus_pipeline.near_copies(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(rows).values()))
    assert near_text.deduplicate(docs(spark, [])).collect() == []


def test_a_crowded_cell_gives_fewer_links_than_texts_and_joins_all_that_are_alike():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (4, 300)).astype(np.uint64)
    sets = []
    for k in range(200):  # four families; in each, pairs alike from about 0.6 to 0.95
        own = base[k % 4].copy()
        own[r.choice(300, r.integers(5, 40), replace=False)] = r.integers(0, 1 << 63, 1)[0] + np.arange(1)
        sets.append(np.unique(np.r_[own, r.integers(0, 1 << 63, r.integers(1, 20)).astype(np.uint64)]))
    sets += [sets[0].copy(), np.array([7], np.uint64), np.array([7], np.uint64)]
    got = list(near_text._cell_links(sets, np.arange(len(sets))))
    assert len(got) < len(sets)
    alike = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    assert all(alike(i, j) for i, j in got)

    def classes(pairs):
        low = list(range(len(sets)))
        for i, j in pairs:
            a, b = low[i], low[j]
            low = [min(a, b) if x in (a, b) else x for x in low]
        return low

    assert classes(got) == classes((i, j) for i in range(len(sets)) for j in range(i) if alike(i, j))


def test_a_crowded_cell_in_blocks_loses_no_link(spark):
    r, rows = random.Random(8), []
    words = prose(1, 200).split()
    for k in range(400):  # 300 copies alike from about 0.4 to 1, and others that share a long passage but are not alike
        copy = list(words) if k < 300 else words[:110] + prose(1000 + k, 90).split()
        for at in r.sample(range(200), r.randint(0, 12) if k % 3 else 1):
            copy[at] = f"edited{k if k % 2 else ''}x{at}"
        rows.append((k, " ".join(copy)))
    want = brute(rows)
    assert 20 < len(set(want.values())) < 390
    seen = {}
    deal = near_text._in_crowded_cells

    def noted(members, sets):
        seen[len(seen)] = max((n for (_, n) in members.groupBy("cell").count().collect()), default=0)
        return deal(members, sets)

    near_text._in_crowded_cells = noted
    try:
        got = {x.doc_id: x.component_id for x in near_text.classes(docs(spark, rows), 8, 16).collect()}
    finally:
        near_text._in_crowded_cells = deal
    assert got == want
    assert len(seen) >= 3 and max(seen.values()) < 80  # blocks of about 16, of a group and a block 32, dealt by hash


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    words = [f"w{k}" for k in range(60)]
    copies = [" ".join(words), " ".join([*words, "one"]), " ".join([*words, "two"]), " ".join(words)]
    for ids in ([1, 1, None, None], [None] * 4, [2, 2, 2, 2], [None, 3, None, 3]):
        rows = [*zip(ids, copies, strict=True), (9, "quite another text"), (None, "and one more without an id")]
        out = [(r.doc_id, r.text) for r in near_text.deduplicate(docs(spark, rows)).collect()]
        known = [i for i in ids if i is not None]
        assert len(out) == 3
        assert [i for i, t in out if t in copies] == [min(known) if known else None]


def test_pairs_within_reach_of_simhash_are_candidates_of_their_own(spark, monkeypatch):
    """Without a shared cell, what SimHash reaches still links, after the exact check."""
    rows = edited()
    sets = {i: near_text.shingles((t or "").encode()) for i, t in rows}
    fps = {i: simhash.majority(s) for i, s in sets.items()}
    monkeypatch.setattr(near_text, "_in_small_cells", lambda shared, n: shared.select(F.col("text_hash").alias("a"), F.col("text_hash").alias("b")))
    got = {r.doc_id: r.component_id for r in near_text.classes(docs(spark, rows), 10**9).collect()}
    exact = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    pairs = [(i, j) for i in sets for j in sets if i < j and (fps[i] ^ fps[j]).bit_count() <= simhash.REACH and exact(i, j)]
    low = {i: i for i in sets}
    for i, j in pairs:
        a, b = low[i], low[j]
        low = {k: min(a, b) if v in (a, b) else v for k, v in low.items()}
    assert len(pairs) > 5
    assert got == low
