"""op4 exact, op5 substring and op9 near duplicates against brute force."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomframe.llm import chunk_dedup, exact_dedup, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more: str = ""):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_meets_its_sql(name, agrees):
    agrees(queries.queries()[name], queries.oracle_sql()[name])


EQUAL = [(1, "same"), (2, "same"), (3, "Same"), (4, None), (5, ""), (6, "same "), (7, "x" * 300_000), (8, "x" * 300_000), (9, "only")]


@pytest.mark.parametrize("key", [None, lambda t: F.length(t).cast("string")])
def test_exact_groups_even_under_a_weak_digest(spark, key):
    """Lengths as digests collide; the check of full bytes still tells the texts apart."""
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(docs(spark, EQUAL), key, files_per_batch=1).collect()}
    by: dict[str, list[int]] = {}
    for i, t in EQUAL:
        by.setdefault(t or "", []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in by.values() for i in g}


def test_exact_rows_that_repeat_a_doc_id_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b")]
    said = exact_dedup.decide(docs(spark, rows)).collect()
    assert sorted(r.group_size for r in said) == [1, 3, 3, 3]
    assert sum(r.kept for r in said if r.group_size == 3) == 1
    assert sorted(map(tuple, exact_dedup.deduplicate(docs(spark, rows)).select("doc_id", "text").collect()), key=str) == [(1, "a"), (None, "b")]


@pytest.mark.parametrize("key", [None, lambda t: F.length(t).cast("string")])
def test_exact_later_deliveries_meet_earlier_ones(spark, key, tmp_path):
    """State and checkpoint outlast a call; texts of earlier deliveries are read through their locators."""
    folder, seen = f"file://{tmp_path}/state", []
    for n, rows in enumerate([EQUAL, [(20, "same"), (0, "only"), (21, "new"), (22, "Sane")], [(30, "new"), (31, "x" * 300_000)]]):
        docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/given{n}")
        seen += rows
        given = spark.read.parquet(f"{tmp_path}/given{n}")
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(given, key, files_per_batch=1, folder=folder).collect()}
        by: dict[str, list[int]] = {}
        for i, t in seen:
            by.setdefault(t or "", []).append(i)
        assert got == {i: (max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""])) for i, t in rows}


def test_exact_keeps_clashing_columns(spark):
    extra = docs(spark, EQUAL).select("*", F.lit(1).alias("digest"), F.lit(2).alias("keep"), F.lit(3).alias("n"), F.lit(4).alias("row_id"))
    out = exact_dedup.deduplicate(extra)
    assert out.columns == extra.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6, 8, 9]


def reference_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


NEAR = [(1, None), (2, " \n"), (3, "one Word"), (4, "ONE word"), (5, "één ÉÉN één één één")] + [
    (10 + 4 * k + j, " ".join([*prose(k, 120 + k).split()[: -j or None], *["x"] * (j > 2)])) for k in range(12) for j in range(4)
]


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    low, todo = {}, set(fps)
    for i in sorted(fps):
        if i in todo:
            todo.discard(i)
            reach, stack = [i], [i]
            while stack:
                x = stack.pop()
                hit = [y for y in todo if (fps[x] ^ fps[y]).bit_count() <= 4]
                todo.difference_update(hit)
                reach += hit
                stack += hit
            low.update(dict.fromkeys(reach, i))
    return low


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 3])
def test_near_classes_against_all_pairs(spark, cell_rows):
    """With cells of at most three rows, crowded cells take the midpoint way and find the same classes."""
    fps = {i: reference_fingerprint(t) for i, t in NEAR}
    want = brute_components(fps)
    assert len(set(want.values())) < len(want)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.classes(docs(spark, NEAR), cell_rows).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_near_bound_and_links_on_planted_fingerprints(spark):
    """Random fingerprints with neighbours at 1 to 6 flips: every class agrees with all pairs; the bound never exceeds."""
    r = random.Random(3)
    fps = []
    for _ in range(60):
        x = r.getrandbits(64)
        fps.append(x)
        for flips in range(1, 7):
            y = x
            for b in r.sample(range(64), flips):
                y ^= 1 << b
            fps.append(y)
            import numpy as np

            u, v = simhash.unary_np(np.array([x, y], np.uint64))
            assert int(u ^ v).bit_count() <= flips
    table = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    from loomframe.llm.common import stored
    from loomframe.llm.components import components

    roots = {row.node: row.root for row in components(stored(simhash.links(table), "links")).collect()}
    want = brute_components(dict(enumerate(fps)))
    groups: dict[int, set] = {}
    for i, low in want.items():
        groups.setdefault(low, set()).add(simhash.signed(fps[i]))
    for g in groups.values():
        assert len({roots.get(x, x) for x in g}) == 1
    assert len({roots.get(simhash.signed(x), simhash.signed(x)) for x in fps}) == len(groups)


def test_near_deduplicate_keeps_the_smallest(spark):
    out = simhash.deduplicate(docs(spark, NEAR).withColumn("fp", F.lit(1)).withColumn("keep", F.lit(False)))
    want = brute_components({i: reference_fingerprint(t) for i, t in NEAR})
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))


def test_substring_finds_planted_passages_and_leaves_clean_documents(spark):
    passage = prose(99, 60)
    rows = [(k, prose(k, 200)) for k in range(20)]
    rows += [(50, prose(50, 100) + " " + passage + " " + prose(51, 30)), (51, passage + " " + prose(52, 77)), (52, prose(53, 41) + "é " + passage), (53, None), (54, "")]
    got: dict[int, list] = {}
    for r in chunk_dedup.spans(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = dict(rows)
    assert set(got) == {50, 51, 52}
    for i, runs in got.items():
        assert all(min(run.first_doc_ids) == 50 for run in runs)  # a chunk at the passage's edge may be shared by the later two alone
        begin = texts[i].index(passage)
        covered = sum(min(run.end, begin + len(passage)) - max(run.start, begin) for run in runs)
        assert covered > 0.8 * len(passage)
        assert all(run.own == (i == 50) for run in runs)
    out = {r.doc_id: r.text for r in chunk_dedup.deduplicate(docs(spark, rows).withColumn("start", F.lit(0))).collect()}
    assert all(out[i] == t for i, t in rows if i not in (51, 52))
    assert all(len(out[i]) < len(texts[i]) - 0.8 * len(passage) for i in (51, 52))
    assert len(out) == len(rows)


def brute_spans(rows, words=chunk_dedup.WORDS):
    """Runs of chunks that other documents hold, document by document."""
    import numpy as np

    cut, held = {}, {}
    for i, t in set(rows):
        data = (t or "").encode()
        ends = chunk_dedup.boundaries(np.frombuffer(data, np.uint8))
        cut[i, t] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for *_, c in cut[i, t]:
            held.setdefault(c, set()).add(i)
    out = []
    for (i, t), parts in cut.items():
        data = (t or "").encode()
        run = []
        for part in [*parts, None]:
            if part and len(held[part[2]]) > 1:
                run.append(part)
                continue
            if run:
                begun = sum(1 for k in range(run[0][0], run[-1][1]) if not data[k : k + 1].isspace() and (k == 0 or data[k - 1 : k].isspace()))
                if begun >= words:
                    points = [len(data[:x].decode()) for x in (run[0][0], run[-1][1])]
                    firsts = sorted({min(j for j in held[c] if j is not None) for *_, c in run})
                    out.append((i, *points, begun, firsts))
            run = []
    return sorted(map(str, out))


def test_spans_equal_a_walk_of_every_document(spark):
    passages = [prose(90 + k, n) for k, n in enumerate((80, 40, 30, 200))]
    rows = [(k, " ".join([prose(200 + k, 20), passages[k % 4], prose(300 + k, 15), passages[(k * 3 + 1) % 4]])) for k in range(12)]
    rows += [(None, passages[0] + " x"), (5, "é " + passages[0]), (20, passages[1]), (20, passages[1]), (30, prose(5, 80) + " " + prose(5, 80)), (None, prose(6, 90)), (None, prose(6, 90)), (31, None), (32, "")]
    rows += [(40, prose(8, 60)), (40, prose(8, 60) + " more")]  # one document by its id
    got = sorted(str((r.doc_id, r.start, r.end, r.n_words, r.first_doc_ids)) for r in chunk_dedup.spans(docs(spark, rows)).collect())
    assert got == brute_spans(rows) and len(got) > 20


@pytest.mark.parametrize(("ids", "found"), [((None, 5), 2), ((4, 5), 2), ((None, None), 0), ((5, 5), 0)])
def test_repeats_with_null_and_equal_ids(spark, ids, found):
    rows = [(i, prose(k, 40) + " " + prose(99, 80)) for k, i in enumerate(ids)]
    assert chunk_dedup.spans(docs(spark, rows)).count() == found


def test_chunks_cover_texts_and_resist_insertions(spark):
    import numpy as np

    text = prose(7, 3000).encode()
    cut = lambda b: {b[x:y] for ends in [chunk_dedup.boundaries(np.frombuffer(b, np.uint8))] for x, y in zip([0, *ends], ends, strict=False)}
    before, after = cut(text), cut(text[:5000] + b"inserted words " + text[5000:])
    assert len(after - before) <= 6
    for sample in (b"", b"a", "é".encode() * 5000, b"x" * 100_000, text):
        ends = chunk_dedup.boundaries(np.frombuffer(sample, np.uint8))
        assert (ends[-1] if ends else 0) == len(sample)
        assert ends == sorted(set(ends))


@pytest.mark.parametrize("run", [exact_dedup.decide, exact_dedup.deduplicate, simhash.classes, simhash.deduplicate, chunk_dedup.spans, chunk_dedup.deduplicate])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).collect() == []
