"""op11 against a full search in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from loomframe.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts, entries, rounds):
    keep = [(i, [float(np.float32(x)) for x in v], label) for i, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in keep), default=0) // parts) * parts
    ints = [(i, [math.floor(256 * x) for x in v] + [0] * (size - len(v)), label, v) for i, v, label in keep]
    width = size // parts
    cut = lambda v, j: v[j * width : (j + 1) * width]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[cut(v, j) for _, v, _, _ in first] for j in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            of: dict[int, list] = {}
            for _, v, _, _ in ints:
                of.setdefault(near(cut(v, j), books[j])[1], []).append(cut(v, j))
            books[j] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[j])]
    out, by = [], {}
    for i, v, label, _ in ints:
        found = [near(cut(v, j), books[j]) for j in range(parts)]
        error = min(sum(d for d, _ in found), 2**63 - 1)
        by[label] = by.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(map(str, [(i, c, e, min(by[label], 2**63 - 1), hashlib.sha256(flat.encode()).hexdigest()) for i, label, c, e in out]))


def ours(spark, rows, **of):
    codes, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **of)
    done = vector_codes.with_label_errors(codes).collect()
    return sorted(map(str, [(r.vec_id, r.code, r.error, r.label_error, vector_codes.digest(books)) for r in done]))


def vectors(seed: int, n: int, size: int, spread: float = 0.3):
    r = random.Random(seed)
    return [(r.randint(0, 10 * n), [r.gauss(0, spread) for _ in range(size)], r.choice([1, 2, None]), "x") for _ in range(n)]


@pytest.mark.parametrize(("n", "size", "parts"), [(150, 12, 4), (40, 7, 4), (3, 4, 4)])
def test_codes_equal_a_full_search(spark, n, size, parts):
    rows = vectors(n, n, size)
    rows += [(None, rows[0][1], 1, None), (rows[0][0], rows[1][1], 2, None), rows[2], (-1, None, 1, None), (-2, [None] * size, 1, None), (-3, [math.inf] * size, 1, None), (-4, [math.nan] * size, 1, None)]
    assert ours(spark, rows, parts=parts, entries=16) == brute(rows, parts, 16, 2)


def test_ties_equal_and_short_vectors(spark):
    rows = [(i, [0.5 * (i % 3), -0.5, 0.25 * (i % 2), 0.0], None, None) for i in range(40)] + [(50, [1.0], 1, None), (51, [], 1, None)]
    assert ours(spark, rows, parts=2, entries=8, rounds=3) == brute(rows, 2, 8, 3)


def test_components_beyond_small_integers(spark):
    rows = [(i, [(-1) ** i * 3.4e38 / (i + 1), float(i), 1e5 * i, -0.001], i % 2, None) for i in range(12)]
    assert ours(spark, rows, parts=2, entries=4) == brute(rows, 2, 4, 2)


def test_empty_tables(spark):
    assert ours(spark, []) == [] == ours(spark, [(1, None, 1, None)])


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(3)
    part, entries = r.integers(-150, 150, (600, 4)), r.integers(-150, 150, (64, 4))
    fixed = np.array(vector_codes.pivots_of(entries.tolist(), 4))
    at, best, evaluated = vector_codes.nearest(part, vector_codes.distances(part, fixed), entries, fixed)
    whole = vector_codes.distances(part, entries)
    assert (best == whole.min(axis=1)).all() and (at == whole.argmin(axis=1)).all()
    assert evaluated < 0.25 * whole.size
