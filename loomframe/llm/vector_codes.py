"""Vector code compression: product codes whose nearest entries are found through fixed pivots (LAESA).

Components become integers, vectors are cut into equal parts, and every part position has a codebook that starts from the
smallest vec_ids and is moved to the means of its parts in a few rounds. For each part position a few of the first
entries, far apart, are its pivots for good. The distances of every part to its pivots are computed once and stored with
the vector; in a round only pivots and entries are compared. The difference of the two distances bounds the distance of
part and entry from below: entries are tried in the order of their bounds, in exact integers, until a bound is beyond the
best. The bounds only order and prune, so the codes are those of a full search.

Rounds are one pass over the stored vectors: tasks emit sums and counts by part and entry, the codebooks themselves
(at most ``entries`` by vector length) are all that the driver holds.

Defined cases: vectors that are null or hold null or non-finite components are left out; fewer vectors than entries give
smaller codebooks; among equal vec_ids the smaller vector comes first, a null vec_id comes last; vectors of other lengths
count as padded with zeros to the longest, and that to a multiple of the number of parts; components beyond 2^24 are
searched in Python's integers, and errors above the greatest long stop there; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import bounded, lean, stored, table
from loomframe.session import ship

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 16, 64, 2, 256, 4
#: Components up to this size are searched in 64-bit integers.
SMALL, LARGEST = 1 << 24, (1 << 63) - 1
BLOCK = 512
#: Sums travel as digits to this base, so that each fits a decimal whatever the components.
BASE = 10**18
Books = list[list[list[int]]]  # by part and entry


def floors(values: np.ndarray, scale: int = SCALE) -> list[int]:
    """Floors of the scaled components; exact, as the scale is a power of two."""
    scaled = np.floor(values.astype(np.float64) * scale)
    return scaled.astype(np.int64).tolist() if not len(scaled) or np.abs(scaled).max() < LARGEST // 2 else [int(x) for x in scaled]


def distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, each row of ``part`` to each of ``entries``."""
    return ((part[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def pivots_of(book: list[list[int]], n: int) -> list[list[int]]:
    """Up to ``n`` entries far apart: the first, then always the one farthest from those chosen."""
    entries = np.array(book, object).reshape(len(book), -1)
    chosen = entries[:1]
    while len(chosen) < min(n, len(entries)):
        near = distances(entries, chosen).min(axis=1)
        chosen = np.vstack([chosen, entries[[max(range(len(near)), key=lambda i: near[i])]]])
    return chosen.tolist()


def nearest(part: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``part`` the index of its nearest entry and their squared distance; how many were evaluated.

    ``to_pivots`` holds the rows' squared distances to ``pivots``.
    """
    between = np.sqrt(distances(pivots, entries).astype(np.float64))
    own = np.sqrt(to_pivots.astype(np.float64))
    bound = np.zeros((len(part), len(entries)))
    for p in range(len(pivots)):
        slack = (own[:, p, None] + between[None, p]) * 1e-12  # of the roots' rounding
        np.maximum(bound, np.abs(own[:, p, None] - between[None, p]) - slack, out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(part), -1, part.dtype)
    at = np.zeros(len(part), np.int64)
    open_, evaluated = np.arange(len(part)), 0
    for k in range(len(entries)):
        entry = order[open_, k]
        now = best[open_]
        going = (now < 0) | (bound[open_, entry] * (1 - 1e-9) <= now)
        open_, entry, now = open_[going], entry[going], now[going]
        if not len(open_):
            break
        evaluated += len(open_)
        found = ((part[open_] - entries[entry]) ** 2).sum(axis=1)
        better = (now < 0) | (found < now) | ((found == now) & (entry < at[open_]))
        best[open_[better]], at[open_[better]] = found[better], entry[better]
    return at, best, evaluated


class Search:
    """The codebooks of a round beside the fixed pivots."""

    def __init__(self, books: Books, pivots: Books):
        self.books, self.pivots = books, pivots
        self.most = max((abs(x) for book in [*books, *pivots] for e in book for x in e), default=0)

    def __call__(self, vectors: np.ndarray, to_pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part position: the parts, their nearest entries and squared distances."""
        width = vectors.shape[1] // len(self.books)
        kind = np.int64 if vectors.dtype == np.int64 and self.most <= SMALL else object
        for j, (book, fixed) in enumerate(zip(self.books, self.pivots, strict=True)):
            part = vectors[:, j * width : (j + 1) * width].astype(kind)
            arrays = (np.array(x, kind).reshape(len(x), width) for x in (book, fixed))
            at, best, _ = nearest(part, to_pivots[:, j * len(fixed) : (j + 1) * len(fixed)].astype(kind), *arrays)
            yield part, at, best


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of integers, which travel as lists of long, or of decimal text where they are larger."""
    width = len(column[0])
    flat = column.flatten()
    if pa.types.is_int64(flat.type):
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)
    return np.array([int(x) for x in flat.to_pylist()], object).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def kept(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is whole, as doubles."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(whole).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _padded(values: list[int], size: int) -> list[int]:
    return [*values, *[0] * (size - len(values))]


def _cut(vector: list[int], parts: int) -> list[list[int]]:
    width = len(vector) // parts
    return [vector[j * width : (j + 1) * width] for j in range(parts)]


def measured(rows: DataFrame, size: int, pivots: Books, large: bool) -> DataFrame:
    """``rows`` as integers (lists of long, or of text where ``large``), with the squared distances of each part to its pivots."""
    of = dict(rows.dtypes)
    cell = pa.string() if large else pa.int64()
    say = str if large else int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = size // len(pivots)
        for batch in _blocks(batches):
            ints = [_padded(floors(v.values.to_numpy(zero_copy_only=False)), size) for v in batch.column("embedding")]
            vectors = np.array(ints, object if large else np.int64).reshape(len(ints), size)
            near = [distances(vectors[:, j * width : (j + 1) * width], np.array(p, vectors.dtype).reshape(len(p), width)) for j, p in enumerate(pivots)]
            lists = [[[say(x) for x in row] for row in whole.tolist()] for whole in (vectors, np.concatenate(near, axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *[pa.array(x, pa.list_(cell)) for x in lists]], names=["vec_id", "label", "vector", "to_pivots"])

    item = "string" if large else "long"
    return rows.mapInArrow(lean(run), f"vec_id {of['vec_id']}, label {of['label']}, vector array<{item}>, to_pivots array<{item}>")


def digits(total: int) -> list[int]:
    """``total`` to the base, lowest first; each digit has its sign."""
    out, rest, sign = [], abs(total), -1 if total < 0 else 1
    while rest or not out:
        rest, low = divmod(rest, BASE)
        out.append(sign * low)
    return out


def moved(rows: DataFrame, books: Books, pivots: Books) -> Books:
    """The codebooks after one round: every used entry at the floor of its parts' mean."""
    search = Search(books, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for batch in _blocks(batches):
            for j, (part, at, _) in enumerate(search(_whole(batch.column("vector")), _whole(batch.column("to_pivots")))):
                for e in np.unique(at).tolist():
                    here = part[at == e]
                    counts[j, e] = counts.get((j, e), 0) + len(here)
                    sums[j, e] = sums.get((j, e), 0) + here.sum(axis=0).astype(object)
        out = [(j, e, i, d, x, counts[j, e]) for (j, e), v in sums.items() for i, total in enumerate(v) for d, x in enumerate(digits(total))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["part", "entry", "place", "digit", "total", "n"])

    found = rows.select("vector", "to_pivots").mapInArrow(lean(run), "part long, entry long, place long, digit long, total long, n long")
    sums = found.groupBy("part", "entry", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    now = [[list(e) for e in book] for book in books]
    totals, counts = {}, {}
    for r in sums.collect():  # at most the entries by the vector's length, and digits of a number
        at = (r.part, r.entry, r.place)
        totals[at] = totals.get(at, 0) + int(r.total) * BASE**r.digit
        counts[at] = max(counts.get(at, 0), r.n)  # every sum has a lowest digit
    for (j, e, i), total in totals.items():
        now[j][e][i] = total // counts[j, e, i]
    return now


def coded(rows: DataFrame, books: Books, pivots: Books) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    search, of = Search(books, pivots), dict(rows.dtypes)
    digits = max(2, len(f"{max(map(len, books)) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            ats, error = [], 0
            for _, at, best in search(_whole(batch.column("vector")), _whole(batch.column("to_pivots"))):
                ats.append(at)
                error = error + best.astype(object)
            codes = ["".join(f"{e:0{digits}x}" for e in row) for row in np.array(ats).T.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array([min(int(e), LARGEST) for e in error])], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(lean(run), f"vec_id {of['vec_id']}, label {of['label']}, code string, error long")


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Books]:
    """Codes of all vectors (vec_id, label, code, error), stored, and the codebooks they name."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = kept(embeddings)
    shape = rows.agg(F.max(F.size("embedding")).alias("size"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most")).first()
    size = -(-(shape["size"] or 0) // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    whole = [_cut(_padded(floors(np.array(r.embedding, np.float64)), size), parts) for r in first]
    books = [[v[j] for v in whole] for j in range(parts)]
    if not first:
        return spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, label {dict(rows.dtypes)['label']}, code string, error long"), books
    fixed = [pivots_of(book, pivots) for book in books]
    large = (shape["most"] or 0) * SCALE >= SMALL
    vectors = stored(measured(rows, size, fixed, large), "vectors")
    for _ in range(rounds):
        books = moved(vectors, books, fixed)
    return stored(coded(vectors, books, fixed), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over rows of an equal label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = stored(codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    return codes.join(bounded(sums), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the code and errors of every vector."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _near(books: str, name: str) -> str:
    """SQL: the nearest entry of every part and their squared distance."""
    return f"""{name} AS (SELECT vec_id, j, min((d, e)) AS m FROM (
  SELECT p.vec_id, p.j, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM parts p JOIN {books} b USING (j)) GROUP BY vec_id, j)"""


def _move(books: str, near: str, name: str) -> str:
    return f"""{name} AS (SELECT b.j, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
  SELECT j, e, list(x ORDER BY i) AS v FROM (
    SELECT p.j, n.m[2] AS e, i, floor(sum(p.v[i])::DOUBLE / count(*))::BIGINT AS x FROM parts p JOIN {near} n USING (vec_id, j), range(1, 1 + (SELECT max(len(v)) FROM parts)) r(i) GROUP BY ALL) GROUP BY ALL) m USING (j, e))"""


SQL = f"""
WITH ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, j, q[j * len(q) // {PARTS} + 1 : (j + 1) * len(q) // {PARTS}] AS v FROM ok, range({PARTS}) r(j)
), b0 AS MATERIALIZED (
  SELECT p.j, k.e, p.v FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM ok ORDER BY vec_id LIMIT {ENTRIES}) k USING (vec_id)
), {_near("b0", "n0")}, {_move("b0", "n0", "b1")}, {_near("b1", "n1")}, {_move("b1", "n1", "b2")}, {_near("b2", "n2")}
, codes AS (
  SELECT vec_id, string_agg(printf('%02x', m[2]), '' ORDER BY j) AS code, sum(m[1])::BIGINT AS error FROM n2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x, ',' ORDER BY j, e, i)) FROM (SELECT j, e, i, v[i]::VARCHAR AS x FROM b2, range(1, 1 + (SELECT max(len(v)) FROM parts)) r(i))) AS codebooks_sha256
FROM codes JOIN ok USING (vec_id)
"""
