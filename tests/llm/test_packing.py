"""op1 and op10 against the tokenizer itself, and exact round trips of op2's archives."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import bfd, packing, warc
from loomframe.llm.common import stored, work_folder
from loomframe.llm.tokens import WordIds, batch_ids, document_ids, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[tuple]:
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij XYZ'-é中🙂0123.,!", k=r.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long words " * 9000), (103, "<|endoftext|> a<|startoftext|>b <|END|>"), (104, " x y\x1cz\x85"), (104, "repeated"), (104, "repeated"), (None, "null id")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in texts()], SCHEMA).withColumns({"uid": F.lit(1), "rank": F.lit(2), "length": F.lit(3)})


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in texts()]


def test_ids_are_the_tokenizers(ids):
    for (_, text), (_, want) in zip(texts(), ids, strict=True):
        assert document_ids((text or "").encode(), vocabulary_path()).tolist() == want


@pytest.mark.parametrize("part", [1, 3000, 1 << 21])
def test_ids_of_a_batch_are_the_tokenizers(ids, part):
    rows = pa.array([b"before", *[(t or "").encode() for _, t in texts()]], pa.binary())
    got = [x.tolist() for x in batch_ids(rows.slice(1), vocabulary_path(), part)]
    assert got == [want for _, want in ids]
    assert list(batch_ids(rows.slice(0, 0), vocabulary_path(), part)) == []


def test_ids_do_not_depend_on_the_caches_size(ids):
    small = WordIds(vocabulary_path(), words=50)
    for _ in range(2):
        for (_, text), (_, want) in zip(texts(), ids, strict=True):
            (got,) = small(pa.array([(text or "").encode()], pa.binary()))
            assert got.tolist() == want[:-1]


def test_common_words_outlast_a_full_cache():
    words, learned = WordIds(vocabulary_path(), words=200), []
    learn = words._learn
    words._learn = lambda: (learned.extend(words.new), learn())
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    for k in range(60):
        fresh = " ".join("z" + name(100 * k + i) for i in range(30))
        list(words(pa.array([f"some common words, {fresh}".encode()], pa.binary())))
        assert len(words.place) <= 300
    assert len(learned) >= 60 * 30
    assert [learned.count(w) for w in (b"some", b"common", b"words,")] == [1, 1, 1]


@pytest.mark.parametrize("length", [4096, 64])
@pytest.mark.parametrize("operator", ["shortest", "best-fit"])
def test_pieces_hold_every_id_once(spark, docs, ids, operator, length):
    rows = packing.pack(docs, length) if operator == "shortest" else bfd.segments(stored(bfd.packed(docs, length), "matrices"))
    rows = rows.collect()
    want: dict = {}
    for i, all_ in ids:
        for start in range(0, len(all_), length):
            part = np.array(all_[start : start + length], "<u4")
            key = (i, start, len(part), zlib.crc32(part.tobytes()), len(all_))
            want[key] = want.get(key, 0) + 1
    got: dict = {}
    sequences: dict[int, list] = {}
    for r in rows:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    total = sum(len(x) for _, x in ids)
    assert len(sequences) <= 1.15 * total / length + (1 if operator == "shortest" else 8)


def test_shortest_pack_first_on_a_histogram():
    slots, n = packing.shortest_pack_first({5: 3, 4: 2, 3: 4, 1: 2}, 10)
    placed: dict[int, list] = {}
    for length, _, count, first, offset in slots:
        for k in range(count):
            placed.setdefault(first + k, []).append((offset, length))
    assert len(placed) == n
    assert sorted(x for p in placed.values() for _, x in p) == sorted([5] * 3 + [4] * 2 + [3] * 4 + [1] * 2)
    assert all(sum(x for _, x in p) <= 10 for p in placed.values())


def test_best_fit_takes_the_tightest_room():
    assert bfd.best_fit_decreasing([6, 4, 7, 3, 1], 10) == [[2, 3], [0, 1], [4]]
    r = random.Random(1)
    lengths = [r.randint(1, 100) for _ in range(500)]
    out = bfd.best_fit_decreasing(lengths, 100)
    assert sorted(i for s in out for i in s) == list(range(500))
    rooms: list[int] = []  # plain best fit
    for x in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(100 - x)
    assert sorted(100 - sum(lengths[i] for i in s) for s in out) == sorted(rooms)


def test_matrix_rows(docs):
    for r in bfd.packed(docs, 64).collect():
        row, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(row) == 64 and r.cu_seqlens[-1] == r.tokens == len(at) and not row[r.tokens :].any()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert at[a:b].tolist() == list(range(b - a))


def test_empty_tables(spark, docs):
    assert packing.pack(docs.limit(0)).collect() == []
    assert bfd.packed(docs.limit(0)).collect() == []


def test_widths_that_do_not_hold_the_ids_are_refused(docs):
    with pytest.raises(Exception, match="does not fit"):
        bfd.packed(docs, width=1).collect()
    with pytest.raises(ValueError, match="two bytes"):
        bfd.packed(docs, length=1 << 17)


def test_archives_round_trip(spark):
    long = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(5, "http://a/", long), (2, "http://b/\r\nX: y", long), (9, None, long), (3, "u", "short"), (4, "u", "short"), (1, "u", None), (7, "u", ""), (8, "u", "y" * 100), (6, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 2_000_000), (13, "u", "y" * 100)]
    path = work_folder(spark, "archives")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)), path, "page_id", "html")
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect():
        kinds = [h["WARC-Type"] for h, _ in warc.parse(gzip.decompress(f.content))]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    archive = warc.read(spark, path, with_payload=True)
    rows = archive.collect()
    first: dict[str, int] = {}
    for i, _, h in sorted(pages):
        first.setdefault(h or "", i)
    payloads = {int(r.id): bytes(r.payload) for r in rows if r.record_type == "response"}
    assert all(r.sound for r in rows)
    got = {int(r.id): (r.bytes, r.digest, r.record_type, r.refers_to and int(r.refers_to)) for r in warc.resolved(archive).collect()}
    for i, _, h in pages:
        body = (h or "").encode()
        again = len(body) >= 100 and first[h] != i
        assert got[i] == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None)
        assert payloads[first[h] if again else i] == body
    assert len(got) == len(rows) == len(pages)


def test_damaged_records_are_told(spark):
    """One byte of the response changes: its own record and those that refer to it are returned, not sound."""
    pages = [("null", "u", "a" * 300), ("b", "v", "a" * 300), (None, "w", "c" * 200), ("d", "x", "c" * 200), ("e", "y", "e" * 150)]
    path = work_folder(spark, "archives")
    warc.write(spark.createDataFrame(pages, "page_id string, url string, html string"), path, "page_id", "html")
    whole = warc.resolved(warc.read(spark, path)).collect()
    assert {r.id for r in whole} == {"null", "b", None, "d", "e"} and all(r.sound for r in whole)
    (file,) = Path(path.removeprefix("file://")).glob("*.gz")
    data = gzip.decompress(file.read_bytes())
    at = data.index(b"a" * 300)
    file.write_bytes(gzip.compress(data[:at] + b"A" + data[at + 1 :]))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    got = {r.id: (r.record_type, r.sound, r.bytes) for r in warc.resolved(warc.read(spark, path)).collect()}
    assert got["b"] == ("response", False, 300) and got["null"] == ("revisit", False, None)
    assert sum(sound for _, sound, _ in got.values()) == 3 and len(got) == 5


def test_archives_of_an_empty_table(spark):
    path = work_folder(spark, "archives")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path, "page_id", "html")
    assert warc.resolved(warc.read(spark, path)).collect() == []
