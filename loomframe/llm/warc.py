"""WARC archives: revisit resolution and deduplicated writing.

Headers (identifier, payload digest, payload length) are shuffled by digest without their payloads; the first record
of a digest keeps its payload as a response, the others become revisit records that refer to it. Records are written
through Spark's own text writer, whose line end is the blank lines that close a WARC record, so archives land in any
file system Spark writes to and a failed task leaves nothing behind. Files are sized by payload bytes.

Every file begins with a ``warcinfo`` record. Reading parses every file by its Content-Length headers, checks the payload against its digest, and resolves revisits
by a join with the responses.

Defined cases: a null payload counts as empty; payloads under ``least`` bytes are never revisits; of repeated rows with
the same identifier and payload each is written, the first by order of the stored rows as response; an empty table
gives archives without records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import stored, table, work_folder
from loomframe.session import ship

LEAST = 100
FILE_BYTES = 24 << 20
CRLF = "\r\n"


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """Stored ``headers`` (record, id, digest, bytes) with ``refers_to``, the id of the response of the same payload.

    A digest shared by a third of all records meets its one response in a join that adaptive execution splits.
    """
    long = F.col("bytes") >= least
    first = headers.where(long).groupBy("digest").agg(F.min(F.struct("id", "record")).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = headers.join(first.select("digest", "first"), "digest", "left")
    revisits = long & (F.col("first.record") != F.col("record"))
    return joined.select("record", "id", "digest", "bytes", F.when(revisits, F.col("first.id")).alias("refers_to"), F.coalesce(revisits, F.lit(False)).alias("revisit"))


def records(rows: DataFrame, date: str) -> Column:
    """A WARC/1.1 record without its closing blank lines, from id, url, digest, payload, refers_to, revisit.

    Record identifiers hold the row's identifier (behind ``=``; ``-`` if it is null) and its payload's digest, so rows that repeat an identifier with other
    payloads have records of their own; the date is that of writing.
    """
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")), F.lit(":"), rows["digest"], F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    url = F.coalesce(F.regexp_replace(rows["url"], r"[\r\n]", " "), F.lit(""))
    revisit = rows["revisit"]
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    block = F.when(revisit, http).otherwise(F.concat(http, rows["payload"]))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(revisit, F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        line("WARC-Record-ID", name(rows["id"])),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), rows["digest"])),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(rows["refers_to"])), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return F.concat(head, block)


def warcinfo(name: Column, date: str) -> Column:
    """The record that begins an archive, with the blank lines that close it."""
    block = f"software: loomframe{CRLF}format: WARC File Format 1.1{CRLF}"
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:warcinfo:"), name, F.lit(f">{CRLF}WARC-Date: {date}{CRLF}"))
    return F.concat(head, F.lit(f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(block)}{CRLF}{CRLF}{block}{CRLF}{CRLF}"))


def write(pages: DataFrame, path: str, ident: str, payload: str, least: int = LEAST) -> None:
    """Write ``pages`` as WARC files under ``path``, each payload once."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(ident).alias("id"), F.col("url"), body.alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest"))
    headers = stored(rows.select(F.monotonically_increasing_id().alias("record"), "id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "headers")
    said = stored(resolve(headers, least), "resolved")
    total = said.agg(F.sum("bytes").alias("s")).first().s or 0
    revisits = said.groupBy("id", "digest").agg(F.count("*").alias("n"), F.count_if("revisit").alias("again"), F.max("refers_to").alias("refers_to"))
    known = stored(revisits.where("again > 0"), "revisits")
    whole = rows.join(F.broadcast(known) if known.count() <= 200_000 else known, rows["id"].eqNullSafe(known["id"]) & (rows["digest"] == known["digest"]), "left").select(
        rows["id"], rows["url"], rows["payload"], rows["digest"], known["n"], known["again"], known["refers_to"]
    )
    single = whole.where("n is null or again = n").withColumn("revisit", F.col("n").isNotNull())
    order = Window.partitionBy("id", "digest").orderBy(F.coalesce("url", F.lit("")))  # rows that repeat a page and its payload
    twin = whole.where("again < n").withColumn("revisit", F.row_number().over(order) > F.col("n") - F.col("again"))
    named = single.unionByName(twin).drop("n", "again")
    files = max(1, -(-int(total) // FILE_BYTES))
    spread = named.repartition(files, F.xxhash64("id", "url", "digest")) if files > 1 else named.coalesce(1)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its task, which writes one file
    archive = F.concat(F.lit(f"{uuid.uuid4().hex}:"), F.spark_partition_id().cast("string"))
    value = F.concat(F.when(first, warcinfo(archive, date)).otherwise(""), records(spread, date))
    spread.select(value.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an unpacked archive: headers, and the payload behind the HTTP head."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        body = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(body) + 4
        yield head, body[body.index(b"\r\n\r\n") + 4 :] if head.get("Content-Type", "").startswith("application/http") else body


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every response and revisit under ``path``: id, url, record_type, digest, refers_to, bytes, sound (payload meets its digest), payload."""
    ship(spark)
    schema = "id string, url string, record_type string, digest string, refers_to string, bytes long, sound boolean, payload binary"

    def name(text: str | None) -> str | None:
        found = text[len("<urn:record:") : -1].rpartition(":")[0] if text else None
        return found[1:] if found and found[0] == "=" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for content in batch.column(0):
                raw, members = content.as_py(), []
                while raw:  # members of a gzip file
                    unpack = zlib.decompressobj(31)
                    members.append(unpack.decompress(raw))
                    raw = unpack.unused_data
                data = b"".join(members)
                out = []
                for head, body in parse(data):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = head["WARC-Type"] == "response"
                    sound = not response or hashlib.sha256(body).hexdigest() == digest
                    out.append((name(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], digest, name(head.get("WARC-Refers-To")), len(body) if response else None, sound, body if with_payload else None))
                    if len(out) == 1000:
                        yield made(out)
                        out = []
                if out:
                    yield made(out)

    kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolved(archive: DataFrame) -> DataFrame:
    """Every record of an archive, each revisit with its full payload's length. ``sound`` tells whether a response meets
    its digest, and of a revisit whether the response it refers to is there and does; the length of one without is null."""
    rows = stored(archive.drop("payload"), "read-records")
    responses = rows.where("record_type = 'response' and sound").groupBy("id", "digest").agg(F.max("bytes").alias("full")).select(F.col("id").alias("to"), F.col("digest").alias("of"), "full")
    revisits = rows.where("record_type = 'revisit'").join(responses, F.col("refers_to").eqNullSafe(F.col("to")) & (F.col("digest") == F.col("of")), "left")
    told = {"bytes": F.col("full"), "sound": F.col("full").isNotNull()}
    return rows.where("record_type = 'response'").unionByName(revisits.select(*[told.get(c, F.col(c)).alias(c) for c in rows.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: pages written as archives without repeated payloads, and read back; a damaged record fails the query."""
    path = work_folder(spark, "archives")
    write(table(spark, sf_dir, "pages"), path, "page_id", "html")
    whole = F.when(F.col("sound"), F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce("id", F.lit("null")))).cast("long"))
    return resolved(read(spark, path)).select(
        F.col("id").cast("long").alias("page_id"), whole.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
