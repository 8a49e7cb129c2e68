"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest with map-side minima, so a payload that a third of all
pages share costs one row per task; each record then learns the smallest id of its digest. That record becomes a
``response``, the others become ``revisit`` records that refer to it and carry no payload. Records are written as
``WARC/1.1`` text with fresh headers by Spark's text writer (record separator CRLF CRLF, gzip, one member for a file), one
archive per task, each beginning with a ``warcinfo`` record. Record ids are made from page id, digest and, for rows that
repeat, their number, so that none occurs twice; a revisit names the id of its response.

Reading back parses by Content-Length and computes lengths and digests from the payloads that it finds; a revisit is
resolved by a join of the id that it refers to with the responses that were read, from which its length and digest come.

Results for odd input: null html is an empty payload, of 0 bytes; very long payloads are written whole; rows that repeat
the smallest id of their payload are all responses; rows without id are all responses, and no revisit refers to them if the
payload has any id; control characters in a url are percent-encoded; an empty table gives an empty archive and no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Payload bytes per archive that the writer aims at; the reader holds one archive at a time.
ARCHIVE_BYTES = 32 << 20


def base32(digest: Column) -> Column:
    """A hexadecimal SHA-1 in upper-case base32: 8 groups of 20 bits, each 4 digits of 5."""
    digits = []
    for group in range(8):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def headed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``key, page_id, url, payload, sha1, payload_bytes``; rows without id have a key each."""
    records = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    key = F.coalesce(F.concat(F.lit("p"), F.col("page_id").cast("string")), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string")))
    return records.withColumns({"key": key, "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, refers_to, nth``; refers_to is null for responses.

    Only headers are shuffled by digest. Pages meet their revisit notes by id, and only duplicates have notes; that is the
    one shuffle of payloads, into partitions of about ARCHIVE_BYTES. ``nth`` numbers rows that repeat.
    """
    records = headed(pages, id_col, url_col, payload_col)
    heads = materialize(records.select("key", "page_id", "sha1", "payload_bytes"), "warc-heads")
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    # with fewer partitions than the session's the join would deal the payloads again
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // ARCHIVE_BYTES)
    first = heads.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    notes = heads.join(first.drop("n"), ["sha1", "payload_bytes"]).where("page_id <> first").select("key", "sha1", F.col("first").alias("refers_to")).distinct()
    found = records.repartition(parts, "key", "sha1").join(notes, ["key", "sha1"], "left")
    nth = F.row_number().over(Window.partitionBy("key", "sha1").orderBy("url"))
    return found.select("page_id", "key", "url", "payload", "payload_bytes", "refers_to", base32(F.col("sha1")).alias("payload_digest"), nth.alias("nth"))


def record_id(key: Column, digest: Column, nth: Column) -> Column:
    """A name-based identifier, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", key, digest, nth.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_text(date: str) -> Column:
    """One record without its closing CRLF CRLF, which the writer adds; a partition's first one has a warcinfo before it."""
    revisit = F.col("refers_to").isNotNull()
    url = F.col("url")
    for char in (*map(chr, range(32)), "\x7f"):
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    original = record_id(F.concat(F.lit("p"), F.col("refers_to").cast("string")), F.col("payload_digest"), F.lit(1))
    number = F.monotonically_increasing_id()
    about = "software: xpspark\r\nformat: WARC File Format 1.1\r\n"
    info = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("warcinfo")), line("WARC-Record-ID", record_id(F.lit("info"), number.cast("string"), F.lit(date))), line("WARC-Date", F.lit(date)), line("Content-Type", F.lit("application/warc-fields")), line("Content-Length", F.lit(str(len(about)))), F.lit(f"\r\n{about}{END}"))
    # the low 33 bits of the id count the rows of a partition
    return F.concat(
        F.when(number.bitwiseAND(F.lit((1 << 33) - 1)) == 0, info).otherwise(""),
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("key"), F.col("payload_digest"), F.col("nth"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", original))).otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write(resolved: DataFrame, path: str, date: str | None = None) -> str:
    """Write ``resolved`` as archives under ``path``, one for each partition; ``date`` is that of writing if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved.select(record_text(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    while (start := stream.readline()) not in (b"", b"\r\n"):
        if start != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {start[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name.lower()] = value.removesuffix("\r\n")
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != END.encode():
            raise ValueError("a record does not end where its length says")
        yield headers, block


def parsed(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Every response and revisit under ``path`` as it stands there."""
    schema = "record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows, held = [], 0
                for head, block in records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    own = kind == "response"
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if own else None
                    rows.append((head["warc-record-id"], head.get("x-page-id"), head["warc-target-uri"], kind, len(block) if own else None, digest, head.get("warc-refers-to"), block.decode("utf-8") if own and payloads else None))
                    held += len(block) if payloads else 0
                    if held > 4 << 20 or len(rows) > 4000:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(run, schema)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload`` of every record under ``path``.

    A revisit has length and digest of the response that it refers to, whose page id is ``refers_to``; one whose response is
    missing has nulls there. Payloads are those of responses, null if not asked for.
    """
    rows = materialize(parsed(spark, path, payloads), "warc-read")
    found = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"), F.col("page_id").alias("p"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest", "payload").join(found, "refers_to", "left")
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    revisits = revisits.select("page_id", "url", "record_type", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("p").alias("refers_to"), F.lit(None).cast("string").alias("payload"))
    return rows.where("record_type = 'response'").select(*columns).unionByName(revisits)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", payloads: bool = True) -> DataFrame:
    """Resolve, write under ``path`` and read back."""
    write(resolve(pages, id_col, url_col, payload_col), path)
    kind = pages.schema[id_col].dataType
    return read(pages.sparkSession, path, payloads).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
