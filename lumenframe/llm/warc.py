"""Operator 5: a content-addressed WARC archive.

Payloads are stored once each under their SHA-256; record headers are stored apart, byte for byte, with the digest of
their payload. Reading joins the two: a payload is accepted only if its bytes give the digest it is stored under (else
the read fails), and a response record is its header, the payload and the closing line breaks. A revisit record has no
block of its own. The query takes its rows from the rebuilt records' bytes. DataFrame functions only, but for
``write_files``, which writes the records as .warc.gz files.

Of the records with equal payloads of at least REVISIT_BYTES bytes the one with the largest id is the response and the
others revisit it; smaller payloads are all responses. Payload bytes are shuffled once to be stored, with the one row of
each group that stands for it (so that a large group of copies is not gathered in a task), and once to be joined.

Null payloads are empty. Ids may be of any ordered type that can be cast from a string. Null ids sort before all others;
of repeated rows with the largest id all are responses. Repeated rows give repeated records. Null URLs give an empty
target. An empty table gives an empty archive. A very long payload is one row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, new_path, quoted, read

REVISIT_BYTES = 1000
CRLF = "\r\n"
#: Fixed, so that an archive of the same pages has the same bytes.
DATE = "2024-01-01T00:00:00Z"


def _uuid(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(kind: Column) -> Column:
    """The header block, its empty line included."""
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _uuid(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uuid(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write ``path``/payloads (digest, payload) and ``path``/headers (page_id, header, digest)."""
    body = F.coalesce(F.col(quoted(payload)).cast("binary"), F.lit("").cast("binary"))
    full = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url)).alias("url"), body.alias("payload"))
    keyed = full.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    brief = keyed.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    brief.write.option("compression", "zstd").parquet(f"{path}/brief")
    spark = pages.sparkSession
    brief = spark.read.schema(brief.schema).parquet(f"{path}/brief")
    chosen = brief.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    # one row of each group carries the payload; equal rows of that id meet in one task, where they become one
    chosen_row = F.struct(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), F.col("digest"))
    carrier = chosen.select(F.struct(F.coalesce(F.col("refers_to").cast("string"), F.lit("")).alias("id"), F.col("digest")).alias("row"))
    stored = keyed.select(chosen_row.alias("row"), "payload").join(carrier, "row", "left_semi").dropDuplicates(["row"])
    stored.select("row.digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    joined = brief.join(chosen, "digest")
    other = (F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    kind = F.when(other, F.lit("revisit")).otherwise(F.lit("response"))
    joined.select("page_id", _header(kind).cast("binary").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def _verified(stored: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest"))).cast("binary")
    return stored.select("digest", F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(bad).alias("payload"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, digest, header, payload (verified), for each record; a revisit has no payload of its own: its digest names it.

    Payloads meet the headers of responses only, so that copies of a large one don't multiply it.
    """
    headers = _table(spark, path, "headers")
    revisit = field("WARC-Type") == "revisit"
    none = F.lit(None).cast("binary")
    responses = headers.where(~revisit).join(_verified(_table(spark, path, "payloads")), "digest").select("page_id", "digest", "header", "payload")
    return responses.union(headers.where(revisit).select("page_id", "digest", "header", none.alias("payload")))


def field(name: str) -> Column:
    """A header field's value, empty without one."""
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)", 1)


def records(archive: DataFrame) -> DataFrame:
    """page_id, digest and record: the original bytes."""
    return archive.select("page_id", "digest", F.concat("header", F.coalesce("payload", F.lit("").cast("binary")), F.lit(CRLF * 2).cast("binary")).alias("record"))


def parsed(rebuilt: DataFrame) -> DataFrame:
    """digest, header and block of rebuilt records, taken apart again at the first empty line; one that isn't closed or differs from its header fails."""
    end = F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2) + 3  # a character a byte
    size = F.octet_length("record") - 4
    cut = rebuilt.select("page_id", "digest", F.substring("record", F.lit(1), end).alias("header"), F.substring("record", end + 1, size - end).alias("block"), F.substring("record", size + 1, F.lit(4)).alias("last"))
    response = field("WARC-Type") == "response"
    wrong = (F.col("last") != F.lit(CRLF * 2).cast("binary")) | (field("Content-Length") != F.octet_length("block").cast("string")) | (response & (field("WARC-Payload-Digest") != F.concat(F.lit("sha1:"), F.sha1("block"))))
    bad = F.raise_error(F.concat(F.lit("record differs from its header: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("binary")
    return cut.select("digest", "header", F.when(wrong, bad).otherwise(F.col("block")).alias("block"))


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """What each rebuilt record says and holds; of a revisit's payload, the size and digest of the response that holds it."""
    archive = read_archive(spark, path)
    kind = archive.schema["page_id"].dataType
    number = lambda name: F.when(F.col("header").cast("string").contains(f"{CRLF}{name}: "), field(name)).cast(kind)
    said = parsed(records(archive)).select(
        "digest", number("X-Page-ID").alias("page_id"), field("WARC-Type").alias("record_type"), number("X-Refers-To-Page").alias("refers_to"),
        F.octet_length("block").cast("long").alias("payload_bytes"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
    )
    said = materialize(said, "said")  # numbers and digests: the records themselves are read once
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    held = said.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = said.where("record_type = 'revisit'").drop("payload_bytes").join(held, "digest")
    return said.where("record_type = 'response'").select(*columns).union(revisits.select(*columns))


def write_files(rebuilt: DataFrame, folder: str, name: str = "part") -> DataFrame:
    """Write rebuilt records as .warc.gz files, a gzip member each, one file for each partition; (file, records) come back once they are asked for.

    The folder is a URI that executors reach. A task that runs again writes its file again.
    """

    def run(batches):
        import gzip

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        file, n = f"{base}/{name}-{TaskContext.get().partitionId():06}.warc.gz", 0
        with store.open_output_stream(file, compression=None) as out:
            for batch in batches:
                for record in batch.column(0):
                    out.write(gzip.compress(record.as_py(), mtime=0))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], names=["file", "records"])

    return rebuilt.select("record").mapInArrow(run, "file string, records long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    return archive_index(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN strlen(p.h) >= 1000 AND p.page_id IS DISTINCT FROM g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p.h) >= 1000 AND p.page_id IS DISTINCT FROM g.last THEN g.last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
