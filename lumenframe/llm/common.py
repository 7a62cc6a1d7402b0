"""Shared plumbing: Arrow scans of whole texts in bounded blocks, and tables in the shared folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of text that a Python worker handles at once; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20

#: Bits of a bitmap of keys that is sent to all executors, whatever their number: 2 MB.
BITS = 1 << 24

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


def lower_col(col):
    """The same as :func:`ascii_lower`, as a Spark column."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master that names none gets a temporary one, any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = _local_dir()
    return base.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lumenframe-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    if df is not None:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_table(df.sparkSession, folder)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def parted(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is certainly not among ``keys`` (one column of the same name), and the others, by a bitmap of fixed size.

    The first can stay where they are; only the others need to meet the keys.
    """
    at = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    marked = df.withColumns({"__bucket": F.bitmap_bucket_number(at), "__bit": F.bitmap_bit_position(at)}).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))
    return tuple(marked.where(test).select(*map(quoted, df.columns)) for test in (~held, held))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with at most ``limit`` bytes of text each, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def arrow_schema(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def map_texts(df: DataFrame, text: str, fn: Callable[[list[str | None]], dict[str, list]], added: str, keep: list[str], *, limit: int = BLOCK_BYTES, make: Callable | None = None) -> DataFrame:
    """Append the columns ``added`` (DDL) that ``fn`` derives from a block of whole texts; of the others pass on ``keep``.

    A narrow map: rows stay where they are, in bounded blocks. ``make``, where given, is called once a task and
    returns the ``fn`` to use, so that tables are built on the executor.
    """
    more = T.StructType.fromDDL(added) if isinstance(added, str) else added
    out = T.StructType([df.schema[k] for k in keep] + list(more))
    cols = [quoted(c) for c in dict.fromkeys([*keep, text])]

    def run(batches):
        use = make() if make else fn
        kinds = arrow_schema(out)
        for block in blocks(batches, text, limit):
            made = use(block.column(text).to_pylist())
            columns = [block.column(k).cast(kinds.field(k).type) for k in keep]
            columns += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], kinds.field(f.name).type) for f in more]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)
        # workers outlive their tasks: what Arrow holds in reserve goes back to the system
        pa.default_memory_pool().release_unused()

    return df.select(*cols).mapInArrow(run, out)


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def renamed(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The frame with neutral column names, which no added column can clash with, and its text's new name; ``toDF(*names)`` undoes it."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names[df.columns.index(text)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
