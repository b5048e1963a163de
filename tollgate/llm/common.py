"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Maps the bytes A-Z of UTF-8 text to a-z and leaves every other byte.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: A-Z lower-cased; digits, letters and bytes of other scripts kept; the rest a space.
PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


#: Bytes of an Arrow batch, beyond which a new one begins.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the folder of ``spark.checkpoint.dir``
    and reread: its lineage ends there, so a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder that ``written`` made for this frame, once nothing that
    is still to be computed reads it."""
    path = df.__dict__.pop("written_to", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _lowered(spark: SparkSession, key: str, most: int) -> None:
    """A setting that Spark knows for the session only: lowered to ``most``, never raised."""
    now = int(str(spark.conf.get(key)).rstrip("b"))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def small_scans(df: DataFrame, records: int = 512) -> DataFrame:
    """Caps the rows of one batch of a Parquet scan: a task holds a batch of whole texts in
    arrays that stay, at Spark's 4,096 rows eight times as large."""
    _lowered(df.sparkSession, "spark.sql.parquet.columnarReaderBatchSize", records)
    return df


def small_batches(df: DataFrame, records: int, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Ships this package and caps the rows and the bytes of one Arrow batch, and the rows
    of one batch of a scan, so that a batch of very long texts fits a Python worker."""
    ship(df.sparkSession)
    for key, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", most_bytes)):
        _lowered(df.sparkSession, f"spark.sql.execution.arrow.{key}", most)
    return small_scans(df, records)


def released(run):
    """``run`` for ``mapInArrow``; once it ends, its worker returns the memory that freed arrays
    leave with the allocators, since the worker stays for later tasks of other kinds."""
    def whole(batches):
        yield from run(batches)
        _return_memory()

    return whole


def _return_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fold_case(c: Column) -> Column:
    """A-Z lower-cased, every other character left as it is."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text after A-Z lower-casing, as
    UTF-8 bytes.  ``bytes.split`` cuts at exactly those six bytes."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased letters and characters of other scripts."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def fold_number(doc_id) -> int:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def map_arrow(df: DataFrame, make, fields: str, keep: list[str], records: int = 512) -> DataFrame:
    """``df`` through ``make()`` in Arrow batches.  ``make`` is called once in
    each task and returns a function from a batch to a dict of columns; the
    columns in ``keep`` keep their types, ``fields`` names the new ones."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(fields).fields)

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                cols = work(batch)
                arrays = [cols[f.name] for f in schema.fields]
                yield pa.RecordBatch.from_arrays(
                    [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays],
                    names=schema.fieldNames())

    return small_batches(df, records).mapInArrow(released(run), schema)
