"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE_CLASS = " \\t\\n\\x0B\\f\\r"
WORD = f"[^{SPACE_CLASS}]+"
_WORD = re.compile(r"\w+")
_ASCII_WORD = bytes(c if c >= 128 or c == 0 or c == 95 or chr(c).isalnum() else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where the setting is absent and driver and executors are one process, a fresh one of this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scriptorium-")
        sc.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns a reader of it.

    Cuts the lineage: a lost executor costs a reread of files that every executor sees. spent:
    tables made by this function that nothing needs any more once df is written; they go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in spent:
        place = spark._jvm.org.apache.hadoop.fs.Path(old.scratch)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


@contextmanager
def arrow_limits(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """Bounds what Spark puts into one Arrow batch while the block runs an action; afterwards the session is as it was."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows and about `size` bytes. Spark bounds what it sends by its own settings, which stay as the session has them."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 4000, size: int = 8 << 20) -> DataFrame:
    """df.mapInArrow(run, schema), run being given batches of bounded size, so that long texts don't fill a Python worker."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(slices(batches, rows, size))

    return df.mapInArrow(sliced, schema)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def cut_words(texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
    """(words of all texts, lengths): what words_of gives for each, cut in one go."""
    joined = " \0 ".join([(t or "").lower().replace("\0", " ") for t in texts]) + " \0 "
    for c in set(joined):
        if c >= "\x80" and not c.isalnum():
            joined = joined.replace(c, " ")
    parts = pc.split_pattern(pa.array([joined.encode().translate(_ASCII_WORD)], pa.binary()).cast(pa.large_string()), " ").flatten()
    parts = parts.filter(pc.greater(pc.binary_length(parts), 0))
    ends = np.flatnonzero(pc.equal(parts, "\0").to_numpy(zero_copy_only=False))
    return parts, np.diff(np.r_[-1, ends]) - 1


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
