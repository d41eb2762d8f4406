"""Small helpers shared by the corpus operators: scratch tables and byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space; bytes
#: from 0x80 up belong to words, so ``text.translate(WORD_BYTES).split()`` gives the words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


#: Folders that were made inside the innermost :func:`settled`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``; a local master without one gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; :func:`settled` deletes what was written there."""
    path = f"{shared_dir(spark)}/keyloom-{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str, row_bytes: int = 0) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and lost executors cost nothing. Where rows are
    large, ``row_bytes`` of one, the writer looks at its buffers after every row and keeps groups of four rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    wide = {"parquet.block.size": 4 * row_bytes, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.block.size.row.check.max": 4}
    df.write.options(**(wide if row_bytes else {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._keyloom_path = path
    return back


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written; all that was written on its way is deleted after that."""
    token = _made.set(made := [])
    try:
        result = make()
    finally:
        _made.reset(token)
    out = written(result, name)
    for path in made:
        _delete(out.sparkSession, path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` that no later plan reads."""
    _delete(df.sparkSession, df._keyloom_path)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def portions(batch: pa.RecordBatch, column: int = 0, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` (text or bytes) holds some ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


class WordHashes(dict):
    """Word -> 64-bit hash, filled on first use; forgets everything beyond ``limit`` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as the signed longs that Spark stores."""
    return x.view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
