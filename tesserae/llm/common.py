"""What the corpus operators share: written intermediate tables, batches of texts, words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space and \x09-\x0D, in every encoding-independent form the operators need.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Texts are handled in slices of about so many bytes, whatever size the Arrow batches have.
SLICE_BYTES = 512 << 10



def _give_back() -> None:
    """Let freed arrays go back to the system at once: a worker lives on through many tasks.

    Arrow takes plain memory, and the C library maps blocks of 2 MB and more one by one (option -3) and keeps 4 MB
    of freed memory at most (option -1). Where it has no such options nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-3, 2 << 20)
        option(-1, 4 << 20)


_give_back()

#: Arrow batches sent to Python workers hold about so many bytes.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small; Spark's own bound counts rows and allows 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset (tests, local mode), a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and columns can be pruned later.

    The table stays until the driver ends, as frames that read it may be lazy.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    atexit.register(_forget, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM has ended: the folder goes with its owner
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice hold about `limit` bytes; one text is never cut."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets of its values in them (null: empty)."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_binary()), b"")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each output bit depends on all input bits (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 19)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums h, so that (h[b] - h[a]) * base ** -a is the same for equal byte strings."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up[:-1], out=out[1:])
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray, separates: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the texts of a buffer, and for each the index of its text."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~separates[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    opens = inside[1:] & (~inside[:-1] | cut)
    closes = inside[:-1] & (~inside[1:] | cut)
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    h = prefix_hashes(_LOWER[raw])
    _, down = powers(len(raw) + 1)
    return mix64((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
