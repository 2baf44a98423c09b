"""What the operators of this subpackage share: tables, scratch tables in the shared folder, Arrow maps, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a scratch table are deleted at the end of the process, or as soon as an operator knows that nobody reads them.
_SCRATCH: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}
#: Fixed-width tables are broadcast up to so many bytes, as counted before; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and all tasks run in this process (local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
        found = _OWN.setdefault("dir", "") or _OWN.update(dir=tempfile.mkdtemp(prefix="chainlens-scratch-")) or _OWN["dir"]
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone: its owner cleans the folder
            return


atexit.register(_sweep)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a written table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chainlens/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chainlens_path = path
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows were counted, marked for broadcast if it is small. Its columns must be of fixed width."""
    width = sum(8 * (1 + (f.dataType.typeName() in ("binary", "string"))) for f in df.schema.fields)  # digests have 16 bytes
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def measured(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its measured bytes are few; for tables whose columns may be of any width."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("binary", "string")]
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in wide:
        size += F.coalesce(F.octet_length(c), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def dropped(df: DataFrame) -> None:
    """Deletes the table of stored()."""
    if path := getattr(df, "_chainlens_path", None):
        delete(df.sparkSession, path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores at its end as keep it apart from those taken (names differ by more than case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


def pieces(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size, so that the working memory of an operator doesn't grow with the batch."""
    n = batch.num_rows
    step = max(1, int(n * most_bytes / max(1, batch.nbytes))) if n else 1
    for at in range(0, n, step):
        yield batch.slice(at, step)


#: How to let go of what an operator keeps in a worker for its next task, by the operator's name.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, clear: Callable[[], None]) -> None:
    """The operator of that name keeps something in its workers, which clear() frees."""
    _KEPT[name] = clear


def make_room(keeps: str = "") -> None:
    """Frees what other operators than keeps have left in this worker: workers live on, and stand beside an executor's heap."""
    for name, clear in _KEPT.items():
        if name != keeps:
            clear()


def give_back(keeps: str = "") -> None:
    """Ends a task's work: caches go, and freed memory goes back to the system, as workers live on beside others."""
    _WORDS.clear()
    make_room(keeps)
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most_bytes: int = 4 << 20, keeps: str = "") -> DataFrame:
    """df.mapInArrow, with fn called on slices of bounded size; keeps: the operator, if it has something for its next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(keeps)
        for batch in batches:
            for part in pieces(batch, most_bytes):
                yield fn(part)
        give_back(keeps)

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """64-bit hashes of words; a cache of bounded size."""

    MOST = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = WordHash()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_hashes(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words (lower case, split at white space) of each text, and where each text's begin (one more entry than texts).

    A text of fewer words, but one at least, has one shingle: all its words. A text without words has none.
    """
    get = _WORDS.__getitem__
    words: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.lower().split()
        counts[i] = len(found)
        words.extend(map(get, found))
    w = np.array(words, np.uint64)
    at = np.concatenate(([0], np.cumsum(counts)))
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    total = int(begin[-1])
    if not total:
        return np.zeros(0, np.uint64), begin
    # the position of each shingle's first word
    first = np.arange(total) - np.repeat(begin[:-1], n) + np.repeat(at[:-1], n)
    size = np.repeat(np.minimum(counts, width), n)
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate((w, np.zeros(width, np.uint64)))
    for j in range(width):
        part = (padded[first + j] ^ np.uint64(j)) * _ODD[j % 5] + np.uint64(j // 5)
        part ^= part >> np.uint64(29)
        out += np.where(size > j, part, np.uint64(0))
    return mix(out), begin
