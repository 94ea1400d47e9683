"""Helpers shared by the operators of this subpackage.

Scratch tables go to the shared folder that ``spark.checkpoint.dir`` names
(``sievekit.session``), are removed as soon as no later step reads them, and
are in any case removed when the driver's JVM ends.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word, as a Java/RE2 pattern: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
TABLE = "{}/{}.parquet"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_sievekit_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    where = Path(tempfile.mkdtemp(prefix="sievekit-ship-")) / "sievekit.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(where))
    sc._sievekit_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(TABLE.format(sf_dir.rstrip("/"), name))
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


class Scratch:
    """Written intermediate tables of one query run."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
        self._path(self.root, lambda fs, p: fs.deleteOnExit(p))

    def _path(self, where: str, act):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        return act(path.getFileSystem(sc._jsc.hadoopConfiguration()), path)

    def write(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, and lost executors cost no recomputation.

        ``batch_rows`` bounds the Arrow batches of this write alone, for rows of some MB each.
        """
        where, conf, key = f"{self.root}/{name}", self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        try:
            if batch_rows:
                conf.set(key, str(batch_rows))
            df.write.option("compression", "zstd").parquet(where)
        finally:
            conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(f"{self.root}/{name}", lambda fs, p: fs.delete(p, True))


def tidy(run):
    """A task function that gives freed memory back to the system at its end.

    Workers outlive tasks, and the C library keeps what numpy and Arrow freed;
    the workers of earlier stages would hold it while later ones run.
    """
    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _WORD_KEYS.clear()
            _WORD_KEYS.old = {}
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return tidied


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short slices of batches, so that a worker holds the results of few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit keys (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class BoundedCache(dict):
    """Values by key, made when missing; drops its older half when full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.keep(key, self.make(key) if value is None else value)

    def find(self, key):
        """The value if it is held, else None; for values that are made from more than the key."""
        value = self.get(key)
        return self.old.get(key) if value is None else value

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD_KEYS = BoundedCache(xxhash.xxh3_64_intdigest, 100_000)


def word_keys(text: bytes) -> np.ndarray:
    """64-bit keys of the text's words."""
    words = text.split()
    return np.fromiter(map(_WORD_KEYS.__getitem__, words), np.uint64, len(words))


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest ones first: high ones that are mostly 0 compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
