"""What the operators share: tables in the shared folder, words, hashes of word runs, and links to components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import work_path

#: White space between words, in Java's and Python's pattern syntax.
BLANKS = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SHINGLE_WORDS = 5
SIMILARITY = 0.8
FILTER_BITS = 1 << 24  # of the bitmap that says which keys are wanted: 2 MB, whatever their number


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a finished query's shuffle files are removed at once; they would stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: The paths that :func:`saved` has written inside the open :func:`scratch` blocks, innermost last.
_open: list[list[str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps neither repeat it nor need the same executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with dropped_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Remove tables of :func:`saved` that no later step reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            _remove(df.sparkSession, file.rpartition("/")[0])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables saved inside are removed at the end, but for those written by the function that the block gets."""
    _open.append([])
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = saved(df, name)
        kept.append(_open[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _open.pop():
            _remove(spark, path)
        if _open:
            _open[-1].extend(kept)


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among those of ``wanted`` (key), and a few others that share a bit with one.

    A join behind it shuffles little more than the rows it finds: a bitmap of ``FILTER_BITS`` bits of hashed keys travels to the tasks that read the rows.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """The UTF-8 words of a text, split at ASCII white space; bytes.lower() changes A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (one-to-one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; with fewer words one hash of all of them; none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed(out + hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
