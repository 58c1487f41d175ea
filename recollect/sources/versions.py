"""Stored tables that change as a whole: versioned folders and a manifest that is put in place atomically.

A table is a folder with ``data/<id>``, one Parquet folder per version, and ``log/<number>.json``, one manifest per version that names its
folder. A change writes its data first, where no reader looks, and then creates the next manifest; the file system creates a file
that must not exist yet for one writer only, so of two writers that have read the same version one gets :class:`Conflict` and may
read again. A writer that dies before the manifest leaves a folder that no version names; :func:`vacuum` removes it. Readers see the version
whose manifest has the highest number, and go on reading it while the next is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import tables as T


class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(where)] if fs.exists(where) else []


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    fs, where = _fs(spark, f"{path}/log/{version:012d}.json")
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version; 0 for a table that was never written."""
    numbers = [int(n[:12]) for n in _names(spark, f"{path}/log") if n.endswith(".json") and n[:12].isdigit()]
    return max(numbers, default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """A version of a table, the newest by default; with a ``schema``, a table never written is empty."""
    number = current_version(spark, path) if version is None else version
    if number == 0:
        if schema is None:
            raise FileNotFoundError(f"no version of {path}")
        return spark.createDataFrame([], schema)
    entry = _manifest(spark, path, number)
    return spark.read.schema(entry["schema"]).parquet(f"{path}/data/{entry['data']}")


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch of a stream that reached the table; -1 before the first."""
    version = current_version(spark, path)
    return _manifest(spark, path, version).get("batch", -1) if version else -1


def commit(df: DataFrame, path: str, read: int, batch: int | None = None) -> int:
    """Put a frame in place as the version after ``read``, the one that the change was made from; its number."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    entry = {"data": name, "schema": schema} | ({} if batch is None else {"batch": batch})
    put_manifest(spark, path, read + 1, entry)
    return read + 1


def put_manifest(spark: SparkSession, path: str, version: int, entry: dict) -> None:
    fs, where = _fs(spark, f"{path}/log/{version:012d}.json")
    _, hidden = _fs(spark, f"{path}/log/.{uuid.uuid4().hex}")
    if current_version(spark, path) >= version:
        raise Conflict(f"version {version} of {path} exists")
    # The manifest is whole under a hidden name before it gets its own, which a rename gives to one writer only.
    stream = fs.create(hidden, False)
    stream.write(bytearray(json.dumps(entry).encode()))
    stream.close()
    try:
        options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(hidden), fs.makeQualified(where), options)
    except Exception as error:
        fs.delete(hidden, False)
        if fs.exists(where):
            raise Conflict(f"version {version} of {path} exists") from error
        raise


def change(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], schema: str | None = None, tries: int = 5) -> int:
    """Replace a table by what ``make`` makes of it; on a conflict it is read and made again."""
    for left in reversed(range(tries)):
        read = current_version(spark, path)
        try:
            return commit(make(read_version(spark, path, read or None, schema)), path, read)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, key: str | Sequence[str], version: str | None = None) -> int:
    """Insert or replace rows by key in a stored table, see :func:`recollect.operators.tables.upsert`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != version)
    return change(spark, path, lambda old: T.upsert(old, rows, key, version), schema)


def clear_table(spark: SparkSession, path: str) -> int:
    """Empty a stored table; the number of rows that it had."""
    while True:
        read = current_version(spark, path)
        if read == 0:
            return 0
        old = read_version(spark, path, read)
        try:
            commit(old.limit(0), path, read)
            return old.count()
        except Conflict:
            continue


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the newest versions, and data that no version names. No writer may be at work."""
    newest = current_version(spark, path)
    kept = {_manifest(spark, path, v)["data"] for v in range(max(1, newest - keep + 1), newest + 1)}
    for name in _names(spark, f"{path}/log"):
        if name.startswith(".") or name.endswith(".json") and int(name[:12]) <= newest - keep:
            fs, where = _fs(spark, f"{path}/log/{name}")
            fs.delete(where, False)
    for name in _names(spark, f"{path}/data"):
        if name not in kept:
            fs, where = _fs(spark, f"{path}/data/{name}")
            fs.delete(where, True)


def merge_notes(spark: SparkSession, path: str, notes: DataFrame, batch: int) -> None:
    """Merge the notes (task_id, note_id, seq) of a stream's batch into a stored table of the latest note per task; a batch that comes again changes nothing."""
    if batch <= last_batch(spark, path):
        return
    read = current_version(spark, path)
    old = read_version(spark, path, read or None, "task_id int, note_id string, seq long").select("task_id", "note_id", "seq")
    new = notes.select(F.col("task_id").cast("int").alias("task_id"), F.col("note_id").cast("string").alias("note_id"), F.col("seq").cast("long").alias("seq"))
    latest = old.unionByName(new).groupBy("task_id").agg(F.max_by("note_id", "seq").alias("note_id"), F.max("seq").alias("seq"))
    commit(latest, path, read, batch)
