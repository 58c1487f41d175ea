"""Vector, graph and table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schemas
from recollect.operators.graph import Graph


def read_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(id, embedding) from parquet, JSON lines of rows, or JSON snapshots ``{dimension, vectors: {id: [...]}}``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.schema("id string, embedding array<float>").json(path)
    # A snapshot is one object over many lines ("document") or, as written here, one object per line ("snapshot").
    raw = spark.read.schema(schemas.VECTOR_SNAPSHOT).json(path, multiLine=fmt == "document")
    return raw.select(F.explode("vectors").alias("id", "embedding"))


SNAPSHOT_ROWS = 1000


def write_vectors(vectors: DataFrame, path: str, fmt: str = "parquet", rows: int = SNAPSHOT_ROWS) -> None:
    """Write (id, embedding). The snapshot form is one JSON object per about ``rows`` ids, however many there are."""
    if fmt == "parquet":
        vectors.write.mode("overwrite").parquet(path)
    elif fmt == "json":
        vectors.select(F.col("id").cast("string").alias("id"), "embedding").write.mode("overwrite").json(path)
    elif fmt == "snapshot":
        buckets = max(1, -(-vectors.count() // rows))
        grouped = vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")).agg(
            F.max(F.size("embedding")).alias("dimension"),
            F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "embedding"))).alias("vectors"),
        )
        grouped.select("dimension", "vectors").write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_graph(graph: Graph, path: str) -> None:
    """Three parquet tables below one folder."""
    for name, frame in zip(Graph._fields, graph):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/{name}") for name in Graph._fields])


def read_graph_snapshot(spark: SparkSession, path: str, multi_line: bool = True) -> Graph:
    """Graph tables from JSON documents holding entities, relations and the link maps."""
    raw = spark.read.schema(schemas.GRAPH_SNAPSHOT).json(path, multiLine=multi_line)
    entities = raw.select(F.inline("entities")).select(F.col("id").alias("entity_id"), "name", "type")
    relations = raw.select(F.inline("relations")).select(
        F.col("subjectId").alias("src"), "predicate", F.col("objectId").alias("dst"), F.col("memoryId").alias("memory_id")
    )
    forward = raw.select(F.explode("entityToMemories").alias("entity_id", "ms")).select("entity_id", F.explode("ms").alias("memory_id"))
    back = raw.select(F.explode("memoryToEntities").alias("memory_id", "es")).select(F.explode("es").alias("entity_id"), "memory_id")
    return Graph(entities, relations, forward.unionByName(back).distinct())


def open_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four tables of a store below one folder; a table not written yet is empty."""
    out = {}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, schema in schemas.STORE.items():
        where = hadoop(f"{root}/{name}")
        exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        out[name] = spark.read.schema(schema).parquet(f"{root}/{name}") if exists else spark.createDataFrame([], schema)
    return out


def save_store(store: dict[str, DataFrame], root: str) -> None:
    """Write tables of a store; memory items are partitioned by type. ``root`` must not be the folder they come from."""
    for name, frame in store.items():
        writer = frame.write.mode("overwrite")
        if name == "memory_items":
            writer = writer.partitionBy("memory_type")
        writer.parquet(f"{root}/{name}")


def read_json_map(column: str):
    """Metadata kept as JSON text; what cannot be read becomes an empty map."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))
