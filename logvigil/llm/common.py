"""What several operators share: input views, the shared folder, sorted streams and components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the tasks this package, once for an application: Spark serves the archive, as with ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="logvigil-package-")) / "logvigil.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty), whatever other columns there are."""
    ship(docs.sparkSession)
    return docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of single-byte characters take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``, else the one set on the context.

    Only on a single machine (a local master, as in tests) may it be unset; a folder of its own is used then.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logvigil-shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so that a lost executor costs no rerun."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """``df`` as a compressed table in the shared folder: smaller than a checkpoint where rows are wide.

    ``tidy`` lets Spark remove the shuffle files of this one job when it ends: the table is what later ones read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None) if tidy else None
    try:
        if tidy:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Delete the tables made by ``written`` that ``table`` reads, once nothing needs them any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def placed_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, bucketed by ``key``: joins and windows on it shuffle the other side only. See ``dropped``."""
    spark = df.sparkSession
    table, count = f"{name}_{uuid.uuid4().hex}", partitions(spark)
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.repartition(count, key).write.bucketBy(count, key).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option(
            "path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.table(table)


def dropped(table: DataFrame, name: str) -> None:
    """Delete a table made by ``placed_by`` and its entry in the catalog."""
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    removed(table)
    for folder in folders:
        if (entry := folder.rsplit("/", 1)[1]).startswith(f"{name}_"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {entry}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut so that no group is split; holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = int(starts[-1]) if len(starts) else 0
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has two long columns ``a`` and ``b``. Returns ``node`` and ``root``, the smallest node
    of its component, for every node with an edge. Each round is two grouped minima joined back to the
    edges, is written to the shared folder, and roughly halves the depth. Nothing but two figures per
    round reaches the driver. A node with very many edges is one key of a join, which Spark splits.
    """
    stars = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        ).filter("a <> b").distinct()
        stars = checkpointed(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
