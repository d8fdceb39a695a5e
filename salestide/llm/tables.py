"""Input tables, the shared folder, and small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What separates words, as a regular-expression class body and a word.
SEPARATORS = r"\x20\x09-\x0D"
WORD = rf"[^{SEPARATORS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as
    on one machine in tests, is a temporary folder used.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cut(frame: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder; Spark removes the files with the frame."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """All words in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def in_order(frame: DataFrame, *keys: str) -> DataFrame:
    """Adds ``_rank``, the 0-based place in the order of ``keys`` (nulls last).

    Rows are range-partitioned and ranked inside each partition; what reaches the
    driver is one count for each partition.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    parted = cut(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    counts = sorted(parted.groupBy("_part").count().collect())
    starts, so_far = [], 0
    for part, n in counts:
        starts.append((part, so_far))
        so_far += n
    spark = frame.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parted.join(offsets, "_part")
        .withColumn("_rank", F.col("_start") + place - 1)
        .drop("_part", "_start")
    )


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once for a session."""
    context = spark.sparkContext
    if getattr(context, "_salestide_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._salestide_shipped = True
