"""What the corpus operators share: the shared folder, written tables, Arrow batches, random keys."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts of 100 KB give batches of 25 MB.
BATCH_ROWS = 256

_own: dict[str, str] = {}
_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as a URI.

    It is what the session names in ``spark.checkpoint.dir``, else the context's checkpoint directory. Where neither
    is set a temporary folder is made and set if all tasks run in this process; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='eventloom-')}")
        spark.sparkContext.setCheckpointDir(made)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Spark deletes the shuffle files of a query that ran under this setting when it ends, not when the driver happens to
#: collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scratch: list[list] = []


@contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """Drops the tables written inside when it ends well or not, but those of the names in ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        for table in _scratch.pop():
            if table.name in keep:
                if _scratch:
                    _scratch[-1].append(table)
            else:
                table.drop()


class Written:
    """A table written to the shared folder: its lineage ends there, so a lost executor costs a read, no recomputation.

    What the write shuffled is deleted at its end.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.name = df.sparkSession, name
        if _scratch:
            _scratch[-1].append(self)
        self.path = fresh_path(self.spark, name)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


#: Sizes up to which Spark gathers a join's side on the driver: as guessed before a run, and as measured when it was shuffled.
GUESSED = "spark.sql.autoBroadcastJoinThreshold"
MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What runs inside gathers a join's side on the driver only if its rows, as measured, are within the session's limit.

    The guess goes by compressed files and ignores that rows are multiplied, so it may be a hundred times too low.
    """
    before = {k: spark.conf.get(k, None) for k in (GUESSED, MEASURED)}
    if before[MEASURED] is None:
        spark.conf.set(MEASURED, spark.conf.get(GUESSED))
    spark.conf.set(GUESSED, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package once a context, whatever paths they were started with."""
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="eventloom-code-")).resolve() / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped["to"] = context.applicationId


def bounded_batches(spark: SparkSession) -> None:
    """Readies a session for passes in Python: the code is shipped, and Spark's default Arrow batch, made for narrow rows,
    is lowered to one that holds long texts. Own settings stay."""
    ship_code(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, text: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """A narrow pass over texts in Python: no shuffle, one Arrow batch in memory at a time.

    ``make`` is called once a task and gives the function from a batch's texts (None for null) to columns by name.
    ``keep`` maps the columns that go along unchanged to their names in the result; ``schema`` names all columns.
    """
    keep = keep or {}
    bounded_batches(df.sparkSession)
    inner = df.select(F.col(text).cast("string").alias("_text"), *[F.col(a).alias(f"_keep{i}") for i, a in enumerate(keep)])
    out = list(keep.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(batch.column(0).to_pylist())
            columns = [batch.column(i + 1) for i in range(len(out))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()]
            yield pa.RecordBatch.from_arrays(columns, names=[*out, *made])

    return inner.mapInArrow(run, schema)


def packed(df: DataFrame) -> Column:
    """All columns as one, so that names of one's own cannot clash with theirs; ``_all.*`` unpacks them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_all")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two XXH64 with independent seeds (null and empty alike)."""
    held = F.coalesce(text, F.lit(""))
    return [F.xxhash64(held).alias("_k1"), F.xxhash64(F.lit(1), held).alias("_k2")]


def integer_id(df: DataFrame, keep: str) -> None:
    """Operators that compare ids or number by them take integers; other kinds are refused, not cast to null."""
    kind = df.schema[keep].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{keep} is {kind}; ids must be integers here")
