"""What the operators of this subpackage share: Arrow batches, the shared folder, fixed-size row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session once, so they need no installation of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="weftlog-")) / "weftlog_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    spark.sparkContext.addPyFile(str(to))


def bound_batches(spark: SparkSession) -> None:
    """Keep a worker's memory independent of row counts: documents can be long, so few go in a batch. Batch sizes that
    the session's owner has set stay."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all
    runs on one machine, and an error if not: executors elsewhere would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone at exit; the folder then belongs to whoever clears the shared one
        pass


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftlog-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read any more, as what came of them is settled itself."""
    for df in tables:
        path = df.__dict__.pop("_settled", None)
        if path:
            _forget(df.sparkSession, path)


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df and the given columns, computed batch by batch. make() runs once a task and gives the function that turns a
    batch into one array for each field. A column of df with the name of a new one is replaced by it."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    arrow = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=t) for x, t in zip(compute(batch), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, names=names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body's inner functions use it: as a lambda's variable it is
    not computed anew at each step, as a column that Catalyst may inline would be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
