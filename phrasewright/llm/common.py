"""What the operators share: reading tables, shipping code to executors, cutting lineage, names that cannot clash."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship as ship_source

__all__ = ["discard", "few", "fresh", "materialise", "partitions", "plan_bytes", "released", "shared_folder", "ship", "table", "tasks_for", "vocabulary"]

#: Text that a task of a derived table should hold at least; smaller ones are taken together, so that tables do not fall into many small files.
TASK_BYTES = 4 << 20
#: Bytes of files for each core below which a table is small.
SMALL_SHARE = 4 << 20
#: Up to so many rows of an id and a few short values (64 bytes each, with room to spare), a counted table is sent to every task.
BROADCAST_ROWS = 1_000_000
#: The tables written in the run at hand; None outside of released().
_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)
#: Tables of single queries, deleted when the driver ends.
_LEFT: dict[str, SparkSession] = {}


#: Rows and bytes of an Arrow batch at most, unless a session says otherwise: texts are long, and a batch is held several times over, in the JVM and in a worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2500"), "spark.sql.execution.arrow.maxBytesPerBatch": (f"{64 << 20}b", f"{4 << 20}b")}


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, and keep Arrow batches of texts small where the session has Spark's own defaults."""
    ship_source(spark)
    for key, (usual, ours) in BATCHES.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data, dealt out anew where it is so small that its files would keep few cores busy; no result depends on that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SMALL_SHARE else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one in the warehouse if that is no local folder;
    a fresh local one only if everything runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="phrasewright-")
        else:
            warehouse = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
            if warehouse.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = str(warehouse).rstrip("/") + "/_phrasewright"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size to be; for a scan, the size of its files. No job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, short: bool = False) -> int:
    """Into how many tasks tables derived from df are written at most: a few for each core, and more where df is large or of unknown size.
    short: tables of a few numbers for a text, one for each core and for each eight times as many bytes of text."""
    size, cores = min(1 << 60, plan_bytes(df)), df.sparkSession.sparkContext.defaultParallelism
    return max(cores if short else 4 * cores, min(1 << 20, size // (TASK_BYTES * (8 if short else 1))))


def materialise(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder, by so many tasks at most, and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    run = _RUN.get()
    if run is not None:
        run.append(path)
    else:
        if not _LEFT:
            atexit.register(_delete_left)
        _LEFT[path] = spark
    (df.coalesce(tasks) if tasks else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["shared_path"] = path
    return out


def few(written: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a written table of short rows is small enough to be sent to every task; it is counted."""
    return written.count() <= most


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    run = _RUN.get()
    if run is not None and path in run:
        run.remove(path)
    _LEFT.pop(path, None)


def _delete_left() -> None:
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote; only for frames nothing lazy still reads."""
    path = df.__dict__.get("shared_path")
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """A run whose tables are deleted at its end, but for those of the frames put into the list: for when all that reads them is itself written.

    Only what this run's own context writes is deleted; other runs and queries of the same driver keep their tables.
    """
    kept: list[DataFrame] = []
    outer = _RUN.get()
    token = _RUN.set([])
    try:
        yield kept
    finally:
        own, keep = list(_RUN.get() or ()), {df.__dict__.get("shared_path") for df in kept}
        for path in own:
            if path not in keep:
                _delete(spark, path)
        _RUN.reset(token)
        for path in keep.intersection(own):
            if outer is not None:
                outer.append(path)
            else:
                if not _LEFT:
                    atexit.register(_delete_left)
                _LEFT[path] = spark


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names like these that are not among those taken, whatever their case."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the same on driver and executors, where the package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
