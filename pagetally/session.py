"""Session settings for the jobs, and the shared folder they may write to."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Adaptive execution merges shuffle partitions that turn out small but adds none, so a
# large run has to set ``spark.sql.shuffle.partitions``: about the input in units of 128 MB.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state lives on local disk with a bounded memory share instead
    # of in the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch uploads what it changed, not the whole state, and looks no key up
    # only to keep a row count.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def build_session(
    app_name: str = "pagetally",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Start a session; leave ``master`` unset under spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_used_roots: set[str] = set()
# The folders named in the innermost ``scratch`` block, if there is one.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def _local_path(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


# Local paths that were seen to be shared by the executors.
_shown_shared: set[str] = set()


def _show_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless the driver and every executor see one another's files in a local path.

    The path of a mount that all machines share looks like one on a machine's own disk, so it is
    tried: each task writes a file, the driver finds them all, and other tasks read them. There are
    two tasks per core or executor, whichever are more, so that all executors that are there by now get some.
    """
    executors = spark._jsc.sc().getExecutorMemoryStatus().size()
    tasks = 2 * max(executors, spark.sparkContext.defaultParallelism)
    path = f"{folder}/trial-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        rows = spark.read.schema("id long").parquet(path)
        seen = rows.selectExpr("count(*)", "count(DISTINCT id)").first()
    finally:
        _delete_quietly(path, spark._jsc.hadoopConfiguration())
    if tuple(seen) != (tasks, tasks):
        raise OSError(f"the driver sees {seen[0]} of {tasks} files that executors wrote")


def work_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; see ``shared_dir``."""
    refused, reason = [], None
    for setting in ("spark.checkpoint.dir", "spark.sql.warehouse.dir"):
        if not (root := spark.conf.get(setting, None)):
            continue
        folder = f"{root.rstrip('/')}/pagetally/{spark.sparkContext.applicationId}"
        if (spark.sparkContext.master.startswith("local") or not _local_path(spark, root)
                or folder in _shown_shared):
            return folder
        try:
            _show_shared(spark, folder)
        except Exception as error:  # whatever hinders it, nothing shows that the folder is shared
            refused.append(root)
            reason = error
        else:
            _shown_shared.add(folder)
            return folder
    raise ValueError(
        f"set spark.checkpoint.dir to a folder all executors share, not {' or '.join(refused)}") from reason


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    Every executor must reach it, so on a cluster a local path is tried first and refused if it
    is not shared. Where the setting is missing or refused, the warehouse, which is shared too,
    takes its place. Results that are not read yet may need the folder, so it is deleted when the
    Python process ends.
    """
    root = work_root(spark)
    if root not in _used_roots:
        _used_roots.add(root)
        atexit.register(_delete_quietly, root, spark._jsc.hadoopConfiguration())
    path = f"{root}/{purpose}-{uuid.uuid4().hex}"
    if (owned := _scope.get()) is not None:
        owned.append(path)
    return path


@contextlib.contextmanager
def _within(owned: list[str] | None) -> Iterator[None]:
    token = _scope.set(owned)
    try:
        yield
    finally:
        _scope.reset(token)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[], contextlib.AbstractContextManager[None]]]:
    """Delete the shared folders named inside when the block ends, by an exception too.

    What is returned from the block must not read them. Gives a function for results that
    outlive it: folders named under ``with outside():`` belong to the block around this one, or
    stay until the process ends if there is none.
    """
    outer, owned = _scope.get(), []
    try:
        with _within(owned):
            yield lambda: _within(outer)
    finally:
        for path in owned:
            _delete_quietly(path, spark._jsc.hadoopConfiguration())


def _delete_quietly(root: str, configuration) -> None:
    # The session may have been stopped by now; its Java process is still there.
    with contextlib.suppress(Exception):
        path = SparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(configuration).delete(path, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
