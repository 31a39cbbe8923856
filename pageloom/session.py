"""Session settings the engine is built for, and the shared working folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are wide rows: small Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    _PROVIDER: _ROCKSDB,
}


#: Working folder of local sessions that name none.
LOCAL_SHARED = f"{tempfile.gettempdir()}/pageloom-shared"

_made: dict[str, list[str]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


def build(name: str = "pageloom", **extra: str) -> SparkSession:
    """Session with the engine's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_state_on_disk(spark: SparkSession) -> None:
    """The state store that state processors need, for sessions not made by ``build``."""
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def keep_batches_small(spark: SparkSession) -> None:
    """Input batches of a few MB for workers that read whole pages or texts, for sessions
    not made by ``build``: a worker holds two of them, and the default of 64 MB would be
    most of its memory."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the place all executors see.

    A local session that names none uses ``LOCAL_SHARED``; on a cluster no machine's
    own folder will do.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = LOCAL_SHARED
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(_owner.get(), []).append(path)
    return path


@contextlib.contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Folders made within belong to ``owner``, so that several jobs of one process
    can each drop their own."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts lineage in a way that outlives lost executors, and lets a table be
    measured or used twice at the price of one scan.  It stays until the caller
    of the job calls ``drop_stored``.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, owner: str = "") -> int:
    """Removes what ``owner`` has put below the shared folder; returns how many.

    For the owner of a job, once its results are written: frames that were not
    yet computed need these tables.
    """
    dropped = 0
    for text in _made.pop(owner, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        dropped += bool(files.delete(path, True))
    return dropped
