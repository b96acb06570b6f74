"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

_own_dir: str | None = None

#: Deletes the shuffle files of an execution when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What the tasks of one worker share: each operator's own store, emptied when an operator that needs none begins.
KEPT: list[dict] = []


def worker_store() -> dict:
    """A store that outlives a task in its worker, until ``forget``."""
    KEPT.append({})
    return KEPT[-1]


def forget() -> None:
    """Give back what earlier operators' tasks keep in this worker, to the system too."""
    for store in KEPT:
        store.clear()
    trim()


def trim() -> None:
    """Give memory that this worker has freed back to the system, which allocators keep otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process (tests)."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="quillmap-")
    return _own_dir


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class Table:
    """A written table. ``df`` reads it again; ``drop`` deletes its files once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self._schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        fs, jpath = _fs(self.spark, self.path)
        fs.delete(jpath, True)


def written(df: DataFrame, name: str) -> Table:
    """Write ``df`` to the shared folder and read it from there: lost executors then cost no recomputation.

    The files go when the application ends, or earlier with ``drop``. What the write has shuffled goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmap-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    fs, jpath = _fs(spark, path)
    fs.deleteOnExit(jpath)
    return Table(spark, path, df.schema)


class Shield:
    """Columns of ``docs`` whose names an operator needs for itself, renamed while it works.

    ``added`` are the names that it adds: such columns of the input are replaced.
    """

    def __init__(self, docs: DataFrame, own: tuple[str, ...], added: tuple[str, ...] = ()):
        docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
        self.back = {f"{c}_{uuid.uuid4().hex}": c for c in docs.columns if c.lower() in own}
        self.df = docs.withColumnsRenamed({c: safe for safe, c in self.back.items()})

    def restored(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(self.back)


#: Bits of an id filter: 1 MB whatever the number of ids.
FILTER_BITS = 1 << 23


def _slot(ids):
    """A bit for each id, alike in Spark (below) and numpy: the id's low bits mixed with its high ones."""
    x = np.asarray(ids, dtype=np.int64)
    return (x ^ (x >> 23) ^ (x >> 46)) & (FILTER_BITS - 1)


def id_filter(ids: DataFrame, column: str = "id"):
    """A broadcast bitmap that says of an id whether it may be in ``ids``; it never denies one that is.

    Built by bitmap aggregation, so the driver gets 256 rows of 4 KB at most. With very many ids it lets all pass, and
    the join that follows does the work alone.
    """
    x = F.col(column)
    slot = x.bitwiseXOR(F.shiftright(x, 23)).bitwiseXOR(F.shiftright(x, 46)).bitwiseAND(FILTER_BITS - 1)
    rows = ids.where(x.isNotNull()).select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    words = np.zeros(FILTER_BITS // 8 + 8192, dtype=np.uint8)
    at = ids.sparkSession.range(1).select(F.bitmap_bucket_number(F.lit(0)).alias("zero"), F.bitmap_bit_position(F.lit(0)).alias("at")).first()
    for r in rows.collect():
        bits = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        start = (r["bucket"] - at["zero"]) * 4096
        words[start : start + len(bits)] |= bits
    return ids.sparkSession.sparkContext.broadcast((words, int(at["at"])))


def may_hold(filter_, ids: np.ndarray) -> np.ndarray:
    """Which of the ids the broadcast filter lets pass."""
    words, zero = filter_
    slot = _slot(ids)
    # Spark numbers the slots of bucket b from 1 + 32768 (b - 1); slot 0 stands in bucket 0, at position 0 too.
    bucket = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
    position = np.where(slot > 0, (slot - 1) % 32768, zero)
    return (words[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1


def _passing(filter_, id_col: str, want: bool):
    def run(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            ids = batch.column(id_col).cast(pa.int64())
            on = may_hold(filter_.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(on if want else ~on))

    return run


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (column id); of ids in ``once``, one row stays.

    Only rows that the id filter lets pass are shuffled, the rest never move.
    """
    special = ids if once is None else ids.unionByName(once).distinct()
    filter_ = id_filter(special)
    sure = docs.mapInArrow(_passing(filter_, id_col, False), docs.schema)
    rest = docs.mapInArrow(_passing(filter_, id_col, True), docs.schema)
    rest = rest.join(ids.withColumnRenamed("id", id_col), id_col, "left_anti").select(docs.columns)
    if once is not None:
        rest = rest.dropDuplicates([id_col])
    return sure.unionByName(rest)
