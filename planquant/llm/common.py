"""What the operators of this subpackage share: Arrow mapping, shared folders, word rules.

Every operator takes a DataFrame, names its key and text columns as parameters and selects only those, so
other columns, whatever they are called, never clash with what an operator adds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from planquant.workers import workers_find_package

#: Bytes of text that an Arrow function handles at a time.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch: rows are sent to a worker in batches of this size (a larger row is a batch of its own), since
#: 10,000 rows of text, the default, can be any size. A session that asks for less keeps its own.
BATCH_BYTES = 4 << 20
#: A result or table has parts of this size at least (by the optimizer, which takes a text for 20 bytes), but
#: `PARTS_PER_CORE` for each core of the session in any case: hundreds of small files cost more than they hold, and a local
#: file system starts a process for each.
PART_BYTES = 8 << 20
PARTS_PER_CORE = 4


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def parts_for(df: DataFrame) -> int:
    """How many parts a result of about the size of `df` should have, by the optimizer's estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def compact(df: DataFrame, parts: int) -> DataFrame:
    """The same rows in at most so many parts; nothing is shuffled, and what has fewer parts stays as it is."""
    return df.coalesce(min(parts, 2**31 - 1))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    workers_find_package(df.sparkSession)
    now = int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return compact(df, parts or parts_for(df)).mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(n) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session that runs in one process may name none; it gets one."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        known = tempfile.mkdtemp(prefix="planquant-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to the shared checkpoint folder. Not for loops: the optimizer's guess of the size stays with
    the rows and is multiplied by every join, round by round, until planning takes longer than the work (`shared_table`)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again."""
    at = f"{checkpoint_dir(df.sparkSession)}/planquant-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Kept(dict):
    """What a worker remembers of an operator, by key: the first `most` entries, which hold what is frequent.

    Workers serve one operator after another, so the memories of all but the last one that `mine` was asked for are
    dropped: what a worker holds is one operator's."""

    _live: ClassVar[dict[str, list[Kept]]] = {}

    def __init__(self, owner: str, most: int):
        super().__init__()
        self.owner, self.most = owner, most
        Kept._live.setdefault(owner, []).append(self)

    def put(self, key, value):
        if len(self) < self.most:
            self[key] = value
        return value

    @staticmethod
    def mine(owner: str) -> None:
        for other, kept in Kept._live.items():
            if other != owner:
                for x in kept:
                    x.clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_of(parts, sep: str = ","):
    """Lower-case hex digest of an array column's parts, joined."""
    return F.sha2(F.array_join(parts, sep), 256)
