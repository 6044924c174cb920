"""Change capture from append-only logs, in batches that survive failures.

A log is a table with a unique, growing offset. It is split into a fixed number of
partitions by key. A batch is planned before it is read: the plan names, for each
partition, the offsets after which it starts and up to which it goes, and is written to the
shared folder first (write-ahead). A batch whose plan exists but whose commit does not is
replayed with the same plan. The sink writes one folder per batch, replacing what an earlier
attempt left there, and readers see one row per key and offset. So nothing is skipped and
nothing is taken twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log partitions; also the number of offsets in a plan, whatever the size of the log.
PARTITIONS = 32


class Store:
    """Small JSON values in a folder that all nodes share.

    A file is written under another name and then renamed to one that must not exist, so readers
    see whole files, a crash loses nothing, and of two writers one fails. ``write`` keeps a value
    that changes as numbered files, of which the last counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def put(self, name: str, value: dict) -> None:
        """Writes a name that was never written before; raises if it was."""
        tmp, to = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(to), plain)
        except Py4JJavaError as e:
            self._fs.delete(tmp, False)
            raise FileExistsError(f"another run has written {to}") from e

    def write(self, name: str, value: dict) -> None:
        """The next value of a name; the one before stays until the one after, for readers under way."""
        n = self._number(name) + 1
        self.put(f"{name}~{n:010d}", value)
        for old in self.names():
            if old.startswith(f"{name}~") and int(old[len(name) + 1 :]) < n - 1:
                self._fs.delete(self._path(f"{self.root}/{old}"), False)

    def _number(self, name: str) -> int:
        return max((int(x[len(name) + 1 :]) for x in self.names() if x.startswith(f"{name}~")), default=0)

    def read(self, name: str) -> dict | None:
        n = self._number(name)
        at = self._path(f"{self.root}/{name}~{n:010d}" if n else f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def names(self, folder: str | None = None) -> list[str]:
        root = self._path(folder or self.root)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def drop(self, path: str) -> None:
        """Deletes a folder below the shared one, with all it holds."""
        self._fs.delete(self._path(path), True)


class ChangeLog:
    """Batches over one log; ``root`` keeps plans, commits and the sink.

    ``key`` decides the log partition, ``offset`` (long, unique, never NULL) the order. Rows
    with a NULL offset can't be placed in a log and are left out. Late rows are taken in the
    batch after their offset appears, as long as offsets grow with arrival.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, offset: str, partitions: int = PARTITIONS):
        self.spark, self.root, self.key, self.offset, self.partitions = spark, root.rstrip("/"), key, offset, partitions
        self.store = Store(spark, f"{self.root}/log")

    def _split(self, log: DataFrame) -> DataFrame:
        return log.where(F.col(self.offset).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.partitions)).cast("int"))

    def _last(self, kind: str) -> int:
        got = [int(n.split("-")[1]) for n in self.store.names() if n.startswith(f"{kind}-")]
        return max(got, default=-1)

    def committed(self) -> dict[str, int]:
        n = self._last("commit")
        return self.store.read(f"plan-{n:08d}")["to"] if n >= 0 else {}

    def next_batch(self) -> int:
        return self._last("commit") + 1

    def pending(self) -> bool:
        """Whether a batch is planned but not committed, so that the next run only replays it."""
        return self.store.read(f"plan-{self.next_batch():08d}") is not None

    def plan(self, log: DataFrame) -> tuple[int, dict] | None:
        """The plan to run: an unfinished one as it stands, else a new one; None if there is nothing new."""
        n = self.next_batch()
        old = self.store.read(f"plan-{n:08d}")
        if old is not None:
            return n, old
        start = self.committed()
        ends = {str(r["_part"]): r["m"] for r in self._split(log).groupBy("_part").agg(F.max(self.offset).alias("m")).collect()}  # at most ``partitions`` rows
        if all(start.get(p) is not None and start[p] >= m for p, m in ends.items()):
            return None
        plan = {"from": start, "to": {**start, **{p: max(m, start.get(p, m)) for p, m in ends.items()}}}
        self.store.put(f"plan-{n:08d}", plan)
        return n, plan

    def rows(self, log: DataFrame, plan: dict) -> DataFrame:
        """The log rows of a plan, without those seen before."""
        null = F.lit(None).cast("long")
        lo = F.create_map(*[F.lit(x) for p in range(self.partitions) for x in (p, int(plan["from"].get(str(p), -(2**63))))])
        hi = F.create_map(*[x for p in range(self.partitions) for x in (F.lit(p), F.lit(int(plan["to"][str(p)])) if str(p) in plan["to"] else null)])
        return self._split(log).where((F.col(self.offset) <= hi[F.col("_part")]) & (F.col(self.offset) > lo[F.col("_part")])).drop("_part")

    def run(self, log: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int | None:
        """Plans, reads, writes and commits one batch; its number, or None if nothing is new.

        ``work`` turns the batch's rows into sink rows, which keep the key and the offset column.
        """
        planned = self.plan(log)
        if planned is None:
            return None
        n, plan = planned
        work(self.rows(log, plan)).write.mode("overwrite").parquet(f"{self.root}/sink/batch={n}")
        self.store.put(f"commit-{n:08d}", {"batch": n})
        return n

    def sink(self) -> DataFrame:
        """The sink's rows of committed batches, once per key and offset."""
        done = [f"{self.root}/sink/batch={n}" for n in range(self._last("commit") + 1)]
        if not done:
            raise FileNotFoundError("no batch is committed")
        df = self.spark.read.parquet(*done)
        return df.dropDuplicates([self.key, self.offset])
