"""The write-ahead log: Parquet batches, each appended as a whole, and a claim for each.

A batch's rows are written once, in a folder of their own, numbered by task and place.
A claim, one small file named by the batch's first sequence number, then shows it: it is
made exclusively, so of two writers that saw the same log one gets the number and the
other looks again.  Ranges are gapless and disjoint, and what is acknowledged is there.
A batch may carry a token; a batch whose token is there already is not appended again,
which makes a retried stream batch harmless.  Claims and rows outlive a flush, for the
readers that have opened them, until the store's ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.keys import entry_bytes
from kvlake.schema import CHANGE_LOG

from .filesystem import Files

_NAME = re.compile(r"b(\d{19})\.json$")
_IN_PARTITION = (1 << 33) - 1


@dataclass(frozen=True)
class Batch:
    first: int
    last: int
    folder: str
    bytes: int
    token: str | None = None
    #: (task, its first row's number in the batch)
    starts: list[tuple[int, int]] = field(default_factory=list, hash=False)

    @property
    def name(self) -> str:
        return f"b{self.first:019d}.json"


class CorruptLog(ValueError):
    """A log row that is neither a put nor a delete."""


class WriteAheadLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/wal"
        self.files = Files(spark, root)
        self._known: dict[str, Batch] = {}

    def batches(self) -> list[Batch]:
        """All batches in order.  A claim never changes, so each is read once."""
        names = [n for n in self.files.names(self.path) if _NAME.match(n)]
        for n in names:
            if n not in self._known:
                self._known[n] = Batch(**json.loads(self.files.read(f"{self.path}/{n}")))
        self._known = {n: self._known[n] for n in names}
        return list(self._known.values())

    def append(
        self, ops: DataFrame, after: int | Callable[[], int], order_by: list | None = None, token: str | None = None,
        claim: Callable[[], None] | None = None,
    ) -> Batch | None:
        """Appends ``ops`` (op, key, value, ttl_seconds, ts_ms) behind ``after`` and all that is in the log.

        Rows are numbered without gaps in ``order_by``, else as they come: by task and place, with one count
        per task at the driver.  ``after`` may be called again, as a claim is tried until it succeeds;
        ``claim`` is called before each try (tests).
        """
        floor = after if callable(after) else lambda: after
        if token and any(b.token == token for b in self.batches()):
            return None
        if order_by:
            ops = ops.orderBy(*order_by)
        at = F.monotonically_increasing_id()
        columns = [F.col(f.name).cast(f.dataType) for f in CHANGE_LOG.fields if f.name != "seq"]
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        placed = ops.withColumn("__at", at).select(
            F.shiftright("__at", 33).cast("int").alias("part"), F.col("__at").bitwiseAND(F.lit(_IN_PARTITION)).alias("place"), *columns
        )
        seen = Observation()
        placed.observe(seen, F.sum(entry_bytes()).alias("bytes")).write.parquet(folder)
        counts = self.spark.read.parquet(folder).groupBy("part").agg(F.count("*").alias("n")).collect()
        starts, total = [], 0
        for r in sorted(counts, key=lambda r: r["part"]):
            starts.append((r["part"], total))
            total += r["n"]
        while total:
            batches = self.batches()
            if token and any(b.token == token for b in batches):
                break
            first = max([floor(), *(b.last for b in batches)]) + 1
            batch = Batch(first, first + total - 1, folder, seen.get["bytes"] or 0, token, starts)
            if claim:
                claim()
            if not self.files.create(f"{self.path}/{batch.name}", json.dumps(vars(batch))):
                continue
            if floor() < first:
                return batch
            # The number had been given, flushed and vacuumed before this claim: take another.
            self.files.delete(f"{self.path}/{batch.name}")
        self.files.delete(folder)
        return None

    def read(self, after: int = -1, batches: list[Batch] | None = None) -> DataFrame:
        """Rows with ``seq`` above ``after``."""
        wanted = [b for b in (self.batches() if batches is None else batches) if b.last > after]
        if not wanted:
            return self.spark.createDataFrame([], CHANGE_LOG)
        starts = [(b.folder.rsplit("/", 1)[-1], part, b.first + start) for b in wanted for part, start in b.starts]
        table = self.spark.createDataFrame(starts, "__folder string, part int, __start bigint")
        schema = ", ".join(["part int", "place bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in CHANGE_LOG.fields if f.name != "seq")])
        rows = self.spark.read.schema(schema).parquet(*(b.folder for b in wanted))
        rows = rows.withColumn("__folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        rows = rows.join(F.broadcast(table), ["__folder", "part"]).withColumn("seq", F.col("__start") + F.col("place"))
        return rows.where(F.col("seq") > after).select(*(f.name for f in CHANGE_LOG.fields))

    def checked(self, after: int = -1) -> DataFrame:
        """As ``read``, but a row of an unknown kind is an error."""
        bad = F.raise_error(F.concat(F.lit("unknown operation: "), F.col("op")))
        return self.read(after).withColumn("op", F.when(F.col("op").isin("P", "D"), F.col("op")).otherwise(bad.cast("string")))

    def truncate(self, up_to: int) -> None:
        """Deletes batches that hold nothing above ``up_to``; open readers of them fail."""
        for b in self.batches():
            if b.last <= up_to:
                self.files.delete(f"{self.path}/{b.name}")
                self.files.delete(b.folder)

    def clear(self) -> None:
        self.files.delete(self.path)
