"""Generations of an index as folders of tables, with a log whose last rows say which one is served.

A generation is built from zero beside the one that is served (the shadow), table by table. It is served when a row is appended to the log, after all of its
tables have been written: a build that fails, or stops, leaves the pointer alone. Readers resolve the pointer once and then read that generation's
tables only, whatever is swapped meanwhile. One writer at a time changes a knowledge base.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "kb string, seq long, event string, generation long, build string, at timestamp, tables map<string, long>"
#: Event -> state of the generation that it names.
STATES = {"shadow_started": "building", "shadow_ready": "shadow_ready", "shadow_failed": "shadow_failed", "swapped": "ready", "cancelled": "gone", "retired": "retired"}
RETIRE_HOURS = 24
REQUIRED = ("nodes", "edges", "vectors")


class Refused(RuntimeError):
    """A step that a generation's state doesn't allow; reason tells which rule it breaks."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def generation_states(log: DataFrame) -> DataFrame:
    """kb, generation, state, swap_at, build, tables of every generation that the log (LOG) has not cancelled: the state of its last event."""
    named = log.withColumn("state", F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), F.col("event")))
    last = named.groupBy("kb", "generation").agg(
        F.max_by("state", "seq").alias("state"), F.max(F.when(F.col("event") == "swapped", F.col("at"))).alias("swap_at"), F.max_by("build", "seq").alias("build"), F.max_by("tables", "seq").alias("tables"),
    )
    return last.where("state != 'gone'")


def pointers(log: DataFrame) -> DataFrame:
    """kb, active, shadow: the generation that was swapped in last, and the one that was started last and is neither swapped nor cancelled."""
    active = log.where("event = 'swapped'").groupBy("kb").agg(F.max_by("generation", "seq").alias("active"))
    states = generation_states(log).where("state IN ('building', 'shadow_ready', 'shadow_failed')")
    shadow = states.groupBy("kb").agg(F.max("generation").alias("shadow"))
    return log.select("kb").distinct().join(active, "kb", "left").join(shadow, "kb", "left")


class Generations:
    """The generations below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def log(self) -> DataFrame:
        """The log as it is now; empty before the first event."""
        own = self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log") if self._exists(f"{self.folder}/log") else own

    def _exists(self, path: str) -> bool:
        try:
            return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).count() > 0
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def _append(self, kb: str, event: str, generation: int, build: str | None = None, tables: Mapping[str, int] | None = None, at: datetime.datetime | None = None) -> None:
        seq = 1 + (self.log.agg(F.max("seq")).head()[0] or 0)
        row = (kb, seq, event, generation, build, at or datetime.datetime.now(), dict(tables) if tables else None)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _pointer(self, kb: str) -> tuple[int | None, int | None]:
        row = pointers(self.log.where(F.col("kb") == kb)).head()
        if row is None:
            raise Refused("no_such_kb")
        return row["active"], row["shadow"]

    def _state(self, kb: str, generation: int):
        return generation_states(self.log.where(F.col("kb") == kb)).where(F.col("generation") == generation).head()

    def path(self, kb: str, generation: int, table: str) -> str:
        return f"{self.folder}/{kb}/g{generation}/{table}"

    def build_shadow(self, kb: str, tables: Mapping[str, DataFrame], build: str, at: datetime.datetime | None = None) -> int:
        """Write all tables of a new generation and say that it is ready. A shadow that is there already is refused; a failed write is told and raised."""
        own = self.log.where(F.col("kb") == kb)
        if not own.isEmpty() and self._pointer(kb)[1] is not None:
            raise Refused("shadow_exists")
        if missing := [t for t in REQUIRED if t not in tables]:
            raise Refused(f"missing_table:{missing[0]}")
        generation = 1 + (own.agg(F.max("generation")).head()[0] or 0)
        self._append(kb, "shadow_started", generation, build, at=at)
        try:
            counts = {}
            for name, df in tables.items():
                df.write.parquet(self.path(kb, generation, name))
                counts[name] = self.spark.read.parquet(self.path(kb, generation, name)).count()
        except Exception:
            self._append(kb, "shadow_failed", generation, build, at=at)
            raise
        self._append(kb, "shadow_ready", generation, build, counts, at)
        return generation

    def swap(self, kb: str, at: datetime.datetime | None = None) -> tuple[int | None, int]:
        """Serve the shadow; (the generation before, the new one)."""
        active, shadow = self._pointer(kb)
        if shadow is None:
            raise Refused("no_shadow")
        state = self._state(kb, shadow)
        if state["state"] != "shadow_ready":
            raise Refused("no_ready_shadow")
        self._append(kb, "swapped", shadow, state["build"], state["tables"], at)
        return active, shadow

    def cancel(self, kb: str) -> int:
        """Forget the shadow, whatever its state. Its folder can be cleared, as no pointer leads there."""
        _, shadow = self._pointer(kb)
        if shadow is None:
            raise Refused("no_shadow")
        self._append(kb, "cancelled", shadow)
        return shadow

    def retire(self, kb: str, generation: int, now: datetime.datetime | None = None, force: bool = False) -> None:
        """No generation retires that is served, is the shadow, isn't ready, or was swapped in within RETIRE_HOURS, unless forced."""
        active, shadow = self._pointer(kb)
        state = self._state(kb, generation)
        young = state is not None and state["swap_at"] is not None and (now or datetime.datetime.now()) - state["swap_at"] < datetime.timedelta(hours=RETIRE_HOURS)
        rules = (("no_such_generation", state is None), ("is_active", generation == active), ("is_shadow", generation == shadow), ("not_ready", state is not None and state["state"] != "ready"), ("too_young", young and not force))
        for reason, broken in rules:
            if broken:
                raise Refused(reason)
        self._append(kb, "retired", generation)

    def resolve(self, kb: str, selector: str | int = "active") -> int:
        """The number of the generation that active, shadow, gN or N means, if it can be read."""
        active, shadow = self._pointer(kb)
        text = str(selector).strip().lower()
        if text == "active":
            if active is None:
                raise Refused("no_active_generation")
            generation = active
        elif text == "shadow":
            if shadow is None:
                raise Refused("no_shadow")
            generation = shadow
        else:
            number = text.removeprefix("g")
            if not number.isdecimal() or int(number) <= 0:
                raise Refused("invalid_selector")
            generation = int(number)
        state = self._state(kb, generation)
        if state is None:
            raise Refused("no_such_generation")
        if state["state"] == "retired":
            raise Refused("retired")
        if state["state"] not in ("ready", "shadow_ready"):
            raise Refused("not_ready")
        return generation

    def read(self, kb: str, selector: str | int = "active") -> dict[str, DataFrame]:
        """The tables of a generation, resolved once; a table of which not all rows are there is refused."""
        generation = self.resolve(kb, selector)
        found = {}
        for name, rows in (self._state(kb, generation)["tables"] or {}).items():
            if not self._exists(self.path(kb, generation, name)):
                raise Refused(f"missing_table:{name}")
            found[name] = self.spark.read.parquet(self.path(kb, generation, name))
            if found[name].count() != rows:
                raise Refused(f"incomplete_table:{name}")
        return found


def replayed(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, n_before, n_after, shared, overlap, same_first: results (query_id, rank, node_id) of one set of queries on two generations."""
    a, b = before.select("query_id", "node_id", F.col("rank").alias("a")), after.select("query_id", "node_id", F.col("rank").alias("b"))
    joined = a.join(b, ["query_id", "node_id"], "full")
    counts = joined.groupBy("query_id").agg(
        F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("all"),
        F.max(((F.col("a") == 1) & (F.col("b") == 1)).cast("int")).alias("same"),
    )
    return counts.select("query_id", "n_before", "n_after", "shared", (F.col("shared") / F.col("all")).alias("overlap"), (F.coalesce("same", F.lit(0)) == 1).alias("same_first"))


def ordered_log(log: DataFrame) -> DataFrame:
    """The log with each event's number within its knowledge base."""
    return log.withColumn("step", F.row_number().over(Window.partitionBy("kb").orderBy("seq")))
