"""Stateful rules on live tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that stateful processors need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedup(df: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark. Conflicts are told by the batch operator."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_activity(df: DataFrame, time: str, delay: str, width: str, wallet: str, side: str, amount: str) -> DataFrame:
    """Rows, amount and about how many sides of each wallet in each window of time."""
    out = df.withWatermark(time, delay).groupBy(F.window(time, width), wallet)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.approx_count_distinct(side).alias("sides"))


def stream_cooldown(df: DataFrame, key: str, time: str, order: str, seconds: int, delay: str) -> DataFrame:
    """order, accepted of every row: it is accepted unless its key had an accepted row less than ``seconds`` before.

    ``time`` is a timestamp, ``order`` a long that breaks ties and names the row. Rows of one micro-batch are taken in order of
    time; rows later than ``delay`` are dropped by the watermark. The state of a key is its last accepted time in
    microseconds; it goes when the watermark has passed it by ``seconds``, since any row still to come is accepted then.
    Rows without a time are left out, as no watermark can place them; a null key is a key of its own. Of a micro-batch's key, times and orders are held, 16 bytes a row.
    """
    rows = df.where(F.col(time).isNotNull()).withWatermark(time, delay)

    def run(name, groups, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        parts = [(g["_t"].to_numpy("datetime64[us]").astype(np.int64), g["_o"].to_numpy(np.int64)) for g in groups]
        t, o = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((o, t))
        t, o, good = t[by], o[by], np.zeros(len(t), bool)
        at = 0 if last is None else int(np.searchsorted(t, last + seconds * 1_000_000))
        while at < len(t):  # from one accepted row to the next
            good[at], last = True, int(t[at])
            at = max(at + 1, int(np.searchsorted(t, last + seconds * 1_000_000)))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        for i in range(0, len(t), 10_000):
            yield pd.DataFrame({order: o[i : i + 10_000], "accepted": good[i : i + 10_000]})

    some = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(order).cast("long").alias("_o"))
    return some.groupBy("_k").applyInPandasWithState(run, f"{order} long, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


class _Cooldown(StatefulProcessor):
    """Holds a key's rows, in buckets of ``width`` seconds, until the watermark has passed their bucket; then no row of it can still come and it is decided in order of time.

    Calls to the state cost more than rows, so a key has one list of arrays, to which a micro-batch adds one, and one timer: at the end of its earliest bucket, or else
    where its last accepted time goes, as every row still to come is accepted then anyway. due is that timer's time.
    """

    def __init__(self, order: str, seconds: int, width: int):
        self.order, self.gap, self.width = order, seconds * 1_000_000, width * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at long, due long")
        self.waiting = handle.getListState("waiting", "t array<long>, o array<long>")

    def _ends(self, t: np.ndarray) -> np.ndarray:
        """The ends of the rows' buckets in milliseconds."""
        return -(-t // self.width) * self.width // 1000

    def handleInputRows(self, key, rows, timerValues):
        # columns come by their places: key, time, order
        parts = [(g.iloc[:, 1].to_numpy("datetime64[us]").astype(np.int64), g.iloc[:, 2].to_numpy(np.int64)) for g in rows if len(g)]
        if not parts:
            return iter(())
        t, o = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.waiting.appendList([(t.tolist(), o.tolist())])
        last, due = self.state.get() or (None, None)
        first = int(self._ends(t).min())
        if due is None or first < due:
            self.handle.registerTimer(first)
            self.state.update((last, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        last, due = self.state.get() or (None, None)
        if due is None or due > passed:  # a timer that a later one has replaced
            return
        held = list(self.waiting.get())
        t, o = (np.concatenate([np.zeros(0, np.int64), *[np.array(x[i], np.int64) for x in held]]) for i in (0, 1))
        settled, due, least = self._ends(t) <= passed, None, None
        if held and not settled.all():
            if settled.any():
                self.waiting.put([(t[~settled].tolist(), o[~settled].tolist())])
            least = int(t[~settled].min())  # may be before the watermark, as its bucket isn't
            due = int(self._ends(np.array([least]))[0])
        elif held:
            self.waiting.clear()
        t, o = t[settled], o[settled]
        by = np.lexsort((o, t))
        t, o, good, at = t[by], o[by], np.zeros(len(t), bool), 0
        if last is not None:
            at = int(np.searchsorted(t, last + self.gap))
        while at < len(t):  # from one accepted row to the next
            good[at], last = True, int(t[at])
            at = max(at + 1, int(np.searchsorted(t, last + self.gap)))
        if last is not None and (last + self.gap) // 1000 + 1 <= passed and (least is None or least >= last + self.gap):
            last = None
        elif last is not None and due is None:
            due = (last + self.gap) // 1000 + 1
        if due is None:
            self.state.clear()
        else:
            self.handle.registerTimer(due)
            self.state.update((last, due))
        for i in range(0, len(t), 10_000):
            yield pd.DataFrame({self.order: o[i : i + 10_000], "accepted": good[i : i + 10_000]})

    def close(self) -> None:
        pass


def stream_cooldown_settled(df: DataFrame, key: str, time: str, order: str, seconds: int, delay: str, width: int = 60) -> DataFrame:
    """order, accepted of every row, by the rule of the batch operator and in event time: the same in whatever order rows arrive within ``delay``.

    ``time`` is a timestamp, ``order`` a long that breaks ties and names the row. A row is told when the watermark has passed the end of its bucket of ``width``
    seconds; what an open stream hasn't passed yet is still to come. Rows later than ``delay`` are dropped and counted, see LateRows. Rows without a time are left out;
    a null key is a key of its own. A key's state is its rows of the open buckets and its last accepted time, which goes when the watermark has passed it by ``seconds``.
    A task holds a key's open rows, 16 bytes each, as it holds a key's rows of a micro-batch. For append mode.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = df.where(F.col(time).isNotNull()).withWatermark(time, delay).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(order).cast("long").alias("_o"))
    return rows.groupBy("_k").transformWithStateInPandas(_Cooldown(order, seconds, width), f"{order} long, accepted boolean", "append", "EventTime")


class LateRows(StreamingQueryListener):
    """Counts, by the name of a stream, the rows that came later than its watermark allows, and those that it read."""

    def __init__(self):
        self.late: dict[str, int] = {}
        self.read: dict[str, int] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.late[name] = self.late.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.read[name] = self.read.get(name, 0) + p.numInputRows

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def stream_balances(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Running balances, for update mode."""
    return df.groupBy(*keys).agg(F.sum(amount).alias("balance"))


def negative_balances(batch: DataFrame) -> DataFrame:
    """What a foreachBatch sink reports of them."""
    return batch.where("balance < 0")


class BalanceSink:
    """foreachBatch sink for the update mode of stream_balances(): changed keys of each micro-batch, and those that fell below zero as alerts.

    Both are folders named by the batch's id, which a replay of the batch writes anew, so a batch that is repeated after a crash changes nothing. What a key has now
    is its row of the highest id. ``fold()`` puts the folders up to an id into one.
    """

    def __init__(self, root: str, keys: Sequence[str]):
        self.root, self.keys = root, list(keys)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        changes = f"{self.root}/changes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(changes)
        written = batch.sparkSession.read.schema(batch.schema).parquet(changes)
        negative_balances(written).write.mode("overwrite").parquet(f"{self.root}/alerts/batch={batch_id}")

    def _folder(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path, fs = self._folder(spark, name)
        if not fs.exists(path):
            return spark.createDataFrame([], f"{schema}, batch long")
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def latest(self, spark: SparkSession, schema: str) -> DataFrame:
        """The present balance of each key, with the batch that changed it last; ``schema`` is that of the batches."""
        rows = self._read(spark, "changes", schema).unionByName(self._read(spark, "folded", schema))
        return rows.groupBy(*self.keys).agg(F.max(F.struct("batch", "balance")).alias("_x")).select(*self.keys, "_x.balance", "_x.batch")

    def alerts(self, spark: SparkSession, schema: str) -> DataFrame:
        """Every key and batch at whose end its balance was below zero."""
        return self._read(spark, "alerts", schema)

    def fold(self, spark: SparkSession, schema: str, upto: int) -> None:
        """Puts the changes of the batches up to ``upto`` into one folder; what they were in goes once it is whole, so a fold that breaks off loses nothing and can be repeated.

        A folded row's batch is ``upto``, whichever changed it.
        """
        made, fs = self._folder(spark, f"folded/batch={upto}")
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(made, "_SUCCESS")):
            fs.delete(made, True)
            self.latest(spark, schema).where(F.col("batch") <= upto).select(*self.keys, "balance").write.parquet(made.toString())
        for name in ("changes", "folded"):
            folder, _ = self._folder(spark, name)
            for f in fs.listStatus(folder):
                part = f.getPath().getName()
                if part.startswith("batch=") and (int(part[6:]) <= upto if name == "changes" else int(part[6:]) < upto):
                    fs.delete(f.getPath(), True)
