"""Run states that follow a stream of deltas: ledger.fold_state() over Structured Streaming.

Each run's state lives in the state store: counters, the parts of its lists by delta, and the newest value of each other field. A delta
is known by its id, so one that comes again, in the same batch or a later one, changes nothing; one that comes late takes its place in
the lists, and doesn't replace what a newer delta has set. What comes out of a batch are the whole states of the runs it touched, so
the last version of each is what a fold of all deltas gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cairn.deploy import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Keeps (counters), (delta -> order, parts of lists) and (field -> order, value) for each key."""

    def __init__(self, schema: T.StructType, by: list[str], delta: str, order: str, add: list[str], concat: list[str], last: list[str]):
        self.schema, self.by, self.delta, self.order, self.add, self.concat, self.last = schema, by, delta, order, add, concat, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        of = lambda names: [T.StructField(c, self.schema[c].dataType) for c in names]
        order = T.StructField("__order", self.schema[self.order].dataType)
        self.sums = handle.getValueState("sums", T.StructType(of(self.add) or [T.StructField("none", T.IntegerType())]))
        self.parts = handle.getMapState("parts", T.StructType(of([self.delta])), T.StructType([order, *of(self.concat)]))
        self.newest = {c: handle.getValueState(f"last_{c}", T.StructType([order, *of([c])])) for c in self.last}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        sums = list(self.sums.get()) if self.add and self.sums.exists() else [0] * len(self.add)
        newest = {c: s.get() if s.exists() else None for c, s in self.newest.items()}
        moved = set()
        for batch in rows:
            for row in map(self._plain, batch.to_dict("records")):
                if self.parts.containsKey((row[self.delta],)):
                    continue
                self.parts.updateValue((row[self.delta],), (row[self.order], *(None if row[c] is None else list(row[c]) for c in self.concat)))
                for k, c in enumerate(self.add):
                    sums[k] += row[c] or 0
                for c in self.last:
                    if row[c] is not None and (newest[c] is None or row[self.order] >= newest[c][0]):
                        newest[c] = (row[self.order], row[c])
                        moved.add(c)
        if self.add:
            self.sums.update(tuple(sums))
        for c in moved:
            self.newest[c].update(newest[c])
        parts = sorted((tuple(v) for _, v in self.parts.iterator()), key=lambda p: (p[0], [str(x) for x in p[1:]]))
        lists = [[x for p in parts for x in (p[1 + k] if p[1 + k] is not None else ())] for k in range(len(self.concat))]
        state = dict(zip(self.by, key, strict=True)) | dict(zip(self.add, sums, strict=True)) | dict(zip(self.concat, lists, strict=True))
        yield pd.DataFrame([state | {c: None if v is None else v[1] for c, v in newest.items()}])

    def _plain(self, row: dict) -> dict:
        """A row's values as the state store takes them: pandas makes floats of whole numbers that stand beside nulls."""
        single = {c: None if pd.isna(row[c]) else int(row[c]) if isinstance(self.schema[c].dataType, T.IntegralType) else row[c] for c in row if c not in self.concat}
        return row | single

    def close(self) -> None:
        pass


def fold_stream(deltas: DataFrame, by: list[str], delta: str, order: str, add: list[str], concat: list[str], last: list[str]) -> DataFrame:
    """The state of each run that a batch touches, as a stream: columns by, add, concat, last. delta: a column that names a delta within its run."""
    used = [*by, delta, order, *add, *concat, *last]
    rows = deltas.select(*dict.fromkeys(used))
    out = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in (*by, *add, *concat, *last)])
    processor = FoldProcessor(rows.schema, by, delta, order, add, concat, last)
    return rows.groupBy(*by).transformWithStateInPandas(processor, out, "Update", "None")


def follow_states(deltas: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Fold a stream of deltas into path until its input is read; fold_stream() says what `how` holds.

    A batch is written under its number, so one that is run again after a failure replaces what it wrote; a query that is started
    again with the same checkpoint goes on from the states it had.
    """
    spark = deltas.sparkSession
    ship(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)  # the only one with this interface; a query keeps what is set at its start
    try:
        return fold_stream(deltas, **how).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def current_states(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The last state of each run."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*by, "batch"))), "batch").alias("state"))
    return newest.select(*by, "state.*")
