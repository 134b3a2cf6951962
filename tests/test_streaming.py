"""States folded on a stream against a fold of the same rows, with replayed and late batches and restarts."""

import random

from pyspark.sql import functions as F

from cairn.operators import ledger
from cairn.streaming import state

SCHEMA = "run string, delta string, step int, tokens long, notes array<string>, verdict string"
HOW = {"by": ["run"], "delta": "delta", "order": "step", "add": ["tokens"], "concat": ["notes"], "last": ["verdict"]}


def test_states_follow_late_and_replayed_batches(spark, tmp_path):
    dice = random.Random(8)
    rows = [(f"r{k % 5}", f"d{k}", k, dice.choice([None, 1, 5]), dice.choice([None, [], [f"n{k}"], ["a", f"m{k}"]]), dice.choice([None, None, f"v{k}"])) for k in range(60)]
    dice.shuffle(rows)  # so most come late
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    sent = []
    for low in range(0, 60, 20):
        sent += rows[low : low + 20]
        again = rows[max(0, low - 7) : low + 20] + rows[low : low + 3]  # some of the batch before, and some twice
        spark.createDataFrame(again, SCHEMA).repartition(3).write.mode("append").parquet(source)
        # Each round starts the query again from its checkpoint.
        state.follow_states(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source), out, checkpoint, **HOW).awaitTermination()
        want = ledger.fold_state(spark.createDataFrame(sent, SCHEMA), ["run"], "step", ["tokens"], ["notes"], ["verdict"])
        show = lambda df: sorted((r.run, r.tokens or 0, list(r.notes), r.verdict) for r in df.collect())
        assert show(state.current_states(spark, out, ["run"])) == show(want)
    batches = spark.read.parquet(out).agg(F.countDistinct("batch")).first()[0]
    state.follow_states(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, **HOW).awaitTermination()
    assert spark.read.parquet(out).agg(F.countDistinct("batch")).first()[0] == batches  # nothing new, nothing written
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != state.PROVIDER
