"""The live index: versions, retries, and brute force over what is there."""

from __future__ import annotations

import numpy as np

from vexel.operators import brute, ivf
from vexel.streaming.live import EVENTS, LiveIndex


def test_stream_of_updates(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(40, 3)).round(2)
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")
    index = ivf.IVFIndex.build(base, 4, iters=1)
    live = LiveIndex(spark, index, str(tmp_path / "live"))
    source = tmp_path / "events"
    first = [(1, "insert", 100, [0.0, 0.0, 0.0]), (2, "delete", 5, None), (3, "insert", 101, [1.0, 1.0, 1.0]), (4, "delete", 101, None)]
    second = [(5, "delete", 100, None), (6, "insert", 5, [9.0, 9.0, 9.0]), (7, "insert", 3, [0.1, 0.0, 0.0])]
    state = {i: r.tolist() for i, r in enumerate(x)}
    for n, events in enumerate((first, second)):
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        q = live.start(spark.readStream.schema(EVENTS).parquet(str(source)), str(tmp_path / "check"))
        q.awaitTermination()
        for _, op, i, v in events:
            state.pop(i, None)
            if op == "insert":
                state[i] = v
        if n == 0:
            live.apply(spark.createDataFrame(first, EVENTS), 0)  # a retry
        now = spark.createDataFrame(list(state.items()), "id bigint, vec array<float>")
        asked = now.limit(6).selectExpr("id as qid", "vec as q")
        got = sorted(live.search(asked, 5, 4).collect())
        assert got == sorted(brute.brute_force_knn(now, asked, 5).collect())
        assert sorted(live.search(asked, 5, 4, mode="ivf").collect()) == got
    old = live.snapshot(0)[0]
    assert [r.id for r in old.collect()] == [100]
