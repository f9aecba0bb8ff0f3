from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import status

CONDITION = "array<struct<type:string,status:string,reason:string,message:string>>"


def test_states(spark):
    rows = [("a", 2, "COMPLETED"), ("a", 1, "RUNNING"), ("b", 1, "RUNNING"), ("c", 3, "FAILED")]
    df = spark.createDataFrame(rows, "app string, s bigint, state string").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = {r.app: r.state for r in status.current_state(df, ["app"]).collect()}
    assert got == {"a": "COMPLETED", "b": "RUNNING", "c": "FAILED"}
    counts = {r.state: r.n for r in status.state_counts(df, ["app"]).collect()}
    assert counts == {"COMPLETED": 1, "RUNNING": 1, "FAILED": 1}


def test_order_of_states(spark):
    history = {
        "in order": "SxRC",
        "restarted": "CRxC",
        "only completed": "C",
        "wrong way": "CR",
        "late first": "RCSRC",
        "nothing": "xx",
    }
    rows = [(app, n, s) for app, states in history.items() for n, s in enumerate(states)]
    df = spark.createDataFrame(rows[::-1], "app string, n bigint, state string")

    def reached(*wanted):
        got = status.saw_in_order(df, ["app"], list(wanted), ts="n")
        return {r.app: (r.reached, r.in_order) for r in got.collect()}

    two = reached("R", "C")
    assert {a for a, (_, ok) in two.items() if ok} == {"in order", "restarted", "late first"}
    assert two["wrong way"] == (1, False) and two["nothing"] == (0, False)
    three = reached("S", "R", "C")
    assert {a for a, (_, ok) in three.items() if ok} == {"in order", "late first"}


def test_same_instant_is_not_later(spark):
    df = spark.createDataFrame([("a", 1, "R"), ("a", 1, "C")], "app string, n bigint, state string")
    assert status.saw_in_order(df, ["app"], ["R", "C"], ts="n").first().reached == 1


def test_pods(spark):
    waiting = [("PodScheduled", "False", "Unschedulable", "pod group is not ready, 2 pending")]
    other = [("PodScheduled", "False", "Unschedulable", "0/3 nodes available")]
    rows = [
        ("n", "x-driver", "Pending", [("Initialized", "True", None, None)] + waiting),
        ("n", "app-1-driver", "Running", None),
        ("m", "app-2-driver", "Pending", other),
        ("m", "app-3-driver", "Failed", [("PodScheduled", "False", "Unschedulable", None)]),
    ]
    pods = spark.createDataFrame(rows, f"namespace string, pod string, phase string, conditions {CONDITION}")
    # The matching pod is the second one of its namespace.
    assert status.any_match(pods, "app-1").first().matched is True
    assert status.any_match(pods, "app-2").first().matched is False
    assert status.any_match(pods.limit(0), "app").first().matched is False
    got = {r.namespace: (r.queued, r.waiting) for r in status.queued(pods, ("namespace",)).collect()}
    assert got == {"n": (True, 1), "m": (False, 0)}


@pytest.mark.parametrize("limit", [100, 2])
def test_retries(spark, limit):
    rows = [("a", "run", n * 10) for n in range(5)] + [("b", "run", n * 4) for n in range(3)]
    rows += [("c", "submit", 0), ("free", "run", 0), ("free", "run", 1)]
    rows += [("never", "run", 0), ("never", "run", 5), ("once", "run", 0)]
    attempts = spark.createDataFrame(rows, "app string, kind string, s bigint").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    policy = spark.createDataFrame(
        [("a", "run", 3, 10), ("b", "run", 3, 10), ("c", "submit", 5, 20), ("never", "run", 0, None), ("once", "run", 0, None)],
        "app string, kind string, max_retries int, gap_s int",
    )
    got = {
        r.app: (r.failures, r.min_gap_s, r.over_budget, r.too_fast)
        for r in status.retry_report(attempts, policy, rows=limit).collect()
    }
    assert got == {
        "a": (5, 10.0, True, False),
        "b": (3, 4.0, False, True),
        "c": (1, None, False, False),
        "free": (2, 1.0, None, None),
        "never": (2, 5.0, True, False),
        "once": (1, None, False, False),
    }
