from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alerts, rules
from tidemark.operators.rules import Component

BASE = 1_700_000_040  # start of a minute
CONTROLLER = Component("controller", "op-controller", "op", "ns")
WEBHOOK = Component("webhook", "op-webhook", "op", "ns")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, s bigint, value double")
    return df.select("metric", "labels", F.timestamp_seconds("s").alias("ts"), "value")


def component_rows(name, cpu, memory, ready, running):
    """One sample per minute and list entry; None leaves the sample out."""
    pod = f"op-1.{name}-abc"
    used = {"namespace": "ns", "pod": pod, "container": "main", "image": "i"}
    limit = {"exported_namespace": "ns", "container": f"op-{name}"}
    replicas = {"exported_namespace": "ns", "replicaset": f"op-1.{name}"}
    phase = {"exported_namespace": "ns", "exported_pod": pod, "phase": "Running"}
    out = []
    for n in range(len(memory)):
        at = BASE + 60 * n
        out.append((rules.CPU_USED, used, at, cpu[n]))
        out.append((rules.CPU_USED, used | {"container": "POD"}, at, 1000.0 * n))
        out.append((rules.MEMORY_USED, used, at, memory[n]))
        out.append((rules.MEMORY_USED, used | {"image": ""}, at, 1e9))
        out.append((rules.CPU_LIMIT, limit, at, 0.5))
        out.append((rules.MEMORY_LIMIT, limit, at, 100.0))
        out.append((rules.READY, replicas, at, ready[n]))
        out.append((rules.WANTED, replicas, at, 2.0))
        if running[n] is not None:
            out.append((rules.PHASE, phase, at, running[n]))
    return out


def test_all_rules(spark):
    # CPU: 28 s in a minute is 93 % of half a core; the fall to 2 is a restart.
    rows = component_rows("controller", [0.0, 28.0, 40.0, 2.0], [50.0, 91.0, 90.0, 95.0], [2.0, 1.0, 2.0, 2.0], [1.0, 0.0, None, 1.0])
    rows += component_rows("webhook", [0.0, 1.0, 2.0, 3.0], [1.0, 1.0, 1.0, 1.0], [2.0, 2.0, 2.0, 0.0], [1.0, 1.0, 1.0, 1.0])
    start, end = BASE * 1_000_000, (BASE + 240) * 1_000_000
    found = rules.component_alerts(
        frame(spark, rows), {"Controller": CONTROLLER, "Webhook": WEBHOOK}, 60, start, end
    )
    got = {}
    for r in found.collect():
        got.setdefault((r.alert, r.severity), set()).add((r.step_us // 1_000_000 - BASE) // 60)
    assert got == {
        ("ControllerCPUUsage", "warning"): {1},
        ("ControllerMemoryUsage", "warning"): {1, 3},
        ("ControllerIsDegraded", "high"): {1},
        ("ControllerIsDown", "critical"): {1, 2},
        ("WebhookIsDegraded", "high"): {3},
    }
    runs = alerts.alert_episodes(found.filter("alert = 'ControllerIsDown'"), ["alert"], 60)
    assert [(r.steps, r.seconds) for r in runs.collect()] == [(2, 60.0)]


def test_range_thresholds_and_service(spark):
    rows = component_rows("controller", [0.0, 28.0, 56.0, 84.0], [50.0, 91.0, 90.5, 95.0], [1.0, 1.0, 1.0, 1.0], [None] * 4)
    start, end = (BASE + 60) * 1_000_000, (BASE + 180) * 1_000_000
    found = rules.component_alerts(
        frame(spark, rows), {"Controller": CONTROLLER}, 60, start, end, cpu_pct=95, memory_pct=90.7, service="release"
    ).collect()
    assert {r.service for r in found} == {"release"}
    got = {}
    for r in found:
        got.setdefault(r.alert, set()).add((r.step_us // 1_000_000 - BASE) // 60)
    assert got == {"ControllerMemoryUsage": {1}, "ControllerIsDegraded": {1, 2}, "ControllerIsDown": {1, 2}}
    lower = rules.component_alerts(frame(spark, rows), {"Controller": CONTROLLER}, 60, start, end, cpu_pct=90)
    assert {(r.step_us // 1_000_000 - BASE) // 60 for r in lower.filter("alert = 'ControllerCPUUsage'").collect()} == {1, 2}


def test_without_samples_everything_is_down(spark):
    start, end = BASE * 1_000_000, (BASE + 120) * 1_000_000
    found = rules.component_alerts(frame(spark, []), {"Controller": CONTROLLER}, 60, start, end)
    assert {(r.alert, r.step_us) for r in found.collect()} == {
        ("ControllerIsDown", start),
        ("ControllerIsDown", start + 60_000_000),
    }
