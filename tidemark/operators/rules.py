"""The alert rules of a component: usage against its limit, degraded, down.

Samples have ``metric``, ``labels`` (a map), ``ts`` and ``value``. A component is told by its name part: its
pods match ``<prefix>.*.<component>.*``, its replica sets ``<prefix>.*.<component>``, its container has a name.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import MICROS, micros, series_key, step_start
from tidemark.operators import alerts, metrics

# Metrics, labels and severities of the rules, the trailing window of the CPU rate
# and how long a scraped value counts.
CPU_USED, CPU_LIMIT = "container_cpu_usage_seconds_total", "kube_pod_container_resource_limits_cpu_cores"
MEMORY_USED = "container_memory_working_set_bytes"
MEMORY_LIMIT = "kube_pod_container_resource_limits_memory_bytes"
READY, WANTED = "kube_replicaset_status_ready_replicas", "kube_replicaset_spec_replicas"
PHASE = "kube_pod_status_phase"
RATE_WINDOW_S = 60
LOOKBACK_S = 300
HIGH_USAGE, DEGRADED, DOWN = "warning", "high", "critical"


@dataclass(frozen=True)
class Component:
    name: str
    container: str
    prefix: str
    namespace: str


Components = Mapping[str, Component]


def _tagged(samples: DataFrame, metric: str, components: Components, **tests) -> DataFrame:
    """Samples of a metric with the ``component`` whose matchers they pass; the matchers are functions of the component.

    Series are few beside their samples: the components are found once for each label set that occurs, and the samples
    meet them by an equality join on the set.
    """
    own = samples.filter(F.col("metric") == metric).withColumn("series", series_key(F.col("labels")))
    marks = [
        F.when(metrics.label_test(**{k: test(c) for k, test in tests.items()}), F.lit(label))
        for label, c in components.items()
    ]
    hit = F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull()))
    found = own.select("series", "labels").dropDuplicates(["series"]).select("series", hit.alias("component"))
    return own.join(found, "series")


def _used(samples: DataFrame, metric: str, components: Components) -> DataFrame:
    """Usage of the components' real containers (no pause container, no unnamed image)."""
    return _tagged(
        samples,
        metric,
        components,
        equal=lambda c: {"namespace": c.namespace},
        unequal=lambda c: {"image": "", "container": "POD"},
        pattern=lambda c: {"pod": f"{c.prefix}.*.{c.name}.*"},
    )


def _limit(samples: DataFrame, metric: str, components: Components) -> DataFrame:
    return _tagged(
        samples,
        metric,
        components,
        equal=lambda c: {"exported_namespace": c.namespace, "container": c.container},
    )


def cpu_high(
    samples: DataFrame,
    components: Components,
    step_s: int,
    pct: float = alerts.DEFAULT_PCT,
    window_s: int = RATE_WINDOW_S,
    lookback_s: int = LOOKBACK_S,
) -> DataFrame:
    """Steps at which a component's busiest container exceeds the threshold of its CPU limit, as last scraped."""
    used = _used(samples, CPU_USED, components)
    rates = metrics.counter_rate(used, window_s, by=("component", "series")).select(
        "component", F.timestamp_micros("us").alias("ts"), F.col("rate").alias("value")
    )
    limits = _limit(samples, CPU_LIMIT, components)
    share = metrics.pct_of_limit(rates, limits, step_s, by=("component",), lookback_s=lookback_s)
    return alerts.threshold_alert(share, pct, HIGH_USAGE)


def memory_high(
    samples: DataFrame,
    components: Components,
    step_s: int,
    pct: float = alerts.DEFAULT_PCT,
    lookback_s: int = LOOKBACK_S,
) -> DataFrame:
    used = _used(samples, MEMORY_USED, components)
    limits = _limit(samples, MEMORY_LIMIT, components)
    share = metrics.pct_of_limit(used, limits, step_s, by=("component",), lookback_s=lookback_s)
    return alerts.threshold_alert(share, pct, HIGH_USAGE)


def is_degraded(samples: DataFrame, components: Components, step_s: int) -> DataFrame:
    """Steps at which any replica set has fewer ready replicas than wanted."""
    keys = ["component", "series", "step_us"]

    def replicas(metric: str, column: str) -> DataFrame:
        rows = _tagged(
            samples,
            metric,
            components,
            equal=lambda c: {"exported_namespace": c.namespace},
            pattern=lambda c: {"replicaset": f"{c.prefix}.*.{c.name}"},
        )
        steps = metrics.resample(rows, step_s, by=("component", "series"))
        return steps.select(*keys, F.col("value").alias(column))

    low = alerts.degraded(replicas(READY, "ready"), replicas(WANTED, "wanted"), keys)
    return low.select("component", "step_us").distinct().withColumn("severity", F.lit(DEGRADED))


def is_down(
    samples: DataFrame, components: Components, step_s: int, start_us: int, end_us: int
) -> DataFrame:
    """Steps from ``start_us`` up to ``end_us`` at which no pod of the component reports Running."""
    running = _tagged(
        samples.filter(F.col("value") == 1),
        PHASE,
        components,
        equal=lambda c: {"exported_namespace": c.namespace, "phase": "Running"},
        pattern=lambda c: {"exported_pod": f"{c.prefix}.*.{c.name}.*"},
    )
    seen = running.select("component", step_start(micros(F.col("ts")), step_s).alias("step_us"))
    step = step_s * MICROS
    steps = samples.sparkSession.range(start_us - start_us % step, end_us, step)
    expected = steps.select(
        F.col("id").alias("step_us"),
        F.explode(F.array(*[F.lit(label) for label in components])).alias("component"),
    )
    return alerts.absent(expected, seen, ["component", "step_us"]).withColumn(
        "severity", F.lit(DOWN)
    )


def component_alerts(
    samples: DataFrame,
    components: Components,
    step_s: int,
    start_us: int,
    end_us: int,
    cpu_pct: float = alerts.DEFAULT_PCT,
    memory_pct: float = alerts.DEFAULT_PCT,
    window_s: int = RATE_WINDOW_S,
    service: str | None = None,
) -> DataFrame:
    """All rules of all components: ``alert, severity, namespace, service, step_us`` for every firing step that
    starts within ``[start_us, end_us)``, the step of ``start_us`` included.

    Only samples of the range are read, and one window before it for the rates. ``service`` names the installation
    and is a label of every alert.
    """
    first = start_us - start_us % (step_s * MICROS)

    def between(low_us: int) -> DataFrame:
        low, high = (F.timestamp_micros(F.lit(us).cast("bigint")) for us in (low_us, end_us))
        return samples.filter((F.col("ts") >= low) & (F.col("ts") < high))

    inside = between(first)
    rules = {
        "CPUUsage": cpu_high(between(first - window_s * MICROS), components, step_s, cpu_pct, window_s),
        "MemoryUsage": memory_high(inside, components, step_s, memory_pct),
        "IsDegraded": is_degraded(inside, components, step_s),
        "IsDown": is_down(inside, components, step_s, start_us, end_us),
    }
    namespace = F.coalesce(
        *[F.when(F.col("component") == k, F.lit(c.namespace)) for k, c in components.items()]
    )
    found = [
        rows.filter(F.col("step_us") >= first).select(
            F.concat(F.col("component"), F.lit(rule)).alias("alert"),
            "severity",
            namespace.alias("namespace"),
            F.lit(service).cast("string").alias("service"),
            "step_us",
        )
        for rule, rows in rules.items()
    ]
    return reduce(DataFrame.unionByName, found)
