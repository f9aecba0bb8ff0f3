"""Named queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fleet as ff
from tidemark.functions.series import MICROS, micros, step_start
from tidemark.functions.text import tokens
from tidemark.operators import (
    alerts,
    audit,
    eventlog,
    fleet,
    latency,
    logs,
    metrics,
    rules,
    sampling,
    status,
)
from tidemark.operators.lookback import as_of, open_intervals, peak_per_step
from tidemark.operators.text import lines, save_pairs, tokenize, word_count
from tidemark.plans import inputs as i
from tidemark.plans import reports
from tidemark.session import apply_settings, scratch_path
from tidemark.sources import basic, tables
from tidemark.streaming import states
from tidemark.streaming.alerts import stream_alerts
from tidemark.streaming.wordcount import every, read_batches, stream_word_count_batches, sum_over_batches

HOUR, DAY = 3600, 86_400
BY = ["metric", "series"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(apply_settings(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# --- text, scans, tables -------------------------------------------------------------------------


@query
def words(spark, sf_dir):
    """Word count over all document lines."""
    return word_count(tokenize(lines(i.documents(spark, sf_dir))))


@query
def text_file_words(spark, sf_dir):
    """Documents written as text files, scanned line by line, counted."""
    path = scratch_path(spark, "documents-text")
    i.documents(spark, sf_dir).select("text").write.text(path)
    return word_count(tokenize(basic.text_scan(spark, path)))


@query
def document_tokens(spark, sf_dir):
    """Words and lines per document; no shuffle."""
    rows = F.split("text", "\n")
    per_line = F.transform(rows, lambda line: F.size(tokens(line)))
    total = F.aggregate(per_line, F.lit(0), lambda a, b: a + b)
    return i.documents(spark, sf_dir).select(
        "doc_id", F.size(rows).cast("bigint").alias("n_lines"), total.cast("bigint").alias("n_tokens")
    )


@query
def saved_pairs(spark, sf_dir):
    """Word counts written as ``(word,n)`` lines and read back."""
    path = scratch_path(spark, "word-pairs")
    save_pairs(words(spark, sf_dir), path)
    return basic.text_scan(spark, path)


@query
def json_scan(spark, sf_dir):
    """Event properties written as JSON lines and scanned with a schema."""
    path = scratch_path(spark, "props-json")
    i.table(spark, sf_dir, "events").select("props").write.text(path)
    return basic.json_scan(spark, path, "k bigint").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def record_values(spark, sf_dir):
    """Keyed binary records, as a stream delivers them, reduced to their text value."""
    records = i.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.col("props").cast("binary").alias("value"),
    )
    return basic.record_value(records).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def range_gaps(spark, sf_dir):
    """All integers up to the largest customer key of an order, with the orders each has."""
    per_customer = (
        i.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = i.table(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0] or 0
    # a slice for each core, more where one would hold over ten million keys
    slices = max(spark.sparkContext.defaultParallelism, -(-top // 10_000_000))
    ids = basic.range_source(spark, top + 1, slices)
    return ids.join(per_customer, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


@query
def pi_from_lines(spark, sf_dir):
    """Share of order lines whose hashed keys fall into the circle; arithmetic instead of chance."""
    key = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104_729 + F.col("l_suppkey") * 31

    def coordinate(factor: int):
        return F.pmod(key * factor, F.lit(1_000_003)) / F.lit(1_000_003.0) * 2 - 1

    flag = sampling.circle_flag(coordinate(48_271), coordinate(69_621)).alias("inside")
    return sampling.pi_from(i.table(spark, sf_dir, "lineitem").select(flag))


def _fresh_table(spark, schema):
    db = "tidemark_tables"
    tables.ensure_db(spark, db, scratch_path(spark, "tables-db"))
    location = scratch_path(spark, "table")
    name = "t_" + location.rsplit("-", 1)[-1]
    tables.ensure_table(spark, db, name, schema, location)
    return db, name


@query
def table_round_trip(spark, sf_dir):
    """Database, external table, append, reset, append, gate, scan: one copy of the rows remains."""
    db, name = _fresh_table(spark, "id BIGINT, name STRING")
    rows = i.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tables.append_rows(rows, db, name)
    tables.reset_table(spark, db, name)
    tables.append_rows(rows, db, name)
    return tables.require_rows(tables.table_scan(spark, db, name))


@query
def appended_twice(spark, sf_dir):
    """A second append doubles the rows."""
    db, name = _fresh_table(spark, "id BIGINT, segment STRING")
    rows = i.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    tables.append_rows(rows, db, name)
    tables.append_rows(rows, db, name)
    return tables.table_scan(spark, db, name).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query
def loaded_twice(spark, sf_dir):
    """A second load replaces the rows."""
    db, name = _fresh_table(spark, "id BIGINT, segment STRING")
    rows = i.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    tables.load_table(rows, db, name)
    tables.load_table(rows, db, name)
    return tables.table_scan(spark, db, name).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query
def counted_load(spark, sf_dir):
    """A load whose own job counts the rows for the gate."""
    db, name = _fresh_table(spark, "id BIGINT, segment STRING")
    rows = i.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    written = tables.load_checked(rows, db, name)
    loaded = tables.table_scan(spark, db, name)
    return loaded.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.lit(written).cast("bigint").alias("written"))


@query
def reloaded_status(spark, sf_dir):
    """Orders partitioned by status; a second load of the open ones replaces that partition only."""
    db = "tidemark_tables"
    tables.ensure_db(spark, db, scratch_path(spark, "tables-db"))
    location = scratch_path(spark, "orders-by-status")
    name = "t_" + location.rsplit("-", 1)[-1]
    tables.ensure_partitioned(spark, db, name, "id BIGINT, price DOUBLE, status STRING", location, ("status",))
    orders = i.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.reload_partitions(orders, db, name)
    again = orders.filter("o_orderstatus = 'O'").withColumn("o_totalprice", F.lit(1.0))
    for _ in range(2):
        tables.reload_partitions(again.select("o_orderkey", "o_totalprice", "o_orderstatus"), db, name)
    return tables.table_scan(spark, db, name)


@query
def previewed_customers(spark, sf_dir):
    """The first rows on the console, the whole table as result."""
    return basic.preview(i.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 5)


@query
def row_count(spark, sf_dir):
    return tables.row_count(i.table(spark, sf_dir, "lineitem"))


# --- streams -------------------------------------------------------------------------------------


def _line_files(spark, sf_dir, path, keep):
    docs = i.documents(spark, sf_dir).filter(keep).select("text")
    docs.write.mode("append").text(path)


def _count_available(spark, source, out, checkpoint):
    """All there is: one batch, as wide as the cluster; a batch of a fixed number of files would not be."""
    stream = spark.readStream.text(source)
    running = stream_word_count_batches(stream, out, checkpoint, {"availableNow": True})
    running.awaitTermination()


@query
def stream_words(spark, sf_dir):
    """Word counts of the lines a stream finds."""
    source, out = scratch_path(spark, "lines"), scratch_path(spark, "counts")
    i.documents(spark, sf_dir).select("text").write.text(source)
    _count_available(spark, source, out, scratch_path(spark, "progress"))
    return sum_over_batches(read_batches(spark, out))


@query
def triggered_stream_words(spark, sf_dir):
    """Word counts of a stream that looks for lines every two seconds, until it has found all."""
    source, out = scratch_path(spark, "lines"), scratch_path(spark, "counts")
    i.documents(spark, sf_dir).select("text").write.text(source)
    running = stream_word_count_batches(spark.readStream.text(source), out, scratch_path(spark, "progress"), every())
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return sum_over_batches(read_batches(spark, out))


@query
def restarted_stream_words(spark, sf_dir):
    """The stream stops, more lines arrive, and it resumes from its checkpoint."""
    source, out = scratch_path(spark, "lines"), scratch_path(spark, "counts")
    progress = scratch_path(spark, "progress")
    for odd in (0, 1):
        _line_files(spark, sf_dir, source, F.col("doc_id") % 2 == odd)
        _count_available(spark, source, out, progress)
    return sum_over_batches(read_batches(spark, out))


@query
def stream_threshold_alerts(spark, sf_dir):
    """Threshold alerts on daily windows of an event stream; the newest window stays open."""
    source, out = scratch_path(spark, "samples"), scratch_path(spark, "alerts")
    grouped = i.samples(spark, sf_dir).withColumn("grp", F.col("series") % 10)
    grouped.write.parquet(source)
    stream = spark.readStream.schema(grouped.schema).parquet(source)
    found = stream_alerts(
        stream,
        F.col("metric") == "purchase",
        F.col("metric") == "signup",
        "1 day",
        "1 hour",
        by=("grp",),
    )
    running = (
        found.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return (
        spark.read.schema(found.schema)
        .parquet(out)
        .select("grp", "step_us", "used", "limit", F.round("pct", 6).alias("pct"), "severity")
    )


def _two_waves(spark, sf_dir, run):
    """Events written in two waves by time; ``run(stream, out, checkpoint)`` is called after each. Returns ``out``."""
    source, out, progress = (scratch_path(spark, name) for name in ("events", "found", "progress"))
    rows = i.samples(spark, sf_dir).withColumn("grp", F.col("series") % 50)
    middle = F.lit("2024-01-15").cast("timestamp")
    for wave in (F.col("ts") < middle, F.col("ts") >= middle):
        rows.filter(wave).write.mode("append").parquet(source)
        run(spark.readStream.schema(rows.schema).parquet(source), out, progress)
    return out


def _of(rows, metric):
    return rows.filter(F.col("metric") == metric)


@query
def stream_degraded_groups(spark, sf_dir):
    """Days on which a group's newest sign-up (ready) is below its newest click (wanted): two streams joined, stopped and
    resumed; the newest day stays open."""

    def run(stream, out, progress):
        found = states.stream_degraded(_of(stream, "signup"), _of(stream, "click"), ["grp"], "1 day", "1 hour")
        states.run_available(found, out, progress)

    out = _two_waves(spark, sf_dir, run)
    return spark.read.schema("grp bigint, step_us bigint, ready double, wanted double").parquet(out)


@query
def stream_absent_groups(spark, sf_dir):
    """Days on which a group has events but no error among them: an outer join of two streams."""

    def run(stream, out, progress):
        found = states.stream_absent(stream, _of(stream, "error"), ["grp"], "1 day", "1 hour")
        states.run_available(found, out, progress)

    return spark.read.schema("grp bigint, step_us bigint").parquet(_two_waves(spark, sf_dir, run))


SESSION_GAP = "6 hours"


@query
def activity_sessions(spark, sf_dir):
    """Sessions of users that end with six hours without an event."""
    return states.sessions(i.samples(spark, sf_dir), ["series"], SESSION_GAP)


@query
def stream_activity_sessions(spark, sf_dir):
    """The sessions a stream has closed."""

    def run(stream, out, progress):
        states.run_available(states.sessions(stream, ["series"], SESSION_GAP, delay="1 hour"), out, progress)

    schema = "series bigint, start_us bigint, last_us bigint, n bigint"
    return spark.read.schema(schema).parquet(_two_waves(spark, sf_dir, run))


# --- metric series -------------------------------------------------------------------------------


@query
def matched_labels(spark, sf_dir):
    found = metrics.match_labels(
        i.labelled_samples(spark, sf_dir),
        equal={"kind": "error"},
        unequal={"image": "", "absent": "x"},
        pattern={"pod": "app-1.*"},
    )
    return found.select("event_id", "value")


@query
def counter_rates(spark, sf_dir):
    found = metrics.counter_rate(i.counters(spark, sf_dir), 7 * DAY)
    return found.withColumns({c: F.round(c, n) for c, n in (("increase", 6), ("rate", 9))})


@query
def counter_increases(spark, sf_dir):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    found = metrics.counter_increase(i.counters(spark, sf_dir), start, end)
    return found.select(*BY, F.round("increase", 4).alias("increase"), "resets")


@query
def counter_resets(spark, sf_dir):
    return metrics.counter_resets(i.counters(spark, sf_dir))


@query
def container_restarts(spark, sf_dir):
    found = metrics.restarts(i.counters(spark, sf_dir))
    return found.select(*BY, F.round("restarts", 4).alias("restarts"))


@query
def step_maximum(spark, sf_dir):
    return metrics.max_over_series(i.samples(spark, sf_dir), HOUR)


def _usage_pct(spark, sf_dir, step_s):
    rows = i.samples(spark, sf_dir)
    usage, limits = (rows.filter(F.col("metric") == m) for m in ("purchase", "signup"))
    return metrics.pct_of_limit(usage, limits, step_s)


@query
def usage_percent(spark, sf_dir):
    found = _usage_pct(spark, sf_dir, 6 * HOUR)
    return found.withColumn("pct", F.round("pct", 6))


@query
def threshold_alerts(spark, sf_dir):
    found = alerts.threshold_alert(_usage_pct(spark, sf_dir, 6 * HOUR), service="sales")
    return found.withColumn("pct", F.round("pct", 6))


@query
def as_of_values(spark, sf_dir):
    """Each purchase with the newest view of its user within a day before it."""
    rows = i.samples(spark, sf_dir).withColumn("us", micros(F.col("ts")))
    bought = rows.filter(F.col("metric") == "purchase").select("series", "us", "value")
    viewed = rows.filter(F.col("metric") == "view").select("series", "us", F.col("value").alias("seen"))
    return as_of(bought, viewed, ["series"], "us", ["seen"], DAY * MICROS)


@query
def lookback_alerts(spark, sf_dir):
    """Usage on quarter hours against limits that are scraped far less often: the newest of the last twelve hours."""
    rows = i.samples(spark, sf_dir).withColumn("grp", F.col("series") % 10)
    usage, limits = (rows.filter(F.col("metric") == m) for m in ("purchase", "signup"))
    share = metrics.pct_of_limit(usage, limits, 900, by=("grp",), lookback_s=12 * HOUR)
    return alerts.threshold_alert(share).withColumn("pct", F.round("pct", 6))


@query
def latest_values(spark, sf_dir):
    return metrics.latest(i.samples(spark, sf_dir))


@query
def current_totals(spark, sf_dir):
    found = metrics.current_total(i.samples(spark, sf_dir))
    return found.withColumn("total", F.round("total", 4))


@query
def usage_windows(spark, sf_dir):
    found = metrics.usage_series(i.samples(spark, sf_dir), "1 day")
    return found.select(*BY, "step_us", F.round("avg_value", 6).alias("avg_value"), "max_value")


@query
def network_rates(spark, sf_dir):
    directions = {"click": "receive", "view": "transmit"}
    found = metrics.net_rates(i.counters(spark, sf_dir), directions, DAY, DAY)
    return found.withColumns({c: F.round(c, 9) for c in directions.values()})


@query
def app_rollup(spark, sf_dir):
    """Per user (application) and event type (metric of a section), split into four executors."""
    rows = i.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("app"),
        (F.col("event_id") % 4).alias("executor"),
        F.col("event_type").alias("metric"),
        "ts",
        "value",
    )
    found = metrics.app_rollup(rows, section="(?:click|view|error)")
    return found.withColumn("total", F.round("total", 4))


@query
def dashboard_rollup(spark, sf_dir):
    """Every section of the application dashboard over order lines as metrics of their supplier's application."""
    return metrics.dashboard(i.application_metrics(spark, sf_dir))


@query
def variable_values(spark, sf_dir):
    return metrics.variable_values(i.table(spark, sf_dir, "events"), "event_type")


@query
def scoped_samples(spark, sf_dir):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-03 00:00:00", "2024-01-09 00:00:00"))
    chosen = {"event_type": ["click", "error"], "user_id": []}
    return metrics.scope(i.table(spark, sf_dir, "events"), chosen, start, end).select(
        "event_id", "event_type", "value"
    )


@query
def resampled(spark, sf_dir):
    return metrics.resample(i.samples(spark, sf_dir), DAY)


@query
def scrape_gaps(spark, sf_dir):
    return metrics.scrape_gaps(i.samples(spark, sf_dir), DAY)


@query
def missing_steps(spark, sf_dir):
    return metrics.missing_steps(metrics.scrape_gaps(i.samples(spark, sf_dir), DAY), DAY)


# --- alerts --------------------------------------------------------------------------------------


def _hits(spark, sf_dir):
    rows = i.samples(spark, sf_dir)
    return metrics.max_over_series(rows, 2 * HOUR).filter(F.col("max_value") > 60)


@query
def alert_states(spark, sf_dir):
    grid = alerts.evaluation_grid(i.samples(spark, sf_dir), 2 * HOUR, ["metric"])
    return alerts.alert_states(_hits(spark, sf_dir), grid, ["metric"])


@query
def alert_transitions(spark, sf_dir):
    step = step_start(micros(F.col("ts")), 2 * HOUR)
    last = i.samples(spark, sf_dir).agg(F.max(step)).first()[0]
    return alerts.alert_transitions(_hits(spark, sf_dir), ["metric"], 2 * HOUR, last)


@query
def alert_episodes(spark, sf_dir):
    return alerts.alert_episodes(_hits(spark, sf_dir), ["metric"], 2 * HOUR)


@query
def degraded_orders(spark, sf_dir):
    """Orders of which fewer lines are final (ready) than there are lines (wanted)."""
    lines = i.table(spark, sf_dir, "lineitem")
    ready = lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("ready"))
    wanted = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("wanted"))
    return alerts.degraded(ready, wanted, ["l_orderkey"])


@query
def absent_lines(spark, sf_dir):
    """Line numbers 1 to 7 that an order does not have."""
    slots = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l_linenumber")
    expected = i.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), slots)
    observed = i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return alerts.absent(expected, observed, ["l_orderkey", "l_linenumber"])


@query
def reached_in_time(spark, sf_dir):
    found = alerts.reached_within(
        i.table(spark, sf_dir, "events"), ["user_id"], "error", DAY, state="event_type"
    )
    return found.withColumn("seconds", F.round("seconds", 6))


@query
def health(spark, sf_dir):
    """Suppliers as components: their lines are replicas, high-tax lines lack a dependency."""
    dependency = F.when(F.col("l_tax") <= 0.06, F.col("l_discount") < 0.1)
    running = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 49)
    return alerts.health(i.table(spark, sf_dir, "lineitem"), ["l_suppkey"], running, dependency)


@query
def pod_counts(spark, sf_dir):
    return alerts.pod_counts(i.pods(spark, sf_dir), ["namespace"])


@query
def component_alerts(spark, sf_dir):
    """All alert rules of two components on half-hour steps of three weeks. The samples are stored
    by metric, so each rule reads only its own."""
    start, end = 1_704_499_200_000_000, 1_706_313_600_000_000
    path = scratch_path(spark, "component-samples")
    i.component_samples(spark, sf_dir).write.partitionBy("metric").parquet(path)
    samples = spark.read.parquet(path)
    return rules.component_alerts(
        samples, i.COMPONENTS, HOUR // 2, start, end, cpu_pct=90, memory_pct=80, window_s=DAY, service="release"
    )


# --- durations -----------------------------------------------------------------------------------


def _order_seconds(spark, sf_dir):
    shipped = (
        i.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("ended"))
    )
    orders = i.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("started")
    )
    # submitted up to four hours before the start; one order in 50 has no record of it
    waited = F.timestamp_add("SECOND", -(F.col("o_orderkey") * 7919 % 14_400), F.col("started"))
    submitted = F.when(F.col("o_orderkey") % 50 != 0, waited)
    runs = orders.join(shipped, "o_orderkey").withColumn("submitted", submitted)
    return latency.with_durations(runs)


@query
def mean_durations(spark, sf_dir):
    found = latency.mean_duration(_order_seconds(spark, sf_dir), ["o_orderstatus"], "run_s")
    return found.withColumn("mean_s", F.round("mean_s", 3))


@query
def start_latency(spark, sf_dir):
    """Mean seconds from submission to start."""
    found = latency.mean_duration(_order_seconds(spark, sf_dir), ["o_orderstatus"], "latency_s")
    return found.withColumn("mean_s", F.round("mean_s", 3))


def _histogram(spark, sf_dir, edges, seconds):
    found = latency.latency_histogram(_order_seconds(spark, sf_dir), edges, seconds, ("o_orderstatus",))
    return found.withColumn("le", F.when(F.col("le") < float("inf"), F.col("le")))


@query
def latency_histogram(spark, sf_dir):
    """Run times per bucket."""
    return _histogram(spark, sf_dir, [d * float(DAY) for d in (-1000, -100, 0, 30, 365, 1000)], "run_s")


@query
def start_latency_histogram(spark, sf_dir):
    """Seconds from submission to start per bucket, empty buckets included."""
    return _histogram(spark, sf_dir, [float(s) for s in (60, 300, 900, 3600, 10_000, 14_400, 20_000)], "latency_s")


# --- event logs ----------------------------------------------------------------------------------


@query
def eventlog_files(spark, sf_dir):
    """Job log written as one folder of files per group of applications and scanned back."""
    path = scratch_path(spark, "event-logs")
    log = i.job_log(spark, sf_dir).withColumn("part", F.col("app").cast("bigint") % 8)
    log.select("value", "part").write.partitionBy("part").text(path)
    return (
        eventlog.eventlog_scan(spark, path)
        .groupBy(F.get_json_object("value", "$.Event").alias("event"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def app_list(spark, sf_dir):
    return eventlog.app_list(i.application_log(spark, sf_dir))


@query
def concurrent_apps(spark, sf_dir):
    """The most applications of a name that run at once, for each day."""
    apps = eventlog.app_list(i.application_log(spark, sf_dir))
    start, end = F.col("start_ms") * 1000, F.col("end_ms") * 1000
    return peak_per_step(open_intervals(apps, start, end, ["name"]), DAY, ["name"])


@query
def running_executors(spark, sf_dir):
    """How many executors each application has from each instant at which that changes, and their cores."""
    executors = eventlog.executor_summary(i.executor_log(spark, sf_dir))
    start, end = F.col("added_ms") * 1000, F.col("removed_ms") * 1000
    return open_intervals(executors, start, end, ["app"])


@query
def job_summary(spark, sf_dir):
    found = eventlog.job_summary(i.job_log(spark, sf_dir))
    return found.withColumn("stages", F.col("stages").cast("bigint"))


@query
def stage_summary(spark, sf_dir):
    return eventlog.stage_summary(i.stage_log(spark, sf_dir))


@query
def task_summary(spark, sf_dir):
    found = eventlog.task_summary(i.task_log(spark, sf_dir))
    return found.withColumn("avg_ms", F.round("avg_ms", 3)).select(
        "*",
        F.get("p50_p95_ms", F.lit(0)).alias("p50_ms"),
        F.get("p50_p95_ms", F.lit(1)).alias("p95_ms"),
    ).drop("p50_p95_ms")


@query
def executor_summary(spark, sf_dir):
    return eventlog.executor_summary(i.executor_log(spark, sf_dir))


@query
def sql_summary(spark, sf_dir):
    return eventlog.sql_summary(i.sql_log(spark, sf_dir))


@query
def retained_files(spark, sf_dir):
    files = i.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("app"), F.col("o_orderkey").alias("seq")
    )
    return eventlog.retain_last(files, 5)


# --- logs ----------------------------------------------------------------------------------------


@query
def attached_lines(spark, sf_dir):
    found = logs.attach_lines(i.log_lines(spark, sf_dir))
    return found.groupBy("file", "record_no").agg(
        F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last_line")
    )


@query
def parsed_logs(spark, sf_dir):
    found = logs.parse_logs(i.log_lines(spark, sf_dir))
    return found.select(
        "file",
        "record_no",
        F.unix_micros("ts").alias("ts_us"),
        "level",
        "logger",
        "message",
        "trace_lines",
        "cause",
    )


@query
def trace_lines(spark, sf_dir):
    return logs.trace_lines(i.log_lines(spark, sf_dir))


@query
def log_levels(spark, sf_dir):
    return logs.log_levels(i.log_lines(spark, sf_dir), "1 day")


@query
def scanned_log_levels(spark, sf_dir):
    """The same from log files on disk."""
    path = scratch_path(spark, "driver-logs")
    i.log_lines(spark, sf_dir).select("value").write.text(path)
    return logs.log_levels(logs.log_scan(spark, path), "1 day")


@query
def signature_hits(spark, sf_dir):
    documents = i.table(spark, sf_dir, "documents")
    return logs.signature_hits(documents, "License", app="source", value="text")


@query
def signature_missing(spark, sf_dir):
    documents = i.table(spark, sf_dir, "documents")
    sources = documents.select("source").distinct()
    return logs.signature_missing(documents, sources, "MIT", app="source", value="text")


@query
def known_issues(spark, sf_dir):
    """A signature from each document searched for in the lines of all, in one scan of them."""
    docs = i.documents(spark, sf_dir, "source")
    lines = docs.select(F.col("source").alias("app"), F.explode(F.split("text", "\n")).alias("value"))
    return logs.known_issues(lines, i.issue_catalogue(spark, sf_dir))


@query
def parsed_batches(spark, sf_dir):
    return logs.parse_batches(i.batch_lines(spark, sf_dir))


@query
def audit_events(spark, sf_dir):
    found = audit.audit_events(i.audit_lines(spark, sf_dir))
    return found.select(
        "priority",
        "service",
        "event",
        F.unix_micros("ts").alias("ts_us"),
        "ip",
        "session",
        "user",
        F.unix_micros("created").alias("created_us"),
        F.unix_micros("expires").alias("expires_us"),
        F.array_join("groups", " ").alias("groups"),
    )


@query
def audit_sessions(spark, sf_dir):
    found = audit.audit_sessions(audit.audit_events(i.audit_lines(spark, sf_dir)))
    return found.withColumns(
        {"mean_s": F.round("mean_s", 3), "longest_s": F.round("longest_s", 3)}
    )


# --- status --------------------------------------------------------------------------------------


@query
def current_states(spark, sf_dir):
    turns = i.table(spark, sf_dir, "conversations")
    found = status.current_state(turns, ["conv_id"], ts="turn", state="role")
    return found.withColumnRenamed("since", "turn")


@query
def state_counts(spark, sf_dir):
    turns = i.table(spark, sf_dir, "conversations")
    return status.state_counts(turns, ["conv_id"], ts="turn", state="role")


@query
def states_in_order(spark, sf_dir):
    turns = i.table(spark, sf_dir, "conversations")
    return status.saw_in_order(
        turns, ["conv_id"], ["system", "user", "assistant"], ts="turn", state="role"
    )


@query
def matched_pods(spark, sf_dir):
    return status.any_match(i.pods(spark, sf_dir), "app-77", by=("namespace",))


@query
def queued_pods(spark, sf_dir):
    return status.queued(i.pods(spark, sf_dir), by=("namespace",))


@query
def retry_report(spark, sf_dir):
    found = status.retry_report(i.failures(spark, sf_dir), i.retry_policy(spark, sf_dir))
    return found.withColumn("min_gap_s", F.round("min_gap_s", 6))


# --- fleet ---------------------------------------------------------------------------------------


@query
def manifest_items(spark, sf_dir):
    return fleet.parse_manifest(i.manifests(spark, sf_dir))


@query
def image_mismatches(spark, sf_dir):
    declared = fleet.parse_manifest(i.manifests(spark, sf_dir))
    return fleet.image_mismatch(declared, i.running_images(spark, sf_dir))


@query
def image_parts(spark, sf_dir):
    return i.image_refs(spark, sf_dir).select(
        "p_partkey", ff.image_parts(F.col("image_ref")).alias("p")
    ).select("p_partkey", "p.*")


@query
def retagged_images(spark, sf_dir):
    return fleet.retag(i.image_refs(spark, sf_dir), i.releases(spark, sf_dir)).select(
        "p_partkey", "image_ref", "new_ref", "changed"
    )


@query
def config_drift(spark, sf_dir):
    return fleet.config_drift(i.config_documents(spark, sf_dir), i.CONFIG_SCHEMA)


@query
def quantities(spark, sf_dir):
    found = fleet.with_quantity(i.raw_quantities(spark, sf_dir), "raw", "amount")
    return found.select("p_partkey", F.col("amount").cast("double").alias("amount"))


@query
def profile_capacity(spark, sf_dir):
    found = fleet.profile_capacity(i.profiles(spark, sf_dir))
    return found.withColumn("cpu", F.col("cpu").cast("double"))


@query
def spark_memory_settings(spark, sf_dir):
    """Memory settings of applications in bytes."""
    return i.memory_settings(spark, sf_dir).select(
        "p_partkey", ff.spark_memory(F.col("raw")).cast("bigint").alias("n_bytes")
    )


@query
def retagged_nodes(spark, sf_dir):
    """Structured image references with the released tag of their name."""
    nodes = fleet.retag_nodes(i.image_nodes(spark, sf_dir), i.releases(spark, sf_dir), "image")
    return nodes.select("p_partkey", "image.registry", "image.repository", "image.tag", "changed")


@query
def uri_parts(spark, sf_dir):
    return i.table(spark, sf_dir, "pages").select(
        "page_id", ff.uri_parts(F.col("url")).alias("u")
    ).select("page_id", "u.*")


@query
def http_status(spark, sf_dir):
    return (
        i.responses(spark, sf_dir)
        .select("page_id", ff.http_status(F.col("raw")).alias("code"))
        .withColumn("found", ff.status_class(F.col("code")))
    )


# --- reports -------------------------------------------------------------------------------------

for _report in (
    reports.region_revenue,
    reports.merged_orders,
    reports.pushed_scan,
    reports.partition_scan,
    reports.saved_table,
    reports.pruned_by_region,
    reports.order_customer,
    reports.customer_orders_outer,
    reports.supplier_customer_nations,
    reports.idle_orders,
    reports.active_orders,
    reports.price_band,
    reports.nation_dim_join,
    reports.pricing_summary,
    reports.approximate_suppliers,
    reports.merged_sketches,
    reports.sales_rollup,
    reports.sales_cube,
    reports.sales_grouping_sets,
    reports.top_orders_per_customer,
    reports.running_total,
    reports.price_against_previous,
    reports.top_parts,
    reports.nation_sets,
    reports.props_json,
    reports.scalar_functions,
    reports.order_calendar,
    reports.above_average_orders,
    reports.largest_orders,
):
    query(_report)
