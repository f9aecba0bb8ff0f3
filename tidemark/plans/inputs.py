"""Inputs of the named queries, derived from the star-schema, event and text tables.

Metric samples, log lines, event-log lines, audit lines, pods, manifests and configuration documents are
rendered from whole tables, so that the work of every query grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import micros
from tidemark.operators import eventlog as ev
from tidemark.operators import rules
from tidemark.operators.ordered import ordered
from tidemark.session import size_shuffles, table_bytes
from tidemark.sources.basic import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
WEEK_US = 7 * 86_400 * 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; shuffles start out wide enough for it."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size_shuffles(spark, table_bytes(rows))
    return rows


def wide_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """The columns of a table whose rows are costly to work on, over all cores even if it is small."""
    return spread(table(spark, sf_dir, name).select(*columns), key)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return wide_table(spark, sf_dir, "orders", "o_orderkey", *columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("event_id", "ts", "user_id", "event_type", "props")
    return wide_table(spark, sf_dir, "events", "event_id", *columns)


def register_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge samples: one series per event type and user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"),
        F.col("user_id").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


def labelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    labels = F.create_map(
        F.lit("kind"),
        F.col("event_type"),
        F.lit("pod"),
        F.concat(F.lit("app-"), F.col("user_id").cast("string")),
        F.lit("image"),
        F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.lit("img")),
    )
    return events.select("event_id", labels.alias("labels"), "value")


COMPONENTS = {
    "Controller": rules.Component("controller", "op-controller", "op", "ns"),
    "Webhook": rules.Component("webhook", "op-webhook", "op", "ns"),
}


def component_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of two components: even users are pods of one, odd users of the other.

    Clicks are CPU counters, purchases memory, views memory limits, sign-ups CPU limits and replica
    counts, errors pod phases. Some users stand for unnamed images or pause containers.
    """
    user = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 2 == 0, "controller").otherwise("webhook")
    pod = F.concat(F.lit("op-1."), name, F.lit("-"), user)

    def labels(**given: Column) -> Column:
        return F.create_map(*[x for key, value in given.items() for x in (F.lit(key), value)])

    namespace = F.lit("ns")
    used = labels(
        namespace=namespace,
        pod=pod,
        container=F.when(F.col("user_id") % 11 == 0, "POD").otherwise("main"),
        image=F.when(F.col("user_id") % 7 == 0, "").otherwise("img"),
    )
    limit = labels(exported_namespace=namespace, container=F.concat(F.lit("op-"), name))
    replicas = labels(
        exported_namespace=namespace, replicaset=F.concat(F.lit("op-"), user, F.lit("."), name)
    )
    phase = labels(exported_namespace=namespace, exported_pod=pod, phase=F.lit("Running"))

    def sample(kind: str, metric: str, of: Column, value: Column) -> Column:
        row = F.struct(
            F.lit(metric).alias("metric"), of.alias("labels"), value.cast("double").alias("value")
        )
        return F.when(F.col("event_type") == kind, row)

    rows = F.array(
        sample("click", rules.CPU_USED, used, F.col("value")),
        sample("signup", rules.CPU_LIMIT, limit, F.col("value") / 20_000),
        sample("purchase", rules.MEMORY_USED, used, F.col("value")),
        sample("view", rules.MEMORY_LIMIT, limit, F.col("value")),
        sample("signup", rules.READY, replicas, F.col("event_id") % 3),
        sample("signup", rules.WANTED, replicas, F.lit(2)),
        sample("error", rules.PHASE, phase, F.col("event_id") % 2),
    )
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"),
        )
        .select("ts", "r.*")
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples: values summed up per series, starting at 0 again every week."""
    rows = samples(spark, sf_dir).withColumn("us", micros(F.col("ts")))
    rows = rows.withColumn("week", F.expr(f"us div {WEEK_US}"))
    summed = ordered(rows, ["metric", "series", "week"], "us").running_sum("value", "total").done()
    return summed.select("metric", "series", "ts", F.round("total", 2).alias("value"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return wide_table(spark, sf_dir, "documents", "doc_id", "doc_id", "text", *columns)


def issue_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature from each document: four of its words, or of every tenth eight of its letters."""
    docs = table(spark, sf_dir, "documents").filter(F.char_length("text") >= 10)
    words = F.array_join(F.slice(F.split("text", " ", 7), 3, 4), " ")
    letters = F.substring("text", 2, 8)
    signature = F.when((F.col("doc_id") % 10 == 0) | (F.char_length(words) < 3), letters).otherwise(words)
    return docs.select(F.col("doc_id").alias("issue"), signature.alias("signature"))


def _ms(ts: str) -> Column:
    return F.expr(f"unix_millis(CAST({ts} AS TIMESTAMP))")


def _event(kind: str, **fields: Column) -> Column:
    named = [F.lit(kind).alias("Event")]
    named += [column.alias(name.replace("_", " ")) for name, column in fields.items()]
    return F.to_json(F.struct(*named))


def _lines(df: DataFrame, app: Column, *events: Column) -> DataFrame:
    """One row per rendered event; null events are left out."""
    listed = F.filter(F.array(*events), lambda e: e.isNotNull())
    return df.select(app.cast("string").alias("app"), F.explode(listed).alias("value"))


def application_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an application; those in status F have ended."""
    orders = _orders(spark, sf_dir)
    start = _event(
        ev.APP_START,
        App_Name=F.col("o_orderpriority"),
        App_ID=F.col("o_orderkey").cast("string"),
        Timestamp=_ms("o_orderdate"),
        User=F.col("o_custkey").cast("string"),
    )
    end = _event(ev.APP_END, Timestamp=_ms("o_orderdate") + (F.col("o_orderkey") % 1000 + 1) * 1000)
    return _lines(
        orders, F.col("o_orderkey"), start, F.when(F.col("o_orderstatus") == "F", end)
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a job of its customer's application; jobs in status O still run."""
    orders = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    start = _event(
        ev.JOB_START,
        Job_ID=key,
        Submission_Time=_ms("o_orderdate"),
        Stage_IDs=F.sequence(F.lit(0), key % 4),
    )
    result = F.when(F.col("o_orderstatus") == "F", "JobSucceeded").otherwise("JobFailed")
    end = _event(
        ev.JOB_END,
        Job_ID=key,
        Completion_Time=_ms("o_orderdate") + (key % 100 + 1) * 1000,
        Job_Result=F.struct(result.alias("Result")),
    )
    return _lines(
        orders, F.col("o_custkey"), start, F.when(F.col("o_orderstatus") != "O", end)
    )


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is an attempt of one of five stages; those in status P have failed."""
    orders = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    info = F.struct(
        (key % 5).alias("Stage ID"),
        key.alias("Stage Attempt ID"),
        F.concat(F.lit("stage "), (key % 5).cast("string")).alias("Stage Name"),
        (key % 7 + 1).alias("Number of Tasks"),
        _ms("o_orderdate").alias("Submission Time"),
        (_ms("o_orderdate") + (key % 60 + 1) * 500).alias("Completion Time"),
        F.when(F.col("o_orderstatus") == "P", F.lit("lost")).alias("Failure Reason"),
    )
    return _lines(orders, F.col("o_custkey"), _event(ev.STAGE_COMPLETED, Stage_Info=info))


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line is a task of its supplier's application."""
    lines = wide_table(
        spark,
        sf_dir,
        "lineitem",
        "l_orderkey",
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_returnflag",
        "l_shipdate",
    )
    quantity = F.col("l_quantity").cast("bigint")
    task = _event(
        ev.TASK_END,
        Stage_ID=F.col("l_linenumber"),
        Stage_Attempt_ID=F.lit(0),
        Task_Info=F.struct(
            _ms("l_shipdate").alias("Launch Time"),
            (_ms("l_shipdate") + quantity * 1000).alias("Finish Time"),
            (F.col("l_partkey") % 10).cast("string").alias("Executor ID"),
            F.concat(F.lit("host-"), (F.col("l_partkey") % 10).cast("string")).alias("Host"),
            (F.col("l_returnflag") == "R").alias("Failed"),
        ),
        Task_Metrics=F.struct(
            (quantity * 900).alias("Executor Run Time"),
            (quantity * 10).alias("JVM GC Time"),
            F.struct((quantity * 4096).alias("Bytes Read")).alias("Input Metrics"),
        ),
    )
    return _lines(lines, F.col("l_suppkey"), task)


def executor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task log and a line for each executor, which is added with its first task; even ones are removed an hour after
    their last."""
    started = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("executor"))
        .agg(F.min("l_shipdate").alias("since"), F.max("l_shipdate").alias("until"))
    )
    added = _event(
        ev.EXECUTOR_ADDED,
        Timestamp=_ms("since"),
        Executor_ID=F.col("executor").cast("string"),
        Executor_Info=F.struct(
            F.concat(F.lit("host-"), F.col("executor").cast("string")).alias("Host"),
            (F.col("executor") % 4 + 1).alias("Total Cores"),
        ),
    )
    removed = _event(
        ev.EXECUTOR_REMOVED,
        Timestamp=_ms("until") + 3_600_000,
        Executor_ID=F.col("executor").cast("string"),
        Removed_Reason=F.lit("idle"),
    )
    gone = F.when(F.col("executor") % 2 == 0, removed)
    return _lines(started, F.col("l_suppkey"), added, gone).unionByName(task_log(spark, sf_dir))


def sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a SQL execution: status O runs, P failed, F completed."""
    orders = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    start = _event(
        ev.SQL_START, executionId=key, description=F.col("o_orderpriority"), time=_ms("o_orderdate")
    )
    error = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("boom "), key.cast("string")))
    end = _event(
        ev.SQL_END,
        executionId=key,
        time=_ms("o_orderdate") + (key % 50 + 1) * 100,
        errorMessage=F.coalesce(error, F.lit("")),
    )
    return _lines(
        orders, F.col("o_custkey"), start, F.when(F.col("o_orderstatus") != "O", end)
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, one file per user; each error carries a stack trace of two lines."""
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARN")
        .otherwise("INFO")
    )
    event = F.col("event_id").cast("string")
    head = F.concat_ws(
        " ",
        F.date_format(F.col("ts").cast("timestamp"), "yy/MM/dd HH:mm:ss"),
        level,
        F.concat(F.initcap("event_type"), F.lit(":")),
        F.lit("event"),
        event,
        F.col("props"),
    )
    trace = F.array(
        F.concat(F.lit("java.nio.file.AccessDeniedException: ./f"), event, F.lit(".jar")),
        F.concat(F.lit("\tat step.Run("), event, F.lit(")")),
    )
    text = F.when(level == "ERROR", F.concat(F.array(head), trace)).otherwise(F.array(head))
    return (
        _events(spark, sf_dir)
        .select(
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"),
            "event_id",
            F.posexplode(text).alias("i", "value"),
        )
        .select("file", (F.col("event_id") * 4 + F.col("i")).alias("line_no"), "value")
    )


def batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed stream batches: per hour a header, the counts per user and a log record."""
    hour = F.expr("unix_millis(CAST(ts AS TIMESTAMP)) div 3600000")
    counts = (
        table(spark, sf_dir, "events")
        .groupBy(hour.alias("hour"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    word = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = counts.select(
        "hour",
        (F.col("user_id") + 3).alias("at"),
        F.concat(F.lit("("), word, F.lit(","), F.col("n").cast("string"), F.lit(")")).alias("value"),
    )
    rule = F.lit("-------------------------------------------")
    header = F.concat(F.lit("Time: "), (F.col("hour") * 3_600_000).cast("string"), F.lit(" ms"))
    ending = F.lit("24/01/01 00:00:00 INFO Batches: all rows are out")
    frame = F.array(
        F.struct(F.lit(0).alias("at"), rule.alias("value")),
        F.struct(F.lit(1).alias("at"), header.alias("value")),
        F.struct(F.lit(2).alias("at"), rule.alias("value")),
        F.struct(F.lit(999_999_998).alias("at"), F.lit("").alias("value")),
        F.struct(F.lit(999_999_999).alias("at"), ending.alias("value")),
    )
    frames = (
        counts.select("hour").distinct().select("hour", F.explode(frame).alias("f")).select("hour", "f.*")
    )
    return rows.unionByName(frames).select(
        F.concat(F.lit("driver-"), (F.col("hour") % 3).cast("string")).alias("file"),
        (F.col("hour") * 1_000_000_000 + F.col("at")).alias("line_no"),
        "value",
    )


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups become login lines, clicks and views two kinds of service start, the rest noise."""
    at = F.col("ts").cast("timestamp")
    event = F.col("event_id").cast("string")
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    expires = F.timestamp_add("SECOND", F.col("event_id") % 900 + 60, at)

    def instant(ts: Column, clock: str) -> Column:
        text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.concat(text, F.lit("808 +0000 UTC m=+"), F.lit(clock))

    login = F.concat(
        F.lit("10.0.0."),
        (F.col("event_id") % 250).cast("string"),
        F.lit(":40404 - s"),
        event,
        F.lit(" - "),
        user,
        F.lit(" ["),
        F.date_format(at, "yyyy/MM/dd HH:mm:ss"),
        F.lit("] [AuthSuccess] Authenticated via OAuth2: Session{email:"),
        user,
        F.lit(" user:u"),
        event,
        F.lit(" token:true id_token:true created:"),
        instant(at, "12.5"),
        F.lit(" expires:"),
        instant(expires, "72.75"),
        F.lit(" refresh_token:true groups:[role:all role:g"),
        (F.col("user_id") % 7).cast("string"),
        F.lit("]}."),
    )
    stamp = F.date_format(at, "yy/MM/dd HH:mm:ss")
    bound = F.concat(
        stamp, F.lit(" INFO HistoryServer: Bound HistoryServer to 0.0.0.0, and started at http://h:18080")
    )
    service = F.concat(
        stamp,
        F.lit(" INFO Utils: Successfully started service 'HistoryServerUI' on port 18080."),
    )
    line = (
        F.when(F.col("event_type") == "signup", login)
        .when(F.col("event_type") == "click", bound)
        .when(F.col("event_type") == "view", service)
        .otherwise(F.concat(stamp, F.lit(" INFO Other: nothing")))
    )
    return _events(spark, sf_dir).select(line.alias("value"))


def application_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as metrics of nine kinds, one for each section of the dashboard."""
    name = F.element_at(F.array(*[F.lit(n) for n in METRIC_NAMES.values()]), (F.col("l_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("app"),
        (F.col("l_partkey") % 4).alias("executor"),
        name.alias("metric"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("bigint")).alias("ts"),
        F.col("l_quantity").alias("value"),
    )


METRIC_NAMES = {
    "tasks": "metrics_executor_doneTasks",
    "memory": "metrics_executor_heapMemory",
    "gc": "metrics_executor_gcSeconds",
    "cores_disk": "metrics_executor_allCores",
    "block_manager": "a_driver_BlockManager_blocks",
    "dag_scheduler": "a_driver_DAGScheduler_waiting",
    "cpu": "a_driver_cpuSeconds",
    "streaming": "a_driver_streamingRows",
    "listener_bus": "a_driver_LiveListenerBus_events",
}


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pods: phase by key, one in three of the pending ones waits in the queue."""
    key = F.col("c_custkey")
    phase = F.element_at(
        F.array(*[F.lit(p) for p in ("Failed", "Pending", "Running", "Succeeded", "Unknown")]),
        (key % 5 + 1).cast("int"),
    )

    def condition(kind: str, status: str, reason: str | None, message: str | None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(status).alias("status"),
            F.lit(reason).cast("string").alias("reason"),
            F.lit(message).cast("string").alias("message"),
        )

    waiting = F.array(
        condition("Initialized", "True", None, None),
        condition("PodScheduled", "False", "Unschedulable", "pod group is not ready, 1 pending"),
    )
    plain = F.array(condition("PodScheduled", "True", None, None))
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("namespace"),
        F.concat(F.lit("app-"), key.cast("string"), F.lit("-driver")).alias("pod"),
        phase.alias("phase"),
        F.when((phase == "Pending") & (key % 3 == 0), waiting)
        .when(key % 4 != 0, plain)
        .alias("conditions"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts: errors while running, sign-ups as failed submissions."""
    kind = F.when(F.col("event_type") == "error", "run").otherwise("submit")
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("error", "signup"))
        .select(F.col("user_id").alias("app"), kind.alias("kind"), "ts")
    )


def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three applications one has no policy, one retries on failure (3 times, 5 after a failed submission) and one
    never."""

    def rule(kind: str, retries: int, gap_s: int) -> Column:
        tries = F.col("app") % 3 == 1
        return F.struct(
            F.lit(kind).alias("kind"),
            F.when(tries, retries).otherwise(0).alias("max_retries"),
            F.when(tries, gap_s).alias("gap_s"),
        )

    rules_ = F.array(rule("run", 3, 1800), rule("submit", 5, 3600))
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("user_id") % 3 != 0)
        .select(F.col("user_id").alias("app"))
        .distinct()
        .select("app", F.explode(rules_).alias("r"))
        .select("app", "r.*")
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part declares a deployment and a daemonset."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("deployment part-"),
        key,
        F.lit(" main registry.example:5000/"),
        F.lower("p_type"),
        F.lit("/app:v"),
        F.col("p_size").cast("string"),
        F.lit(",daemonset part-"),
        key,
        F.lit(" agent agent:1."),
        key,
        F.lit(",,"),
    )
    return table(spark, sf_dir, "part").select(text.alias("manifest"))


def running_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs: main containers with the size capped at 40, no agent for every seventh part."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("part-"), key)
    size = F.least("p_size", F.lit(40)).cast("string")
    main = F.concat(F.lit("registry.example:5000/"), F.lower("p_type"), F.lit("/app:v"), size)

    def row(kind: str, container: str, image: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            name.alias("name"),
            F.lit(container).alias("container"),
            image.alias("image"),
        )

    agent = F.when(
        F.col("p_partkey") % 7 != 0, row("daemonset", "agent", F.concat(F.lit("agent:1."), key))
    )
    found = F.filter(F.array(row("deployment", "main", main), agent), lambda r: r.isNotNull())
    return table(spark, sf_dir, "part").select(F.explode(found).alias("r")).select("r.*")


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references of all shapes: registry with port, no slash, no tag."""
    key = F.col("p_partkey")
    brand = F.lower(F.regexp_replace("p_brand", "#", "-"))
    size = F.col("p_size").cast("string")
    ref = (
        F.when(key % 4 == 0, F.concat(brand, F.lit(":"), size))
        .when(key % 4 == 1, brand)
        .otherwise(F.concat(F.lit("registry.example:5000/team/"), brand, F.lit(":"), size))
    )
    return table(spark, sf_dir, "part").select("p_partkey", ref.alias("image_ref"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest tag per brand; brands that end in 3 have no release."""
    brand = F.lower(F.regexp_replace("p_brand", "#", "-"))
    newest = F.max("p_size").cast("string")
    return (
        table(spark, sf_dir, "part")
        .filter(~F.col("p_brand").endswith("3"))
        .groupBy(brand.alias("brand"))
        .agg(newest.alias("size"))
        .select(
            F.concat(
                F.lit("registry.example:5000/team/"), "brand", F.lit(":"), "size"
            ).alias("image_ref")
        )
    )


CONFIG_SCHEMA = {
    "properties": {
        "size": {"type": "integer", "default": 10},
        "serial": {"type": "integer", "default": 9_007_199_254_740_992},
        "meta": {
            "properties": {
                "brand": {"default": "Brand#2"},
                "kind": {"default": "see part values.yaml file"},
            }
        },
        "prices": {"items": {"properties": {"tier": {"default": 1}}}},
    }
}


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a nested document with a key the schema does not know."""
    document = F.to_json(
        F.struct(
            F.col("p_size").alias("size"),
            (F.lit(9_007_199_254_740_992) + F.col("p_partkey") % 2).alias("serial"),
            F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).alias("meta"),
            F.array(
                F.struct((F.col("p_partkey") % 2).alias("tier")),
                F.struct((F.col("p_partkey") % 3).alias("tier")),
            ).alias("prices"),
            F.col("p_name").alias("unknown"),
        )
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), document.alias("json")
    )


SUFFIXES = ("m", "", "K", "M", "G", "T", "Ki", "Mi", "Gi", "Ti", "g", "bad")


def raw_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int")
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), suffix).alias("raw")
    )


MEMORY_SUFFIXES = ("m", "g", "k", "", "MB", "t", "b", "Gi", ".5g")


def memory_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in MEMORY_SUFFIXES]), (F.col("p_partkey") % len(MEMORY_SUFFIXES) + 1).cast("int")
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), suffix).alias("raw")
    )


def image_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in parts: registry and tag, all three, repository and tag, and one without a tag."""
    brand = F.lower(F.regexp_replace("p_brand", "#", "-"))
    size = F.col("p_size").cast("string")
    which = F.col("p_partkey") % 4

    def node(registry: Column, repository: Column, tag: Column) -> Column:
        return F.struct(registry.alias("registry"), repository.alias("repository"), tag.alias("tag"))

    none = F.lit(None).cast("string")
    whole = F.concat(F.lit("registry.example:5000/team/"), brand)
    image = (
        F.when(which == 0, node(whole, none, size))
        .when(which == 1, node(F.lit("registry.example:5000/"), F.concat(F.lit("/team/"), brand), size))
        .when(which == 2, node(none, whole, size))
        .otherwise(node(F.lit("registry.example:5000"), F.concat(F.lit("team/"), brand), none))
    )
    return table(spark, sf_dir, "part").select("p_partkey", image.alias("image"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("profile"),
        (size % 2 == 0).alias("optional"),
        (size % 3 == 0).alias("temporary"),
        (size.cast("decimal(8,0)") / 10).cast("decimal(8,1)").alias("cpu"),
        (size.cast("bigint") * 100).alias("mem_mi"),
        (F.col("p_partkey") % 3 + 1).alias("n"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response text per page with one of four outcomes; the last has no status line."""
    which = F.col("page_id") % 4
    status = (
        F.when(which == 0, "HTTP/1.1 200 OK")
        .when(which == 1, "HTTP/2 404")
        .when(which == 2, "HTTP/1.1 503 Service Unavailable")
        .otherwise("connection refused after 200 tries")
    )
    text = F.concat(F.lit("* trying "), F.col("url"), F.lit("\n"), status, F.lit("\nServer: x"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("raw"))
