"""Named SQL reports over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.series import micros
from tidemark.operators import sketches
from tidemark.operators.joins import lookup, null_safe_join, range_join
from tidemark.operators.ordered import ordered
from tidemark.plans.inputs import register_tables, table
from tidemark.session import scratch_path
from tidemark.sources.tables import ensure_db, merged_scan, save_table


def money(column: str):
    """Exact amount: sums of doubles depend on the order of the rows, sums of decimals do not."""
    return F.col(column).cast("decimal(12,2)")


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, "region", "nation", "customer", "orders")
    return spark.sql(
        """
        SELECT r_name, sum(n) AS orders, CAST(sum(total) AS DOUBLE) AS revenue
        FROM (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total
              FROM orders GROUP BY o_custkey)
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name
        """
    )


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed orders written without, open ones with a priority column, read as one table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old, new = scratch_path(spark, "orders-old"), scratch_path(spark, "orders-new")
    closed = F.col("o_orderstatus") == "F"
    orders.filter(closed).drop("o_orderpriority").write.parquet(old)
    orders.filter(~closed).write.parquet(new)
    return (
        merged_scan(spark, old, new)
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pushed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters reach the parquet reader, which reads three columns."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R"))
        .select("l_orderkey", "l_linenumber", "l_quantity")
    )


def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored by priority; the scan opens one priority's folder only."""
    path = scratch_path(spark, "orders-by-priority")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders.write.partitionBy("o_orderpriority").parquet(path)
    return (
        spark.read.parquet(path)
        .filter(F.col("o_orderpriority") == "2-HIGH")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a table of the catalog; each run has a table of its own."""
    path = scratch_path(spark, "customers")
    name = "customers_" + path.rsplit("-", 1)[-1]
    ensure_db(spark, "tidemark_reports", scratch_path(spark, "reports-db"))
    save_table(table(spark, sf_dir, "customer"), "tidemark_reports", name, path)
    return (
        spark.table(f"tidemark_reports.{name}")
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pruned_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored by nation, joined with the nations of one region: which folders are opened is known only when the
    filtered nations have been read."""
    path = scratch_path(spark, "customers-by-nation")
    table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    customers = spark.read.schema("c_custkey bigint, c_nationkey bigint").parquet(path)
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name")
    joined = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def order_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join; orders are summed up per customer first, so a busy customer joins as one row."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("total"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.sum("n").alias("orders"), F.sum("total").cast("double").alias("revenue"))
    )


def customer_orders_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join: every customer with the number of orders, zero included."""
    per_customer = (
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders")
    )


def supplier_customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full join of two per-nation counts, either of which may lack a nation."""
    suppliers = (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").alias("nation"))
        .agg(F.count(F.lit(1)).alias("suppliers"))
    )
    customers = (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return suppliers.join(customers, "nation", "full")


def idle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


def active_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


def price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per price range; ranges of neighbouring nations overlap."""
    bands = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("band"),
        (F.col("n_nationkey") * 20000.0).alias("low"),
        (F.col("n_nationkey") * 20000.0 + 30000.0).alias("high"),
    )
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    return (
        range_join(
            orders, bands, F.col("o_totalprice"), F.col("low"), F.col("high"), bin_width=10000.0
        )
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(money("o_totalprice")).cast("double").alias("total"),
        )
    )


def nation_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension table broadcast after a check of its size."""
    nations = lookup(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum(money("c_acctbal")).cast("double").alias("balance"),
        )
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "customers", "balance")
    )


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    discounted = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"),
            F.sum(money("l_extendedprice")).cast("double").alias("sum_base"),
            F.round(F.sum(discounted), 2).cast("double").alias("sum_disc"),
            F.avg("l_quantity").alias("avg_qty"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("l_suppkey").alias("suppliers"),
            F.count_if(F.col("l_quantity") > 25).alias("large"),
        )
    )


def approximate_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers per return flag, and whether the approximate distinct count is within 10 percent of them."""
    near = F.abs(F.col("approx") / F.col("exact") - 1) <= 0.1
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.approx_count_distinct("l_suppkey", 0.02).alias("approx"),
            F.count_distinct("l_suppkey").alias("exact"),
        )
        .select("l_returnflag", "exact", near.alias("near"))
    )


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("qty")
    )


def _totals(grouped) -> DataFrame:
    return grouped.agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"))


def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the spread of prices per return flag and year, from sketches stored per day; beside the exact numbers
    of lines and suppliers whether the estimates are as near as their errors say (three and two times them)."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_suppkey", "l_extendedprice")
    dated = lines.withColumn("day", F.to_date("l_shipdate"))
    path = scratch_path(spark, "sketches")
    sketches.sketched(dated, ["l_returnflag", "day"], "l_suppkey", "l_extendedprice").write.parquet(path)
    keys = ["l_returnflag", "year"]
    daily = spark.read.parquet(path).withColumn("year", F.year("day"))
    shares = {"p50": 0.5, "p95": 0.95}
    found = sketches.estimated(sketches.merged(daily, keys), keys, shares)
    below = [F.count_if(F.col("l_extendedprice") < F.col(c)).alias(f"{c}_below") for c in shares]
    upto = [F.count_if(F.col("l_extendedprice") <= F.col(c)).alias(f"{c}_upto") for c in shares]
    exact = dated.withColumn("year", F.year("day")).join(lookup(found.drop("n")), keys)
    exact = exact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.max("distinct").alias("distinct"), *below, *upto
    )
    error = F.greatest(F.lit(1.0), F.col("suppliers") * 3 * sketches.DISTINCT_ERROR)
    checks = [(F.abs(F.col("distinct") - F.col("suppliers")) <= error).alias("suppliers_near")]
    for c, q in shares.items():
        room = F.col("n") * 2 * sketches.RANK_ERROR + 1
        near = (F.col(f"{c}_below") <= F.col("n") * q + room) & (F.col(f"{c}_upto") >= F.col("n") * q - room)
        checks.append(near.alias(f"{c}_near"))
    return exact.select(*keys, "n", "suppliers", *checks)


def sales_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(_sales(spark, sf_dir).rollup("l_returnflag", "l_linestatus"))


def sales_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(_sales(spark, sf_dir).cube("l_returnflag", "l_linestatus"))


def sales_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _sales(spark, sf_dir)
    flag, status = "l_returnflag", "l_linestatus"
    return _totals(sales.groupingSets([(flag,), (status,)], flag, status))


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest orders per customer. Each task keeps three rows per customer before the shuffle."""
    largest = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_orderkey", "o_totalprice")
        .withColumn("place", F.row_number().over(largest))
        .filter(F.col("place") <= 3)
    )


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total of each customer by order date (orders of one day count together)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        micros(F.col("o_orderdate")).alias("us"),
        money("o_totalprice").alias("price"),
    )
    total = ordered(orders, ["o_custkey"], "us").running_sum("price", "total").done()
    return total.select("o_custkey", "o_orderkey", F.col("total").cast("double").alias("total"))


def price_against_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of price from a customer's previous order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", money("o_totalprice").alias("price")
    )
    scan = ordered(orders, ["o_custkey"], "o_orderkey").previous(before="price").done()
    return scan.select(
        "o_custkey", "o_orderkey", (F.col("price") - F.col("before")).cast("double").alias("change")
    )


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best-selling parts; the limit is the report."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
        .orderBy(F.desc("qty"), "l_partkey")
        .limit(10)
    )


def nation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with suppliers or customers, with both, or with the first without the second; with all their rows, the
    suppliers beyond the customers of a nation."""
    of_s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    of_c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))

    def tagged(df: DataFrame, how: str) -> DataFrame:
        return df.select(F.lit(how).alias("how"), "nation")

    return (
        tagged(of_s.union(of_c).distinct(), "union")
        .unionByName(tagged(of_s.intersect(of_c), "intersect"))
        .unionByName(tagged(of_s.subtract(of_c), "except"))
        .unionByName(tagged(of_s.exceptAll(of_c), "except_all"))
    )


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k bigint")
    return (
        table(spark, sf_dir, "events")
        .select("event_type", props.getField("k").alias("k"))
        .groupBy("event_type")
        .agg(F.sum("k").alias("sum_k"), F.max("k").alias("max_k"), F.count("k").alias("n"))
    )


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String, date, number and array expressions on each part and order."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_name").alias("upper_name"),
        F.substring("p_brand", 7, 5).cast("int").alias("brand_no"),
        F.size(words).cast("bigint").alias("n_words"),
        F.element_at(words, -1).alias("last_word"),
        F.array_join(F.array_sort(words), "+").alias("sorted_words"),
        F.floor(F.sqrt(F.col("p_size").cast("double"))).cast("bigint").alias("root"),
        F.pmod("p_partkey", F.lit(7)).cast("bigint").alias("mod7"),
        F.coalesce(F.nullif("p_size", F.lit(10)), F.lit(-1)).alias("size_or"),
    )


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per calendar month."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.month("o_orderdate").cast("bigint").alias("month"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def above_average_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above their customer's average: the average per customer is joined back.

    The correlated form is ``WHERE o_totalprice > (SELECT avg(...) WHERE o_custkey = ...)``; written as
    an aggregate and a join it compares exact cents. Both sides of the join have an exchange of their
    own, so that adaptive execution can split a busy customer's orders.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", money("o_totalprice").alias("price"))
    average = orders.groupBy("o_custkey").agg(
        F.sum("price").alias("total"), F.count(F.lit(1)).alias("n")
    )
    return (
        null_safe_join(orders, average, ["o_custkey"], "inner")
        .filter(F.col("price") * F.col("n") > F.col("total"))
        .select("o_orderkey", "o_custkey")
    )


def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar and correlated subqueries in SQL."""
    register_tables(spark, sf_dir, "orders", "customer")
    return spark.sql(
        """
        SELECT c_custkey, c_mktsegment
        FROM customer c
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
          AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 450000)
        """
    )
