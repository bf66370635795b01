"""Query shapes users ask of the warehouse, as DataFrame queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slink.plans.bindings import table
from slink.plans.registry import query

# "Now" for relative dates.
ANCHOR = "2001-08-01"


def anchor():
    return F.lit(ANCHOR).cast("timestamp_ntz")


def load(spark, sf_dir, *names):
    return [table(spark, sf_dir, name) for name in names]


@query(
    "q1_project_lateral_alias",
    """SELECT o_orderkey, o_totalprice AS price, round(o_totalprice * 2, 2) AS doubled, round(o_totalprice * 2, 2) + 1 AS doubled_plus
    FROM orders""",
)
def q1(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.round(F.col("price") * 2, 2).alias("doubled"),
        (F.col("doubled") + 1).alias("doubled_plus"),
    )


@query(
    "q2_equality_lower_in",
    """SELECT c_custkey, c_mktsegment FROM customer
    WHERE c_mktsegment = 'BUILDING' OR lower(c_mktsegment) = 'household' OR c_nationkey IN (1, 2, 3)""",
)
def q2(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    wanted = (segment == "BUILDING") | (F.lower(segment) == "household") | F.col("c_nationkey").isin(1, 2, 3)
    return customer.filter(wanted).select("c_custkey", "c_mktsegment")


@query(
    "q3_filter_on_alias",
    "SELECT o_orderkey, month(o_orderdate) AS month, year(o_orderdate) AS year FROM orders WHERE month(o_orderdate) = 1",
)
def q3(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    parts = orders.select("o_orderkey", F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"))
    return parts.filter(F.col("month") == 1)


@query(
    "q4_comma_join",
    "SELECT r_name, n_name AS nation FROM region, nation WHERE r_regionkey = n_regionkey",
)
def q4(spark, sf_dir):
    region, nation = load(spark, sf_dir, "region", "nation")
    # A comma join with its key in WHERE: Catalyst turns the pair into an equi-join.
    return spark.sql(
        "SELECT r_name, n_name AS nation FROM {region}, {nation} WHERE r_regionkey = n_regionkey", region=region, nation=nation
    )


@query(
    "q5_join_chain_top10",
    """SELECT DISTINCT count(*) AS orders_per_product, p_name AS title
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
    GROUP BY p_name ORDER BY orders_per_product DESC NULLS FIRST, title LIMIT 10""",
)
def q5(spark, sf_dir):
    orders, lineitem, supplier, part = load(spark, sf_dir, "orders", "lineitem", "supplier", "part")
    lines = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .join(orders, lineitem.l_orderkey == orders.o_orderkey)
    )
    # Grouping already makes rows distinct.
    counted = lines.groupBy(F.col("p_name").alias("title")).agg(F.count("*").alias("orders_per_product"))
    return counted.orderBy(F.desc_nulls_first("orders_per_product"), "title").limit(10)


@query(
    "q6_join_sum_filter",
    "SELECT sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 500",
)
def q6(spark, sf_dir):
    orders, lineitem = load(spark, sf_dir, "orders", "lineitem")
    large = orders.filter(F.col("o_totalprice") > 500)
    return lineitem.join(large, lineitem.l_orderkey == large.o_orderkey).agg(F.sum("l_quantity").alias("quantity"))


@query(
    "q7_repeat_same_brand",
    """WITH bought AS (
      SELECT DISTINCT o_custkey, p_brand, o_orderkey, o_orderdate
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
    SELECT count(DISTINCT o1.o_orderkey) AS same_brand_orders, count(DISTINCT o2.o_orderkey) AS total_repeat_orders,
      round(count(DISTINCT o1.o_orderkey) * 1.0 / count(DISTINCT o2.o_orderkey) * 100, 4) AS likelihood_same_brand
    FROM bought o1 JOIN bought o2 ON o1.o_custkey = o2.o_custkey AND o1.p_brand = o2.p_brand
      AND o1.o_orderkey <> o2.o_orderkey AND o1.o_orderdate < o2.o_orderdate
      AND o1.o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 2 YEAR""",
)
def q7(spark, sf_dir):
    """Later orders of the same customer and brand, without building the pairs.

    An order has a later partner when it is before the last date of its
    (customer, brand), and an earlier one when it is after the first date
    inside the window. Two bounds per group replace the theta self-join, whose
    output would grow with the square of a customer's orders.
    """
    orders, lineitem, part = load(spark, sf_dir, "orders", "lineitem", "part")
    bought = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .select("l_orderkey", "p_brand")
        .join(orders, F.col("l_orderkey") == orders.o_orderkey)
        .select("o_custkey", "p_brand", "o_orderkey", "o_orderdate")
    )
    start = F.add_months(anchor(), -24).cast("timestamp_ntz")
    recent = F.col("o_orderdate") >= start
    bounds = bought.groupBy("o_custkey", "p_brand").agg(
        F.min(F.when(recent, F.col("o_orderdate"))).alias("first_recent"), F.max("o_orderdate").alias("last")
    )
    marked = bought.join(bounds, ["o_custkey", "p_brand"]).select(
        "o_orderkey",
        (recent & (F.col("o_orderdate") < F.col("last"))).alias("is_first"),
        F.coalesce(F.col("o_orderdate") > F.col("first_recent"), F.lit(False)).alias("is_second"),
    )
    # One row per order, so the distinct counts are plain sums.
    per_order = marked.groupBy("o_orderkey").agg(F.bool_or("is_first").alias("f"), F.bool_or("is_second").alias("s"))
    counted = per_order.agg(
        F.count_if("f").alias("same_brand_orders"), F.count_if("s").alias("total_repeat_orders")
    )
    share = F.col("same_brand_orders").cast("double") / F.nullif("total_repeat_orders", F.lit(0)) * 100
    return counted.withColumn("likelihood_same_brand", F.round(share, 4))


@query(
    "q8_semi_join_having",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (
      SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 2 YEAR GROUP BY o_custkey HAVING count(*) > 1)""",
)
def q8(spark, sf_dir):
    customer, orders = load(spark, sf_dir, "customer", "orders")
    recent = orders.filter(F.col("o_orderdate") >= F.add_months(anchor(), -24).cast("timestamp_ntz"))
    repeat = recent.groupBy("o_custkey").count().filter(F.col("count") > 1)
    return customer.join(repeat, customer.c_custkey == repeat.o_custkey, "left_semi").select("c_custkey", "c_name")


@query(
    "q9_correlated_exists",
    """SELECT count(*) AS orders_per_month, month(o_orderdate) AS month, year(o_orderdate) AS year
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    WHERE p_name LIKE 'red%' AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 5 YEAR AND EXISTS (
      SELECT * FROM lineitem l2 JOIN part p2 ON p2.p_partkey = l2.l_partkey WHERE p2.p_name LIKE 'small%' AND l2.l_orderkey = o_orderkey)
    GROUP BY month(o_orderdate), year(o_orderdate)""",
)
def q9(spark, sf_dir):
    orders, lineitem, part = load(spark, sf_dir, "orders", "lineitem", "part")

    def lines_of(prefix):
        parts = part.filter(F.col("p_name").startswith(prefix)).select("p_partkey")
        return lineitem.join(parts, lineitem.l_partkey == parts.p_partkey).select("l_orderkey")

    recent = orders.filter(F.col("o_orderdate") >= F.add_months(anchor(), -60).cast("timestamp_ntz"))
    both = recent.join(lines_of("small"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(
        lines_of("red"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    return (
        both.groupBy(F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"))
        .agg(F.count("*").alias("orders_per_month"))
        .orderBy(F.desc_nulls_first("orders_per_month"), "year", "month")
    )


@query(
    "q10_derived_table_join",
    """SELECT o_orderkey, top.customer_id FROM orders JOIN (
      SELECT c_custkey AS customer_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
      FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY total DESC, customer_id LIMIT 15) AS top
    ON o_custkey = top.customer_id""",
)
def q10(spark, sf_dir):
    customer, orders = load(spark, sf_dir, "customer", "orders")
    spent = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    top = (
        spent.join(customer, spent.o_custkey == customer.c_custkey, "left_semi")
        .orderBy(F.desc("total"), "o_custkey")
        .limit(15)
        .select(F.col("o_custkey").alias("customer_id"))
    )
    return orders.join(top, orders.o_custkey == top.customer_id).select("o_orderkey", "customer_id")


@query(
    "q11_ratio_to_total",
    """SELECT s_name AS vendor, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM lineitem), 8) AS likelihood
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name""",
)
def q11(spark, sf_dir):
    lineitem, supplier = load(spark, sf_dir, "lineitem", "supplier")
    total = lineitem.agg(F.count("*")).scalar()
    per_key = lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    per_vendor = per_key.join(supplier, per_key.l_suppkey == supplier.s_suppkey).groupBy(F.col("s_name").alias("vendor"))
    return per_vendor.agg(F.sum("n").alias("n")).withColumn("likelihood", F.round(F.col("n").cast("double") / total, 8))


@query(
    "q12_cast_before_divide",
    "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS finished_share FROM orders GROUP BY o_custkey",
)
def q12(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    share = F.count_if(F.col("o_orderstatus") == "F").cast("double") / F.count("*")
    return orders.groupBy("o_custkey").agg(share.alias("finished_share"))


@query(
    "q13_extract_group",
    """SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, count(*) AS orders
    FROM orders GROUP BY ALL""",
)
def q13(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    date = F.col("o_orderdate")
    keys = [F.year(date).alias("year"), F.quarter(date).alias("quarter"), F.month(date).alias("month")]
    return orders.groupBy(*keys).agg(F.count("*").alias("orders"))


@query(
    "q14_lag_percent_change",
    """WITH s AS (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales FROM orders GROUP BY 1, 2)
    SELECT year, quarter, total_sales,
      round(total_sales / lag(total_sales) OVER (PARTITION BY year ORDER BY quarter) - 1, 6) AS percent_change FROM s""",
)
def q14(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    sales = orders.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_sales")
    )
    previous = F.lag("total_sales").over(Window.partitionBy("year").orderBy("quarter"))
    return sales.withColumn("percent_change", F.round(F.col("total_sales") / previous - 1, 6))


@query(
    "q15_previous_month",
    """SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE o_orderdate >= date_trunc('month', TIMESTAMP '2001-08-01') - INTERVAL 1 MONTH
      AND o_orderdate < date_trunc('month', TIMESTAMP '2001-08-01') GROUP BY o_orderstatus""",
)
def q15(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    this_month = F.trunc(F.lit(ANCHOR).cast("date"), "month")
    start, end = F.add_months(this_month, -1).cast("timestamp_ntz"), this_month.cast("timestamp_ntz")
    month = orders.filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
    return month.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "q16_relative_dates",
    """SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH) AS last_6_months,
      count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY) AS last_7_days,
      count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 5 YEAR) AS last_5_years FROM orders""",
)
def q16(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    date = F.col("o_orderdate")
    return orders.agg(
        F.count_if(date >= F.timestamp_add("MONTH", F.lit(-6), anchor())).alias("last_6_months"),
        F.count_if(date >= anchor() - F.make_interval(days=F.lit(7))).alias("last_7_days"),
        F.count_if(date >= anchor() - F.make_interval(years=F.lit(5))).alias("last_5_years"),
    )


@query("q17_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def q17(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    return part.filter(F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name")


@query(
    "q18_concat_group_top5",
    """SELECT count(*) AS orders_per_customer, c_name || ' ' || n_name AS full_name
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY c_name, n_name ORDER BY orders_per_customer DESC, full_name LIMIT 5""",
)
def q18(spark, sf_dir):
    orders, customer, nation = load(spark, sf_dir, "orders", "customer", "nation")
    # Orders are counted per key first: one row per customer goes into the joins.
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    named = counted.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    per_name = named.groupBy("c_name", "n_name").agg(F.sum("n").alias("orders_per_customer"))
    return (
        per_name.select("orders_per_customer", F.concat_ws(" ", "c_name", "n_name").alias("full_name"))
        .orderBy(F.desc("orders_per_customer"), "full_name")
        .limit(5)
    )


@query(
    "q19_or_equalities",
    """SELECT count(*) AS orders_per_product, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_name = 'small ring' OR p_name = 'red widget' GROUP BY p_name""",
)
def q19(spark, sf_dir):
    lineitem, part = load(spark, sf_dir, "lineitem", "part")
    name = F.col("p_name")
    chosen = part.filter((name == "small ring") | (name == "red widget"))
    lines = lineitem.join(chosen, lineitem.l_partkey == chosen.p_partkey)
    return (
        lines.groupBy(name.alias("title"))
        .agg(F.count("*").alias("orders_per_product"))
        .orderBy(F.desc_nulls_first("orders_per_product"), "title")
    )


@query(
    "q20_distinct_ordered",
    """SELECT DISTINCT p_brand AS vendor, s_name AS supplier FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey""",
)
def q20(spark, sf_dir):
    lineitem, part, supplier = load(spark, sf_dir, "lineitem", "part", "supplier")
    pairs = lineitem.join(part, lineitem.l_partkey == part.p_partkey).select("p_brand", "l_suppkey").distinct()
    named = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select(F.col("p_brand").alias("vendor"), F.col("s_name").alias("supplier")).distinct().orderBy("vendor", "supplier")


@query(
    "q21_aggregate_filter",
    """SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS open_quantity,
      count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_returnflag""",
)
def q21(spark, sf_dir):
    (lineitem,) = load(spark, sf_dir, "lineitem")
    return lineitem.groupBy("l_returnflag").agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("open_quantity"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
    )


@query(
    "q22_min_max_sum",
    """SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_order, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""",
)
def q22(spark, sf_dir):
    orders, customer = load(spark, sf_dir, "orders", "customer")
    building = customer.filter(F.col("c_mktsegment") == "BUILDING")
    joined = orders.join(building, orders.o_custkey == building.c_custkey)
    return joined.agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_order"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query("q23_star", "SELECT nation.*, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def q23(spark, sf_dir):
    nation, region = load(spark, sf_dir, "nation", "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(nation["*"], region["r_name"])


@query("q24_constant_select", "SELECT 'unsure' AS user_name, 'a' || 'b' AS col1 FROM customer")
def q24(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    return customer.select(F.lit("unsure").alias("user_name"), F.concat(F.lit("a"), F.lit("b")).alias("col1"))


@query(
    "q25_first_row_nulls_last",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate ASC NULLS LAST, o_orderkey LIMIT 1""",
)
def q25(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    first = orders.orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").limit(1)
    return first.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query(
    "q26_compound_date_parts",
    """WITH p AS (SELECT month(o_orderdate) AS month, year(o_orderdate) AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      JOIN part ON p_partkey = l_partkey WHERE p_name LIKE '%ring')
    SELECT count(*) AS order_count, month, year FROM p
    WHERE (month = 1 AND year = 1999) OR (month = 12 AND year = 1998) OR (month = 1 AND year = 1998) OR (month = 12 AND year = 1997)
    GROUP BY month, year""",
)
def q26(spark, sf_dir):
    orders, lineitem, part = load(spark, sf_dir, "orders", "lineitem", "part")
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    in_winter = (
        ((month == 1) & (year == 1999))
        | ((month == 12) & (year == 1998))
        | ((month == 1) & (year == 1998))
        | ((month == 12) & (year == 1997))
    )
    rings = part.filter(F.col("p_name").endswith("ring"))
    lines = lineitem.join(rings, lineitem.l_partkey == rings.p_partkey)
    joined = lines.join(orders.filter(in_winter), lines.l_orderkey == orders.o_orderkey)
    return (
        joined.groupBy(month.alias("month"), year.alias("year"))
        .agg(F.count("*").alias("order_count"))
        .orderBy(F.desc("year"), F.desc("month"))
    )
