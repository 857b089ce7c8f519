"""Relational queries over the star schema: projections, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.plans.book import Book

BOOK = Book()
query = BOOK.query

#: Parts of one text that one row of a join holds.
PARTS_TOGETHER = 1024

# --- projections and filters -------------------------------------------------


@query("P01_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def projection(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("P02_equality", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def equality(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("P03_null_tests", "SELECT o_orderkey IS NULL AS no_order, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def null_tests(spark, d):
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    both = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy(F.col("o_orderkey").isNull().alias("no_order")).agg(F.count("*").alias("n"))


@query("P04_in_list", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 7, 15, 23, 42)")
def in_list(spark, d):
    return table(spark, d, "part").where(F.col("p_size").isin(1, 7, 15, 23, 42)).select("p_partkey", "p_brand", "p_size")


@query("P05_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%' AND p_type IN (SELECT p_type FROM part WHERE p_size = 1)")
def not_like(spark, d):
    part = table(spark, d, "part")
    kinds = part.where("p_size = 1").select("p_type").distinct()
    return part.where(~F.col("p_name").like("%a%")).join(kinds, "p_type", "left_semi").select("p_partkey", "p_name")


@query("P08_blank_rows", "SELECT event_id, nullif(trim(props), '') AS props FROM events WHERE coalesce(nullif(trim(event_type), ''), nullif(trim(props), '')) IS NOT NULL")
def blank_rows(spark, d):
    events = table(spark, d, "events")
    cells = [F.nullif(F.trim(c), F.lit("")) for c in ("event_type", "props")]
    return events.where(F.coalesce(*cells).isNotNull()).select("event_id", cells[1].alias("props"))


@query("P09_not_expired", "SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def not_expired(spark, d):
    events = table(spark, d, "events")
    newest = events.agg(F.max("ts").alias("newest"))  # one row
    return events.join(F.broadcast(newest), F.col("ts") > F.col("newest") - F.expr("INTERVAL 24 HOURS")).select("event_id", "user_id")


@query("P11_name_patterns", "SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z][A-Za-z0-9#_-]{0,39}$') AS valid FROM customer")
def name_patterns(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").rlike("^[A-Za-z][A-Za-z0-9#_-]{0,39}$").alias("valid"))


@query(
    "P14_where_having_case",
    """SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 1 ELSE 0 END)::BIGINT AS middling
       FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY o_custkey HAVING count(*) > 5""",
)
def where_having_case(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_discount > 0.05")
    seen = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return seen.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice").between(1000, 50000)).alias("middling")).where("n > 5")


# --- joins -------------------------------------------------------------------


@query("J01_left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(spark, d):
    # Orders are counted before the join, so what is shuffled to it has a row per customer.
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    joined = table(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("J02_inner_join_of_ids", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34)")
def inner_join_of_ids(spark, d):
    some = table(spark, d, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13, 21, 34))
    return table(spark, d, "lineitem").join(some, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


@query(
    "J03_revenue_by_nation",
    """SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def revenue_by_nation(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == nation.n_nationkey)
    return joined.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n_orders"))


@query(
    "J04_full_outer_merge",
    """SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers
       FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k""",
)
def full_outer_merge(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full_outer")


@query("J05_left_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def left_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("J06_left_semi", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def left_semi(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "supplier").join(returned, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("J07_every_pair", "SELECT r_name, n_name FROM region, nation")
def every_pair(spark, d):
    """Each region with each nation; both are fixed lists."""
    return table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).select("r_name", "n_name")


@query(
    "J08_containment_join",
    """SELECT doc_id, item_id FROM documents, (SELECT item_id, text AS passage FROM benchmark) WHERE contains(text, passage)""",
)
def containment_join(spark, d):
    """Which documents hold which benchmark passage: candidates share 7 words within it, then the whole passage is looked for.

    The first and the last word of a passage may be parts of longer words in the text, so the key leaves them out. Passages of fewer than
    9 words have no such key; they are looked for in every text, broadcast if there are few of them.
    """
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")).withColumn("inner", F.split("passage", " "))
    passages = passages.withColumn("key", F.when(F.size("inner") >= 9, F.xxhash64(F.slice("inner", 2, 7)))).drop("inner")
    docs = table(spark, d, "documents").select("doc_id", "text")
    split = docs.select("doc_id", F.split("text", " ").alias("w"))  # a column of its own, so that a text is split once and not for each of its words
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 6, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, F.lit(7)))))
    found = split.select("doc_id", F.explode(keys).alias("key")).join(passages.where("key IS NOT NULL"), "key").select("doc_id", "item_id", "passage")
    long = found.join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id").distinct()
    brief = passages.where("key IS NULL").select("item_id", "passage")
    if brief.isEmpty():
        return long
    brief = F.broadcast(brief) if brief.count() <= 10_000 else brief
    return long.unionByName(docs.join(brief, F.contains("text", "passage")).select("doc_id", "item_id"))


@query(
    "J09_near_match",
    """SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND length(a.p_type) = length(b.p_type) AND a.p_partkey < b.p_partkey
       WHERE hamming(a.p_type, b.p_type) <= 2""",
)
def near_match(spark, d):
    """All pairs of parts of one brand and size whose type texts have one length and differ in two places at most.

    Texts are compared once, however many parts have them: those that differ in two places have one of their three thirds in common, so
    they are joined on it; a pair comes from its first one. Then the parts of near texts, and of one text, are paired block by block.
    """
    keys = ["p_brand", "p_size", "p_type"]
    part = table(spark, d, "part").select("p_partkey", *keys).dropna()
    classes = part.groupBy(*keys).agg(F.count("*").alias("parts")).withColumn("n", F.length("p_type"))
    start = lambda i: F.floor(F.col("n") * i / 3).cast("int")
    thirds = F.array(*[F.substr("p_type", start(i) + 1, start(i + 1) - start(i)) for i in range(3)])
    block = ["p_brand", "p_size", "n"]

    def cut(text_name: str, thirds_name: str):
        rows = classes.select(*block, F.col("p_type").alias(text_name), thirds.alias(thirds_name))
        number = F.explode(F.array(*map(F.lit, range(3)))).alias("third")
        return rows.select("*", number).withColumn("text", F.get(thirds_name, "third"))

    pairs = cut("own", "thirds").join(cut("other", "others"), [*block, "third", "text"]).where("own < other")
    pairs = pairs.where(F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: (i >= F.col("third")) | (F.get("thirds", i) != F.get("others", i))))
    places = F.sequence(F.lit(1), F.greatest("n", F.lit(1)))
    differ = F.aggregate(places, F.lit(0), lambda s, i: s + (F.substring("own", i, F.lit(1)) != F.substring("other", i, F.lit(1))).cast("int"))
    near = pairs.where(differ <= 2).select("p_brand", "p_size", "own", "other")
    near = near.unionByName(classes.select("p_brand", "p_size", F.col("p_type").alias("own"), F.col("p_type").alias("other")))

    number = F.pmod(F.xxhash64("p_partkey"), F.ceil(F.col("parts") / PARTS_TOGETHER))
    dealt = part.join(classes, keys).groupBy(*keys, number.alias("number")).agg(F.collect_list("p_partkey").alias("members"))
    side = lambda text, x: dealt.select("p_brand", "p_size", F.col("p_type").alias(text), F.col("number").alias(f"{x}_number"), F.col("members").alias(f"{x}_members"))
    met = near.join(side("own", "x"), ["p_brand", "p_size", "own"]).join(side("other", "y"), ["p_brand", "p_size", "other"])
    one, within = F.col("own") == F.col("other"), F.col("x_number") == F.col("y_number")
    met = met.where(~one | (F.col("x_number") <= F.col("y_number"))).select((one & within).alias("within"), F.explode("x_members").alias("x"), "y_members")
    met = met.select("within", "x", F.explode("y_members").alias("y")).where(F.when(F.col("within"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@query("J10_keyed_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def keyed_lookup(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query(
    "J11_correlated_and_lateral",
    """SELECT n_name, s.n AS suppliers, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS best
       FROM nation, LATERAL (SELECT count(*) AS n FROM supplier WHERE s_nationkey = n_nationkey) s""",
)
def correlated_and_lateral(spark, d):
    for name in ("nation", "supplier", "customer"):
        table(spark, d, name).createOrReplaceTempView(f"j11_{name}")
    return spark.sql(
        """SELECT n_name, s.n AS suppliers, (SELECT max(c_acctbal) FROM j11_customer WHERE c_nationkey = n_nationkey) AS best
           FROM j11_nation, LATERAL (SELECT count(*) AS n FROM j11_supplier WHERE s_nationkey = n_nationkey) s"""
    )


@query(
    "J13_as_of_join",
    """SELECT event_id, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts) AS last_order FROM events""",
)
def as_of_join(spark, d):
    """Each event with its user's latest order up to then: both are merged by time and the last order is carried forward."""
    events = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("timestamp_ntz").alias("order_at"), F.lit(1).alias("kind"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("order_at"), F.lit(0).alias("kind"))
    line = W.partitionBy("k").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    return events.unionByName(orders).withColumn("last_order", F.last("order_at", ignorenulls=True).over(line)).where("kind = 1").select("event_id", "last_order")


# --- aggregates --------------------------------------------------------------


@query("A01_counts", "SELECT count(*) AS n, count(o_orderpriority) AS known, count(DISTINCT o_custkey) AS customers FROM orders")
def counts(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("known"), F.countDistinct("o_custkey").alias("customers"))


@query(
    "A03_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(l_shipdate) AS first_ship, max(l_tax) AS most_tax,
       round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_tax").alias("most_tax"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.count("*").alias("n"),
    )


@query("A04_scope_counts", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def scope_counts(spark, d):
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "A05_index_summary",
    """SELECT count(DISTINCT source) AS sources, count(*) AS documents, count(*) FILTER (WHERE e.vec_id IS NULL) AS missing_vectors, bool_or(e.vec_id IS NULL) AS incomplete
       FROM documents LEFT JOIN embeddings e ON doc_id = vec_id""",
)
def index_summary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    missing = F.col("has").isNull()
    return docs.join(vectors, "doc_id", "left").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("documents"), F.count_if(missing).alias("missing_vectors"), F.bool_or(missing).alias("incomplete"))


@query("A06_cells", "SELECT 'orders' AS name, count(*) AS n_rows, count(*) * 6 AS cells FROM orders UNION ALL SELECT 'part', count(*), count(*) * 6 FROM part")
def cells(spark, d):
    def one(name):
        rows = table(spark, d, name)
        return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), (F.count("*") * len(rows.columns)).alias("cells"))

    return one("orders").unionByName(one("part"))


@query(
    "A07_weighted_average",
    """SELECT l_suppkey, round(sum(w * p) / sum(w), 4) AS score FROM (SELECT l_suppkey, CASE l_returnflag WHEN 'R' THEN 3 ELSE 1 END AS w,
       CASE l_linestatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS p FROM lineitem) GROUP BY l_suppkey""",
)
def weighted_average(spark, d):
    w = F.when(F.col("l_returnflag") == "R", 3).otherwise(1)
    p = F.when(F.col("l_linestatus") == "F", F.lit(1.0)).otherwise(F.lit(0.35))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(w * p) / F.sum(w), 4).alias("score"))


@query(
    "A08_sum_within_tolerance",
    """SELECT o_orderkey, round(exact, 2)::DOUBLE AS line_sum, abs(exact::DOUBLE - o_totalprice) <= 1.01 OR abs(exact::DOUBLE * 1.1::DOUBLE - o_totalprice) <= 1.01 AS agrees
       FROM orders JOIN (SELECT l_orderkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4)) AS exact FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def sum_within_tolerance(spark, d):
    """Amounts are summed and rounded as decimals: a sum of doubles depends on the order of its rows, and its halves round either way."""
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(amount).alias("exact"))
    summed = F.col("exact").cast("double")
    targets = F.array(summed, summed * 1.1)
    agrees = F.exists(targets, lambda t: F.abs(t - F.col("o_totalprice")) <= 1.01)
    return table(spark, d, "orders").join(sums, "o_orderkey").select("o_orderkey", F.round("exact", 2).cast("double").alias("line_sum"), agrees.alias("agrees"))


@query(
    "A09_least_by_order",
    """SELECT o_custkey, first(o_orderpriority ORDER BY length(o_orderpriority), o_orderkey) AS doubtful FROM orders GROUP BY o_custkey""",
)
def least_by_order(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(F.length("o_orderpriority"), "o_orderkey")).alias("doubtful"))


@query(
    "A10_totals_once",
    """SELECT round(sum(CASE WHEN pos = 1 THEN o_totalprice END), 2) AS order_total, round(sum(l_extendedprice), 2) AS line_total FROM
       (SELECT o_totalprice, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS pos FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)""",
)
def totals_once(spark, d):
    """An order's total counts on its first line only, its lines' amounts on every line."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    flat = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")
    first = F.row_number().over(W.partitionBy("o_orderkey").orderBy(F.col("l_linenumber").asc_nulls_last())) == 1
    flat = flat.withColumn("first", first)
    return flat.agg(F.round(F.sum(F.when(F.col("first"), F.col("o_totalprice"))), 2).alias("order_total"), F.round(F.sum("l_extendedprice"), 2).alias("line_total"))


@query("A11_shared_notes", "SELECT s_nationkey, string_agg(s_name, '; ' ORDER BY s_suppkey) AS names FROM supplier GROUP BY s_nationkey")
def shared_notes(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(ordered, lambda x: x["s_name"]), "; ").alias("names"))


@query("A14_any_all", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS some_done, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY o_custkey")
def any_all(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("some_done"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@query("A15_usage", "SELECT conv_id, max(length(text)) AS longest, sum(length(text))::BIGINT AS total, round(sum(length(text)) / nullif(count(*), 0), 3) AS rate FROM conversations GROUP BY conv_id")
def usage(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(n).alias("longest"), F.sum(n).alias("total"), F.round(F.try_divide(F.sum(n), F.count("*")), 3).alias("rate"))


@query(
    "A16_doubtful_values",
    """SELECT o_orderkey, ((o_totalprice < 1000)::INT + (o_orderpriority LIKE '%LOW%')::INT + (o_orderstatus = 'P')::INT)::BIGINT AS doubtful FROM orders""",
)
def doubtful_values(spark, d):
    level = lambda ok: F.when(ok, F.lit("check")).otherwise(F.lit("ok"))
    levels = F.create_map(F.lit("total"), level(F.col("o_totalprice") < 1000), F.lit("priority"), level(F.col("o_orderpriority").like("%LOW%")), F.lit("status"), level(F.col("o_orderstatus") == "P"))
    return table(spark, d, "orders").select("o_orderkey", F.size(F.filter(F.map_values(levels), lambda x: x == "check")).cast("long").alias("doubtful"))


@query(
    "A17_grouping_sets",
    """SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT AS g, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed
       FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
)
def grouping_sets(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("a17_lineitem")
    return spark.sql(
        """SELECT l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed
           FROM a17_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())"""
    )


@query("A17_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A17_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("A17_percentiles", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY c_mktsegment")
def percentiles(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.percentile("c_acctbal", 0.5), 4).alias("median"), F.round(F.percentile("c_acctbal", 0.9), 4).alias("p90"))


# --- windows, sort, limit ----------------------------------------------------


@query("W01_rank_position", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def rank_position(spark, d):
    order = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query(
    "W02_latest_questions",
    """SELECT conv_id, text AS latest, previous FROM (SELECT conv_id, text, lag(text) OVER w AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
       FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE r = 1""",
)
def latest_questions(spark, d):
    user = table(spark, d, "conversations").where("role = 'user'")
    by_turn = W.partitionBy("conv_id").orderBy("turn")
    marked = user.select("conv_id", "turn", F.col("text").alias("latest"), F.lag("text").over(by_turn).alias("previous"), F.lead("turn").over(by_turn).isNull().alias("is_last"))
    return marked.where("is_last").select("conv_id", "latest", "previous")


@query("W03_last_by_role", "SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer, max(turn) AS turns FROM conversations GROUP BY conv_id")
def last_by_role(spark, d):
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", answer).alias("last_answer"), F.max("turn").alias("turns"))


@query(
    "W04_running_cut",
    """SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 2000""",
)
def running_cut(spark, d):
    upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(upto).alias("used")).where("used <= 2000")


@query("W05_first_of_group", "SELECT l_orderkey, l_linenumber, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_first FROM lineitem")
def first_of_group(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == F.min("l_linenumber").over(W.partitionBy("l_orderkey"))).alias("is_first"))


@query(
    "W06_consecutive_runs",
    """SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM
       (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL""",
)
def consecutive_runs(spark, d):
    by_time = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("event_type") == F.lag("event_type").over(by_time), 0).otherwise(1)
    runs = table(spark, d, "events").withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_time))
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("W08_first_per_key", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id")
def first_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("W10_ordered_names", "SELECT row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS place, n_name FROM nation")
def ordered_names(spark, d):
    """The 25 nations by name, case ignored."""
    return table(spark, d, "nation").select(F.row_number().over(W.orderBy(F.lower("n_name"), "n_nationkey")).cast("long").alias("place"), "n_name")


@query("W12_limit", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def limit(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_retailprice")


@query("W14_top_per_group", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_per_group(spark, d):
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, d, "part").withColumn("r", place).where("r <= 3").select("p_brand", "p_partkey")


@query(
    "W15_round_robin",
    """SELECT s_nationkey, s_suppkey, row_number() OVER (ORDER BY r, s_nationkey) AS place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 4""",
)
def round_robin(spark, d):
    """The best four suppliers of each nation, one of each nation in turn: at most a hundred rows are numbered."""
    r = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    some = table(spark, d, "supplier").withColumn("r", r).where("r <= 4")
    return some.select("s_nationkey", "s_suppkey", F.row_number().over(W.orderBy("r", "s_nationkey")).cast("long").alias("place"))


@query(
    "W17_frames",
    """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""",
)
def frames(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("w17_orders")
    return spark.sql(
        """SELECT o_orderkey, cast(rank() OVER w AS BIGINT) AS r, cast(dense_rank() OVER w AS BIGINT) AS dr,
                  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent,
                  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS quarter
           FROM w17_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)"""
    )


# --- set operations ----------------------------------------------------------


@query("U01_append_union", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def append_union(spark, d):
    named = lambda t, p: table(spark, d, t).select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance"))
    return named("customer", "c").unionByName(named("supplier", "s"))


@query("U02_word_intersection", "SELECT p_partkey, len(list_intersect(string_split(lower(p_type), ' '), ['brass', 'steel', 'small', 'large']))::BIGINT AS shared FROM part")
def word_intersection(spark, d):
    wanted = F.array(*map(F.lit, ("brass", "steel", "small", "large")))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(F.split(F.lower("p_type"), " "), wanted)).cast("long").alias("shared"))


@query("U03_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def difference(spark, d):
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return left.subtract(table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")))


@query(
    "U05_set_operations",
    """(SELECT l_suppkey AS k FROM lineitem WHERE l_quantity < 3 INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 48) EXCEPT ALL SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""",
)
def set_operations(spark, d):
    lines = table(spark, d, "lineitem")
    few, many = (lines.where(c).select(F.col("l_suppkey").alias("k")) for c in ("l_quantity < 3", "l_quantity > 48"))
    return few.intersectAll(many).exceptAll(table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k")))
