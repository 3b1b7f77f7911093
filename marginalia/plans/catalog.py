"""Queries of the relational operators over the star-schema tables, and their oracles.

Table keys such as (l_orderkey, l_linenumber) repeat, so every order is made total by further columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import ordered as O
from marginalia.operators import reports as R
from marginalia.operators import selection as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS n FROM lineitem) WHERE n = 1""")
def first_row_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return O.first_per_key(rows, ["l_orderkey"], LINE_ORDER.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _editions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("language_letter"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_year"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_record_id"))
    return O.edition_ids(rows)


_EDITIONS = """SELECT book_id, language_letter, pub_year, source_record_id, book_id || '_' || language_letter ||
    CASE WHEN c = 1 THEN '' WHEN n < 26 THEN chr(97 + n::INT) WHEN n < 702 THEN chr(97 + ((n - 26) // 26)::INT) || chr(97 + ((n - 26) % 26)::INT) END AS translation_id
FROM (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY book_id, language_letter) AS c FROM (
    SELECT o_custkey AS book_id, o_orderstatus AS language_letter, strftime(o_orderdate, '%Y-%m-%d') AS pub_year, lpad(o_orderkey::VARCHAR, 12, '0') AS source_record_id FROM orders)
    WINDOW w AS (PARTITION BY book_id, language_letter ORDER BY pub_year, source_record_id))"""


@query(_EDITIONS)
def edition_ids(spark, sf_dir):
    return _editions(spark, sf_dir)


@query(f"""SELECT c_custkey AS book_id, c_name AS title, e.translation_id AS tr_translation_id, e.pub_year AS tr_pub_year
FROM customer LEFT JOIN ({_EDITIONS}) e ON e.book_id = c_custkey AND e.language_letter = 'P'""")
def books_left_editions(spark, sf_dir):
    from marginalia.operators.linkage import merged_table

    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"))
    editions = _editions(spark, sf_dir).filter("language_letter = 'P'").select("book_id", "translation_id", "pub_year")
    return merged_table(books, editions)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unlinked_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 1.0 ELSE 0.0 END) AS share
FROM orders GROUP BY 1""")
def semi_flag_share_by_year(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("flag", F.lit(1))
    orders = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left")
    return orders.groupBy(T.year_of(F.col("o_orderdate").cast("string")).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("flag", F.lit(0))).alias("share"))


@query("""SELECT key, name, nation FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, key) AS n FROM (
    SELECT 0 AS file, c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 1, s_suppkey, s_name, NULL FROM supplier)) WHERE n = 1""")
def union_position_dedup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.lit(0).alias("file"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit(1).alias("file"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    both = customers.unionByName(suppliers, allowMissingColumns=True)
    return O.first_per_key(both, ["key"], ["file", "key"]).select("key", "name", "nation")


@query("""WITH RECURSIVE e AS (
    SELECT user_id, event_id, floor(value)::BIGINT::VARCHAR AS record, CASE WHEN event_id % 5 = 0 THEN '' ELSE (event_id % 23)::VARCHAR END AS isbn,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), k AS (
    SELECT user_id, n, [record] AS records, CASE WHEN isbn <> '' THEN [isbn] ELSE []::VARCHAR[] END AS isbns, event_id, TRUE AS kept FROM e WHERE n = 1
    UNION ALL
    SELECT e.user_id, e.n,
           CASE WHEN list_contains(k.records, e.record) OR (e.isbn <> '' AND list_contains(k.isbns, e.isbn)) THEN k.records ELSE list_append(k.records, e.record) END,
           CASE WHEN list_contains(k.records, e.record) OR e.isbn = '' OR list_contains(k.isbns, e.isbn) THEN k.isbns ELSE list_append(k.isbns, e.isbn) END,
           e.event_id, NOT (list_contains(k.records, e.record) OR (e.isbn <> '' AND list_contains(k.isbns, e.isbn)))
    FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1
) SELECT user_id, event_id FROM k WHERE kept""")
def greedy_edition_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id", "event_id", F.floor("value").cast("long").cast("string").alias("record"), F.when(F.col("event_id") % 5 == 0, "").otherwise((F.col("event_id") % 23).cast("string")).alias("isbn"))
    return O.greedy_editions(rows, ["user_id"], "event_id", "record", "isbn").select("user_id", "event_id")


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS low, max(l_quantity) AS high, median(l_quantity) AS mid,
    avg((l_discount > 0.05)::INT) AS discounted, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1""")
def summary_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.median("l_quantity").alias("mid"), F.avg((F.col("l_discount") > 0.05).cast("int")).alias("discounted"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("""SELECT year(o_orderdate)::INT AS year, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, count(o_totalprice) AS n FROM orders GROUP BY 1""")
def quartiles_by_year(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(*R.quartiles("o_totalprice"))
    return out.select("year", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), "n")


@query("""SELECT p_brand, count(p_size) AS count, avg(p_size) AS mean, stddev_samp(p_size) AS std, min(p_size) AS min, quantile_cont(p_size, 0.25) AS q1, quantile_cont(p_size, 0.5) AS median, quantile_cont(p_size, 0.75) AS q3, max(p_size) AS max FROM part GROUP BY 1""")
def describe_per_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*R.describe("p_size"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def topk_value_counts(spark, sf_dir):
    return R.top_values(table(spark, sf_dir, "part"), "p_type", 15)


@query("SELECT floor(round(l_discount * 2500)::BIGINT / 50)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_002(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(R.histogram(F.col("l_discount"), 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, o_custkey) AS r FROM c)
SELECT max(share) FILTER (r <= 15) AS top15_share, count(*) FILTER (share < 0.5) + 1 AS for_half, count(*) FILTER (n = 1) AS single FROM s""")
def concentration(spark, sf_dir):
    # Customers are ranked by their number of orders in ranges of it, so no task holds all of them.
    per = R.counts(table(spark, sf_dir, "orders"), "o_custkey")
    tally = per.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("rank0", F.coalesce(F.sum("customers").over(before), F.lit(0))).withColumn("sum0", F.coalesce(F.sum(F.col("n") * F.col("customers")).over(before), F.lit(0))).withColumn("all", F.sum(F.col("n") * F.col("customers")).over(Window.partitionBy(F.lit(1))))
    top = F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("customers"), 15 - F.col("rank0")))) / F.max("all")
    below = F.sum(F.greatest(F.lit(0), F.least(F.col("customers"), F.ceil((0.5 * F.col("all") - F.col("sum0")) / F.col("n")).cast("long") - 1)))
    return tally.agg(top.alias("top15_share"), (below + 1).cast("long").alias("for_half"), F.coalesce(F.max(F.when(F.col("n") == 1, F.col("customers"))), F.lit(0)).alias("single"))


@query("""SELECT y.year::INT AS year, count(o_orderkey) AS n FROM generate_series(1990, 2005) y(year) LEFT JOIN orders ON year(o_orderdate) = y.year GROUP BY 1""")
def dense_year_counts(spark, sf_dir):
    return R.dense_counts(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), "year", 1990, 2005)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total FROM orders GROUP BY 1""")
def coverage_matrix(spark, sf_dir):
    return R.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


_TYPES = "click view purchase signup search error login logout".split()


@query(f"""SELECT user_id, concat_ws('+', {', '.join(f"CASE WHEN bool_or(event_type = '{t}') THEN '{t}' END" for t in _TYPES)}) AS combo FROM events GROUP BY 1""")
def combo_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(R.combination(F.col("event_type"), _TYPES, "+").alias("combo"))


@query("""SELECT user_id, arg_min(props, event_id) AS first_props, count(DISTINCT event_type) AS types, (SELECT string_agg(t, '; ' ORDER BY m) FROM (SELECT event_type AS t, min(event_id) AS m FROM events i WHERE i.user_id = o.user_id GROUP BY 1)) AS in_order
FROM events o GROUP BY user_id""")
def shortlist_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    # one row for each user and type first, so that a user's events are never gathered
    kinds = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("m"), F.min_by("props", "event_id").alias("p"))
    return kinds.groupBy("user_id").agg(F.min_by("p", "m").alias("first_props"), F.count(F.lit(1)).alias("types"), T.ordered_unique(F.col("event_type"), F.col("m")).alias("in_order"))


@query("""SELECT coalesce(l_returnflag, 'All') AS l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS open, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def subtotal_all_row(spark, sf_dir):
    return R.with_total(table(spark, sf_dir, "lineitem"), "l_returnflag", [F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.sum("l_quantity").alias("quantity")])


@query("""SELECT year(ts)::INT AS year, month(ts)::INT AS month, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value > 50) AS large, avg((event_type = 'view')::INT) AS viewed FROM events GROUP BY 1, 2""")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") > 50).alias("large"), F.avg((F.col("event_type") == "view").cast("int")).alias("viewed"))


@query("""SELECT l_orderkey AS book_id, """ + ", ".join(f"coalesce(bool_or({c} AND l_returnflag = '{x}'), FALSE) AS {k}_{x}" for k, c in (("all", "l_quantity > 5"), ("early", "l_quantity > 5 AND year(l_shipdate) < 1998"), ("tr", "l_quantity > 5 AND l_tax > 0.02"), ("early_tr", "l_quantity > 5 AND year(l_shipdate) < 1998 AND l_tax > 0.02")) for x in "ANR") + " FROM lineitem GROUP BY 1")
def multi_flag_any(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_returnflag").alias("language_letter"), (F.col("l_quantity") > 5).alias("ok"), (F.year("l_shipdate") < 1998).alias("early_ed"), (F.col("l_tax") > 0.02).alias("has_translator"))
    return X.availability(rows, "ok", ("A", "N", "R"))


_FIRST_SHIP = "SELECT l_orderkey, min(year(l_shipdate))::INT AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


@query(f"""SELECT o_orderkey, least(year(o_orderdate)::INT, f.y) AS year_a, coalesce(f.y, year(o_orderdate)::INT) AS year_b FROM orders LEFT JOIN ({_FIRST_SHIP}) f ON l_orderkey = o_orderkey""")
def year_first_edition(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.year("l_shipdate")).alias("fe"))
    orders = table(spark, sf_dir, "orders").join(first, "o_orderkey", "left")
    year = F.year("o_orderdate")
    return orders.select("o_orderkey", F.least(year, F.col("fe")).alias("year_a"), X.publication_year(year, F.col("fe")).alias("year_b"))


@query("""SELECT a.o_orderkey AS first_key, b.o_orderkey AS later_key, (b.o_orderdate::DATE - a.o_orderdate::DATE)::INT AS gap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey
WHERE b.o_orderdate::DATE - a.o_orderdate::DATE BETWEEN 0 AND 15""")
def gap_between(spark, sf_dir):
    # Range join: besides the equal keys, dates are cut into cells as wide as the range, and a row meets two cells.
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.to_date("o_orderdate").alias("day")).withColumn("cell", F.floor(F.unix_date("day") / 16))
    first = orders.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).withColumnsRenamed({"o_orderkey": "first_key", "day": "from_day"})
    pairs = first.join(orders.withColumnRenamed("o_orderkey", "later_key"), ["o_custkey", "o_orderpriority", "cell"])
    return pairs.filter("first_key <> later_key AND datediff(day, from_day) BETWEEN 0 AND 15").select("first_key", "later_key", F.datediff("day", "from_day").alias("gap"))


_ANCHORS = "SELECT user_id, event_id, floor(value)::BIGINT AS value FROM events WHERE event_type = 'purchase'"


@query(f"""WITH a AS ({_ANCHORS}), r AS (SELECT e.user_id, e.event_id,
    (SELECT max(event_id) FROM a WHERE a.user_id = e.user_id AND a.event_id < e.event_id) AS lo, (SELECT min(event_id) FROM a WHERE a.user_id = e.user_id AND a.event_id >= e.event_id) AS hi FROM events e)
SELECT r.user_id, r.event_id, lo AS lo_number, l.value AS lo_value, hi AS hi_number, h.value AS hi_value, l.value + (r.event_id - lo) * (h.value - l.value) / (hi - lo)::DOUBLE AS expected
FROM r JOIN a l ON l.user_id = r.user_id AND l.event_id = lo JOIN a h ON h.user_id = r.user_id AND h.event_id = hi WHERE h.value >= l.value AND hi - lo <= 1000""")
def bracket_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("value"), "event_type")
    anchors = events.filter("event_type = 'purchase'").select("user_id", "event_id", "value")
    out = O.bracket(events.select("user_id", "event_id"), anchors, ["user_id"], "event_id", "value", most_span=1000)
    return out.withColumn("expected", O.interpolated(F.col("event_id"), F.col("lo_number"), F.col("lo_value"), F.col("hi_number"), F.col("hi_value")))


@query(f"""WITH a AS ({_ANCHORS}), r AS (SELECT user_id, event_id, value, lag(event_id) OVER w AS lo, lag(value) OVER w AS lo_value, lead(event_id) OVER w AS hi, lead(value) OVER w AS hi_value FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, 1 - abs(value - (lo_value + (event_id - lo) * (hi_value - lo_value) / (hi - lo)::DOUBLE)) / (hi_value - lo_value + 1) AS score,
       CASE WHEN hi - lo <= 10 THEN '<=10' WHEN hi - lo <= 40 THEN '11-40' ELSE '>40' END AS bucket FROM r WHERE hi_value >= lo_value""")
def leave_one_out(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.floor("value").cast("long").alias("value"))
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.withColumn("lo", F.lag(F.struct("event_id", "value")).over(order)).withColumn("hi", F.lead(F.struct("event_id", "value")).over(order)).filter("hi.value >= lo.value")
    lo, hi = F.col("lo"), F.col("hi")
    expected = O.interpolated(F.col("event_id"), lo["event_id"], lo["value"], hi["event_id"], hi["value"])
    return rows.select("user_id", "event_id", O.proximity(F.col("value"), expected, lo["value"], hi["value"]).alias("score"), T.distance_bucket(hi["event_id"] - lo["event_id"]).alias("bucket"))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::INT AS done FROM events")
def cumulative_steps(spark, sf_dir):
    return O.cumulative_steps(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_type", "event_id", "done")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 95) THEN 'OCR checked' WHEN bool_or(event_type = 'purchase') THEN 'Scanned' WHEN bool_or(event_type = 'click') THEN 'Received' WHEN bool_or(event_type = 'view') THEN 'Ordered' ELSE 'To do' END AS stage FROM events GROUP BY 1""")
def furthest_stage(spark, sf_dir):
    mark = lambda test: F.when(F.bool_or(test), "x").otherwise("")
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(mark(kind == "view").alias("ordered"), mark(kind == "click").alias("received"), mark(kind == "purchase").alias("scanned"), mark((kind == "purchase") & (F.col("value") > 95)).alias("ocr"))
    return rows.select("user_id", T.furthest_stage(("Ordered", F.col("ordered")), ("Received", F.col("received")), ("Scanned", F.col("scanned")), ("OCR checked", F.col("ocr"))).alias("stage"))


@query("""SELECT c_custkey, 'name' AS kind, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def unpivot_volumes(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    wide = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left")
    return O.volumes(wide, "c_custkey", {"c_name": "name", "c_mktsegment": "segment", "n_name": "nation"})


@query("""SELECT c_custkey AS book_id, max(o_orderdate) FILTER (o_orderstatus = 'F') AS "F_day", max(o_orderdate) FILTER (o_orderstatus = 'O') AS "O_day", max(o_orderdate) FILTER (o_orderstatus = 'P') AS "P_day" FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def pivot_editions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("language_letter"), "o_orderdate")
    return X.wide_editions(rows, {"o_orderdate": "day"}, ("F", "O", "P"))


_SIZES = "SELECT o_orderpriority AS line, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2"


@query(f"""WITH s AS ({_SIZES}), q AS (SELECT *, n * 100 / sum(n) OVER (PARTITION BY line)::DOUBLE AS q FROM s), f AS (SELECT *, floor(q)::BIGINT AS f FROM q),
r AS (SELECT *, 100 - sum(f) OVER (PARTITION BY line) AS rest, row_number() OVER (PARTITION BY line ORDER BY q - f DESC, year) AS k FROM f)
SELECT line, year, n, (f + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM r""")
def proportional_allocation(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("line"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return X.proportional(sizes, "year", "n", F.lit(100), ("line",))


@query("""WITH RECURSIVE g AS (SELECT o_orderpriority || '/' || o_orderstatus || '/' || year(o_orderdate) AS line, count(*) AS n FROM orders GROUP BY 1),
o AS (SELECT list(struct_pack(line := line, n := n, got := 0::BIGINT) ORDER BY n DESC, line) AS gs, least(5000, sum(n))::BIGINT AS remaining FROM g),
r AS (
    SELECT gs, remaining, 1 AS i, greatest(1, remaining // len(gs)) AS share FROM o
    UNION ALL
    SELECT CASE WHEN i > len(gs) THEN gs ELSE list_transform(gs, lambda x, j: CASE WHEN j = i THEN struct_pack(line := x.line, n := x.n, got := x.got + least(share, x.n - x.got, remaining)) ELSE x END) END,
           CASE WHEN i > len(gs) THEN remaining ELSE remaining - least(share, gs[i].n - gs[i].got, remaining) END,
           CASE WHEN i > len(gs) THEN 1 ELSE i + 1 END,
           CASE WHEN i > len(gs) THEN greatest(1, remaining // greatest(1, len(list_filter(gs, lambda x: x.got < x.n)))) ELSE share END
    FROM r WHERE remaining > 0
) SELECT u.line AS line, u.got AS share FROM (SELECT unnest(gs) AS u FROM r WHERE remaining = 0)""")
def even_allocation(spark, sf_dir):
    line = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string"))
    return X.even_shares(table(spark, sf_dir, "orders").groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n")), "line", "n", 5000)


@query(f"""WITH s AS ({_SIZES}), q AS (SELECT *, n * 20 / sum(n) OVER (PARTITION BY line)::DOUBLE AS q FROM s), f AS (SELECT *, floor(q)::BIGINT AS f FROM q),
r AS (SELECT *, 20 - sum(f) OVER (PARTITION BY line) AS rest, row_number() OVER (PARTITION BY line ORDER BY q - f DESC, year) AS k FROM f),
a AS (SELECT line, year, (f + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM r),
p AS (SELECT o_orderkey, o_orderpriority AS line, year(o_orderdate)::INT AS year, row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY (o_orderstatus = 'P') DESC, (o_orderkey * 7919 + 42) % 10007, o_orderkey) AS n FROM orders)
SELECT p.o_orderkey, p.line, p.year FROM p JOIN a ON a.line = p.line AND a.year = p.year WHERE p.n <= a.share""")
def stratified_sample(spark, sf_dir):
    pool = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("line"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "P").alias("partial"))
    sizes = pool.groupBy("line", "year").agg(F.count(F.lit(1)).alias("n"))
    shares = X.proportional(sizes, "year", "n", F.lit(20), ("line",)).drop("n")
    return X.stratified(pool, shares, ["line", "year"], ["partial"], (F.col("o_orderkey") * 7919 + 42) % 10007, "o_orderkey").select("o_orderkey", "line", "year")


@query("""SELECT book_id, language_letter, translation_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, language_letter ORDER BY strict_ok DESC, single DESC, CASE WHEN early THEN year END ASC NULLS LAST, tr DESC, CASE WHEN NOT early THEN exact::INT END DESC NULLS LAST, year ASC NULLS LAST, translation_id) AS n FROM (
SELECT l_orderkey AS book_id, l_returnflag AS language_letter, l_discount > 0.05 AS strict_ok, l_quantity > 10 AS single, l_tax > 0.03 AS tr, l_discount > 0.02 AS exact, year(l_shipdate) AS year, l_orderkey % 2 = 0 AS early, l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity::INT AS translation_id FROM lineitem)) WHERE n = 1""")
def best_edition(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_returnflag").alias("language_letter"), (F.col("l_discount") > 0.05).alias("strict_ok"), (F.col("l_quantity") > 10).alias("single"), (F.col("l_tax") > 0.03).alias("has_translator"), (F.col("l_discount") > 0.02).alias("exact"), F.year("l_shipdate").alias("year"), F.when(F.col("l_orderkey") % 2 == 0, "early").otherwise("late").alias("period"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("translation_id"))
    return X.best_edition(rows).select("book_id", "language_letter", "translation_id")


@query("""SELECT l_partkey, count(*) AS n, count(*) > 1 AS anthology, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1""")
def membership_multiplicity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("anthology"), F.min("l_orderkey").alias("first_order"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS part FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), w AS (SELECT o_custkey, count(*) AS whole FROM orders GROUP BY 1 HAVING count(*) >= 10)
SELECT w.o_custkey, whole, coalesce(part, 0) AS part, coalesce(part, 0) / whole AS rate FROM w LEFT JOIN p ON p.o_custkey = w.o_custkey""")
def rate_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return R.rate(orders.filter("o_orderstatus = 'P'"), orders, "o_custkey")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH c AS (SELECT user_id, event_id, value, sum((value > 90)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT user_id, event_id, max(CASE WHEN value > 90 THEN floor(value)::BIGINT END) OVER (PARTITION BY user_id, g) AS carried FROM c""")
def carried_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("value") > 90, F.floor("value").cast("long")))
    return rows.select("user_id", "event_id", O.carried_forward(rows, ["user_id"], "event_id", "mark").alias("carried"))


@query("""SELECT l_orderkey, l_linenumber, score, score - coalesce(next, 0) AS margin FROM (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS n FROM (
    SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber)) WHERE n = 1""")
def runner_up_margin(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("score"))
    return O.runner_up(rows, ["l_orderkey"], "score", "l_linenumber")
