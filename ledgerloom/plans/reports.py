"""Queries over the store's tables, one per operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, items, text
from ledgerloom.operators import ledgers, matching, records, similarity
from ledgerloom.runtime import table
from ledgerloom.sources.sinks import document_rows
from ledgerloom.streaming import pipelines

AS_OF = "2026-06-30"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- scans, projections, filters ---------------------------------------------------------------------------------------
_UNIT_SQL = "CASE WHEN u IN ('', 'none', 'nan', '-', 'n/a') THEN f " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{n}'" for p, n in text.UNIT_RULES) + " WHEN NOT regexp_matches(u, '[a-z]') THEN f ELSE 'Pcs' END"


@query(f"SELECT unit_name, count(*) AS n, count(DISTINCT u) AS spellings FROM (SELECT u, {_UNIT_SQL} AS unit_name FROM (SELECT lower(regexp_replace(coalesce(unit, ''), '^\\s+|\\s+$', '', 'g')) AS u, CASE WHEN regexp_matches(lower(coalesce(description, '')), '{text.LUMP_SUM_WORDS}') THEN 'Lump Sum' ELSE 'Pcs' END AS f FROM catalog_items)) GROUP BY 1")
def units_normalized(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalog_items").select(text.normalize_unit(F.col("unit"), F.col("description")).alias("unit_name"), F.lower(text.strip(F.coalesce("unit", F.lit("")))).alias("u"))
    return c.groupBy("unit_name").agg(F.count("*").alias("n"), F.count_distinct("u").alias("spellings"))


@query(r"WITH k AS (SELECT id, name, regexp_replace(lower(coalesce(name, '')), '[^\w]', '', 'g') AS key FROM suppliers) SELECT key, count(*) OVER (PARTITION BY key) AS n, id, name FROM k WHERE key IN (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1)")
def supplier_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers entered under one key, with all members."""
    return matching.duplicate_groups(table(spark, d, "suppliers"), text.squeezed_key(F.col("name")), ["id", "name"])


_SUFFIXES = "|".join(text.CLIENT_SUFFIXES)


@query(rf"SELECT key, count(*) AS n, count(DISTINCT client_name) AS spellings FROM (SELECT client_name, replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce(client_name, '')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), '( ({_SUFFIXES}))+$', ''), ' ', '') AS key FROM quotations) GROUP BY key")
def client_keys(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").select("client_name", text.client_key(F.col("client_name")).alias("key"))
    return q.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("client_name").alias("spellings"))


@query(r"SELECT key, count(*) AS n FROM (SELECT CASE WHEN length(x) >= 9 THEN right(x, 9) ELSE x END AS key FROM (SELECT regexp_replace(coalesce(client_phone, ''), '\D', '', 'g') AS x FROM quotations)) GROUP BY key")
def phone_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quotations").groupBy(text.phone_key(F.col("client_phone")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT id, left(sha256(concat_ws(chr(31), lower(regexp_replace(coalesce(quote_number, ''), '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(coalesce(status, ''), '^\\s+|\\s+$', '', 'g')), printf('%.4f', coalesce(CAST(subtotal AS DOUBLE), 0)))), 32) AS item_id FROM quotations")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quotations").select("id", text.content_id(F.col("quote_number"), F.col("status"), F.col("subtotal")).alias("item_id"))


@query(r"SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}$')) AS iso, count(*) FILTER (WHERE coalesce(t, '') = '') AS blank, CAST(min(try_strptime(t, '%d/%m/%Y')) AS DATE) AS first_slashed FROM (SELECT trim(start_date) AS t FROM jobs)")
def typed_dates(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select(F.trim("start_date").alias("t"))
    slashed = F.when(F.col("t").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date("t", "d/M/yyyy"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("t").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")).alias("iso"), F.count_if(F.coalesce("t", F.lit("")) == "").alias("blank"), F.min(slashed).alias("first_slashed"))


@query(f"SELECT id, greatest(0, date_diff('day', quote_date, DATE '{AS_OF}') / 365.25) AS years FROM quotations WHERE quote_date IS NOT NULL")
def quote_ages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").filter("quote_date is not null")
    return q.select("id", dates.elapsed_years(F.col("quote_date"), F.lit(AS_OF).cast("date")).alias("years"))


@query("SELECT id, description, CAST(rate AS DOUBLE) AS rate FROM catalog_items WHERE contains(lower(concat_ws(' ', description, category)), 'oak') ORDER BY category, id LIMIT 25")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalog_items").filter(ledgers.mentions("oak", "description", "category"))
    return c.orderBy(F.asc_nulls_last("category"), "id").limit(25).select("id", "description", F.col("rate").cast("double").alias("rate"))


@query("SELECT count(*) FILTER (WHERE coalesce(rate, 0) <= 0) AS zero_rate, count(*) FILTER (WHERE coalesce(trim(description), '') = '') AS no_description, count(*) FILTER (WHERE coalesce(trim(unit), '') = '') AS no_unit, count(*) FILTER (WHERE cost_price > rate) AS sold_under_cost, count(*) AS n FROM catalog_items")
def preflight_counts(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    c = table(spark, d, "catalog_items")
    return c.agg(F.count_if(F.coalesce("rate", F.lit(0)) <= 0).alias("zero_rate"), F.count_if(blank("description")).alias("no_description"), F.count_if(blank("unit")).alias("no_unit"), F.count_if(F.col("cost_price") > F.col("rate")).alias("sold_under_cost"), F.count("*").alias("n"))


# ---- JSON items ----------------------------------------------------------------------------------------------------------
@query(
    """
    WITH q AS (SELECT id, max(items_json) AS j FROM quotations GROUP BY id),
    a AS (SELECT id, unnest(CAST(j AS JSON[])) AS e FROM q WHERE json_valid(j) AND json_type(j) = 'ARRAY'),
    o AS (SELECT id, TRY_CAST(replace(e->>'$.qty', ',', '') AS DECIMAL(18,4)) AS qty, TRY_CAST(replace(e->>'$.rate', ',', '') AS DECIMAL(18,4)) AS rate FROM a WHERE json_type(e) = 'OBJECT')
    SELECT id, count(*) AS lines, CAST(round(sum(coalesce(qty, 0) * coalesce(rate, 0)), 2) AS DOUBLE) AS subtotal FROM o GROUP BY id"""
)
def quotation_line_totals(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").groupBy("id").agg(F.max("items_json").alias("j"))
    lines = q.select("id", F.explode(items.items(F.col("j"))).alias("i"))
    return lines.groupBy("id").agg(F.count("*").alias("lines"), F.round(F.sum(F.coalesce("i.qty", F.lit(0)) * F.coalesce("i.rate", F.lit(0))), 2).cast("double").alias("subtotal"))


# ---- joins -----------------------------------------------------------------------------------------------------------------
@query("SELECT c.c_custkey, count(o.o_orderkey) AS orders, coalesce(CAST(round(sum(CAST(o.o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE), 0) AS total, coalesce(CAST(round(sum(CAST(o.o_totalprice AS DECIMAL(18,4))) FILTER (WHERE o.o_orderstatus = 'F'), 2) AS DOUBLE), 0) AS filled FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1")
def customer_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders are summed per customer before they meet the customers, so the join moves one row per customer."""
    price = F.col("o_totalprice").cast("decimal(18,4)")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(price).alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("filled"))
    sums = [F.coalesce(F.round(c, 2).cast("double"), F.lit(0.0)).alias(c) for c in ("total", "filled")]
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), *sums)


@query("WITH q AS (SELECT id, arg_max(status, (loaded_at, created_at)) AS status FROM quotations GROUP BY id), i AS (SELECT id, max(quotation_id) AS quotation_id, arg_max(status, (loaded_at, created_at)) AS status FROM invoices GROUP BY id) SELECT coalesce(q.status, 'none') AS quotation_status, coalesce(i.status, 'none') AS invoice_status, count(*) AS n FROM i LEFT JOIN q ON i.quotation_id = q.id GROUP BY 1, 2")
def invoice_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Invoices with the quotation they bill, both as last delivered."""
    by = F.struct("loaded_at", "created_at")
    q = table(spark, d, "quotations").groupBy(F.col("id").alias("quotation_id")).agg(F.max_by("status", by).alias("q_status"))
    i = table(spark, d, "invoices").groupBy("id").agg(F.max("quotation_id").alias("quotation_id"), F.max_by("status", by).alias("i_status"))
    return i.join(q, "quotation_id", "left").groupBy(F.coalesce("q_status", F.lit("none")).alias("quotation_status"), F.coalesce("i_status", F.lit("none")).alias("invoice_status")).agg(F.count("*").alias("n"))


@query("SELECT s.id, s.name FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM catalog_items c WHERE c.supplier_id = s.id)")
def suppliers_without_items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalog_items").select(F.col("supplier_id").alias("id"))
    return table(spark, d, "suppliers").join(c, "id", "left_anti").select("id", "name")


@query("SELECT s.id, count(c.id) AS items, CAST(min(c.rate) AS DOUBLE) AS lowest, CAST(max(c.rate) AS DOUBLE) AS highest FROM suppliers s LEFT JOIN catalog_items c ON c.supplier_id = s.id GROUP BY 1")
def supplier_items(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier, those without items with 0 and nulls."""
    c = table(spark, d, "catalog_items").groupBy(F.col("supplier_id").alias("id")).agg(F.count("*").alias("items"), F.min("rate").cast("double").alias("lowest"), F.max("rate").cast("double").alias("highest"))
    s = table(spark, d, "suppliers").select("id").distinct()
    return s.join(c, "id", "left").select("id", F.coalesce("items", F.lit(0)).alias("items"), "lowest", "highest")


@query(
    r"""
    WITH k AS (SELECT key, min(id) AS id FROM (SELECT id, trim(regexp_replace(regexp_replace(lower(description), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM catalog_items WHERE description IS NOT NULL) WHERE key <> '' GROUP BY key),
    l AS (SELECT id AS line_id, trim(regexp_replace(regexp_replace(lower(title), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM (SELECT max(title) AS title, id FROM jobs GROUP BY id) UNION ALL SELECT -id, key FROM k),
    e AS (SELECT line_id, id, 1 AS rung FROM l JOIN k USING (key)),
    c AS (SELECT line_id, arg_min(k.id, (-length(k.key), k.id)) AS id, 3 AS rung FROM l, k WHERE length(l.key) >= 6 AND length(k.key) >= 6 AND (contains(l.key, k.key) OR contains(k.key, l.key)) AND line_id NOT IN (SELECT line_id FROM e) GROUP BY line_id)
    SELECT * FROM e UNION ALL SELECT * FROM c"""
)
def catalog_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Titles of jobs, and the catalogue's own keys, looked up in the catalogue."""
    catalog = table(spark, d, "catalog_items").select("id", "description")
    jobs = table(spark, d, "jobs").groupBy(F.col("id").alias("line_id")).agg(F.max("title").alias("description"))
    own = catalog.select(text.catalog_key(F.col("description")).alias("description"), "id").filter("description <> ''").groupBy("description").agg((-F.min("id")).alias("line_id")).select("line_id", "description")
    return matching.catalog_ladder(jobs.unionByName(own), catalog)


# ---- one row of many ---------------------------------------------------------------------------------------------------------
@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def first_orders(spark: SparkSession, d: str) -> DataFrame:
    return records.keep_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT id, arg_max(status, (loaded_at, created_at)) AS status, arg_max(quote_number, (loaded_at, created_at)) FILTER (WHERE quote_number IS NOT NULL) AS quote_number FROM quotations GROUP BY id")
def latest_quotations(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").select("id", "status", "quote_number", "loaded_at", "created_at")
    return records.keep_latest(q, ["id"], [F.col("loaded_at"), F.col("created_at")], inherit=["quote_number"]).select("id", "status", "quote_number")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def newest_three(spark: SparkSession, d: str) -> DataFrame:
    return records.keep_newest_n(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def numbered_orders(spark: SparkSession, d: str) -> DataFrame:
    return records.number_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey", "number")


@query("WITH f AS (SELECT id, arg_min(status, loaded_at) AS status, arg_min(due_date, loaded_at) AS due_date FROM quotations GROUP BY id), l AS (SELECT id, arg_max(status, loaded_at) AS status, arg_max(due_date, loaded_at) AS due_date FROM quotations GROUP BY id) SELECT id, coalesce(l.status, f.status) AS status, coalesce(l.due_date, f.due_date) AS due_date FROM f JOIN l USING (id)")
def upserted_quotations(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each quotation with its last delivery merged in."""
    q = table(spark, d, "quotations")
    first = q.groupBy("id").agg(*(F.min_by(F.struct(c), "loaded_at")[c].alias(c) for c in ("status", "due_date")))
    last = q.groupBy("id").agg(*(F.max_by(F.struct(c), "loaded_at")[c].alias(c) for c in ("status", "due_date")))
    return records.upsert(first, last, ["id"])


@query("WITH gone AS (SELECT DISTINCT record_id FROM removed_records WHERE table_name = 'quotations') SELECT 'quotations' AS t, count(*) AS n FROM quotations WHERE id NOT IN (FROM gone) UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE coalesce(quotation_id, 0) NOT IN (FROM gone)")
def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "removed_records").filter("table_name = 'quotations'").select(F.col("record_id").alias("id"))
    q, j = records.cascade_delete(table(spark, d, "quotations").select("id"), table(spark, d, "jobs").select("id", "quotation_id"), gone, "id", "quotation_id")
    return q.select(F.lit("quotations").alias("t")).union(j.select(F.lit("jobs"))).groupBy("t").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(allotted AS DOUBLE) AS allotted FROM (SELECT *, p + CASE WHEN r = 1 THEN 100 - sum(p) OVER (PARTITION BY l_orderkey) ELSE 0 END AS allotted FROM (SELECT l_orderkey, l_linenumber, round(100 * CAST(l_quantity AS DECIMAL(18,4)) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) OVER (PARTITION BY l_orderkey) AS DOUBLE), 0) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem))")
def allotted_shares(spark: SparkSession, d: str) -> DataFrame:
    """A hundred parts per order, split by quantity; whole parts, the largest line takes what rounding leaves."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,4)").cast("double").alias("q"), F.lit(100.0).alias("whole"))
    return records.proportional(l, ["l_orderkey"], "q", "whole", [F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "allotted")


# ---- aggregates -----------------------------------------------------------------------------------------------------------------
@query(f"SELECT bucket, count(*) AS n, CAST(sum(grand_total) AS DOUBLE) AS total FROM (SELECT grand_total, CASE WHEN late <= 0 OR late IS NULL THEN 'current' WHEN late <= 30 THEN '1-30' WHEN late <= 60 THEN '31-60' WHEN late <= 90 THEN '61-90' ELSE '90+' END AS bucket FROM (SELECT grand_total, date_diff('day', due_date, DATE '{AS_OF}') AS late FROM (SELECT id, max(due_date) AS due_date, max(grand_total) AS grand_total FROM invoices GROUP BY id))) GROUP BY 1")
def aging_buckets(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "invoices").groupBy("id").agg(F.max("due_date").alias("due_date"), F.max("grand_total").alias("grand_total"))
    late = F.datediff(F.lit(AS_OF).cast("date"), "due_date")
    bucket = F.when(late.isNull() | (late <= 0), "current").when(late <= 30, "1-30").when(late <= 60, "31-60").when(late <= 90, "61-90").otherwise("90+")
    return i.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("grand_total").cast("double").alias("total"))


@query("SELECT strftime(issue_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(vat) FILTER (WHERE lower(status) <> 'cancelled') AS DOUBLE) AS output_vat, CAST(sum(subtotal - discount_amount) FILTER (WHERE lower(status) <> 'cancelled') AS DOUBLE) AS net, count(*) FILTER (WHERE lower(status) = 'draft') AS drafts FROM invoices WHERE issue_date IS NOT NULL GROUP BY 1")
def vat_by_month(spark: SparkSession, d: str) -> DataFrame:
    live = F.lower("status") != "cancelled"
    i = table(spark, d, "invoices").filter("issue_date is not null")
    return i.groupBy(F.date_format("issue_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.when(live, F.col("vat"))).cast("double").alias("output_vat"), F.sum(F.when(live, F.col("subtotal") - F.col("discount_amount"))).cast("double").alias("net"), F.count_if(F.lower("status") == "draft").alias("drafts"))


@query("SELECT count(*) AS n, CAST(round(avg(rate) FILTER (WHERE rate > 0), 4) AS DOUBLE) AS average, CAST(min(rate) FILTER (WHERE rate > 0) AS DOUBLE) AS lowest, CAST(max(rate) AS DOUBLE) AS highest, count(DISTINCT supplier_id) AS sellers, count(DISTINCT lower(category)) AS categories, min(year(created_at)) AS first_year, max(year(created_at)) AS last_year FROM catalog_items")
def library_analytics(spark: SparkSession, d: str) -> DataFrame:
    good = F.when(F.col("rate") > 0, F.col("rate"))
    return table(spark, d, "catalog_items").agg(F.count("*").alias("n"), F.round(F.avg(good.cast("double")), 4).alias("average"), F.min(good).cast("double").alias("lowest"), F.max("rate").cast("double").alias("highest"), F.count_distinct("supplier_id").alias("sellers"), F.count_distinct(F.lower("category")).alias("categories"), F.min(F.year("created_at")).alias("first_year"), F.max(F.year("created_at")).alias("last_year"))


@query("SELECT l_orderkey, CAST(round(sum(q * r), 2) AS DOUBLE) AS subtotal, CAST(round(sum(q * r) * 0.05, 2) AS DOUBLE) AS vat FROM (SELECT l_orderkey, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST(l_tax AS DECIMAL(18,4)) AS r FROM lineitem) GROUP BY 1")
def document_totals(spark: SparkSession, d: str) -> DataFrame:
    dec = lambda c: F.col(c).cast("decimal(18,4)")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(dec("l_quantity") * dec("l_tax")).alias("s"))
    return s.select("l_orderkey", F.round("s", 2).cast("double").alias("subtotal"), F.round(F.col("s").cast("decimal(30,8)") * F.lit("0.05").cast("decimal(3,2)"), 2).cast("double").alias("vat"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))), 2) AS DOUBLE) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    dec = lambda c: F.col(c).cast("decimal(18,4)")
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(dec("l_quantity")).cast("double").alias("quantity"), F.round(F.sum(dec("l_extendedprice") * (1 - dec("l_discount"))), 2).cast("double").alias("revenue"))


@query("SELECT n_name, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))), 2) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Lines are summed per order before the join with orders, so the widest table is shuffled once, as one row per order."""
    dec = lambda c: F.col(c).cast("decimal(18,4)")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(dec("l_extendedprice") * (1 - dec("l_discount"))).alias("r"), F.count("*").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    per = lines.join(o, "l_orderkey").groupBy("c_custkey").agg(F.sum("r").alias("r"), F.sum("k").alias("k")).join(c, "c_custkey").groupBy("n_nationkey").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))
    return per.join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_name", F.round("r", 2).cast("double").alias("revenue"), F.col("k").alias("n"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line_no, CAST(round(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(18,4)) * 0.05, 2) AS DOUBLE) AS vat, CAST(round(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(18,4)) * 1.05, 2) AS DOUBLE) AS line_total FROM lineitem")
def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.lit("").alias("description"), F.lit("Pcs").alias("unit"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("rate"))
    return document_rows(l).select("doc_id", "line_no", F.col("vat").cast("double").alias("vat"), F.col("line_total").cast("double").alias("line_total"))


# ---- vectors -----------------------------------------------------------------------------------------------------------------
@query("SELECT query_id, id, round(score, 5) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def nearest_five(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, every id divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    return similarity.nearest(e.filter("vec_id % 100 = 0"), e, 5).withColumn("score", F.round("score", 5))


# ---- events ------------------------------------------------------------------------------------------------------------------
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query("SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """session_window merges sessions as an aggregate, so a user's events are not gathered in order in one task."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return s.select("user_id", "start", "last", "n")


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def streamed_hours(spark: SparkSession, d: str) -> DataFrame:
    """The windows that a watermark at the latest event has closed, from a stream of the table's files."""
    e = pipelines.file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return pipelines.window_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))
