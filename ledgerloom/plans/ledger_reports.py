"""Queries of ledgers, lookups and ordered views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, shapes, text
from ledgerloom.operators import ledgers, records, similarity
from ledgerloom.runtime import table

AS_OF = "2026-06-30"
QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _day() -> F.Column:
    return F.lit(AS_OF).cast("date")


def _money(*names: str) -> list:
    return [F.round(n, 2).cast("double").alias(n) for n in names]


def _latest(spark: SparkSession, d: str, name: str, columns: list[str]) -> DataFrame:
    rows = table(spark, d, name).select("id", *columns, "loaded_at", "created_at").filter("id is not null")
    return records.keep_latest(rows, ["id"], [F.col("loaded_at"), F.col("created_at"), F.col("status")]).drop("loaded_at", "created_at")


_LAST = lambda t, cols: "SELECT id, " + ", ".join(f"arg_max({c}, (loaded_at, created_at, status)) AS {c}" if c in ("status", "payment_status") else f"max({c}) AS {c}" for c in cols) + f" FROM {t} WHERE id IS NOT NULL GROUP BY id"
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,4))"


# ---- sums over children --------------------------------------------------------------------------------------------------
@query(f"SELECT o_orderkey, coalesce(n, 0) AS entries, round(CAST(coalesce(c, 0) AS DOUBLE), 2) AS actual_cost, round(CAST(CAST(o_totalprice AS DECIMAL(18,4)) - coalesce(c, 0) AS DOUBLE), 2) AS margin, n IS NOT NULL AS has_costs FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum({_PRICE}) AS c FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def job_margins(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs, their lines as costs booked against them."""
    jobs = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("quoted_total"))
    costs = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"))
    out = ledgers.with_margin(ledgers.left_totals(jobs, costs, "o_orderkey", "l_orderkey", {"actual_cost": F.col("amount")}))
    return out.select("o_orderkey", "entries", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in ("actual_cost", "margin")), "has_costs")


@query(f"SELECT count(*) AS jobs_total, count(n) AS jobs_costed, count(*) - count(n) AS jobs_without_costs, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE n > 0) AS DOUBLE) AS quoted, CAST(sum(c) AS DOUBLE) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum({_PRICE}) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def margin_coverage(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("quoted_total"))
    costs = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"))
    out = ledgers.margin_coverage(ledgers.left_totals(jobs, costs, "o_orderkey", "l_orderkey", {"actual_cost": F.col("amount")}))
    return out.select("jobs_total", "jobs_costed", "jobs_without_costs", F.col("quoted").cast("double").alias("quoted"), F.col("actual").cast("double").alias("actual"))


@query(f"SELECT l_orderkey, l_returnflag, count(*) AS entries, round(CAST(sum({_PRICE}) AS DOUBLE), 2) AS total FROM lineitem GROUP BY 1, 2")
def category_costs(spark: SparkSession, d: str) -> DataFrame:
    costs = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    return ledgers.breakdown(costs, ["l_orderkey"], "l_returnflag", F.col("l_extendedprice").cast("decimal(18,4)")).withColumn("total", F.round(F.col("total").cast("double"), 2))


@query("SELECT s.id, s.name, count(c.id) AS entries, CAST(coalesce(sum(c.cost_price), 0) AS DOUBLE) AS spend, row_number() OVER (ORDER BY coalesce(sum(c.cost_price), 0) DESC, lower(s.name) NULLS FIRST, s.name NULLS FIRST, s.id) AS place FROM suppliers s LEFT JOIN catalog_items c ON c.supplier_id = s.id GROUP BY s.id, s.name ORDER BY place LIMIT 500")
def supplier_spend(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by what was bought from them, those without purchases too: the first 500."""
    s = table(spark, d, "suppliers").select("id", "name")
    c = table(spark, d, "catalog_items").select("supplier_id", "cost_price")
    spent = ledgers.left_totals(s, c, "id", "supplier_id", {"spend": F.col("cost_price")})
    return ledgers.view(spent, [F.desc("spend"), *ledgers.nocase(F.col("name")), F.col("id")], 500).withColumn("spend", F.col("spend").cast("double"))


_OWED = f"""i AS ({_LAST("invoices", ["quotation_id", "client_name", "grand_total", "due_date", "status"])}), q AS (SELECT id, max(amount_paid) AS paid FROM quotations WHERE id IS NOT NULL GROUP BY id),
    p AS (SELECT i.id, i.client_name, i.due_date, i.status, coalesce(i.grand_total, 0) AS total, coalesce(q.paid, 0) AS paid FROM i LEFT JOIN q ON i.quotation_id = q.id),
    b AS (SELECT *, total - paid AS balance FROM p), s AS (SELECT *, coalesce(due_date < DATE '{AS_OF}' AND balance > 0.01 AND coalesce(status, '') <> 'Cancelled', false) AS is_overdue FROM b)"""


def _owed(spark: SparkSession, d: str) -> DataFrame:
    """Invoices as last delivered, with what was paid on the quotation they bill."""
    i = _latest(spark, d, "invoices", ["quotation_id", "client_name", "grand_total", "due_date", "status"])
    paid = table(spark, d, "quotations").filter("id is not null").groupBy(F.col("id").alias("q")).agg(F.max("amount_paid").alias("amount"))
    docs = ledgers.left_totals(i, paid, "quotation_id", "q", {"paid": F.col("amount")}).withColumn("total", F.coalesce("grand_total", F.lit(0)))
    return ledgers.owed(docs, _day())


@query(f"WITH {_OWED} SELECT id, CAST(paid AS DOUBLE) AS paid, CAST(balance AS DOUBLE) AS balance, CASE WHEN paid <= 0 THEN 'Unpaid' WHEN balance > 0.01 THEN 'Partial' ELSE 'Paid' END AS payment_state, is_overdue, CASE WHEN is_overdue THEN date_diff('day', due_date, DATE '{AS_OF}') ELSE 0 END AS days_overdue FROM s")
def invoice_states(spark: SparkSession, d: str) -> DataFrame:
    return _owed(spark, d).select("id", *_money("paid", "balance"), "payment_state", "is_overdue", "days_overdue")


_OPEN = "SELECT *, CASE WHEN days <= 0 THEN 'current' WHEN days <= 30 THEN '1_30' WHEN days <= 60 THEN '31_60' WHEN days <= 90 THEN '61_90' ELSE 'over_90' END AS bucket FROM (SELECT *, CASE WHEN is_overdue THEN date_diff('day', due_date, DATE '" + AS_OF + "') ELSE 0 END AS days FROM s WHERE balance > 0.01 AND coalesce(status, '') <> 'Cancelled')"


@query(f"WITH {_OWED}, o AS ({_OPEN}) SELECT bucket, count(*) AS documents, CAST(sum(balance) AS DOUBLE) AS balance, CAST((SELECT sum(balance) FROM o) AS DOUBLE) AS outstanding FROM o GROUP BY 1")
def aging_totals(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.aging(_owed(spark, d)).select("bucket", "documents", *_money("balance", "outstanding"))


@query(f"WITH {_OWED}, o AS ({_OPEN}) SELECT id, bucket, CAST(balance AS DOUBLE) AS balance, days AS days_overdue, row_number() OVER (ORDER BY days DESC, id) AS place FROM o ORDER BY place LIMIT 500")
def aging_worklist(spark: SparkSession, d: str) -> DataFrame:
    """The 500 documents to chase first."""
    open_ = ledgers.open_documents(_owed(spark, d)).select("id", "bucket", "balance", "days_overdue")
    return ledgers.view(open_, [F.desc("days_overdue"), F.col("id")], 500).withColumn("balance", F.col("balance").cast("double"))


@query(f"WITH {_OWED} SELECT lower(trim(client_name)) AS client, count(*) AS documents, CAST(sum(total) AS DOUBLE) AS billed, CAST(sum(paid) AS DOUBLE) AS paid, CAST(sum(total) - sum(paid) AS DOUBLE) AS outstanding, count(*) FILTER (WHERE is_overdue) AS overdue FROM s WHERE coalesce(status, '') <> 'Cancelled' GROUP BY 1")
def client_statements(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.statements(_owed(spark, d), F.lower(F.trim("client_name"))).select("client", "documents", *_money("billed", "paid", "outstanding"), "overdue")


@query(f"WITH q AS ({_LAST("quotations", ["client_id", "grand_total", "amount_paid", "status"])}) SELECT client_id, count(*) AS quotes, CAST(coalesce(sum(grand_total) FILTER (WHERE status = 'Won'), 0) AS DOUBLE) AS billed, CAST(coalesce(sum(amount_paid) FILTER (WHERE status = 'Won'), 0) AS DOUBLE) AS paid, CAST(greatest(coalesce(sum(grand_total) FILTER (WHERE status = 'Won'), 0) - coalesce(sum(amount_paid) FILTER (WHERE status = 'Won'), 0), 0) AS DOUBLE) AS outstanding FROM q WHERE client_id IS NOT NULL GROUP BY 1")
def client_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """The totals of the last delivery of every quotation; amounts are the greatest delivered."""
    q = table(spark, d, "quotations").filter("id is not null").groupBy("id").agg(F.max("client_id").alias("client_id"), F.max("grand_total").alias("grand_total"), F.max("amount_paid").alias("amount_paid"), F.max_by("status", F.struct("loaded_at", "created_at", "status")).alias("status"))
    return ledgers.client_ledger(q).select("client_id", "quotes", *_money("billed", "paid", "outstanding"))


@query(
    """
    WITH q AS (SELECT id, max(items_json) AS j FROM quotations WHERE status = 'Won' AND quote_date >= DATE '2026-01-01' GROUP BY id),
    a AS (SELECT unnest(CAST(j AS JSON[])) AS e FROM q WHERE json_valid(j) AND json_type(j) = 'ARRAY'),
    n AS (SELECT TRY_CAST(replace(e->>'$.qty', ',', '') AS DECIMAL(18,4)) AS qty, TRY_CAST(replace(e->>'$.rate', ',', '') AS DECIMAL(18,4)) AS rate, TRY_CAST(replace(e->>'$.cost_price', ',', '') AS DECIMAL(18,4)) AS cost FROM a WHERE json_type(e) = 'OBJECT')
    SELECT round(CAST(coalesce(sum(CAST((coalesce(rate, 0) - cost) * coalesce(qty, 0) AS DECIMAL(38,8))) FILTER (WHERE cost IS NOT NULL), 0) AS DOUBLE), 2) AS margin, count(cost) AS lines_with_cost, count(*) - count(cost) AS lines_without_cost FROM n"""
)
def quote_margins(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").filter("status = 'Won'").groupBy("id").agg(F.max("items_json").alias("items_json"), F.max("quote_date").alias("quote_date")).withColumn("status", F.lit("Won"))
    return ledgers.line_margins(q, F.lit("2026-01-01").cast("date")).select(F.round(F.col("margin").cast("double"), 2).alias("margin"), "lines_with_cost", "lines_without_cost")


# ---- windows of dates and ordered views ----------------------------------------------------------------------------------
_TYPED = lambda c: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(trim({c}), '{p}') THEN CAST(try_strptime(trim({c}), '{f}') AS DATE) END" for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "%d %B %Y"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "%d-%b-%Y"))) + ")"
_JOBS = f"j AS (SELECT id, arg_max(status, (loaded_at, created_at, status)) AS status, {_TYPED('max(start_date)')} AS s, {_TYPED('max(end_date)')} AS e FROM jobs WHERE id IS NOT NULL GROUP BY id)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").filter("id is not null").groupBy("id").agg(F.max_by("status", F.struct("loaded_at", "created_at", "status")).alias("status"), F.max("start_date").alias("s"), F.max("end_date").alias("e"))
    return j.withColumns({"s": dates.typed_date(F.col("s")), "e": dates.typed_date(F.col("e"))})


@query(f"WITH {_JOBS} SELECT id, status, s AS starts, e AS ends FROM j WHERE status IN ('Planned', 'In Progress') AND (s BETWEEN DATE '2026-06-01' AND DATE '2026-07-01' OR e BETWEEN DATE '2026-06-01' AND DATE '2026-07-01')")
def upcoming_jobs(spark: SparkSession, d: str) -> DataFrame:
    due = ledgers.coming(F.col("s"), F.col("e"), F.lit("2026-06-01").cast("date"), 30)
    return _jobs(spark, d).filter(F.col("status").isin("Planned", "In Progress") & due).select("id", "status", F.col("s").alias("starts"), F.col("e").alias("ends"))


@query(f"WITH {_JOBS} SELECT id, status, row_number() OVER (ORDER BY CASE status WHEN 'In Progress' THEN 0 WHEN 'Planned' THEN 1 ELSE 2 END, s NULLS FIRST, id) AS place FROM j ORDER BY place LIMIT 300")
def jobs_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 jobs: those in progress, then planned ones, by start."""
    j = _jobs(spark, d).select("id", "status", "s")
    return ledgers.view(j, [ledgers.by_priority(F.col("status"), ["In Progress", "Planned"]), F.col("s").asc_nulls_first(), F.col("id")], 300).select("id", "status", "place")


@query("SELECT id, description, row_number() OVER (ORDER BY lower(description) NULLS FIRST, description NULLS FIRST, id) AS place FROM catalog_items ORDER BY place LIMIT 400")
def catalog_nocase(spark: SparkSession, d: str) -> DataFrame:
    """The first 400 catalogue rows by description, whatever the case."""
    return ledgers.view(table(spark, d, "catalog_items").select("id", "description"), [*ledgers.nocase(F.col("description")), F.col("id")], 400)


@query(f"SELECT year(t) AS y, month(t) AS m, count(*) AS n FROM (SELECT {_TYPED('start_date')} AS t FROM jobs) GROUP BY 1, 2")
def typed_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts of jobs by month, read in every form people type."""
    t = table(spark, d, "jobs").select(dates.typed_date(F.col("start_date")).alias("t"))
    return t.groupBy(F.year("t").alias("y"), F.month("t").alias("m")).agg(F.count("*").alias("n"))


# ---- lookups and identities ------------------------------------------------------------------------------------------------
@query("SELECT c.id, c.supplier_id, s.name AS supplier_name FROM catalog_items c LEFT JOIN (SELECT id, min(name) AS name FROM suppliers GROUP BY id) s ON c.supplier_id = s.id")
def items_with_supplier(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "suppliers").groupBy(F.col("id").alias("supplier_id")).agg(F.min("name").alias("supplier_name"))
    return table(spark, d, "catalog_items").select("id", "supplier_id").join(names, "supplier_id", "left").select("id", "supplier_id", "supplier_name")


_CODES = "r AS (SELECT id, max(client_name) AS client, max(job_id) AS code FROM invoices WHERE job_id IS NOT NULL AND job_id <> 0 GROUP BY id), k AS (SELECT DISTINCT id FROM jobs)"


@query(f"WITH {_CODES} SELECT client, count(*) AS n_rows, count(*) FILTER (WHERE code NOT IN (SELECT id FROM k)) AS misses, count(*) FILTER (WHERE code NOT IN (SELECT id FROM k)) = 0 AS ok FROM r GROUP BY 1")
def blocked_clients(spark: SparkSession, d: str) -> DataFrame:
    """Invoices look up their jobs; a client with a job that isn't there is held back, the others are not."""
    r = table(spark, d, "invoices").filter("job_id is not null and job_id <> 0").groupBy("id").agg(F.coalesce(F.max("client_name"), F.lit(None)).alias("client"), F.max("job_id").cast("string").alias("code"))
    card = table(spark, d, "jobs").select(F.col("id").cast("string").alias("code"), F.col("id").alias("job"))
    _, missed = ledgers.looked_up(r, card, "code", ["job"])
    return ledgers.blocked_groups(r, missed, "client")


_NAME_SQL = rf"lower(trim(regexp_replace(coalesce(client_name, ''), '\s+', ' ', 'g')))"
_PHONE_SQL = r"CASE WHEN length(regexp_replace(coalesce(client_phone, ''), '\D', '', 'g')) >= 9 THEN right(regexp_replace(coalesce(client_phone, ''), '\D', '', 'g'), 9) ELSE regexp_replace(coalesce(client_phone, ''), '\D', '', 'g') END"


@query(
    f"""
    WITH r AS (SELECT id, {_NAME_SQL} AS n, {_PHONE_SQL} AS p FROM quotations),
    a AS (SELECT n, p, min(id) AS first FROM r WHERE n <> '' GROUP BY 1, 2),
    k AS (SELECT n, count(*) AS k, min('new-' || first) AS only FROM a WHERE p <> '' GROUP BY 1),
    x AS (SELECT a.n, a.p, CASE WHEN a.p = '' AND k.k = 1 THEN k.only ELSE 'new-' || a.first END AS identity FROM a LEFT JOIN k ON a.n = k.n)
    SELECT r.id, x.identity FROM r LEFT JOIN x ON r.n = x.n AND r.p = x.p"""
)
def resolved_clients(spark: SparkSession, d: str) -> DataFrame:
    """Every row's account by name and phone, starting from no accounts at all."""
    q = table(spark, d, "quotations").select("id", "client_name", "client_phone")
    known = spark.createDataFrame([], "identity string, name_key string, phone_key string")
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("client_name", F.lit("")), r"\s+", " ")))
    return ledgers.resolve_identities(q, known, name, text.phone_key(F.col("client_phone")), "id").select("id", "identity")


@query("WITH RECURSIVE m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 END AS t FROM customer), w AS (SELECT id, id AS root FROM m UNION ALL SELECT w.id, m.t FROM w JOIN m ON w.root = m.id JOIN m n ON m.t = n.id WHERE m.t <> w.root), r AS (SELECT id, min(root) AS root FROM w GROUP BY 1) SELECT o_orderkey, root AS o_custkey FROM orders JOIN r ON o_custkey = id")
def repointed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders after every third customer was merged into another, in chains."""
    merges = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.floor(F.col("c_custkey") / 3).cast("bigint")).alias("merged_into"))
    return ledgers.repoint(table(spark, d, "orders").select("o_orderkey", "o_custkey"), records.resolve_chain(merges), "o_custkey")


@query("SELECT CASE WHEN coalesce(trim(file_name), '') = '' THEN 'Unknown file' ELSE file_name END AS file, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1")
def files_stored(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.grouped_files(table(spark, d, "documents").select("file_name", "n_chars"), "file_name", chars=F.col("n_chars"))


# ---- prices carried forward, formats, curves, vectors -----------------------------------------------------------------------
@query(f"SELECT id, round(CAST(grand_total AS DOUBLE) * pow(1.04, greatest(0, date_diff('day', quote_date, DATE '{AS_OF}') / 365.25)), 2) AS adjusted FROM quotations WHERE quote_date IS NOT NULL AND grand_total IS NOT NULL")
def uplifted_totals(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").filter("quote_date is not null and grand_total is not null")
    return q.select("id", F.round(ledgers.uplifted(F.col("grand_total"), dates.elapsed_years(F.col("quote_date"), _day()), 0.04), 2).alias("adjusted"))


@query("SELECT id, format('{:,.2f}', CAST(grand_total AS DOUBLE)) AS shown, printf('INV-%04d', id) AS number, CAST(issue_date + INTERVAL 30 DAY AS DATE) AS due FROM (SELECT id, max(grand_total) AS grand_total, max(issue_date) AS issue_date FROM invoices WHERE id IS NOT NULL GROUP BY id)")
def shown_invoices(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "invoices").filter("id is not null").groupBy("id").agg(F.max("grand_total").alias("t"), F.max("issue_date").alias("d"))
    return i.select("id", text.money(F.col("t")).alias("shown"), text.document_number("INV", F.col("id")).alias("number"), dates.due_date(F.col("d"), 30).alias("due"))


@query(
    """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS c, l_discount * 50 AS h FROM lineitem),
    r AS (SELECT *, CASE WHEN c > 0 AND h > 0 THEN c * c / (8 * h) + h / 2 ELSE 0 END AS r FROM x),
    a AS (SELECT *, CASE WHEN r > 0 THEN degrees(2 * atan2(c / 2, r - h)) ELSE 0 END AS angle FROM r)
    SELECT l_orderkey, l_linenumber, round(r, 6) AS radius_m, round(CASE WHEN r <= 0 OR angle < 5 THEN c ELSE r * radians(least(angle, 360)) END, 6) AS run_m FROM a"""
)
def curve_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as chords, discounts as rises: radius and developed length of every line."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("c"), (F.col("l_discount") * 50).alias("h"))
    run = shapes.developed_run(F.lit("curved"), F.col("c"), F.lit(0.0), F.col("h"), F.lit(0.0))
    return x.select("l_orderkey", "l_linenumber", F.round(shapes.radius(F.col("c"), F.col("h")), 6).alias("radius_m"), F.round(run, 6).alias("run_m"))


@query("SELECT t AS item_type, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(coalesce(description, '')), '{w}')" for w in words)} THEN '{name}'" for name, words in shapes.ITEM_TYPES) + " ELSE 'wall' END AS t FROM catalog_items) GROUP BY 1")
def item_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_items").groupBy(shapes.item_type(F.col("description")).alias("item_type")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1) SELECT m.label, CAST(m.i - 1 AS INT) AS at, round(m.v / n.norm, 6) AS v FROM m JOIN n ON m.label IS NOT DISTINCT FROM n.label")
def pooled_labels(spark: SparkSession, d: str) -> DataFrame:
    """The normalised mean vector of every label, one row per dimension."""
    e = table(spark, d, "embeddings").select("label", "embedding")
    pooled = similarity.mean_pool(e, ["label"], "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("at", "v")).select("label", "at", F.round("v", 6).alias("v"))


@query("SELECT id, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN len(list_filter(CAST(j AS JSON[]), lambda e: json_type(e) = 'OBJECT')) ELSE 0 END AS item_count FROM (SELECT id, max(items_json) AS j FROM quotations WHERE id IS NOT NULL GROUP BY id)")
def quotation_headers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotations").filter("id is not null").groupBy("id").agg(F.max("items_json").alias("items_json"))
    return ledgers.headers(q)


@query("SELECT id, arg_max(status, (loaded_at, created_at, status)) AS status FROM quotations WHERE id IS NOT NULL GROUP BY id HAVING contains(lower(concat_ws(chr(10), max(client_name), max(venue))), 'mall') AND arg_max(status, (loaded_at, created_at, status)) = 'Won'")
def history_search(spark: SparkSession, d: str) -> DataFrame:
    """Won quotations whose client or venue mentions a mall."""
    q = table(spark, d, "quotations").filter("id is not null").groupBy("id").agg(F.max("client_name").alias("client_name"), F.max("venue").alias("venue"), F.max_by("status", F.struct("loaded_at", "created_at", "status")).alias("status"))
    return q.filter((F.col("status") == "Won") & ledgers.mentions("Mall", "client_name", "venue")).select("id", "status")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'override' ELSE title END AS title FROM (SELECT id, max(title) AS title FROM jobs WHERE id IS NOT NULL GROUP BY id) WHERE id NOT IN (SELECT record_id FROM removed_records WHERE table_name = 'jobs' AND record_id IS NOT NULL)")
def edited_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with every seventh title overridden and the removed ones left out."""
    j = table(spark, d, "jobs").filter("id is not null").groupBy("id").agg(F.max("title").alias("title"))
    over = j.filter("id % 7 = 0").select("id", F.lit("title").alias("field"), F.lit("override").alias("value"))
    gone = table(spark, d, "removed_records").filter("table_name = 'jobs' and record_id is not null").select(F.col("record_id").alias("id"))
    return ledgers.overridden(j, "id", over, gone)
