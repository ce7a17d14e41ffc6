"""Records with what their child records add up to: paid and owed, spent and earned, by client, category and period.

Children are summed per parent before they meet the parents, so a join moves one row per parent and a parent with a third
of all children is no hot task. Derived facts are never stored. Dates are explicit: nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.items import items

CENT = 0.01  # a balance up to a cent is settled


def left_totals(parents: DataFrame, children: DataFrame, key: str, foreign: str, sums: dict[str, Column], count: str = "entries") -> DataFrame:
    """parents with a count of their children and sums over them, 0 where there are none."""
    per = children.filter(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("_key")).agg(F.count("*").alias(count), *(F.sum(c).alias(n) for n, c in sums.items()))
    joined = parents.join(per, parents[key] == per["_key"], "left").drop("_key")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in (count, *sums)})


def owed(documents: DataFrame, as_of: Column, cancelled: str = "Cancelled") -> DataFrame:
    """documents(total, paid, due_date, status) with balance, payment_state, is_overdue and days_overdue.

    Overdue is what is owed after its due date and wasn't cancelled; a null status is not cancelled."""
    balance = F.round(F.coalesce("total", F.lit(0)) - F.coalesce("paid", F.lit(0)), 2)
    late = (F.col("due_date") < as_of) & (F.col("balance") > CENT) & ~F.coalesce(F.col("status") == cancelled, F.lit(False))
    state = F.when(F.coalesce("paid", F.lit(0)) <= 0, "Unpaid").when(F.col("balance") > CENT, "Partial").otherwise("Paid")
    out = documents.withColumn("balance", balance).withColumn("payment_state", state).withColumn("is_overdue", F.coalesce(late, F.lit(False)))
    return out.withColumn("days_overdue", F.when(F.col("is_overdue"), F.datediff(as_of, "due_date")).otherwise(0))


def open_documents(states: DataFrame, cancelled: str = "Cancelled") -> DataFrame:
    """What is still to be collected, each with the bucket of its lateness."""
    d = F.col("days_overdue")
    bucket = F.when(d <= 0, "current").when(d <= 30, "1_30").when(d <= 60, "31_60").when(d <= 90, "61_90").otherwise("over_90")
    return states.filter((F.col("balance") > CENT) & ~F.coalesce(F.col("status") == cancelled, F.lit(False))).withColumn("bucket", bucket)


def aging(states: DataFrame, cancelled: str = "Cancelled") -> DataFrame:
    """bucket, documents, balance, and outstanding: the whole over all buckets."""
    per = open_documents(states, cancelled).groupBy("bucket").agg(F.count("*").alias("documents"), F.sum("balance").alias("balance"))
    return per.withColumn("outstanding", per.agg(F.sum("balance")).scalar())


def statements(states: DataFrame, client: Column, cancelled: str = "Cancelled") -> DataFrame:
    """client, documents, billed, paid, outstanding, overdue per client: what is sent when chasing."""
    live = states.filter(~F.coalesce(F.col("status") == cancelled, F.lit(False)))
    one = live.groupBy(client.alias("client")).agg(F.count("*").alias("documents"), F.sum(F.coalesce("total", F.lit(0))).alias("billed"), F.sum(F.coalesce("paid", F.lit(0))).alias("paid"), F.count_if("is_overdue").alias("overdue"))
    return one.withColumn("outstanding", F.col("billed") - F.col("paid"))


def client_ledger(quotations: DataFrame, won: str = "Won") -> DataFrame:
    """client_id, quotes, billed, paid, outstanding (never below 0) per client; only won quotations bill."""
    is_won = F.col("status") == won
    zero = lambda c: F.coalesce(F.sum(F.when(is_won, F.col(c))), F.lit(0))
    one = quotations.filter("client_id is not null").groupBy("client_id").agg(F.count("*").alias("quotes"), zero("grand_total").alias("billed"), zero("amount_paid").alias("paid"))
    return one.withColumn("outstanding", F.greatest(F.col("billed") - F.col("paid"), F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(100 * part.cast("double") / whole.cast("double"), 1)).otherwise(0.0)


def line_margins(quotations: DataFrame, since: Column, won: str = "Won") -> DataFrame:
    """One row: margin over the lines of won quotations since a date whose cost is known, and how many lines that covers."""
    lines = quotations.filter((F.col("status") == won) & (F.col("quote_date") >= since)).select(F.explode(items(F.col("items_json"))).alias("i"))
    known = F.col("i.cost_price").isNotNull()
    qty, rate = F.coalesce("i.qty", F.lit(0)), F.coalesce("i.rate", F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(known, (c * qty).cast("decimal(38,8)"))), F.lit(0))
    one = lines.agg(total(rate - F.col("i.cost_price")).alias("margin"), total(rate).alias("revenue"), F.count_if(known).alias("lines_with_cost"), F.count_if(~known).alias("lines_without_cost"))
    return one.withColumn("margin_pct", percent(F.col("margin"), F.col("revenue")))


def with_margin(jobs: DataFrame, quoted: str = "quoted_total", actual: str = "actual_cost", entries: str = "entries") -> DataFrame:
    """jobs with margin, margin_pct and has_costs: whether the margin is measured or only quoted."""
    q = F.coalesce(F.col(quoted), F.lit(0))
    return jobs.withColumns({"margin": q - F.col(actual), "margin_pct": percent(q - F.col(actual), q), "has_costs": F.col(entries) > 0})


def margin_coverage(jobs: DataFrame, quoted: str = "quoted_total", actual: str = "actual_cost", entries: str = "entries") -> DataFrame:
    """One row: quoted against actual over the jobs that have costs, and how many have none."""
    costed = F.col(entries) > 0
    total = lambda c: F.coalesce(F.sum(F.when(costed, F.col(c))), F.lit(0))
    one = jobs.agg(F.count("*").alias("jobs_total"), F.count_if(costed).alias("jobs_costed"), F.count_if(~costed).alias("jobs_without_costs"), total(quoted).alias("quoted"), total(actual).alias("actual"))
    return one.withColumns({"margin": F.col("quoted") - F.col("actual"), "margin_pct": percent(F.col("quoted") - F.col("actual"), F.col("quoted"))})


def breakdown(costs: DataFrame, keys: list[str], category: str, amount: Column) -> DataFrame:
    """keys, category, entries, total."""
    return costs.groupBy(*keys, category).agg(F.count("*").alias("entries"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))


# ---- windows of dates and views in a fixed order -----------------------------------------------------------------------


def trailing(day: Column, as_of: Column, days: int) -> Column:
    """Whether a day is no more than so many days before as_of; null days are not."""
    return F.coalesce(day >= F.date_sub(as_of, days), F.lit(False))


def coming(start: Column, end: Column, as_of: Column, days: int) -> Column:
    """Whether a start or an end lies between as_of and so many days later."""
    inside = lambda c: F.coalesce(c.between(as_of, F.date_add(as_of, days)), F.lit(False))
    return inside(start) | inside(end)


def by_priority(value: Column, first: list[str]) -> Column:
    """Place of a value in a list of those that come first; the others share the last place."""
    rank = F.when(F.lit(False), 0)
    for i, v in enumerate(first):
        rank = rank.when(value == v, i)
    return rank.otherwise(len(first))


def nocase(value: Column) -> list[Column]:
    """Order by a text whatever its case, nulls first; equal ones by the text itself."""
    return [F.lower(value).asc_nulls_first(), value.asc_nulls_first()]


def view(df: DataFrame, order: list[Column], limit: int, status: str | None = None) -> DataFrame:
    """The first `limit` rows of a status, or of all, in a total order, with their place from 1.

    The limit is taken first, as a top-k of every partition; only the view's own rows are then numbered together."""
    rows = df if status is None else df.filter(F.col("status") == status)
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def mentions(needle: str, *columns: str) -> Column:
    """Whether any of the columns holds the needle, whatever the case; a blank needle is held by every row."""
    return F.lower(F.concat_ws("\n", *columns)).contains(needle.strip().lower())


def headers(df: DataFrame, items_column: str = "items_json") -> DataFrame:
    """df without its line items but with their number, 0 where they can't be read."""
    return df.withColumn("item_count", F.size(items(F.col(items_column)))).drop(items_column)


def overridden(df: DataFrame, key: str, overrides: DataFrame, removed: DataFrame) -> DataFrame:
    """df with values replaced by overrides(key, field, value) of its own columns, and without the keys in removed.

    The last override of a field in the order of its value's text counts; fields df hasn't are left alone."""
    fields = [c for c in df.columns if c != key]
    wide = overrides.filter(F.col("field").isin(*fields)).groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields))
    types = dict(df.dtypes)
    told = df.join(removed.select(key).distinct(), key, "left_anti").join(wide, key, "left")
    return told.select(*(F.col(c) if c == key else F.coalesce(F.col(f"_{c}").try_cast(types[c]), c).alias(c) for c in df.columns))


def review_severity(reasons: Column) -> Column:
    """0 where a rate is missing, 1 a description, 2 where figures don't reconcile, 3 otherwise, from an array of reasons."""
    has = lambda words: F.exists(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: F.contains(F.lower(r), F.lit(words)))
    return F.when(has("missing unit rate"), 0).when(has("missing description"), 1).when(has("reconcile"), 2).otherwise(3)


# ---- lookups and identities --------------------------------------------------------------------------------------------


def looked_up(rows: DataFrame, card: DataFrame, code: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(found, missed): rows with columns of the card's entry of their code; and the rows whose code it doesn't know.

    A code on several entries takes the least of each column by the entry's order of columns. One pass over the rows."""
    one = card.filter(F.col(code).isNotNull()).groupBy(F.upper(F.trim(code)).alias("_code")).agg(F.min(F.struct(*columns)).alias("_e"))
    told = rows.join(one, F.upper(F.trim(rows[code].cast("string"))) == one["_code"], "left")
    found = told.filter("_e is not null").select(*rows.columns, *(F.col(f"_e.{c}").alias(c) for c in columns))
    return found, told.filter("_e is null").select(*rows.columns)


def blocked_groups(rows: DataFrame, missed: DataFrame, group: str) -> DataFrame:
    """group, rows, misses, ok: a group with any row that couldn't be looked up is not fit for use; the others are."""
    n = rows.groupBy(group).agg(F.count("*").alias("n_rows"))
    m = missed.groupBy(group).agg(F.count("*").alias("misses"))
    return n.join(m, group, "left").withColumn("misses", F.coalesce("misses", F.lit(0))).withColumn("ok", F.col("misses") == 0)


def resolve_identities(records: DataFrame, known: DataFrame, name_key: Column, phone_key: Column, order: str) -> DataFrame:
    """records with identity and is_new: an account of known(identity, name_key, phone_key), or a new one.

    A record belongs to the account of its name and phone; one without phone to the account of its name, if there is one
    only, and otherwise to the account of that name without phone. A new account is called by the least `order` of its
    records. Blank names have no identity."""
    r = records.withColumns({"_n": name_key, "_p": F.coalesce(phone_key, F.lit(""))})
    own = known.select(F.col("name_key").alias("_n"), F.coalesce("phone_key", F.lit("")).alias("_p"), F.col("identity").cast("string").alias("_id")).groupBy("_n", "_p").agg(F.min("_id").alias("_id"))
    asked = r.filter("_n <> ''").groupBy("_n", "_p").agg(F.min(order).alias("_first"))
    every = asked.join(own, ["_n", "_p"], "full").withColumn("_new", F.col("_id").isNull()).withColumn("_id", F.coalesce("_id", F.concat(F.lit("new-"), F.col("_first").cast("string"))))
    phoned = every.filter("_p <> ''").groupBy("_n").agg(F.count("*").alias("_k"), F.min("_id").alias("_only"), F.max("_new").alias("_only_new"))
    told = every.join(phoned, "_n", "left")
    lone = (F.col("_p") == "") & F.col("_new") & (F.col("_k") == 1)
    named = told.select("_n", "_p", F.when(lone, F.col("_only")).otherwise(F.col("_id")).alias("identity"), F.when(lone, F.col("_only_new")).otherwise(F.col("_new")).alias("is_new"))
    return r.join(named, ["_n", "_p"], "left").drop("_n", "_p")


def repoint(children: DataFrame, roots: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """children whose reference follows merges: roots(key, root) as resolve_chain gives them; unknown references stay."""
    to = roots.select(F.col(key).alias("_from"), F.col("root").alias("_root"))
    joined = children.join(to, children[foreign] == to["_from"], "left")
    return joined.select(*(F.coalesce("_root", foreign).alias(c) if c == foreign else children[c] for c in children.columns))


def grouped_files(rows: DataFrame, file: str, unknown: str = "Unknown file", **sums: Column) -> DataFrame:
    """file, n and sums per file; rows without one go together."""
    name = F.when(F.coalesce(F.trim(file), F.lit("")) == "", unknown).otherwise(F.col(file))
    return rows.groupBy(name.alias("file")).agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in sums.items()))


def uplifted(rate: Column, years: Column, markup: float) -> Column:
    """A rate carried forward over years at a yearly markup."""
    return rate.cast("double") * F.pow(F.lit(1.0 + markup), years)


def accrued_percent(rate: Column, adjusted: Column) -> Column:
    """How much a rate has risen, in percent; null where that is none to speak of (under 0.05) or there is no rate."""
    pct = (adjusted / rate - 1) * 100
    return F.when((rate > 0) & (F.abs(pct) >= 0.05), pct)
