"""Sources: files in folders, spreadsheet cells, text lines, rate cards, configurations."""

from __future__ import annotations

import json
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_rate, first_number, looks_like_description, looks_like_spec_line, normalize_unit, number_range, strip, trailing_numbers

# --- fixed values: header words and file names of the quotation folders ----------------------------------------------
OWN_OUTPUT = r"_Quotation_\d{8}_\d{4}\.(xlsx|docx|pdf)$"
SHEETS = "option|opt|sheet|quotation|production"
TOTAL_WORDS = "total|vat|amount|grand|sub total|subtotal|tax"
ROLE_WORDS = (("description", "description|particulars|scope of work"), ("images", "image|photo|picture"), ("item_num", r"item #|item no|s\.no|sr no|sl no"), ("qty", "qty|quantity"))
RATE_FIRM, RATE_LOOSE = "unit price|unit cost|unit rate|rate", "price|cost"
CARD_ALIASES = {"category": "category", "itemcode": "code", "code": "code", "descriptionspecification": "description", "description": "description", "unit": "unit", "pricerangeaed": "price_range", "pricerange": "price_range", "avgcostaed": "avg_cost", "avgcost": "avg_cost", "typicalusage": "usage", "usage": "usage"}
#: Text lines that name no item: fields of a document's head, and column headers standing alone.
HEAD_WORDS = r"page |quotation #|date:|client:|venue:|location:|site:|attn|attention"
COLUMN_WORDS = ("description", "item", "item description", "qty", "quantity", "rate", "unit price", "unit cost", "unit rate", "price", "cost", "amount", "total", "unit", "sr.no", "sr. no", "s.no", "s. no", "no.")
TABLE_HEAD, TABLE_PRICE, GENERIC_ITEM = "description|item|particulars", "cost|rate|price|amount", ("item", "items", "item name", "element")
# ---------------------------------------------------------------------------------------------------------------------


def scan_folder(spark: SparkSession, root: str, excluded: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): the office files under root with path, name, kind and mtime; and how many were left out, by reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    folders = F.transform(F.split(F.lower("path"), "/"), lambda x: F.url_decode(x))
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    reason = (
        F.when(~kind.isin("xlsx", "pdf", "docx"), "other type").when(name.startswith("~$"), "temporary").when(F.arrays_overlap(folders, F.array(*(F.lit(x.lower()) for x in excluded)) if excluded else F.array().cast("array<string>")), "excluded folder")
        .when(name.rlike(OWN_OUTPUT), "own output")
    )
    judged = files.select("path", name.alias("name"), kind.alias("kind"), "mtime", "bytes", reason.alias("reason"))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def chosen_cells(cells: DataFrame) -> DataFrame:
    """Cells of the sheets worth reading: the active one, and those whose title has one of the telling words."""
    return cells.filter(F.col("is_active") | F.lower("sheet").rlike(SHEETS))


def column_roles(cells: DataFrame) -> DataFrame:
    """file, sheet, header_row, role, col: from the first row, of the first 15, with a description header.

    Totals and taxes never become the rate; an exact rate header beats a general price header; the first column of a role wins."""
    keys = ["file", "sheet"]
    top = cells.filter("row <= 15 and col <= 15").withColumn("v", F.lower(strip(F.col("value"))))
    header = top.filter(F.col("v").rlike("description|particulars")).groupBy(*keys).agg(F.min("row").alias("header_row"))
    return roles_of(top.join(header, keys).filter("row = header_row and v <> ''"))


def roles_of(row: DataFrame) -> DataFrame:
    """file, sheet, header_row, role, col of the cells (v) of header rows."""
    keys = ["file", "sheet"]
    role = F.when(F.col("v").rlike(TOTAL_WORDS), "total")
    for r, words in ROLE_WORDS:
        role = role.when(F.col("v").rlike(words), r)
    role = role.when(F.col("v").rlike(RATE_FIRM), "rate").when(F.col("v").rlike(RATE_LOOSE), "rate").when(F.col("v").startswith("unit"), "unit")
    rank = F.when(F.col("v").rlike(RATE_FIRM), 0).otherwise(1)
    return row.select(*keys, "header_row", role.alias("role"), F.struct(F.when(role == "rate", rank).otherwise(0).alias("r"), "col").alias("o")).filter("role is not null").groupBy(*keys, "header_row", "role").agg(F.min("o").alias("o")).select(*keys, "header_row", "role", "o.col")


def guessed_roles(cells: DataFrame) -> DataFrame:
    """file, sheet, role, col from what the columns of the first 15 rows hold, for sheets without a header.

    The description is the wordiest column (three texts at least), the quantity the numeric column with most small whole
    numbers, the rate the last but one of the others. Sheets without all three give nothing."""
    keys = ["file", "sheet"]
    top = cells.filter("row <= 15 and col <= 15 and value is not null").withColumn("n", F.col("value").try_cast("double"))
    texty = F.col("n").isNull() & (strip(F.col("value")) != "") & ~F.col("value").rlike(r"^[\d.,\s]+$")
    small = (F.col("n") > 0) & (F.col("n") <= 500) & (F.col("n") == F.floor("n"))
    stats = top.groupBy(*keys, "col").agg(F.sum(F.when(texty, F.length(strip(F.col("value")))).otherwise(0)).alias("letters"), F.count_if(texty).alias("texts"), F.count_if(F.col("n").isNotNull()).alias("numbers"), F.count_if(small).alias("small"))
    per = stats.groupBy(*keys).agg(F.max(F.struct("letters", -F.col("col"), "texts", "col")).alias("d"), F.array_sort(F.collect_list(F.when(F.col("numbers") >= 2, F.struct((-F.col("small")).alias("s"), "col")))).alias("num"))
    numeric = F.filter("num", lambda x: x["col"] != F.col("d.col"))
    per = per.filter("d.texts >= 3").withColumn("num", numeric).filter("size(num) >= 2").withColumn("rates", F.array_sort(F.transform(F.slice("num", F.lit(2), F.size("num")), lambda x: x["col"])))
    rate = F.when(F.size("rates") >= 2, F.element_at("rates", F.size("rates") - 1)).otherwise(F.get("rates", F.lit(0)))
    roles = F.array(F.struct(F.lit("description").alias("role"), F.col("d.col").alias("col")), F.struct(F.lit("qty").alias("role"), F.get("num", F.lit(0))["col"].alias("col")), F.struct(F.lit("rate").alias("role"), rate.alias("col")))
    return per.select(*keys, F.explode(roles).alias("r")).select(*keys, "r.role", "r.col")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """file, sheet, row, description, unit, qty, rate, total, confidence of the line items of all sheets.

    Rows without description and total rows are dropped; a row without rate stays only with a quantity, total or unit."""
    cells = chosen_cells(cells)
    keys = ["file", "sheet"]
    roles = column_roles(cells)
    guesses = guessed_roles(cells).join(roles.select(*keys).distinct(), keys, "left_anti").withColumn("header_row", F.lit(1))
    every = roles.unionByName(guesses)
    wide = cells.join(every, [*keys, "col"]).filter("row > header_row").groupBy(*keys, "row").agg(*(F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ("description", "unit", "qty", "rate", "total", "images")))
    rows = wide.select(*keys, "row", strip(F.col("description")).alias("description"), "unit", *(clean_rate(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("qty", "rate", "total")))
    rows = rows.filter((F.col("description") != "") & ~F.lower("description").contains("total")).filter("rate > 0 or qty > 0 or total > 0 or trim(coalesce(unit, '')) <> ''")
    expected = F.col("total") / F.col("qty")
    fits = (F.col("rate") >= 0.5 * expected) & (F.col("rate") <= 1.3 * expected)
    confidence = F.when(F.col("rate") <= 0, "none").when((F.col("qty") > 0) & (F.col("total") > 0), F.when(fits, "high").otherwise("low")).otherwise("high")
    return rows.withColumn("confidence", confidence).withColumn("unit", normalize_unit(F.col("unit"), F.col("description")))


def table_rows(cells: DataFrame) -> DataFrame:
    """Like sheet_rows, for tables of documents: merged cells repeat their text and count once, a blank rate is total / qty."""
    before = Window.partitionBy("file", "sheet", "row").orderBy("col")
    repeated = (F.col("_left") == F.col("value")) & F.col("value").rlike(r"\p{L}")
    once = cells.withColumn("_left", F.lag("value").over(before)).filter(~F.coalesce(repeated, F.lit(False))).drop("_left")
    rows = sheet_rows(once.withColumn("is_active", F.lit(True)))
    return rows.withColumn("rate", F.when((F.col("rate") <= 0) & (F.col("qty") > 0) & (F.col("total") > 0), F.col("total") / F.col("qty")).otherwise(F.col("rate")))


def line_items(lines: DataFrame) -> DataFrame:
    """file, page, line_no, description, qty, rate, total, confidence, specs of the priced lines of a text.

    A line ending in three numbers or more is quantity, rate and total, one ending in two has its rate last; the
    specification lines after it, up to eight and up to the first other line, go with it."""
    w = Window.partitionBy("file", "page").orderBy("line_no")
    read = lines.withColumn("t", trailing_numbers(F.col("text"))).withColumn("next", F.collect_list(F.struct("text", looks_like_spec_line(F.col("text")).alias("spec"), (strip(F.col("text")) == "").alias("blank"))).over(w.rowsBetween(1, 8)))
    numbers, n = F.col("t.numbers"), F.size("t.numbers")
    stop = F.array_position(F.transform("next", lambda x: ~x["spec"] & ~x["blank"]), F.lit(True))
    specs = F.transform(F.filter(F.slice("next", F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size("next")).cast("int")), lambda x: x["spec"]), lambda x: strip(x["text"]))
    at = lambda k: F.get(numbers, n - k)
    out = read.filter((n >= 2) & (F.length("t.rest") >= 3) & F.col("t.rest").rlike(r"\p{L}{3}") & ~F.lower("t.rest").rlike("total|vat"))
    total = F.when(n >= 3, at(1)).otherwise(0.0)
    qty, rate = F.when(n >= 3, at(3)).otherwise(at(2)), F.when(n >= 3, at(2)).otherwise(at(1))
    fits = F.abs(qty * rate - total) <= 0.02 * total
    return out.select("file", "page", "line_no", F.col("t.rest").alias("description"), qty.alias("qty"), rate.alias("rate"), total.alias("total"), F.when(n >= 3, F.when(fits, "high").otherwise("low")).otherwise("medium").alias("confidence"), specs.alias("specs"))


def wrapped_items(lines: DataFrame, reach: int = 14, large: float = 10.0) -> DataFrame:
    """file, page, line_no, description, unit, rate, tier, specs of lines(file, page, line_no, text), reading on where a price
    isn't on the item's own line.

    Tier 1 is a line that ends in two prices or more. Tier 2 takes, for another line that can be a description, the first
    price over `large` of the next `reach` lines, else the last price there; the first short word in between is its unit,
    and the lines up to that price are used up. What each line would take is a window over its page; which lines are
    reached is then one fold over the page's jumps, of which a page has as many as lines."""
    w = Window.partitionBy("file", "page").orderBy("line_no")
    raw, low = strip(F.coalesce("text", F.lit(""))), F.lower(strip(F.coalesce("text", F.lit(""))))
    headed = low.contains("description") & low.rlike("rate|price|amount|qty|unit")
    title = (raw == F.upper(raw)) & raw.rlike(r"\p{L}") & ~raw.rlike(r"\d")
    skipped = (F.length(raw) < 4) | low.rlike(HEAD_WORDS) | low.contains("total") | raw.rlike(r"^\d+(\.\d+)?$") | headed | low.isin(*COLUMN_WORDS) | title
    read = lines.select("file", "page", "line_no", raw.alias("raw"), skipped.alias("skipped"), trailing_numbers(F.col("text")).alias("t"), clean_rate(F.coalesce("text", F.lit(""))).alias("price"))
    spec = F.struct(F.col("raw").alias("text"), "price", looks_like_spec_line(F.col("raw")).alias("spec"), (F.col("raw") == "").alias("blank"))
    read = read.withColumn("next", F.collect_list(spec).over(w.rowsBetween(1, reach))).withColumn("i", F.row_number().over(w))
    n = F.size("t.numbers")
    same_rate = F.when(n >= 3, F.get("t.numbers", n - 2)).otherwise(F.get("t.numbers", n - 1))
    first = ~F.col("skipped") & looks_like_description(F.col("t.rest")) & (n >= 2) & (same_rate > 0)
    priced = F.filter(F.transform("next", lambda x, i: F.struct((i + 1).alias("off"), x["price"].alias("price"))), lambda x: x["price"] > 0)
    over = F.filter(priced, lambda x: x["price"] > large)
    chosen = F.when(F.size(over) > 0, F.get(over, F.lit(0))).when(F.size(priced) > 0, F.element_at(priced, -1))
    unit = F.when(F.size(over) > 0, F.get(F.filter(F.slice("next", F.lit(1), F.greatest(chosen["off"] - 1, F.lit(0))), lambda x: (F.length(x["text"]) < 8) & x["text"].rlike("[a-zA-Z]")), F.lit(0))["text"])
    tier = F.when(first, 1).when(~F.col("skipped") & chosen.isNotNull() & looks_like_description(F.col("raw")), 2)
    stop = F.array_position(F.transform(F.slice("next", 1, 8), lambda x: ~x["spec"] & ~x["blank"]), F.lit(True))
    specs = F.transform(F.filter(F.slice("next", F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.least(F.size("next"), F.lit(8))).cast("int")), lambda x: x["spec"]), lambda x: x["text"])
    told = read.withColumn("tier", tier).withColumn("jump", F.when(F.col("tier") == 2, chosen["off"] + 1).otherwise(1))
    told = told.select("file", "page", "line_no", "i", "tier", "jump", F.when(F.col("tier") == 1, F.col("t.rest")).otherwise(F.col("raw")).alias("description"), F.when(F.col("tier") == 2, unit).alias("unit_word"), F.when(F.col("tier") == 1, same_rate).otherwise(chosen["price"]).alias("rate"), specs.alias("specs"))
    jumps = told.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("i", "jump"))).alias("js"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("seen"))
    step = lambda s, x: F.when(x["i"] < s["next"], s).otherwise(F.struct((x["i"] + x["jump"]).alias("next"), F.array_append(s["seen"], x["i"]).alias("seen")))
    reached = jumps.select("file", "page", F.explode(F.aggregate("js", start, step, lambda s: s["seen"])).alias("i"))
    kept = told.filter("tier is not null").join(reached, ["file", "page", "i"])
    return kept.select("file", "page", "line_no", "description", normalize_unit(F.col("unit_word"), F.col("description")).alias("unit"), "rate", "tier", "specs")


def anchored_images(images: DataFrame, roles: DataFrame) -> DataFrame:
    """file, sheet, row, image_ref: images(file, sheet, row, col, image_id, image_ref) by the row they are anchored in; where
    a sheet has a column of images, only those anchored there. The last image of a row counts."""
    column = roles.filter("role = 'images'").select("file", "sheet", F.col("col").alias("image_col"))
    told = images.join(column, ["file", "sheet"], "left").filter("image_col is null or image_col = col")
    return told.groupBy("file", "sheet", "row").agg(F.max_by("image_ref", "image_id").alias("image_ref"))


def rows_with_images(cells: DataFrame, images: DataFrame) -> DataFrame:
    """sheet_rows with image_ref, null where a row has none."""
    return sheet_rows(cells).join(anchored_images(images, column_roles(chosen_cells(cells))), ["file", "sheet", "row"], "left")


def page_images(images: DataFrame, most: int = 40) -> DataFrame:
    """The first `most` images of every page, from the top."""
    w = Window.partitionBy("file", "page").orderBy("y0", "image_id")
    return images.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= most).drop("_at")


def page_slice(pages: DataFrame, start: int = 1, count: int | None = None, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(pages from `start`, at most `count` and never past page `most`; file, n_pages, skipped per file)."""
    last = min(most, start + count - 1) if count is not None else most
    per = pages.groupBy("file").agg(F.count("*").alias("n_pages"), F.count_if(~F.col("page").between(start, last)).alias("skipped"))
    return pages.filter(F.col("page").between(start, last)), per


def located(files: DataFrame, names: DataFrame) -> DataFrame:
    """name, path of the files(path, name) that bear the names, the first path where several do; null where none does."""
    one = files.groupBy("name").agg(F.min("path").alias("path"))
    return names.select("name").distinct().join(one, "name", "left")


def document_headers(cells: DataFrame, rows: int = 6) -> DataFrame:
    """file, sheet, header_row, role, col of tables of documents: the first of so many rows with a description-like and a
    price-like cell; where no cell describes by name, a cell that just says item does."""
    keys = ["file", "sheet"]
    top = cells.filter(F.col("row") <= rows).withColumn("v", F.lower(strip(F.col("value"))))
    header = top.groupBy(*keys, "row").agg(F.max(F.col("v").rlike(TABLE_HEAD)).alias("d"), F.max(F.col("v").rlike(TABLE_PRICE)).alias("p")).filter("d and p").groupBy(*keys).agg(F.min("row").alias("header_row"))
    row = top.join(header, keys).filter("row = header_row and v <> ''")
    roles = roles_of(row)
    named = roles.filter("role = 'description'").select(*keys)
    generic = row.filter(F.col("v").isin(*GENERIC_ITEM)).join(named, keys, "left_anti").groupBy(*keys, "header_row").agg(F.min("col").alias("col")).select(*keys, "header_row", F.lit("description").alias("role"), "col")
    return roles.unionByName(generic)


def rate_card(spark: SparkSession, path: str) -> DataFrame:
    """code, category, description, unit, avg_cost, low, high, usage; unpriced rows dropped, the last of a repeated code wins."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    named: dict[str, Column] = {}
    for c in raw.columns:
        key = "".join(x for x in c.lower() if x.isalpha())
        if key in CARD_ALIASES:
            named.setdefault(CARD_ALIASES[key], F.col(f"`{c}`"))
    text = lambda n: named.get(n, F.lit(None).cast("string")).alias(n)
    rows = raw.select(*(text(n) for n in ("code", "category", "description", "unit", "usage", "avg_cost", "price_range")), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("r", number_range(F.col("price_range"))).withColumn("avg", first_number(F.col("avg_cost")))
    cost = F.when(F.col("avg") > 0, F.col("avg")).otherwise((F.col("r.low") + F.col("r.high")) / 2)
    rows = rows.select(F.upper(strip(F.col("code"))).alias("code"), "category", "description", "unit", cost.cast("decimal(18,4)").alias("avg_cost"), F.col("r.low").alias("low"), F.col("r.high").alias("high"), "usage", "at").filter("code <> '' and avg_cost > 0")
    return rows.groupBy("code").agg(F.max_by(F.struct("category", "description", "unit", "avg_cost", "low", "high", "usage"), "at").alias("v")).select("code", "v.*")


def config(path: str, default):
    """A dataclass filled from a JSON file; unknown keys and values of another type keep the default."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return default
    known = {f.name: getattr(default, f.name) for f in fields(default)}
    fit = {k: type(known[k])(v) for k, v in (found.items() if isinstance(found, dict) else ()) if k in known and not isinstance(v, bool) and isinstance(v, (int, float) if isinstance(known[k], float) else type(known[k]))}
    return replace(default, **fit)


def fresh_rate_card(spark: SparkSession, path: str, held: tuple[int, DataFrame] | None = None, force: bool = False) -> tuple[int, DataFrame]:
    """(mtime, card): the held card while its file is as it was, else a new reading of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    mtime = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    if held is not None and held[0] == mtime and not force:
        return held
    return mtime, rate_card(spark, path)
