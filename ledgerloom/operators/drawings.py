"""Spatial operators on the text and linework of drawing pages.

Pairs are only formed within a page, and, where a reach is known, within neighbouring cells of a grid on that page: an
equality join, so a crowded page is spread over many tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.shapes import boxes_related, overlap_ratio, point_to_segment
from ledgerloom.runtime import materialize, scratch

PAGE = ["file", "page"]


def segments(lines: DataFrame) -> DataFrame:
    """file, page, x0, y0, x1, y1 with length, angle and axis (h, v or o), ends in reading order."""
    swap = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    end = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    df = lines.withColumns({"x0": end("x0", "x1"), "x1": end("x1", "x0"), "y0": end("y0", "y1"), "y1": end("y1", "y0")})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    axis = F.when((angle <= 3) | (angle >= 177), "h").when((angle >= 87) & (angle <= 93), "v").otherwise("o")
    return df.withColumns({"length": F.hypot(dx, dy), "angle": angle, "axis": axis})


def merge_parallel(df: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Segments of one axis that continue or thicken each other, as one: gaps and islands along each line of the page."""
    straight = df.filter("axis in ('h', 'v')")
    h = F.col("axis") == "h"
    at, low, high = F.when(h, F.col("y0")).otherwise(F.col("x0")), F.when(h, F.col("x0")).otherwise(F.least("y0", "y1")), F.when(h, F.col("x1")).otherwise(F.greatest("y0", "y1"))
    s = straight.select(*PAGE, "axis", at.alias("at"), low.alias("low"), high.alias("high"))
    by_line = Window.partitionBy(*PAGE, "axis").orderBy("at", "low", "high")
    s = s.withColumn("band", F.sum(F.when(F.col("at") - F.lag("at").over(by_line) <= tolerance, 0).otherwise(1)).over(by_line))
    in_band = Window.partitionBy(*PAGE, "axis", "band").orderBy("low", "high", "at")
    reach = F.max("high").over(in_band.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("island", F.when(F.col("low") <= reach + tolerance, 0).otherwise(1)).withColumn("island", F.sum("island").over(in_band))
    one = s.groupBy(*PAGE, "axis", "band", "island").agg(F.min("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high"))
    h = F.col("axis") == "h"
    xy = lambda a, b: F.when(h, F.col(a)).otherwise(F.col(b))
    return one.select(*PAGE, "axis", xy("low", "at").alias("x0"), xy("at", "low").alias("y0"), xy("high", "at").alias("x1"), xy("at", "high").alias("y1"), (F.col("high") - F.col("low")).alias("length"))


def islands(pixels: DataFrame, gap: int = 6, least: int = 10) -> DataFrame:
    """file, page, y, x0, x1: runs of dark pixels(file, page, y, x) of a row, over gaps of up to `gap`, of at least `least`."""
    w = Window.partitionBy(*PAGE, "y").orderBy("x")
    run = F.sum(F.when(F.col("x") - F.lag("x").over(w) <= gap, 0).otherwise(1)).over(w)
    return pixels.withColumn("run", run).groupBy(*PAGE, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).filter(F.col("x1") - F.col("x0") + 1 >= least).drop("run")


def is_frame(width: Column, height: Column) -> Column:
    """Whether a segment is the page's border: near an edge, or spanning the page."""
    h = (F.col("y0") <= 0.02 * height) | (F.col("y0") >= 0.98 * height) | (F.col("length") >= 0.95 * width)
    v = (F.col("x0") <= 0.02 * width) | (F.col("x0") >= 0.98 * width) | (F.col("length") >= 0.95 * height)
    return F.when((width <= 0) | (height <= 0), False).when(F.col("axis") == "h", h).when(F.col("axis") == "v", v).otherwise(False)


def classify_pages(segs: DataFrame, pages: DataFrame, share: float = 0.72, least: int = 8) -> DataFrame:
    """file, page, kind, aligned_share: 'flat' where enough of the linework is straight along the axes."""
    inner = segs.join(pages, PAGE).filter(~is_frame(F.col("width_px"), F.col("height_px")))
    agg = inner.groupBy(*PAGE).agg(F.count("*").alias("n"), (F.sum(F.when(F.col("axis") != "o", F.col("length")).otherwise(0.0)) / F.sum("length")).alias("aligned_share"))
    return pages.select(*PAGE).join(agg, PAGE, "left").select(*PAGE, F.when((F.col("n") >= least) & (F.col("aligned_share") >= share), "flat").otherwise("perspective").alias("kind"), F.coalesce("aligned_share", F.lit(0.0)).alias("aligned_share"))


def attach(tokens: DataFrame, segs: DataFrame, pages: DataFrame, reach: float = 0.06, shortest: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(spans, unattached): each dimension token with its nearest straight segment within reach of the page's longer side.

    A segment is entered in every grid cell it passes within one cell of, cells being as wide as the reach."""
    side = F.greatest("width_px", "height_px")
    t = tokens.filter("metres > 0").join(pages, PAGE).select(*PAGE, "token_id", "text", "metres", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (side * reach).alias("reach"))
    t = t.withColumns({"gx": F.floor(F.col("cx") / F.col("reach")).cast("int"), "gy": F.floor(F.col("cy") / F.col("reach")).cast("int")})
    s = segs.join(pages, PAGE).filter((F.col("axis") != "o") & (F.col("length") >= side * shortest)).withColumn("reach", side * reach)
    cell = lambda c, d: (F.floor(F.col(c) / F.col("reach")) + d).cast("int")
    s = s.withColumn("gx", F.explode(F.sequence(cell("x0", -1), cell("x1", 1)))).withColumn("gy", F.explode(F.sequence((F.floor(F.least("y0", "y1") / F.col("reach")) - 1).cast("int"), (F.floor(F.greatest("y0", "y1") / F.col("reach")) + 1).cast("int"))))
    s = s.select(*PAGE, "gx", "gy", "seg_id", "axis", "length", "x0", "y0", "x1", "y1")
    d = point_to_segment(F.col("cx"), F.col("cy"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    near = t.join(s, [*PAGE, "gx", "gy"]).withColumn("distance", d).filter(F.col("distance") <= F.col("reach"))
    best = near.groupBy(*PAGE, "token_id").agg(F.min_by(F.struct("text", "metres", "seg_id", "axis", "length", "distance", "x0", "y0", "x1", "y1"), F.struct("distance", "seg_id")).alias("b"))
    spans = best.select(*PAGE, "token_id", F.col("b.text").alias("token"), F.col("b.metres").alias("value_m"), "b.axis", "b.x0", F.least("b.y0", "b.y1").alias("y0"), "b.x1", F.greatest("b.y0", "b.y1").alias("y1"), F.round("b.length", 2).alias("px_len"), F.round(F.col("b.length") / F.col("b.metres"), 2).alias("px_per_m"), F.round("b.distance", 1).alias("distance_px"))
    return spans, t.select(*PAGE, "token_id", "text").join(spans.select(*PAGE, "token_id"), [*PAGE, "token_id"], "left_anti")


def page_scale(spans: DataFrame) -> DataFrame:
    """file, page, scale (median pixels a metre), outliers (token ids more than a quarter off it)."""
    mid = spans.filter("px_per_m > 0").groupBy(*PAGE).agg(F.median("px_per_m").alias("scale"))
    off = spans.join(mid, PAGE).filter(F.abs(F.col("px_per_m") - F.col("scale")) / F.col("scale") > 0.25).groupBy(*PAGE).agg(F.array_sort(F.collect_list("token_id")).alias("outliers"))
    return mid.join(off, PAGE, "left").select(*PAGE, F.round("scale", 2).alias("scale"), F.coalesce("outliers", F.array().cast("array<int>")).alias("outliers"))


def box(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def cluster_spans(spans: DataFrame, gap: float = 0.12) -> DataFrame:
    """spans with cluster (from 0 within the page): groups whose boxes cross or nearly touch are one, with the box of both.

    Every round gives each group the least group of its page it is related to, until none is related to another; a
    round's pairs are those of one page's groups, of all pages at once."""
    label = spans.select(*PAGE, "token_id", F.col("token_id").alias("label"))
    with scratch(spans.sparkSession) as keep:
        while True:
            label = materialize(label, "span-groups")
            boxes = label.join(spans, [*PAGE, "token_id"]).groupBy(*PAGE, "label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
            one, other = boxes.select(*PAGE, "label", box().alias("a")), boxes.select(*PAGE, F.col("label").alias("to"), box().alias("b"))
            joined = one.join(other, PAGE).filter((F.col("to") < F.col("label")) & boxes_related(F.col("a"), F.col("b"), gap)).groupBy(*PAGE, "label").agg(F.min("to").alias("to"))
            joined = materialize(joined, "span-related")
            if not joined.limit(1).count():
                break
            label = label.join(joined, [*PAGE, "label"], "left").select(*PAGE, "token_id", F.coalesce("to", "label").alias("label"))
        number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("label")) - 1
        return keep(spans.join(label.withColumn("cluster", number).drop("label"), [*PAGE, "token_id"]).select(*spans.columns, "cluster"), "span-clusters")


def elements(clustered: DataFrame) -> DataFrame:
    """file, page, element, length_m, height_m, px_per_m: the largest value along each axis, the upper median scale, by falling area."""
    size = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("value_m"))), F.lit(0.0))
    one = clustered.groupBy(*PAGE, "cluster").agg(size("h").alias("length_m"), size("v").alias("height_m"), F.array_sort(F.collect_list("px_per_m")).alias("scales"))
    one = one.withColumn("px_per_m", F.element_at("scales", F.floor(F.size("scales") / 2).cast("int") + 1))
    area = F.col("length_m") * F.greatest("height_m", F.lit(0.01))
    return one.withColumn("element", F.row_number().over(Window.partitionBy(*PAGE).orderBy(area.desc(), "cluster"))).select(*PAGE, "element", "length_m", "height_m", "px_per_m")


def suppress_overlaps(tokens: DataFrame, most: float = 0.5) -> DataFrame:
    """tokens of all reading passes without those a surer kept token overlaps.

    Of two that overlap the less sure one yields, of equally sure ones the later. In rounds, tokens that yield to no token
    still open are kept, and those yielding to a kept one are dropped; the surest open token is always settled."""
    sure = F.struct((-F.col("confidence")).alias("c"), F.col("token_id").alias("t"))
    ranked = tokens.select(*PAGE, "token_id", sure.alias("place"), box().alias("b"))
    with scratch(tokens.sparkSession) as keep:
        rival = ranked.select(*PAGE, F.col("token_id").alias("surer"), F.col("place").alias("surer_place"), F.col("b").alias("surer_b"))
        yields = materialize(ranked.join(rival, PAGE).filter((F.col("surer_place") < F.col("place")) & (overlap_ratio(F.col("b"), F.col("surer_b")) > most)).select(*PAGE, "token_id", "surer"), "overlaps")
        one, dropped = [*PAGE, "token_id"], yields.select(*PAGE, "token_id").limit(0)
        edges = yields
        while edges.limit(1).count():
            firm = edges.select(*PAGE, F.col("surer").alias("token_id")).distinct().join(edges.select(*one).distinct(), one, "left_anti")
            lost = materialize(edges.join(firm.withColumnRenamed("token_id", "surer"), [*PAGE, "surer"], "left_semi").select(*one).distinct(), "overlap-lost")
            dropped = dropped.union(lost)
            left = edges.join(lost, one, "left_anti")  # a dropped token neither yields any more nor makes others yield
            edges = materialize(left.join(lost.withColumnRenamed("token_id", "surer"), [*PAGE, "surer"], "left_anti"), "overlap-edges")
        return keep(tokens.join(dropped, one, "left_anti"), "tokens-kept")


def images_to_rows(rows: DataFrame, images: DataFrame, above: float = 6.0) -> DataFrame:
    """file, page, row, image_ref: each image goes to the free row whose band it overlaps most, images in order of image_id.

    A row's band runs from a little above its own top to the next row's top."""
    bands = rows.withColumn("bottom", F.lead("y0", 1, float("inf")).over(Window.partitionBy(*PAGE).orderBy("y0", "row"))).select(*PAGE, "row", (F.col("y0") - above).alias("top"), "bottom")
    overlap = F.least("y1", "bottom") - F.greatest("y0", "top")
    pairs = images.join(bands, PAGE).withColumn("overlap", overlap).filter("overlap > 0").select(*PAGE, "image_id", "image_ref", "row", "overlap")

    def assign(page: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, own in page.sort_values(["image_id", "overlap", "row"], ascending=[True, False, True]).groupby("image_id", sort=True):
            free = own[~own["row"].isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best["row"])
                out.append(best)
        return pd.DataFrame(out, columns=page.columns)[["file", "page", "row", "image_ref"]]

    return pairs.groupBy(*PAGE).applyInPandas(assign, "file string, page int, row int, image_ref string")


def reconcile(elems: DataFrame) -> DataFrame:
    """elements(file, page, page_kind, element, label, length_m, height_m, depth_m) with missing sizes filled from the best
    element of the same label (flat pages first, then by page), and repeated ones marked: duplicate_of is the first
    element with the same label and sizes to five centimetres, include is false for the others."""
    e = elems.withColumn("_label", F.trim(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), r"[^a-z0-9]+", " ")))
    named = F.col("_label") != ""
    order = F.struct((F.col("page_kind") != "flat").alias("k"), "file", "page", "element")
    donors = e.filter(named).groupBy("_label").agg(*(F.min_by(c, F.when(F.col(c) > 0, order)).alias(f"_{c}") for c in ("length_m", "height_m", "depth_m")))
    e = e.join(donors, "_label", "left").withColumn("filled", F.array_compact(F.array(*(F.when((F.coalesce(F.col(c), F.lit(0.0)) <= 0) & F.col(f"_{c}").isNotNull(), c) for c in ("length_m", "height_m", "depth_m")))))
    e = e.withColumns({c: F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", F.lit(0.0))) for c in ("length_m", "height_m", "depth_m")})
    step = lambda c: F.bround(F.col(c) / 0.05).cast("int")
    e = e.withColumn("_sig", F.when(named, F.concat_ws("|", "_label", step("length_m"), step("height_m"))))
    first = e.filter("_sig is not null").groupBy("_sig").agg(F.min(F.struct("file", "page", "element")).alias("_first"))
    e = e.join(first, "_sig", "left").withColumn("_own", F.col("_first") == F.struct("file", "page", "element"))
    return e.withColumns({"duplicate_of": F.when(~F.col("_own"), F.col("_first")), "include": F.coalesce("_own", F.lit(True))}).select(*elems.columns, "filled", "duplicate_of", "include")


# --- fixed values: texts of a sheet that name no object -------------------------------------------------------------------
SHEET_WORDS = r"(?i)^(scale|drawn|checked|date|rev|sheet|drawing\s*no|project|client|title|dwg|page)\b"
ONLY_SIZE = r"(?i)^[\d\s.,:x×/-]+(\s*(mm|cm|m))?$"
TITLE_WORDS = "wall|counter|kiosk|arch|stage|backdrop|partition|platform|riser|booth|display|elevation|plan|section|detail|unit"
# ---------------------------------------------------------------------------------------------------------------------------


def names_something(text: Column) -> Column:
    """Whether a text can be an object's label: letters of some length that are no size and no field of the sheet."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 3) & ~t.rlike(ONLY_SIZE) & ~t.rlike(SHEET_WORDS) & t.rlike(r"\p{L}{2}")


def cluster_labels(boxes: DataFrame, tokens: DataFrame) -> DataFrame:
    """boxes(file, page, cluster, x0..y1) with label: the text of the page nearest to the box's centre that names something."""
    t = tokens.filter(names_something(F.col("text"))).select(*PAGE, F.trim("text").alias("label"), "token_id", ((F.col("x0") + F.col("x1")) / 2).alias("tx"), ((F.col("y0") + F.col("y1")) / 2).alias("ty"))
    away = F.hypot(F.col("tx") - (F.col("x0") + F.col("x1")) / 2, F.col("ty") - (F.col("y0") + F.col("y1")) / 2)
    near = boxes.join(t, PAGE).groupBy(*PAGE, "cluster").agg(F.min_by("label", F.struct(away, "token_id")).alias("label"))
    return boxes.join(near, [*PAGE, "cluster"], "left")


def cluster_shapes(boxes: DataFrame, arcs: DataFrame, least: float = 0.02) -> DataFrame:
    """boxes with shape and sagitta_m: curved where the longest arc(file, page, chord, rise, x0..y1) that meets the box is
    bowed enough for its chord, its rise measured by the box's px_per_m; flat (and 0) otherwise."""
    a = arcs.select(*PAGE, "chord", "rise", *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    meets = (F.col("a_x0") <= F.col("x1")) & (F.col("a_x1") >= F.col("x0")) & (F.col("a_y0") <= F.col("y1")) & (F.col("a_y1") >= F.col("y0"))
    top = boxes.join(a, PAGE).filter(meets).groupBy(*PAGE, "cluster").agg(F.max(F.struct("chord", "rise")).alias("_arc"))
    out = boxes.join(top, [*PAGE, "cluster"], "left")
    bowed = F.coalesce((F.col("px_per_m") > 0) & (F.col("_arc.chord") > 0) & (F.col("_arc.rise") / F.col("_arc.chord") >= least), F.lit(False))
    return out.withColumn("shape", F.when(bowed, "curved").otherwise("flat")).withColumn("sagitta_m", F.when(bowed, F.round(F.col("_arc.rise") / F.col("px_per_m"), 3)).otherwise(0.0)).drop("_arc")


def reading_order(tokens: DataFrame) -> DataFrame:
    """tokens with place: their order within the page, by lines ten pixels high and then from the left."""
    return tokens.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y0"), -1), "x0", "token_id")))


def page_titles(spans: DataFrame) -> DataFrame:
    """file, page, title: of the texts(file, page, token_id, text, size) that name something, the largest; a word that
    titles drawings is worth twelve points."""
    score = F.col("size") + F.when(F.lower("text").rlike(TITLE_WORDS), 12).otherwise(0)
    return spans.filter(names_something(F.col("text"))).groupBy(*PAGE).agg(F.max_by(F.trim("text"), F.struct(score, "size", -F.col("token_id"))).alias("title"))
