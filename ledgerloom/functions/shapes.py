"""Column functions on curves, boxes and dimensions written as text. Bad input gives 0, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: how dimensions are written ----------------------------------------------------------------------
PAIR = r"(?i)(?<![\d.,])(\d+(?:[.,]\d+)?)\s*(?:mm|cm|m)?\s*[x×*]\s*(\d+(?:[.,]\d+)?)\s*(?:mm|cm|m)?(?:\s*[x×*]\s*(\d+(?:[.,]\d+)?))?\s*(?:mm|cm|m)?\b"
SINGLE = r"(?i)(?<![\d.,])(\d+(?:[.,]\d+)?)\s*(mm|cm|m)\b"
BARE = r"(?<![\w.,])(\d{3,5})(?![\w.,])"
#: Item types by the words of a drawing, the most specific first.
ITEM_TYPES = (
    ("counter", ("kiosk counter", "reception counter", "bar counter", "counter", "kiosk", "reception desk", "cash desk", "bar unit", "servery", "podium counter")),
    ("arch", ("main arch", "entrance arch", "archway", "portal", "gateway", "arch")),
    ("stage", ("stage", "riser", "platform", "deck", "podium", "catwalk", "runway")),
    ("wall", ("feature wall", "backdrop", "back drop", "partition", "wall", "panel wall", "media wall", "step and repeat", "fascia")),
)
CUTOUT_WORDS = ("window", "niche", "opening", "cut out", "cutout", "cut-out", "void", "screen", "tv", "recess", "aperture", "display box")
ENVELOPE_WORDS = ("clear opening", "overall", "external", "envelope", "structural opening", "finished opening", "o/a", "outer", "total size")
CUTOUT_COUNT = r"(?:x\s*)?(\d{1,2})\s*(?:nos|no\.?|pcs|off)\b"
ENVELOPE_TOLERANCE, CUTOUT_SHARE = 0.02, 0.90
# --------------------------------------------------------------------------------------------------------------------


def _positive(c: Column) -> Column:
    return F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def radius(chord: Column, sagitta: Column) -> Column:
    c, h = _positive(chord), _positive(sagitta)
    return F.when((c > 0) & (h > 0), c * c / (8 * h) + h / 2).otherwise(0.0)


def included_angle(chord: Column, r: Column, sagitta: Column | None = None) -> Column:
    """Degrees; more than 180 where the rise exceeds the radius."""
    c, r = _positive(chord), _positive(r)
    half = F.degrees(2 * F.asin(F.least(c / (2 * r), F.lit(1.0))))
    if sagitta is not None:
        h = _positive(sagitta)
        half = F.when(h > 0, F.degrees(2 * F.atan2(c / 2, r - h))).otherwise(half)
    return F.when((c <= 0) | (r <= 0), 0.0).when(c > 2 * r, 180.0).otherwise(half)


def arc_length(r: Column, angle: Column) -> Column:
    return _positive(r) * F.radians(F.least(_positive(angle), F.lit(360.0)))


def arc_from_chord(chord: Column, sagitta: Column, least_angle: float = 5.0) -> Column:
    """Length of the arc over a chord; the chord itself where it is as good as straight."""
    c, r = _positive(chord), radius(chord, sagitta)
    angle = included_angle(chord, r, sagitta)
    return F.when((r <= 0) | (angle < least_angle), c).otherwise(arc_length(r, angle))


def annulus_area(outer: Column, inner: Column) -> Column:
    o = _positive(outer)
    i = F.least(_positive(inner), o)
    return F.pi() * (o * o - i * i)


def annulus_edge(outer: Column, inner: Column) -> Column:
    o = _positive(outer)
    return 2 * F.pi() * (o + F.least(_positive(inner), o))


def arch_band(opening: Column, height: Column, sagitta: Column | None = None, r: Column | None = None) -> Column:
    """Two legs and the arc over an opening, 0 without both sizes. The rise is the one given, else what a radius that
    spans the opening implies, else that of a half circle; it is never more than the height."""
    o, h = _positive(opening), _positive(height)
    given = _positive(sagitta) if sagitta is not None else F.lit(0.0)
    span = _positive(r) if r is not None else F.lit(0.0)
    implied = F.when((span > 0) & (span >= o / 2), span - F.sqrt(F.greatest(span * span - o * o / 4, F.lit(0.0)))).otherwise(0.0)
    rise = F.least(F.when(given > 0, given).when(implied > 0, implied).otherwise(o / 2), h)
    return F.when((o > 0) & (h > 0), 2 * (h - rise) + arc_from_chord(o, rise)).otherwise(0.0)


def is_curved(shape: Column) -> Column:
    """Slower to make than a flat panel: bent, or cut round."""
    return F.coalesce(shape.isin("curved", "ring", "arch"), F.lit(False))


def is_bent(shape: Column) -> Column:
    """Formed by bending; a ring is cut flat and isn't."""
    return F.coalesce(shape.isin("curved", "arch"), F.lit(False))


def developed_run(shape: Column, length: Column, r: Column, sagitta: Column, angle: Column, least_angle: float = 5.0) -> Column:
    """Length of material along an item: its arc where it is curved, by its rise or else by radius and angle, its length
    where it is flat, an arch (whose head arch_band develops), or as good as straight."""
    c, radius_, turn = _positive(length), _positive(r), _positive(angle)
    by_angle = F.when((radius_ > 0) & (turn >= least_angle), arc_length(radius_, turn)).otherwise(c)
    bent = F.when(_positive(sagitta) > 0, arc_from_chord(c, sagitta, least_angle)).otherwise(by_angle)
    return F.when((c > 0) & shape.isin("curved", "ring"), bent).otherwise(c)


def describe_shape(shape: Column, r: Column, angle: Column, sagitta: Column, outer: Column, inner: Column) -> Column:
    """A curve in words: ring or disc by its radii, arc by radius and angle, else by rise, else not stated; or flat."""
    o, i, rad, turn, rise = map(_positive, (outer, inner, r, angle, sagitta))
    ring = F.when(i > 0, F.format_string("ring, R%.3f m outer / R%.3f m inner", o, i)).otherwise(F.format_string("disc, R%.3f m", o))
    arc = F.when((rad > 0) & (turn > 0), F.format_string("arc R%.3f m over %.1f deg", rad, turn)).when(rise > 0, F.format_string("arc, %.3f m rise", rise)).otherwise("arc, rise not stated")
    return F.when(shape == "ring", ring).when(is_bent(shape), arc).otherwise("flat")


def chord_and_rise(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """struct(chord, rise) of a cubic curve by its four points: the distance of its ends, and of its middle from their line.

    Both follow from the ends' vector and the middle's: the middle of a cubic is the weighted mean 1:3:3:1 of its points."""
    dx, dy = x3 - x0, y3 - y0
    to_x, to_y = (3 * (x1 + x2) + x3 - 7 * x0) / 8, (3 * (y1 + y2) + y3 - 7 * y0) / 8
    chord = F.hypot(dx, dy)
    return F.struct(chord.alias("chord"), F.when(chord > 0, F.abs(dx * to_y - dy * to_x) / chord).otherwise(0.0).alias("rise"))


def point_to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / square))).otherwise(0.0)
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller box's; boxes are structs x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, w * h / smaller).otherwise(0.0)


def boxes_related(a: Column, b: Column, gap: float = 0.12) -> Column:
    """Whether two boxes cross, or nearly touch against the longer of their sides."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    reach = gap * F.greatest(a["x1"] - a["x0"], a["y1"] - a["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(1.0))
    return ((w > 0) & (h > 0)) | ((F.greatest(-w, F.lit(0.0)) < reach) & (F.greatest(-h, F.lit(0.0)) < reach))


def to_metres(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "mm", 0.001).when(unit == "cm", 0.01).otherwise(1.0)


def bare_unit(value: Column) -> Column:
    """The unit a number without one is taken to have."""
    return F.when(value >= 100, "mm").when(value >= 10, "cm").otherwise("m")


def dimensions(text: Column) -> Column:
    """array<struct(raw, kind, metres array<double>, assumed)>: products, then single lengths, then, where fewer than two
    were found, bare numbers of three to five digits; a raw text counts once, and not where a longer one holds it."""
    t = F.coalesce(text, F.lit(""))
    number = lambda s: F.replace(s, F.lit(","), F.lit(".")).cast("double")

    def row(raw: Column, kind: str, values: Column, unit: Column) -> Column:
        metres = F.transform(values, lambda v: to_metres(v, F.coalesce(unit, bare_unit(v))))
        return F.struct(raw.alias("raw"), F.lit(kind).alias("kind"), metres.alias("metres"), unit.isNull().alias("assumed"))

    def pair(raw: Column) -> Column:
        values = F.transform(F.regexp_extract_all(raw, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), number)
        unit = F.regexp_extract(F.lower(raw), r"(mm|cm|m)\b", 1)
        return row(F.trim(raw), "pair", values, F.when(unit != "", unit))

    def single(raw: Column) -> Column:
        return row(F.trim(raw), "single", F.array(number(F.regexp_extract(raw, SINGLE, 1))), F.lower(F.regexp_extract(raw, SINGLE, 2)))

    pairs = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(PAIR), F.lit(0))), pair)
    singles = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(SINGLE), F.lit(0))), single)
    found = F.concat(pairs, F.filter(singles, lambda s: ~F.exists(pairs, lambda p: p["raw"].contains(s["raw"]))))
    bare = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(BARE), F.lit(1))), lambda r: row(r, "bare", F.array(r.cast("double")), F.lit(None).cast("string")))
    return F.when(F.size(found) < 2, F.concat(found, bare)).otherwise(found)


def item_type(text: Column) -> Column:
    """The first type one of whose words stands in a text; wall where none does."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in ITEM_TYPES:
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), name)
    return out.otherwise("wall")


def assigned_dimensions(found: Column) -> Column:
    """struct(length_m, height_m, depth_m, confidence, assumed_unit) from what dimensions() gives of a page.

    Candidates are ranked as rows: a product of three (high, the first), the product of two with the largest area
    (medium), the two largest lengths or the only one (low); the best ranked one is read."""
    size = lambda d, i: F.round(F.coalesce(F.get(d["metres"], F.lit(i)), F.lit(0.0)), 3)

    def row(rank: int, order: Column, d: Column, conf: str, three: bool) -> Column:
        return F.struct(F.lit(rank).alias("rank"), order.alias("order"), size(d, 0).alias("length_m"), size(d, 1).alias("height_m"), (size(d, 2) if three else F.lit(0.0)).alias("depth_m"), F.lit(conf).alias("confidence"), d["assumed"].alias("assumed_unit"))

    pairs = F.filter(found, lambda d: d["kind"] == "pair")
    triples = F.transform(F.filter(pairs, lambda d: F.size(d["metres"]) > 2), lambda d, i: row(0, i.cast("double"), d, "high", True))
    twos = F.transform(pairs, lambda d, i: row(1, -(F.get(d["metres"], F.lit(0)) * F.get(d["metres"], F.lit(1))), d, "medium", False))
    lengths = F.array_sort(F.transform(F.filter(found, lambda d: d["kind"] != "pair"), lambda d, i: F.struct((-F.get(d["metres"], F.lit(0))).alias("m"), i.alias("i"), d["assumed"].alias("a"))))
    at = lambda i: F.round(F.coalesce(-F.get(lengths, F.lit(i))["m"], F.lit(0.0)), 3)
    single = F.struct(F.lit(2).alias("rank"), F.lit(0.0).alias("order"), at(0).alias("length_m"), at(1).alias("height_m"), F.lit(0.0).alias("depth_m"), F.lit("low").alias("confidence"), F.exists(F.slice(lengths, 1, 2), lambda x: x["a"]).alias("assumed_unit"))
    best = F.array_min(F.concat(triples, twos, F.when(F.size(lengths) > 0, F.array(single)).otherwise(F.slice(F.array(single), 1, 0))))
    none = F.struct(F.lit(0.0).alias("length_m"), F.lit(0.0).alias("height_m"), F.lit(0.0).alias("depth_m"), F.lit("none").alias("confidence"), F.lit(False).alias("assumed_unit"))
    return F.when(best.isNull(), none).otherwise(F.struct(*(best[c].alias(c) for c in ("length_m", "height_m", "depth_m", "confidence", "assumed_unit"))))


def cutouts(texts: Column) -> Column:
    """array<struct(label, width_m, height_m, count)>: openings that a text names beside their size, envelopes aside."""
    word = lambda t: F.get(F.filter(F.array(*map(F.lit, CUTOUT_WORDS)), lambda w: F.contains(F.lower(t), w)), F.lit(0))
    size = lambda t: F.get(F.filter(dimensions(t), lambda d: d["kind"] == "pair"), F.lit(0))["metres"]
    count = lambda t: F.coalesce(F.regexp_extract(F.lower(t), CUTOUT_COUNT, 1).try_cast("int"), F.lit(1))
    named = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t.isNotNull() & word(t).isNotNull() & ~F.exists(F.array(*map(F.lit, ENVELOPE_WORDS)), lambda w: F.contains(F.lower(t), w)) & size(t).isNotNull())
    return F.transform(named, lambda t: F.struct(F.initcap(word(t)).alias("label"), F.round(F.get(size(t), F.lit(0)), 3).alias("width_m"), F.round(F.get(size(t), F.lit(1)), 3).alias("height_m"), count(t).alias("count")))


def real_cutouts(found: Column, length: Column, height: Column) -> Column:
    """The cutouts that aren't the item's own envelope restated: not its size within a tolerance, not most of its area."""
    near = lambda v, whole: F.abs(v - whole) <= whole * ENVELOPE_TOLERANCE
    area = lambda c: c["width_m"] * c["height_m"] * F.greatest(c["count"], F.lit(1)) / (length * height)
    return F.when(length * height > 0, F.filter(found, lambda c: ~((near(c["width_m"], length) & near(c["height_m"], height)) | (area(c) > CUTOUT_SHARE)))).otherwise(found)
