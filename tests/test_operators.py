import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import corrections, drawings, matching, orphans, records, similarity
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import pipelines


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- orphans -------------------------------------------------------------------------------------------------------------
T = lambda d: dt.datetime(2024, 1, d)
Q = "id bigint, created_at timestamp_ntz, loaded_at timestamp_ntz, extra string"
J = "id bigint, quotation_id bigint, created_at timestamp_ntz, loaded_at timestamp_ntz, extra string"
I = "id bigint, quotation_id bigint, job_id bigint, created_at timestamp_ntz, loaded_at timestamp_ntz"  # noqa: E741
R = "table_name string, record_id bigint, removed_at timestamp_ntz"


def history(spark):
    q = [(1, T(1), T(1), "x"), (2, T(1), T(9), "x"), (3, T(1), T(1), "x"), (4, T(1), T(1), "x"), (4, T(1), T(8), "x"), (None, T(1), T(1), "x"), (5, T(1), None, "x"), (1, T(1), T(1), "x")]
    j = [(10, 1, T(2), T(2), ""), (11, 2, T(2), T(2), ""), (12, 3, T(2), T(2), ""), (13, 4, T(2), T(2), ""), (14, 99, T(2), T(2), ""), (15, 0, T(2), T(2), ""), (16, None, T(2), T(2), ""), (14, 99, T(2), T(5), ""), (17, 5, T(2), T(2), "")]
    i = [(20, 1, 10, T(3), T(3)), (21, 3, 77, T(3), T(3)), (22, None, None, T(3), T(3))]
    r = [("quotations", 3, T(4)), ("quotations", 3, T(4)), ("quotations", 4, T(5)), ("jobs", 500, T(5)), (None, 1, T(5)), ("quotations", None, T(5)), ("quotations", 1, None)]
    make = lambda x, s: spark.createDataFrame(x, s)
    return {"quotations": make(q, Q), "jobs": make(j, J), "invoices": make(i, I)}, make(r, R)


EXPECTED = [("invoices", 21, "job_id", "missing"), ("invoices", 21, "quotation_id", "removed"), ("jobs", 11, "quotation_id", "late"), ("jobs", 12, "quotation_id", "removed"), ("jobs", 14, "quotation_id", "missing"), ("jobs", 17, "quotation_id", "missing")]


@pytest.mark.parametrize("cuts", [[], ["2024-01-04"], ["2024-01-02", "2024-01-05", "2024-01-09"]])
def test_orphans_do_not_depend_on_the_cuts(spark, cuts):
    records_, removed = history(spark)
    state = orphans.replay(spark, records_, removed, cuts)
    assert rows(orphans.orphans(state), "table_name", "row_id", "field_name", "status") == EXPECTED


def test_orphans_of_empty_tables(spark):
    records_, removed = history(spark)
    state = orphans.replay(spark, {k: v.limit(0) for k, v in records_.items()}, removed.limit(0), [])
    assert orphans.orphans(state).count() == 0 and orphans.snapshot_counts(state).count() == 0


def test_orphans_reopen_and_resolve(spark):
    records_, removed = history(spark)
    none = {k: v.limit(0) for k, v in records_.items()}
    state = orphans.advance(orphans.empty_state(spark), none | {"jobs": records_["jobs"].filter("id = 10")}, removed.limit(0))
    assert rows(orphans.orphans(state), "row_id", "status") == [(10, "missing")]
    parent = records_["quotations"].filter("id = 1").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    state = orphans.advance(state, none | {"quotations": parent}, removed.limit(0))
    assert orphans.orphans(state).count() == 0
    gone = spark.createDataFrame([("quotations", 1, T(20))], R)
    state = orphans.advance(state, none, gone)
    assert rows(orphans.orphans(state), "row_id", "status") == [(10, "removed")]


def test_orphan_stream(spark, tmp_path):
    records_, removed = history(spark)
    for name, df in [*records_.items(), ("removed", removed)]:
        df.write.parquet(f"{tmp_path}/{name}")
    read = lambda n: pipelines.file_stream(spark, f"{tmp_path}/{n}")
    state = pipelines.track_orphans({n: read(n) for n in records_}, read("removed"))
    assert rows(orphans.orphans(state), "table_name", "row_id", "field_name", "status") == EXPECTED


def test_orphan_batches_touch_few_buckets(spark):
    n, span = 20_000, 100
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    q = spark.range(1, n).select("id", at.alias("created_at"), at.alias("loaded_at"))
    j = spark.range(1, n).select("id", F.col("id").alias("quotation_id"), at.alias("created_at"), at.alias("loaded_at"))
    none = spark.createDataFrame([], R)
    state = orphans.advance(orphans.empty_state(spark, span), {"quotations": q, "jobs": j}, none)
    before = state.store.state()
    small = j.filter(f"id >= {n - n // 100}").withColumn("id", F.col("id") + n)
    state = orphans.advance(state, {"quotations": q.limit(0), "jobs": small}, none)
    after = state.store.state()
    touched = {b for b in after["refs"] if after["refs"][b] != before["refs"].get(b)}
    assert len(touched) <= 0.05 * len(before["refs"]) and orphans.orphans(state).count() == 0
    assert state.refs.count() == n - 1 + small.count()
    state.store.prune(1)
    assert orphans.state_at(spark, state.store.root, span).refs.count() == n - 1 + small.count()


def test_orphan_stream_restarts_where_it_died(spark, tmp_path, monkeypatch):
    records_, removed = history(spark)
    for name, df in [*records_.items(), ("removed", removed)]:
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    read = lambda n: pipelines.file_stream(spark, f"{tmp_path}/{n}", 1)
    run = lambda: pipelines.track_orphans({n: read(n) for n in records_}, read("removed"), f"{tmp_path}/state")
    real, calls = orphans.advance, []

    def dying(*a, **k):
        calls.append(1)
        out = real(*a, **k)
        if len(calls) == 2:
            raise RuntimeError("killed after its commit")
        return out

    monkeypatch.setattr(pipelines, "advance", dying)
    with pytest.raises(Exception, match="killed"):
        run()
    assert rows(orphans.orphans(run()), "table_name", "row_id", "field_name", "status") == EXPECTED
    monkeypatch.setattr(pipelines, "advance", real)
    records_["jobs"].filter("id = 14").withColumn("id", F.lit(18).cast("bigint")).write.mode("append").parquet(f"{tmp_path}/jobs")
    assert ("jobs", 18, "quotation_id", "missing") in rows(orphans.orphans(run()), "table_name", "row_id", "field_name", "status")


def test_scratch_deletes_all_but_what_is_kept(spark):
    from ledgerloom.runtime import materialize, outside, scratch

    with scratch(spark) as keep:
        gone = materialize(spark.range(3), "gone")
        files = gone.inputFiles()
        with outside():
            other = materialize(spark.range(4), "other")
        with scratch(spark) as inner:
            kept = inner(gone, "inner")
        kept = keep(kept.filter("id > 0"), "kept")
    assert kept.count() == 2 and other.count() == 4 and not any(__import__("os").path.exists(f.removeprefix("file://")) for f in files)


def test_shared_folder_must_be_named_on_a_cluster():
    from ledgerloom import runtime

    class Spark:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Spark)


# ---- records ---------------------------------------------------------------------------------------------------------------
def test_keep_first_latest_newest(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, t int, v string")
    assert rows(records.keep_first(df, ["k"], [F.col("t")]), "k", "t") == [("a", 1), ("b", 1)]
    assert records.keep_latest(df, ["k"], [F.col("t")], inherit=["v"]).orderBy("k").collect() == [("a", 3, "x"), ("b", 1, None)]
    assert rows(records.keep_newest_n(df, ["k"], [F.desc("t")], 2), "k", "t") == [("a", 2), ("a", 3), ("b", 1)]


def test_number_rows(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.hash("id"))
    got = [r["number"] for r in records.number_rows(df, ["v", "id"], 5).orderBy("v", "id").collect()]
    assert got == list(range(6, 1006))


def test_number_rows_of_wide_rows_in_many_ranges(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 9).select(F.xxhash64("id").alias("v"), "id", F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"))
    got = records.number_rows(df, ["v", "id"], partitions=64)
    assert got.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first() == (n, n, 1, n)
    assert records.number_rows(df.limit(0), ["v", "id"]).count() == 0


def test_long_chains_and_cycles(spark):
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") < 999, F.col("id") + 1).when((F.col("id") >= 1000) & (F.col("id") < n - 1), F.col("id") + 1).when(F.col("id") == n - 1, 1000).alias("merged_into"))
    got = records.resolve_chain(df).groupBy("root").agg(F.count("*").alias("n"))
    assert rows(got, "root", "n") == [(999, 1000), (1000, 2000)]


def test_upsert_update_delete_guard(spark):
    old = spark.createDataFrame([(1, "a", ["x"]), (2, "b", None)], "id int, v string, s array<string>")
    new = spark.createDataFrame([(2, None, ["z"]), (3, "c", None), (1, "n", ["y"])], "id int, v string, s array<string>")
    assert sorted(map(tuple, records.upsert(old, new, ["id"], ["s"]).collect())) == [(1, "n", ["x", "y"]), (2, "b", ["z"]), (3, "c", [])]
    changes = spark.createDataFrame([(1, "v", "A"), (1, "id", "9"), (2, "v", "bad"), (8, "v", "A")], "id int, field string, value string")
    out, refused = records.update(old, changes, "id", {"v": ("A", "B")})
    assert rows(out, "id", "v") == [(1, "A"), (2, "b")] and refused.count() == 3
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, p int")
    gone = spark.createDataFrame([(1,), (1,)], "id int")
    assert [d.count() for d in records.cascade_delete(old, child, gone, "id", "p")] == [1, 2]
    assert sorted((r["c"], r["p"]) for r in records.cascade_delete(old, child, gone, "id", "p", "null")[1].filter("c < 12").collect() if r["p"]) == [(11, 2)]
    fresh = spark.createDataFrame([(3, 1, "a"), (4, 1, "a"), (5, 9, "b"), (6, 2, "z")], "id int, p int, key string")
    have = spark.createDataFrame([("z",)], "key string")
    assert rows(records.guarded_insert(have, fresh, ["key"], old, "id", "p"), "id") == [(3,)]


def test_chains_end_and_cycles_resolve(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 99), (7, 1), (8, 8)], "id int, merged_into int")
    assert rows(records.resolve_chain(df), "id", "root") == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 4), (6, 6), (7, 3), (8, 8)]


def test_proportional_keeps_the_total(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 5.0)], "g string, i int, s double").withColumn("t", F.lit(100.0))
    got = records.proportional(df, ["g"], "s", "t", [F.col("i")])
    assert rows(got, "g", "i", "allotted") == [("a", 1, 34.0), ("a", 2, 33.0), ("a", 3, 33.0), ("b", 1, 100.0)]


# ---- corrections, matching, vectors --------------------------------------------------------------------------------------------
ITEM = "file_name string, original_description string, historical_rate double, unit string, venue string, rate_confidence string, venue_confidence string, needs_review boolean, flag_reason string"
FIX = "file_name string, original_description string, rate double, unit string, venue string, corrected_fields array<string>"


@pytest.mark.parametrize("fix, rate, expected", [((None, None, "Al Barsha", ["venue"]), 750.0, (750.0, "Al Barsha", False)), ((0.0, None, "Al Barsha", []), 750.0, (750.0, "Kite Beach", False)), ((1234.0, None, None, ["rate"]), 500.0, (1234.0, "Kite Beach", False)), (None, 500.0, (500.0, "Kite Beach", True))])
def test_corrections(spark, fix, rate, expected):
    items = spark.createDataFrame([("F.xlsx", " Pirate Ship", rate, "Pcs", "Kite Beach", "low", "low", True, "unverified")], ITEM)
    fixes = spark.createDataFrame([("F.xlsx ", "pirate ship", *fix)] if fix else [], FIX)
    out = corrections.apply_corrections(items, fixes).first()
    assert (out["historical_rate"], out["venue"], out["needs_review"]) == expected


def test_correction_fields_unite(spark):
    a = spark.createDataFrame([("f", "d", 5.0, None, None, ["rate"])], FIX)
    b = spark.createDataFrame([("f", "d", None, None, "v", ["venue"])], FIX)
    assert tuple(corrections.merge_corrections(a, b).first()) == ("f", "d", 5.0, None, "v", ["rate", "venue"])


def test_review_reasons(spark):
    items = spark.createDataFrame([("f", "x", 0.0, "", "", "", "low", True, "should Reconcile"), ("f", "Ship", 5.0, "", "Hall", "", "high", False, None), ("f", "x", 0.0, "", "", "", "low", True, "dismissed")], ITEM)
    assert [len(r[0]) for r in items.select(corrections.review_reasons()).collect()] == [4, 0, 0]


def test_ladder_against_brute_force(spark):
    rng = random.Random(5)
    words = ["oak", "wall", "stage", "deck", "play", "tunnel", "arch", "light", "box", "panel"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    catalog = [(i, text(rng.randint(1, 3)).title()) for i in range(40)] + [(90, None), (91, " "), (92, "Oak")]
    lines = [(i, text(rng.randint(1, 4)) + "\nspec") for i in range(60)] + [(99, None), (98, "")]
    got = {r["line_id"]: (r["id"], r["rung"]) for r in matching.catalog_ladder(spark.createDataFrame(lines, "line_id int, description string"), spark.createDataFrame(catalog, "id int, description string")).collect()}
    keys = [(i, d.lower().strip()) for i, d in catalog if d and d.strip()]
    want = {}
    for i, d in lines:
        if not d:
            continue
        title = d.split("\n")[0]
        exact = [k for k, c in keys if c == title]
        held = sorted((-len(c), k) for k, c in keys if len(c) >= 6 and len(title) >= 6 and (c in title or title in c))
        if exact:
            want[i] = (min(exact), 2)
        elif held:
            longest = held[0][0]
            want[i] = (min(k for n, k in held if n == longest), 3)
    assert got == want


def test_best_by_words(spark):
    cards = spark.createDataFrame([("A", "Wood", "Pcs", 5.0, "mdf board 18"), ("B", "Wood", "Pcs", 4.0, "mdf board 18"), ("C", "Wood", "Pcs", 1.0, "mdf flexible 18"), ("D", "Paint", "L", 1.0, "mdf 18")], "code string, category string, unit string, cost double, text string")
    roles = spark.createDataFrame([("wall", "wood", "Pcs", ["mdf", "18"], ["flexible"]), ("none", "metal", None, ["mdf"], None)], "role string, category string, unit string, prefer array<string>, avoid array<string>")
    assert rows(matching.best_by_words(roles, cards), "role", "code") == [("wall", "B")]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    vectors[7] = vectors[9]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "vec_id bigint, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in similarity.nearest(df.filter("vec_id % 10 = 0 or vec_id = 99"), df, 3).collect()}
    u = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = np.round(u[q] @ u.T, 9)
        order = [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:3]
        assert [got[q, k] for k in (1, 2, 3)] == order
    assert similarity.nearest(df.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("need, service, label", [([0.99, 0.14, 0.0], False, "matched"), ([0.0, 1.0, 0.0], False, None), ([0.75, 0.66, 0.0], False, "suggested"), ([1.0, 0.0, 0.0], True, None)])
def test_crossfill(spark, need, service, label):
    df = spark.createDataFrame([(1, "img", [1.0, 0.0, 0.0], False), (2, "", need, service)], "id bigint, image_ref string, embedding array<float>, service boolean")
    assert [r["label"] for r in similarity.crossfill(df).collect()] == ([label] if label else [])


def test_similarity_percent(values):
    assert values([(0.0,), (2.0,), (4.0,), (None,), (0.5,)], "d double", similarity.similarity_percent(F.col("d"))) == [100.0, 0.0, 0.0, 0.0, 75.0]


# ---- readers and sinks ----------------------------------------------------------------------------------------------------------
def sheet(file, name, lines, active=True):
    return [(file, name, active, r, c, v) for r, line in enumerate(lines, 1) for c, v in enumerate(line, 1) if v is not None]


CELLS = "file string, sheet string, is_active boolean, row int, col int, value string"


def test_sheet_rows(spark):
    good = [["Quotation"], ["Ref", "1"], ["Venue", "Kite Beach"], ["Description", "Unit", "Qty", "Unit Rate", "Total"], ["Main Stage Platform 8m x 6m", "Sqm", "1", "12500", "12500"], ["LED Screen", "Pcs", "2", "6500", "13000"], ["Odd", "Pcs", "2", "100", "900"], ["Heading only"], ["Gap row", "Set", None, None, None], [None, None, None, None, "26400"], ["Grand Total", None, None, None, "26400"]]
    bare = [["Soft Play Area with Ball Pit", "2", "4200", "8400"], ["Inflatable Bouncy Castle", "3", "850.5", "2551.5"], ["Registration Desk", "2", "1200", "2400"]]
    hidden = [["Description", "Rate"], ["Secret", "5"]]
    cells = spark.createDataFrame(sheet("a", "Quotation", good) + sheet("b", "Sheet1", bare) + sheet("c", "Notes", hidden, False), CELLS)
    got = {(r["file"], r["description"]): (r["unit"], r["qty"], r["rate"], r["confidence"]) for r in readers.sheet_rows(cells).collect()}
    assert got[("a", "Main Stage Platform 8m x 6m")] == ("Sqm", 1.0, 12500.0, "high")
    assert got[("a", "Odd")][3] == "low" and got[("a", "Gap row")][3] == "none"
    assert ("a", "Grand Total") not in got and ("a", "Heading only") not in got and not [k for k in got if k[0] == "c"]
    assert got[("b", "Inflatable Bouncy Castle")][1:3] == (3.0, 850.5)  # the first row is taken for a header


def test_table_rows_merge_cells_and_derive_rates(spark):
    lines = [["Description", "Description", "Qty", "Price", "Total"], ["Arch", "Arch", "2", None, "500"]]
    cells = spark.createDataFrame(sheet("d", "1", lines), CELLS)
    assert [(r["description"], r["rate"]) for r in readers.table_rows(cells).collect()] == [("Arch", 250.0)]


def test_line_items(spark):
    text = ["Client Name:", "Backdrop 10x6m  2  450.00  900.00", "- printed fabric", "", "L 10m", "Another line", "Totem 3 120.00", "2,129.60", "Total 5 1,029.00"]
    df = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(text)], "file string, page int, line_no int, text string")
    got = [(r["description"], r["qty"], r["rate"], r["total"], r["confidence"], r["specs"]) for r in readers.line_items(df).orderBy("line_no").collect()]
    assert got == [("Backdrop 10x6m", 2.0, 450.0, 900.0, "high", ["- printed fabric", "L 10m"]), ("Totem", 3.0, 120.0, 0.0, "medium", [])]


def test_wrapped_items_use_up_their_lines(spark):
    text = ["EVENT QUOTATION", "Description", "Client: Acme", "Backdrop 10x6m  2  450.00  900.00", "- printed fabric", "Stage platform wrapped", "over lines", "Sqm", "4", "1,200.00", "Registration desk", "5", "7", "Grand Total 900", "Note about nothing"]
    df = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(text)] + [("f", 2, 0, None), ("g", 1, 0, "")], "file string, page int, line_no int, text string")
    got = [(r["line_no"], r["description"], r["unit"], r["rate"], r["tier"]) for r in readers.wrapped_items(df).orderBy("file", "page", "line_no").collect()]
    assert got == [(3, "Backdrop 10x6m", "Pcs", 450.0, 1), (4, "- printed fabric", "Sqm", 1200.0, 2), (10, "Registration desk", "Pcs", 7.0, 2)]
    assert readers.wrapped_items(df.limit(0)).count() == 0


def test_images_pages_and_files(spark):
    cells = spark.createDataFrame(sheet("a", "Quotation", [["Description", "Photo", "Qty", "Rate"], ["Stage", None, "1", "500"], ["Desk", None, "2", "50"]]), CELLS)
    images = spark.createDataFrame([("a", "Quotation", 2, 2, 1, "x"), ("a", "Quotation", 2, 2, 2, "y"), ("a", "Quotation", 3, 4, 3, "z")], "file string, sheet string, row int, col int, image_id int, image_ref string")
    assert rows(readers.rows_with_images(cells, images).fillna("", ["image_ref"]), "description", "image_ref") == [("Desk", ""), ("Stage", "y")]
    many = spark.createDataFrame([("f", 1, i, float(90 - i)) for i in range(50)], "file string, page int, image_id int, y0 double")
    assert readers.page_images(many).agg(F.count("*"), F.min("image_id")).first() == (40, 10)
    kept, per = readers.page_slice(spark.createDataFrame([("f", p) for p in range(1, 71)], "file string, page int"), 5, 3)
    assert rows(kept, "page") == [(5,), (6,), (7,)] and rows(per, "n_pages", "skipped") == [(70, 67)]
    files = spark.createDataFrame([("/b/x.pdf", "x.pdf"), ("/a/x.pdf", "x.pdf")], "path string, name string")
    assert {r["name"]: r["path"] for r in readers.located(files, spark.createDataFrame([("x.pdf",), ("n.pdf",)], "name string")).collect()} == {"x.pdf": "/a/x.pdf", "n.pdf": None}
    heads = spark.createDataFrame(sheet("d", "1", [["Note"], ["Item", "Qty", "Unit Cost"], ["Arch", "1", "5"]]) + sheet("e", "1", [["Item"], ["x"]]), CELLS)
    assert rows(readers.document_headers(heads), "file", "header_row", "role", "col") == [("d", 2, "description", 1), ("d", 2, "qty", 2), ("d", 2, "rate", 3)]


def test_summaries_refs_and_cards(spark):
    lines = spark.createDataFrame([(1, 1, "Stage\noak", "Pcs", 2.0, 50.0), (1, 2, "Desk", "Pcs", 1.0, 100.0), (2, 1, None, None, None, None)], "doc_id int, line_no int, description string, unit string, qty double, rate double")
    off = spark.createDataFrame([(1, "percent", 10.0)], "doc_id int, discount_type string, discount_value double")
    got = {r["doc_id"]: tuple(None if v is None else float(v) for v in r[1:]) for r in sinks.document_summary(sinks.document_rows(lines), off).collect()}
    assert got[1] == (2.0, 200.0, 20.0, 9.0, 189.0)
    uri = "data:image/png;base64,AAEC"
    df = spark.createDataFrame([(f'[{{"image":"{uri}","n":1}},5]',), ("[]",), ("broken",), (None,)], "j string")
    out = [r[0] for r in df.select(sinks.refs_for_images(F.col("j"))).collect()]
    digest = __import__("hashlib").sha256(bytes([0, 1, 2])).hexdigest()
    assert out == [f'[{{"image":"{digest}","n":1}},5]', "[]", "broken", None]
    card = spark.createDataFrame([("A", 1.0)], "code string, avg_cost double")
    kept, refused = sinks.appended_cards(card, spark.createDataFrame([(" b ", 2.0), ("a", 3.0), ("", 1.0), ("c", 0.0), ("b", 5.0)], "code string, avg_cost double"))
    assert rows(kept, "code", "avg_cost") == [("A", 1.0), ("B", 2.0)] and rows(refused, "code", "reason") == [("", "no code"), ("A", "code exists"), ("C", "no cost")]
    assert rows(sinks.backfilled(card, code=F.lit("z"), usage=F.lit("u")), "code", "usage") == [("A", "u")]


def test_rate_card(spark, tmp_path):
    (tmp_path / "card.csv").write_text("﻿Category,Item Code,Description / Specification,Unit,Price Range (AED),Avg. Cost (AED),Typical Usage\nWood,wd-1,MDF,Sheet,58.00 – 72.00,65,walls\nWood,wd-2,Ply,Sheet,\"1,100 – 1,400\",,x\nWood,wd-3,None,Sheet,,,x\nWood,WD-1,MDF new,Sheet,,70,walls\n", encoding="utf-8")
    got = {r["code"]: (r["description"], float(r["avg_cost"])) for r in readers.rate_card(spark, f"{tmp_path}/card.csv").collect()}
    assert got == {"WD-1": ("MDF new", 70.0), "WD-2": ("Ply", 1250.0)}


def test_scan_folder(spark, tmp_path):
    for name in ("a.xlsx", "sub/b.PDF", "Old/c.docx", "~$a.xlsx", "x_Quotation_20250101_1200.xlsx", "n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files, skipped = readers.scan_folder(spark, str(tmp_path), ["old"])
    assert rows(files, "name") == [("a.xlsx",), ("b.PDF",)]
    assert rows(skipped, "reason", "n") == [("excluded folder", 1), ("other type", 1), ("own output", 1), ("temporary", 1)]


def test_config(tmp_path):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class C:
        rate: float = 1.0
        name: str = "x"

    (tmp_path / "c.json").write_text('{"rate": 5, "name": 3, "other": 1}')
    assert readers.config(str(tmp_path / "c.json"), C()) == C(5.0, "x")
    assert readers.config(str(tmp_path / "none.json"), C()) == C()


def test_publish_swaps_and_refuses(spark, tmp_path):
    root = f"{tmp_path}/t"
    sinks.publish(spark.range(3).toDF("id"), root, 3)
    sinks.publish(spark.range(5).toDF("id"), root)
    with pytest.raises(ValueError):
        sinks.publish(spark.range(7).toDF("id"), root, 8)
    assert sinks.published(spark, root).count() == 5


def test_blobs(spark):
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),), (None,)], "bytes binary")
    stored = sinks.blobs(df)
    assert stored.count() == 2
    live = stored.select("ref").limit(1)
    assert sinks.orphan_blobs(stored, [live, live]).count() == 1
    with pytest.raises(ValueError):
        sinks.orphan_blobs(stored, [live.limit(0)])


def test_upsert_stream_survives_a_crash_before_its_pointer(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import buckets

    spark.createDataFrame([(k, 1, f"a{k}") for k in range(20)], "k int, t int, v string").write.parquet(f"{tmp_path}/in")
    run = lambda: pipelines.upsert_stream(pipelines.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", ["k"], ["t"], 4)
    assert run().count() == 20
    spark.createDataFrame([(3, 2, "new"), (99, 1, "z")], "k int, t int, v string").write.mode("append").parquet(f"{tmp_path}/in")
    real = buckets.point
    monkeypatch.setattr(buckets, "point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run()
    assert pipelines.BucketStore(spark, f"{tmp_path}/out", {"rows": "k int, t int, v string"}).read("rows").count() == 20
    monkeypatch.setattr(buckets, "point", real)
    got = {r["k"]: r["v"] for r in run().collect()}
    assert len(got) == 21 and got[3] == "new" and got[4] == "a4" and got[99] == "z"
    __import__("shutil").rmtree(f"{tmp_path}/out/_pointers")
    spark.createDataFrame([(5, 2, "later")], "k int, t int, v string").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="nothing was ever committed"):
        run()


def test_upsert_stream_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string").repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        got = pipelines.upsert_stream(pipelines.file_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", ["k"], ["t"])
        assert rows(got, "k", "v") == [(1, "b"), (2, "c")]


def test_session_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(100)), (2, at(0)), (3, at(900))], "user_id int, ts timestamp").write.parquet(f"{tmp_path}/e")
    got = pipelines.sessions(pipelines.file_stream(spark, f"{tmp_path}/e"))
    assert rows(got, "user_id", "n") == [(1, 1), (1, 2), (2, 1)]


def test_pages_are_imported_once_and_reconciled(spark, tmp_path):
    schema = "file string, page int, page_kind string, element int, label string, length_m double, height_m double, depth_m double"
    put = lambda rs: spark.createDataFrame(rs, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: pipelines.import_pages(pipelines.file_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/state")
    put([("f", 1, "flat", 1, "Tower", 0.0, 2.0, 0.0), ("f", 2, "flat", 1, "tower", 1.0, 2.0, 0.5)])
    assert run().read("elements").count() == 2
    put([("f", 1, "flat", 1, "Tower", 0.0, 3.0, 0.0), ("g", 1, "flat", 1, None, 1.0, 1.0, 1.0)])
    got = {(r["file"], r["page"]): (r["length_m"], r["height_m"]) for r in pipelines.finish_import(run()).collect()}
    assert got == {("f", 1): (1.0, 3.0), ("f", 2): (1.0, 2.0), ("g", 1): (1.0, 1.0)}


def test_corrections_replay_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a.xlsx", "Stage", 100.0, "Pcs", "X", "low", "low", True, "r"), ("b.xlsx", "Desk", 5.0, "Pcs", "Y", "low", "low", True, "r")], ITEM).write.parquet(f"{tmp_path}/items")
    fixes = spark.createDataFrame([("a.xlsx", "stage", 250.0, None, None, ["rate"])], FIX)
    got = pipelines.corrected_stream(pipelines.file_stream(spark, f"{tmp_path}/items"), fixes)
    assert rows(got, "file_name", "historical_rate", "needs_review") == [("a.xlsx", 250.0, False), ("b.xlsx", 5.0, True)]


def test_rate_card_is_read_again_when_its_file_changes(spark, tmp_path):
    path = tmp_path / "card.csv"
    path.write_text("Item Code,Avg Cost\nA,1\n")
    held = readers.fresh_rate_card(spark, str(path))
    assert readers.fresh_rate_card(spark, str(path), held) is held
    path.write_text("Item Code,Avg Cost\nA,1\nB,2\n")
    __import__("os").utime(path, (1, 1))
    assert readers.fresh_rate_card(spark, str(path), held)[1].count() == 2


# ---- ledgers -------------------------------------------------------------------------------------------------------------------
def test_identities(spark):
    from ledgerloom.operators import ledgers

    known = spark.createDataFrame([("c1", "acme", "111"), ("c2", "bolt", ""), ("c3", "twin", "1"), ("c4", "twin", "2")], "identity string, name_key string, phone_key string")
    asked = [(1, "acme", "111"), (2, "acme", ""), (3, "bolt", ""), (4, "bolt", "9"), (5, "twin", ""), (6, "new", ""), (7, "new", ""), (8, "fresh", "5"), (9, "fresh", ""), (10, "", "7"), (11, None, None)]
    got = ledgers.resolve_identities(spark.createDataFrame(asked, "id int, n string, p string"), known, F.coalesce("n", F.lit("")), F.col("p"), "id")
    assert {r["id"]: (r["identity"], r["is_new"]) for r in got.collect()} == {1: ("c1", False), 2: ("c1", False), 3: ("c2", False), 4: ("new-4", True), 5: ("new-5", True), 6: ("new-6", True), 7: ("new-6", True), 8: ("new-8", True), 9: ("new-8", True), 10: (None, None), 11: (None, None)}


def test_lookups_totals_and_views_of_odd_rows(spark):
    from ledgerloom.operators import ledgers

    r = spark.createDataFrame([(1, "a", "g"), (2, "zz", "g"), (3, None, None), (4, " B ", "h")], "id int, code string, grp string")
    card = spark.createDataFrame([("A", 1.0), ("a ", 0.5), ("b", 2.0), (None, 9.0)], "code string, cost double")
    found, missed = ledgers.looked_up(r, card, "code", ["cost"])
    assert rows(found, "id", "cost") == [(1, 0.5), (4, 2.0)] and rows(missed, "id") == [(2,), (3,)]
    assert {r_["grp"]: (r_["misses"], r_["ok"]) for r_ in ledgers.blocked_groups(r, missed, "grp").filter("grp is not null").collect()} == {"g": (1, False), "h": (0, True)}
    totals = ledgers.left_totals(r, spark.createDataFrame([(1, 5.0), (1, None), (None, 3.0)], "id int, amount double"), "id", "id", {"spent": F.col("amount")})
    assert rows(totals, "id", "entries", "spent")[:2] == [(1, 2, 5.0), (2, 0, 0.0)]
    day = lambda x: F.lit(x).cast("date")
    docs = spark.createDataFrame([(1, 10.0, 0.0, "2024-01-01", None), (2, 10.0, 10.0, "2024-01-01", "Sent"), (3, None, None, None, "Sent"), (4, 10.0, 4.0, "2024-01-01", "Cancelled"), (5, 10.0, 4.0, "2024-03-01", "Sent")], "id int, total double, paid double, due string, status string").withColumn("due_date", F.col("due").cast("date"))
    states = ledgers.owed(docs, day("2024-02-15"))
    assert rows(states, "id", "payment_state", "is_overdue", "days_overdue") == [(1, "Unpaid", True, 45), (2, "Paid", False, 0), (3, "Unpaid", False, 0), (4, "Partial", False, 0), (5, "Partial", False, 0)]
    assert rows(ledgers.aging(states), "bucket", "balance", "outstanding") == [("31_60", 10.0, 16.0), ("current", 6.0, 16.0)]
    assert [ledgers.aging(states.limit(0)).count(), ledgers.view(r, [F.col("id")], 0).count()] == [0, 0]
    near = spark.createDataFrame([("2024-02-01", None), (None, "2024-02-20"), (None, None), ("2024-04-01", "2024-04-02")], "s string, e string").select(F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    assert [x[0] for x in near.select(ledgers.coming(F.col("s"), F.col("e"), day("2024-02-15"), 30)).collect()] == [False, True, False, False]
    assert [x[0] for x in near.select(ledgers.trailing(F.col("s"), day("2024-02-15"), 20)).collect()] == [True, False, False, True]


def test_pooling_search_and_stale_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0], 1), (1, [0.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, 1.0], None)], "k int, v array<float>, m int")
    got = {r["k"]: [round(x, 6) for x in r["pooled"]] for r in similarity.mean_pool(df, ["k"], "v", "m").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    lib = spark.createDataFrame([(1, [1.0, 0.0], 100.0, "2024-01-01"), (2, [0.0, 1.0], 50.0, None)], "vec_id bigint, embedding array<float>, rate double, quote_date string")
    ask = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    found = similarity.search(ask, lib, F.lit("2025-12-31").cast("date"), 0.1, 2)
    assert [(r["id"], r["similarity"], r["adjusted_rate"]) for r in found.orderBy("rank").collect()] == [(1, 100.0, round(100 * 1.1 ** (730 / 365.25), 2)), (2, 0.0, 50.0)]
    items = spark.createDataFrame([(1, "t1"), (2, None), (3, "t3")], "id int, updated_at string")
    stored = spark.createDataFrame([(1, "t1"), (2, None), (3, "old"), (4, "x")], "id int, updated_at string")
    kept, stale = similarity.stale_vectors(items, stored)
    assert rows(kept, "id") == [(1,), (2,)] and rows(stale, "id") == [(3,)]
    rung = similarity.semantic_rung(ask.withColumnRenamed("vec_id", "line_id"), lib.select("vec_id", "embedding"), spark.createDataFrame([], "line_id bigint"))
    assert rows(rung, "line_id", "id", "rung") == [(9, 1, 4)]


# ---- drawings ------------------------------------------------------------------------------------------------------------------
def test_attach_measure_cluster(spark):
    pages = spark.createDataFrame([("f", 1, 600.0, 400.0)], "file string, page int, width_px double, height_px double")
    lines = [(60, 320, 170, 320), (60, 80, 60, 320), (360, 320, 485, 320), (485, 90, 485, 320), (100, 5, 101, 6)]
    segs = drawings.segments(spark.createDataFrame([("f", 1, i, *map(float, s)) for i, s in enumerate(lines)], "file string, page int, seg_id int, x0 double, y0 double, x1 double, y1 double"))
    tokens = [(0, "110.0 cm", 1.1, 100, 325, 130, 335), (1, "240.0 cm", 2.4, 30, 190, 58, 210), (2, "125.0 cm", 1.25, 410, 325, 440, 335), (3, "230.0 cm", 2.3, 488, 190, 510, 210), (4, "9 m", 9.0, 250, 10, 260, 20)]
    toks = spark.createDataFrame([("f", 1, t[0], t[1], t[2], *map(float, t[3:])) for t in tokens], "file string, page int, token_id int, text string, metres double, x0 double, y0 double, x1 double, y1 double")
    spans, loose = drawings.attach(toks, segs, pages)
    assert rows(loose, "token_id") == [(4,)]
    assert rows(spans, "token_id", "axis", "px_per_m") == [(0, "h", 100.0), (1, "v", 100.0), (2, "h", 100.0), (3, "v", 100.0)]
    assert rows(drawings.page_scale(spans), "scale") == [(100.0,)]
    got = drawings.elements(drawings.cluster_spans(spans))
    assert sorted((r["length_m"], r["height_m"]) for r in got.collect()) == [(1.1, 2.4), (1.25, 2.3)]


def test_merge_parallel_and_islands(spark):
    segs = spark.createDataFrame([("f", 1, "h", 0.0, 10.0, 50.0, 10.0), ("f", 1, "h", 48.0, 11.0, 90.0, 11.0), ("f", 1, "h", 200.0, 10.0, 250.0, 10.0), ("f", 1, "v", 5.0, 0.0, 5.0, 9.0)], "file string, page int, axis string, x0 double, y0 double, x1 double, y1 double")
    assert rows(drawings.merge_parallel(segs), "axis", "length") == [("h", 50.0), ("h", 90.0), ("v", 9.0)]
    dark = spark.createDataFrame([("f", 1, 3, x) for x in [*range(0, 10), *range(14, 25), *range(60, 64)]], "file string, page int, y int, x int")
    assert rows(drawings.islands(dark), "x0", "x1") == [(0, 24)]


def test_classify_pages(spark):
    pages = spark.createDataFrame([("f", 1, 100.0, 100.0), ("f", 2, 100.0, 100.0)], "file string, page int, width_px double, height_px double")
    flat = [("f", 1, 20.0, 10.0 + 5 * i, 60.0, 10.0 + 5 * i) for i in range(9)]
    steep = [("f", 2, 20.0, 10.0 + i, 60.0, 50.0 + i) for i in range(9)]
    segs = drawings.segments(spark.createDataFrame(flat + steep, "file string, page int, x0 double, y0 double, x1 double, y1 double"))
    assert rows(drawings.classify_pages(segs, pages), "page", "kind") == [(1, "flat"), (2, "perspective")]


def test_suppress_overlaps_and_images(spark):
    toks = spark.createDataFrame([("f", 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), ("f", 1, 1, 0.8, 1.0, 1.0, 9.0, 9.0), ("f", 1, 2, 0.7, 20.0, 0.0, 30.0, 10.0)], "file string, page int, token_id int, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert rows(drawings.suppress_overlaps(toks), "token_id") == [(0,), (2,)]
    lines = spark.createDataFrame([("f", 1, 1, 170.0), ("f", 1, 2, 320.0)], "file string, page int, row int, y0 double")
    images = spark.createDataFrame([("f", 1, 0, "a", 190.0, 311.0), ("f", 1, 1, "b", 300.0, 420.0), ("f", 1, 2, "c", 200.0, 300.0)], "file string, page int, image_id int, image_ref string, y0 double, y1 double")
    assert rows(drawings.images_to_rows(lines, images), "row", "image_ref") == [(1, "a"), (2, "b")]


def test_overlap_rounds_follow_the_surest(spark):
    boxes = [(0, 0.9, 0.0), (1, 0.8, 4.0), (2, 0.7, 8.0), (3, 0.6, 12.0), (4, 0.6, 40.0)]  # each overlaps the next by more than half
    toks = spark.createDataFrame([("f", 1, i, c, x, 0.0, x + 10, 10.0) for i, c, x in boxes], "file string, page int, token_id int, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert rows(drawings.suppress_overlaps(toks), "token_id") == [(0,), (2,), (4,)]
    assert drawings.suppress_overlaps(toks.limit(0)).count() == 0


def test_groups_grow_with_their_boxes(spark):
    at = [(0, 0.0, 0.0, 100.0, 10.0), (1, 105.0, 0.0, 110.0, 100.0), (2, 112.0, 90.0, 300.0, 95.0), (3, 900.0, 900.0, 910.0, 910.0)]
    spans = spark.createDataFrame([("f", p, i, *b) for p in (1, 2) for i, *b in at], "file string, page int, token_id int, x0 double, y0 double, x1 double, y1 double")
    assert rows(drawings.cluster_spans(spans), "page", "token_id", "cluster") == [(p, i, int(i == 3)) for p in (1, 2) for i in range(4)]
    assert drawings.cluster_spans(spans.limit(0)).count() == 0


def test_labels_shapes_order_and_titles(spark):
    box = spark.createDataFrame([("f", 1, 0, 0.0, 0.0, 100.0, 100.0, 50.0), ("f", 1, 1, 500.0, 0.0, 600.0, 50.0, 50.0)], "file string, page int, cluster int, x0 double, y0 double, x1 double, y1 double, px_per_m double")
    toks = spark.createDataFrame([("f", 1, 0, "SCALE 1:50", 40.0, 40.0, 60.0, 60.0, 9.0), ("f", 1, 1, "2400 mm", 45.0, 45.0, 55.0, 55.0, 9.0), ("f", 1, 2, "Feature wall", 45.0, 120.0, 55.0, 130.0, 10.0), ("f", 1, 3, "Counter A", 540.0, 60.0, 560.0, 70.0, 8.0), ("f", 1, 4, "Big notes", 0.0, 300.0, 9.0, 310.0, 20.0)], "file string, page int, token_id int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert rows(drawings.cluster_labels(box, toks), "cluster", "label") == [(0, "Feature wall"), (1, "Counter A")]
    arcs = spark.createDataFrame([("f", 1, 80.0, 20.0, 10.0, 10.0, 90.0, 30.0), ("f", 1, 30.0, 9.0, 10.0, 10.0, 40.0, 19.0), ("f", 1, 90.0, 0.5, 505.0, 1.0, 595.0, 2.0)], "file string, page int, chord double, rise double, x0 double, y0 double, x1 double, y1 double")
    assert rows(drawings.cluster_shapes(box, arcs), "cluster", "shape", "sagitta_m") == [(0, "curved", 0.4), (1, "flat", 0.0)]
    assert [r["token_id"] for r in drawings.reading_order(toks).orderBy("place").collect()] == [0, 1, 3, 2, 4]
    assert rows(drawings.page_titles(toks), "title") == [("Feature wall",)]


def test_reconcile(spark):
    e = spark.createDataFrame([("f", 1, "perspective", 1, "Display Tower", 0.0, 2.4, 0.0), ("f", 2, "flat", 1, "display  tower", 1.1, 2.41, 0.6), ("f", 3, "flat", 1, "Other", 1.0, 1.0, 1.0), ("f", 3, "flat", 2, None, 1.0, 1.0, 1.0)], "file string, page int, page_kind string, element int, label string, length_m double, height_m double, depth_m double")
    got = {(r["page"], r["element"]): r for r in drawings.reconcile(e).collect()}
    assert (got[1, 1]["length_m"], got[1, 1]["depth_m"], got[1, 1]["filled"]) == (1.1, 0.6, ["length_m", "depth_m"])
    assert got[2, 1]["duplicate_of"]["page"] == 1 and not got[2, 1]["include"]
    assert got[3, 1]["include"] and got[3, 2]["include"] and got[3, 2]["duplicate_of"] is None


def test_entry_and_queries(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and all(itertools.starmap(lambda k, f: callable(f), names.items()))
