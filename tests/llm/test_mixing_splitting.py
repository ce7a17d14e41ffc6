import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as M
from ledgerloom.llm import splitting as S
from ledgerloom.llm.counting import encoding

DOC = "doc_id bigint, text string, source string, copies int"


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(rng.randint(1, 12))), rng.choice(["a", "A ", "b", "B", "c", None, "other"]), 7) for i in range(n)]
    return rows + [(n + 1, None, "a", 7), (n + 2, "", "b", 7), (n + 3, rows[0][1], "a", 7), (n + 4, rows[0][1], "b", 7)]


WEIGHTS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 9), ("missing", 0.1, 2)]


def weights(spark, rows=WEIGHTS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_meets_shares_and_repeats(spark):
    rows = docs(spark)
    drawn, report = (x.collect() for x in M.mix(spark.createDataFrame(rows, DOC), weights(spark)))
    texts = {i: t for i, t, *_ in rows}
    most = {"a": 1, "b": 3, "c": 9}
    assert all(0 < r["copies"] <= most[r["source"]] for r in drawn)
    assert len({texts[r["doc_id"]] for r in drawn}) == len(drawn)  # no text twice, whatever its sources
    assert all(r["n_tokens"] == len(encoding().encode_ordinary(texts[r["doc_id"]])) for r in drawn)
    shares = {r["source"]: r for r in report}
    total = sum(r["copies"] * r["n_tokens"] for r in drawn)
    largest = max(len(encoding().encode_ordinary(t)) for t in texts.values() if t)
    for s in "abc":
        own = sum(r["copies"] * r["n_tokens"] for r in drawn if r["source"] == s)
        assert own == shares[s]["tokens_drawn"] and abs(own - shares[s]["effective_share"] * total) <= 3 * largest
    assert shares["missing"]["tokens_drawn"] == 0 and abs(sum(shares[s]["effective_share"] for s in "abc") - 1) < 1e-9


def test_thresholds_against_sorting(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.randrange(1 << 63), rng.randint(1, 50)) for i in range(500) for s in "xy"]
    df = spark.createDataFrame(rows, "source string, doc_id bigint, h bigint, n_tokens int")
    for budget in (0, 1, 777, 5000, 10**9):
        low = M.thresholds(df, {"x": budget, "y": budget / 2})
        for s, b in (("x", budget), ("y", budget / 2)):
            total, best = 0, 0
            for _, _, _, n in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
                if total + n > b:
                    best = total + n if total + n - b < b - total else total
                    break
                total += n
                best = total
            assert sum(r[3] for r in rows if r[0] == s and r[2] < low[s]) == best


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert M.mix(empty, weights(spark))[0].count() == 0
    assert M.mix(spark.createDataFrame(docs(spark, 20), DOC), weights(spark, []))[0].count() == 0


def test_too_large_a_mix_is_capped(spark):
    drawn, _ = M.mix(spark.createDataFrame(docs(spark, 60), DOC), weights(spark), total=10**9)
    assert {r["source"]: r["c"] for r in drawn.groupBy("source").agg(F.min("copies").alias("c")).collect()} == {"a": 1, "b": 3, "c": 9}


TEXTS = ["", None, "short", "word " * 1100, "a" * 9000, "Sentence one is here. " * 400, "line of text\n" * 500, "para graph text.\n\n" * 600, "العرض التركيب والفك. " * 300, "😀" * 900, "x\r\ny\r\n\r\n" * 900, "".join(chr(0x4E00 + i % 4000) for i in range(3000))]


@pytest.mark.parametrize("limit, overlap", [(1024, 64), (100, 10), (64, 0)])
def test_pieces(spark, limit, overlap):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, piece_no string")
    rows = S.pieces(df, limit, overlap, limit // 8).orderBy("doc_id", "piece_no").collect()
    for i, t in enumerate(TEXTS):
        own = [r for r in rows if r["doc_id"] == i]
        ids = encoding().encode_ordinary(t or "")
        assert bool(own) == (len(ids) > limit)
        if not own:
            continue
        assert own[0]["start_token"] == 0 and own[-1]["end_token"] == len(ids) and all(r["n_tokens"] <= limit for r in own)
        assert len(own) >= -(-(len(ids) - overlap) // (limit - overlap)) and [r["n_pieces"] for r in own] == [len(own)] * len(own)
        for a, b in zip(own, own[1:]):
            assert overlap <= a["end_token"] - b["start_token"] <= overlap + 3
        assert all(encoding().decode_bytes(ids[r["start_token"] : r["end_token"]]).decode() == r["text"] for r in own)


def test_cuts_take_the_strongest_boundary():
    strength = np.zeros(300, dtype=np.int8)
    strength[[140, 155]] = 2
    strength[160] = 4
    assert S.cuts(strength, 200, 0, 20) == [(0, 161), (161, 300)]


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        S.pieces(spark.createDataFrame([], "doc_id bigint, text string"), 100, 60)
    assert S.pieces(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
