"""Drawing a mix of sources at target weights, without sorting.

Every distinct text has a hash and belongs to one source (that of its lowest doc_id among the listed sources), so that a
text standing on several rows is not repeated unnoticed. Per source the budget is its share of the mix; as many whole
rounds of its texts as fit are taken, and of the last round the texts whose hash lies under a threshold. The thresholds
come from histograms: tokens by source and the hash's leading bits, then, in the one bucket where the budget ends, by
the next bits, until that bucket holds one text. The draw is then a filter on the hash.

The mix is the largest in which every present source can have its share within its repeats, or a given size. Shares of
listed sources without any text are spread over the present ones in proportion and reported as effective_share.

Edge cases: null and empty texts and texts of unlisted sources are not drawn; source names match whatever their case and
surrounding spaces; equal hashes of different texts stay together; with no weights or no texts the mix is empty; where a
given size exceeds a source's repeats, the source gives all it may and the report shows the lower share.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.counting import n_tokens
from ledgerloom.llm.tokens import VOCABULARY
from ledgerloom.runtime import materialize, scratch

BITS, LEVEL = 63, 12  # of the hash, and of each histogram: a level has 4096 buckets per source


def _name(column: str):
    return F.lower(F.trim(F.col(column)))


def texts_by_source(documents: DataFrame, weights: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """source, doc_id, h, n_tokens of every distinct text of a listed source."""
    listed = weights.select(_name("source").alias("source")).distinct()
    rows = documents.select("doc_id", "text", _name("source").alias("source")).filter("text <> ''").join(F.broadcast(listed), "source", "left_semi")
    sized = rows.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), n_tokens(F.col("text"), path).alias("n_tokens"))
    one = sized.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d"))
    return materialize(one.select("d.source", "d.doc_id", F.shiftrightunsigned(F.xxhash64("digest"), 1).alias("h"), "d.n_tokens"), "mix-texts")


def thresholds(texts: DataFrame, budgets: dict[str, float]) -> dict[str, int]:
    """Per source the hash below which its texts, taken by rising hash, come nearest to its budget in tokens."""
    spark = texts.sparkSession
    found: dict[str, int] = {s: 0 for s in budgets}  # lower end of the boundary bucket
    left = dict(budgets)
    open_ = set(budgets)
    for shift in range(BITS - LEVEL, -LEVEL, -LEVEL):
        if not open_:
            break
        shift = max(shift, 0)
        above = shift + LEVEL
        edge = spark.createDataFrame([(s, found[s]) for s in sorted(open_)], "source string, low bigint")
        inside = texts.join(F.broadcast(edge), "source").filter((F.shiftrightunsigned("h", above) == F.shiftrightunsigned("low", above)) & (F.col("h") >= F.col("low")) if above < BITS else F.lit(True))
        rows = inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("b")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
        buckets = defaultdict(list)
        for r in rows:
            buckets[r["source"]].append((r["b"], r["tokens"], r["n"]))
        for s in sorted(open_):
            for b, tokens, n in sorted(buckets[s]):
                if tokens > left[s]:
                    found[s] = b << shift
                    if n == 1 or shift == 0:
                        open_.discard(s)
                        if tokens - left[s] < left[s]:  # the draw comes nearer to its budget with the last text than without
                            found[s] = (b + 1) << shift
                    break
                left[s] -= tokens
            else:
                found[s] = ((found[s] >> above) + 1) << above if above < BITS else 1 << BITS
                open_.discard(s)
    return found


def mix(documents: DataFrame, weights: DataFrame, total: int | None = None, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn, report): drawn has doc_id, source, copies, n_tokens; report has a row per listed source."""
    spark = documents.sparkSession
    with scratch(spark) as keep:
        texts = texts_by_source(documents, weights, path)
        held = {r["source"]: r["t"] for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row per listed source
        listed = {r["source"]: (r["share"], r["most"]) for r in weights.groupBy(_name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).collect() if r["source"] is not None}
        present = {s: v for s, v in listed.items() if held.get(s) and (v[0] or 0) > 0 and (v[1] or 0) > 0}
        sum_shares = sum(v[0] for v in present.values())
        share = {s: v[0] / sum_shares for s, v in present.items()}
        size = total if total is not None else min((present[s][1] * held[s] / share[s] for s in present), default=0)
        full, budget = {}, {}
        for s in sorted(present):
            want = size * share[s] + 1e-6  # a budget of exactly whole rounds must not miss its last text by rounding
            full[s] = min(present[s][1], int(want // held[s]))
            budget[s] = want - full[s] * held[s] if full[s] < present[s][1] else 0.0
        low = thresholds(texts, budget)
        plan = spark.createDataFrame([(s, full[s], low[s] if low[s] < 1 << BITS else -1) for s in sorted(present)], "source string, full int, low bigint")
        copies = F.col("full") + F.when((F.col("low") < 0) | (F.col("h") < F.col("low")), 1).otherwise(0)
        drawn = texts.join(F.broadcast(plan), "source").select("doc_id", "source", copies.alias("copies"), "n_tokens").filter("copies > 0")
        drawn = keep(drawn, "mix-drawn")
        names = spark.createDataFrame([(s, v[0], v[1], share.get(s, 0.0), held.get(s, 0)) for s, v in sorted(listed.items())], "source string, target_share double, max_repeats int, effective_share double, tokens_held bigint")
        sums = drawn.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"), F.max("copies").alias("copies"))
        whole = drawn.agg(F.sum(F.col("copies") * F.col("n_tokens"))).scalar()
        report = names.join(F.broadcast(sums), "source", "left").select(  # both have a row per listed source
            "source", "target_share", "effective_share", "max_repeats", "tokens_held", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_texts", "copies", "tokens_drawn")), (F.coalesce(F.col("tokens_drawn"), F.lit(0)) / whole).alias("actual_share")
        )
        return drawn, keep(report, "mix-report")
