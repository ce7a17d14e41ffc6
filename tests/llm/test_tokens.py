import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.counting import encoding, n_tokens
from ledgerloom.llm.token_queries import p6_ids, p6_roundtrip
from ledgerloom.llm.tokens import Encoder, common_words, encode, words

ODD = ["", " ", None, "Hello world", "it's we'll I'd 'S", "a b  c　", "x\u0085y  z", "   spaces   before", "tabs\t\t\n\r\n end  ", "العرض التركيب والفك", "ग्राहक ने पास कर दिया", "é é ﬁ", "😀👩‍👩‍👧 🇦🇪", "½ ²³ Ⅳ 12345 ١٢٣", "=" * 3000, "ab" * 2000, "\x00\x01\x1c\x1d a", "don't can't ''' '", "a" * 5000 + " " * 500 + "b", "日本語テキスト", "-- __init__(self): # 100%"]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode(df.drop("ids")).collect()}
    want = {i: encoding().encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert got == want


def test_odd_texts(spark):
    check(spark, ODD)


def test_random_texts(spark):
    rng = random.Random(4)
    pieces = [" ", "  ", "\n", "a", "the", "'s", "é", "ع", "क", "ा", "1", "₹", "😀", " ", "\t", "Zz", "'"]
    check(spark, ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)])


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn", "Co")), max_size=30), max_size=30))
def test_round_trip(spark, texts):
    df = encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    got = {r["doc_id"]: bytes(r["b"]).decode() for r in Encoder(spark).with_bytes(df, "ids", "b").collect()}
    assert got == dict(enumerate(texts))


@pytest.mark.parametrize("most", [1, 3])
def test_dictionary_is_bounded_and_does_not_change_ids(spark, most):
    texts = ["a b c a b a", "d e f g h a", "a" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert common_words(df, most).count() <= most
    got = {r["doc_id"]: list(r["ids"]) for r in encode(df, most=most).collect()}
    assert got == {i: encoding().encode_ordinary(t) for i, t in enumerate(texts)}


def test_words_join_to_the_text(spark):
    texts = [t for t in ODD if t]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_join(words(F.col("t")), "")).collect()
    assert [r[0] for r in got] == texts


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode(df).count() == 0


def test_counts(spark):
    got = spark.createDataFrame([(t,) for t in ODD], "t string").select(n_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(encoding().encode_ordinary(t)) if t else 0 for t in ODD]


def test_queries(spark, data):
    assert p6_ids(spark, data).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert p6_roundtrip(spark, data).filter("not same").count() == 0
