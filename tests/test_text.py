import random

import models
from pyspark.sql import functions as F

from docketry.functions import text

TRICKY = ["", "\n", "a\r\nb\r", "x\x0by\x0cz w\x85", "no end", "end\n\n", "\x1c\x1d\x1e", "é_x ab12 fooBarBaz HTTPServer a1B2"]


def random_texts(n=80):
    rng = random.Random(5)
    return ["".join(rng.choice("aBc1_ -/\n\r\té.Zz(x2") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def one_column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_lines_match_python(spark):
    values = TRICKY + random_texts()
    got = dict(one_column(spark, values).select("i", text.split_lines(F.col("t"))).collect())
    assert [got[i] for i in range(len(values))] == [v.splitlines() for v in values]


def test_tokens_match_model(spark):
    values = TRICKY + random_texts() + ["SAMPLE_APP_FunctionCode_NOOP = 0, camelCase2Go mixed/Case-here"]
    got = dict(one_column(spark, values).select("i", text.tokenize(F.col("t"))).collect())
    assert [got[i] for i in range(len(values))] == [models.tokens(v) for v in values]


def test_joined_form_follows_pieces(spark):
    row = one_column(spark, ["see fooBarBaz now"]).select(text.tokenize(F.col("t"))).first()[0]
    assert row == ["see", "foo", "bar", "baz", "foobarbaz", "now"]


def test_strip_matches_python(spark):
    values = ["  a b \n", " x ", "\x1ca\x1f", "", " \t"]
    got = dict(one_column(spark, values).select("i", text.strip(F.col("t"))).collect())
    assert [got[i] for i in range(len(values))] == [v.strip() for v in values]


def test_query_identifiers_keep_user_order_and_drop_plain_words(spark):
    df = spark.createDataFrame([(["B_ID", "A"], "", "sub", "plain SAMPLE_APP getTlm x9y B_ID ab 9abc éabc_d")],
                               "ids array<string>, title string, subsystem string, t string")
    got = df.select(text.query_identifiers(F.col("ids"), F.col("title"), F.col("subsystem"), F.col("t"))).first()[0]
    assert got == ["B_ID", "A", "SAMPLE_APP", "getTlm", "x9y"]


def test_canonical_hash_equals_python_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("é\n\"q\"", ["a", "b"])], "t string, l array<string>")
    got = df.select(text.canonical_sha(query_text=F.col("t"), extracted=F.col("l"))).first()[0]
    want = json.dumps({"query_text": "é\n\"q\"", "extracted": ["a", "b"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(want.encode()).hexdigest()
