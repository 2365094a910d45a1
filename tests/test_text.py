import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiqua.functions import text as X
from lexiqua.functions.lexicons import LANGUAGE_NAMES, recorded_stop_words, stop_words
from lexiqua.operators import features


def values(spark, rows, expr, schema="t string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_tokens_edges(spark):
    rows = ["Hello, World! It's a well-known e.g. thing... end.", None, "", "Été über 3x x3 a.b (tok)", "a.,b", "..word word.."]
    want = [["hello", "world", "a", "thing", "end"], [], [], ["été", "über", "tok"], ["b"], ["word"]]
    assert values(spark, rows, X.tokens(F.col("t"))) == want


def test_tokens_equal_padding_and_splitting(spark, small):
    """The single look-around pattern gives what padding, splitting and filtering gives."""
    padded = F.regexp_replace(F.lower("text"), X.PADDED, " $1 ")
    slow = F.filter(F.split(padded, r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert docs.where(X.tokens(F.col("text")) != slow).count() == 0


def test_stop_words_keep_duplicates_and_unknown_languages(spark):
    df = spark.createDataFrame([("en", ["the", "cat", "cat"]), ("zz", ["the", "cat"])], "lang string, w array<string>")
    kept = X.without_stop_words(F.col("w"), F.col("lang"), stop_words(["en"]))
    assert [r[0] for r in df.select(kept).collect()] == [["cat", "cat"], ["the", "cat"]]


def test_stop_word_lists_equal_those_of_spark(spark):
    for lang in ("de", "en", "es", "fr"):
        assert recorded_stop_words(lang) == stop_words([lang])[lang]
    with pytest.raises(ValueError):
        stop_words(["en", "xx"])


def test_stop_words_do_not_need_the_jar_folder(spark, monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark, "__file__", "/nowhere/pyspark/__init__.py")
    assert "the" in stop_words(["en"])["en"] and "der" in recorded_stop_words("de")


def test_root_ttr(spark):
    df = spark.createDataFrame([([],), (["a", "a", "b", "c"],)], "w array<string>")
    assert [r[0] for r in df.select(X.root_ttr(F.col("w"))).collect()] == [0.0, 1.5]


def python_mask(text, mode="strict"):
    """The same ordered substitutions with another regex engine."""

    def plain(p):
        return p.removeprefix("(?U)")

    def links(t):
        return re.sub(X.MAIL_TRACKER, X.URL_MASK, re.sub(X.TAG, X.URL_MASK, re.sub(plain(X.URL), X.URL_MASK, t)))

    t = links(text) if mode == "clean" else text
    t = re.sub(plain(X.PHONE), X.PHONE_MASK, t)
    t = re.sub(plain(X.EMAIL), lambda m: X.OWN_MASK if m.group().endswith(X.OWN_DOMAIN) else X.OTHER_MASK, t)
    t = re.sub(plain(X.STREET), X.ADDRESS_MASK, t)
    t = links(t) if mode == "strict" else t
    for p in (X.NUMERIC_ADDRESS, X.UNIT_ADDRESS, X.PO_BOX, X.CITY_STATE_ZIP):
        t = re.sub(plain(p), X.ADDRESS_MASK, t)
    return t


PII_TEXTS = [
    "Mail a.b@saascompany.com or c@other.org, not d@saascompany.com.evil.org",
    "Call +1 (555) 123-4567 then see https://x.example/y?z=1 <b>now</b>",
    "PO Box 12, Austin, TX 78701-1234, 12 Main Oak Street. é12 ab cd",
    "12 Rue Dré und 5 mehr Worte; http://a.s.hubspotemail.net/abc 7-9 two words",
    "",
]


@pytest.mark.parametrize("mode", ["strict", "clean"])
def test_masking_equals_other_engine(spark, small, mode):
    docs = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    pages = [r[0] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    texts = PII_TEXTS + docs + pages
    got = values(spark, texts, X.mask_pii(F.col("t"), mode))
    assert got == [python_mask(t, mode) for t in texts]
    assert values(spark, [None], X.mask_pii(F.col("t"), mode)) == [None]


def fold_mtld(seq, threshold=0.72, least=10):
    def one(s):
        factors, seen, n, ttr = 0.0, [], 0, 1.0
        for w in s:
            n += 1
            if w not in seen:
                seen.append(w)
            ttr = len(seen) / n
            if n >= least and ttr < threshold:
                factors, seen, n, ttr = factors + 1, [], 0, 1.0
        if n:
            factors += (1 - ttr) / (1 - threshold)
        return len(s) / factors if factors else 0.0

    return (one(seq) + one(seq[::-1])) / 2


def test_mtld(spark):
    rows = [[], ["a"], ["a"] * 12, list("abcdefghij") * 3, [str(i % 7) for i in range(100)], None]
    got = values(spark, rows, X.mtld(F.col("t")), "t array<string>")
    for row, value in zip(rows, got):
        assert value is None if row is None else value == pytest.approx(fold_mtld(row))


def test_entities_of_unsupported_language(spark):
    df = spark.createDataFrame([("en", "Ann Lee a@b.org"), ("xx", "Ann Lee a@b.org"), ("en", None)], "lang string, t string")
    got = [r[0] for r in df.select(F.size(X.entities(F.col("t"), F.col("lang"), ("en",)))).collect()]
    assert got == [2, 0, 0]


def test_ngrams_of_short_lists(spark):
    assert values(spark, [["a"], ["a", "b", "c"]], X.ngrams(F.col("t"), 2), "t array<string>") == [[], ["a b", "b c"]]


def test_multi_hot_has_no_column_for_null(spark):
    df = spark.createDataFrame([(1, ["a", "a"]), (2, []), (3, None), (4, ["b", None])], "id int, v array<string>")
    out = features.multi_hot(df, "v", "is").orderBy("id")
    assert out.columns == ["id", "is_a", "is_b"]
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]


def test_language_table():
    assert LANGUAGE_NAMES["xxx"] == "unknown" and LANGUAGE_NAMES["de"] == "German"


def test_annotate_hook(spark):
    df = spark.createDataFrame([(1, "en", "a b"), (2, "zz", "c"), (3, "en", "d")], "id int, lang string, t string")

    def loader(lang):
        return (lambda s: [x.split() for x in s]) if lang == "en" else None

    out = features.annotate(df, loader, "t", "lang", "tags", "array<string>")
    assert {r["id"]: list(r["tags"]) for r in out.collect()} == {1: ["a", "b"], 2: [], 3: ["d"]}


def test_score_hook(spark):
    df = spark.range(10)
    out = features.score_batches(df, lambda: lambda b: pd.Series([[float(i)] for i in b["id"]], index=b.index), "p")
    assert all(r["p"] == [float(r["id"])] for r in out.collect())


def test_importance_rollup(spark):
    rows = [("m", "color_red_size", 1.0), ("m", "color_blue", 2.0)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    total = {r["feature"]: r["importance"] for r in features.importance_rollup(df, ["color", "size", "none"]).collect()}
    mean = {r["feature"]: r["importance"] for r in features.importance_rollup(df, ["color", "size", "none"], "average").collect()}
    assert total == {"color": 3.0, "size": 1.0, "none": 0.0} and mean == {"color": 1.5, "size": 1.0, "none": None}


def test_hash_numbers_are_those_of_the_expression(spark):
    from lexiqua.functions.numeric import hash_number, hash_numbers

    starts = ["12345|en|0|", "12345|é|98765|", "|", "x" * 52 + "|", "y" * 70 + "|"]
    places = [0, 9, 10, 99, 100, 12345, 10**6]
    rows = [(s[:-1], i) for s in starts for i in places]
    want = [r[0] for r in spark.createDataFrame(rows, "s string, i long").select(hash_number(F.col("s"), F.col("i"))).collect()]
    assert hash_numbers(starts, np.full(len(starts), len(places)), np.array(places * len(starts))).tolist() == want
    assert hash_numbers([], np.empty(0, int), np.empty(0, int)).tolist() == []
