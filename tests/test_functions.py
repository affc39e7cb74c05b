"""Normalisation and association columns on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from tracelake.functions import association, normalize as nz


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f,values,want",
    [
        (nz.clean_text, ["  a \n b ", "", " None", "N/A", None, "nan"], ["a b", None, None, None, None, None]),
        (nz.naics_code, ["54-13 30", "x1", "--", None], ["541330", "X1", None, None]),
        (nz.company_key, ["Acme & Sons, Inc.", "The Co of LLC", "Inc", None, " "], ["ACME SONS", "THE CO OF LLC", "INC", None, None]),
        (nz.identifier_token, ["ab-12/3", "", None], ["AB123", None, None]),
        (nz.contract_family, ["ABCDEF1234P0001", "ABCDEFMOD12", "SHORTP1", "ABCDEFGH"], ["ABCDEF1234", "ABCDEF", None, None]),
        (nz.keyword_pack, ["Pack:Rule", "solo", " a|b:c "], ["pack", "solo", "a/b"]),
        (nz.humanize, ["pack_a:rule_b"], ["pack a: rule b"]),
    ],
)
def test_text_columns(spark, f, values, want):
    assert column(spark, values, f) == want


def test_long_key_tokens_are_hashed(spark):
    got = column(spark, ["a|b", "x" * 121, " "], nz.key_token)
    assert got[0] == "A/B" and got[1].startswith("sha1:") and len(got[1]) == 25 and got[2] is None


def test_dates(spark):
    got = column(spark, ["2024-02-29", "03/01/2024", "20240302", "not-a-date", None, "2018-05-04 12:34:56"], nz.parsed_date)
    assert [str(x) if x else None for x in got] == ["2024-02-29 00:00:00", "2024-03-01 00:00:00", "2024-03-02 00:00:00", None, None, "2018-05-04 12:34:56"]


def signal(spark, total, c1, c2, c12, smoothing):
    return spark.range(1).select(*[c.alias(n) for n, c in association.pair_signal(*map(F.lit, (total, c1, c2, c12)), smoothing).items()]).first().asDict()


def test_pair_signal(spark):
    flat = signal(spark, 3, 3, 3, 3, 0.0)
    assert flat["pmi"] == flat["npmi"] == 0
    s = signal(spark, 100, 10, 20, 8, 0.5)
    a, b, c, d = 8.5, 2.5, 12.5, 78.5
    n = a + b + c + d
    pmi = math.log((a / n) / ((a + b) / n * (a + c) / n))
    assert s["npmi"] == pytest.approx(pmi / -math.log(a / n)) and s["log_odds"] == pytest.approx(math.log(a * d / (b * c)))
    assert s["lift_raw"] == pytest.approx(8 * 100 / 200) and s["expected_count"] == pytest.approx(2)
    assert set(signal(spark, 0, 1, 1, 1, 0.5).values()) == {0.0}


def test_key_texts_equal_their_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from tracelake import registry

    texts = ["", " ", "\t x \t", "None", " n/a ", "x|y", "\u00a0x\u3000", "\u03a3\u03a3 a\u03a3", "\u0130b", "\u0130" * 61, "\u00c9" * 121, " " + "a" * 120 + " ", None]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = {(r["doc_id"], r["token"]) for r in registry.queries()["nrm18_key_tokens"](spark, folder).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert got == set(con.sql(registry.oracle_sql()["nrm18_key_tokens"]).fetchall())
