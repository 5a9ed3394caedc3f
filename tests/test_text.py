"""Cleaning and narratives, against pairs written by hand and a check sign by sign."""

import pytest
from pyspark.sql import functions as F

from caseloom.config import ABBREVIATIONS, EMPTY_NARRATIVE
from caseloom.functions.text import clean_text, expand_frequency, narrative, tokens, words
from caseloom.operators.features import with_narrative
from conftest import SMALL


# Letters that equal I or S when case is ignored.
LOOKALIKES = str.maketrans("ıİſ", "IIS")


def expected_clean(text):
    """Character by character: runs of letters and digits are looked up, other signs kept or blanked."""
    out, run = [], ""
    for sign in (text or "") + " ":
        if sign.isalnum() or sign == "_":
            run += sign
            continue
        out.append(ABBREVIATIONS.get(run.translate(LOOKALIKES).upper(), run))
        out.append(sign if sign in "-.,()" else " ")
        run = ""
    return " ".join("".join(out).split()).lower()


def cleaned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["t"] for r in rows.select("id", clean_text(F.col("text")).alias("t")).orderBy("id").collect()]


def test_expands_abbreviations(spark):
    pairs = {
        "5mg po BID, im if needed": "5mg oral twice daily, intramuscular if needed",
        "CP/HA since Monday": "chest pain headache since monday",
        "Sc dose (tid) PRN.": "subcutaneous dose (three times daily) as needed.",
        "QUID pro QUO; POs": "quid pro quo pos",
    }
    assert cleaned(spark, list(pairs)) == list(pairs.values())


def test_blank_text_is_empty(spark):
    assert cleaned(spark, ["", None, " \t\n"]) == ["", "", ""]


@pytest.mark.parametrize("text", [
    "iv IV Iv,IV;PO", "QIDs and _QD_ stay", "éIV IVé über-PRN", "a b c\x1cd　e", "½ ² x_y 漢字 हिन्दी",
    "dose (5 mg), 2.5-3 / day!", "HA\nCP\r\nSC", "$IV$ #PO# 'QD'", "BID TID QID BID",
])
def test_sign_by_sign(spark, text):
    assert cleaned(spark, [text]) == [expected_clean(text)]


def test_sign_by_sign_on_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", clean_text(F.col("text")).alias("t"))
    assert [r["t"] for r in documents.collect() if r["t"] != expected_clean(r["text"])] == []


def test_narrative_parts(spark, two_reports):
    first = with_narrative(two_reports).orderBy("primaryid").first()["narrative"]
    assert first == "drug warfarin. route subcutaneous. active ingredient warfarin sodium. reactions bleeding nose"


def test_narrative_skips_null_keeps_empty(spark):
    rows = spark.createDataFrame([(1, "A", None, "", "x | y"), (2, None, None, None, None)],
                                 "id int, d string, r string, p string, x string")
    told = rows.select("id", narrative(*[F.col(c) for c in "drpx"]).alias("n")).orderBy("id").collect()
    assert told[0]["n"] == "drug a. active ingredient . reactions x y"
    assert told[1]["n"] == EMPTY_NARRATIVE


def test_narrative_without_columns(spark):
    assert with_narrative(spark.range(1)).first()["narrative"] == EMPTY_NARRATIVE


def test_words_and_tokens(spark):
    rows = spark.createDataFrame([(1, ""), (2, "a b c")], "id int, t string")
    found = rows.select(F.size(words(F.col("t"))).alias("n"), tokens(F.col("t"), 2).alias("k")).orderBy("n").collect()
    assert [(r["n"], r["k"]) for r in found] == [(0, []), (3, ["a", "b"])]


def test_expand_frequency(spark):
    rows = spark.createDataFrame([(1, "QD"), (2, "weekly"), (3, None)], "id int, f string")
    assert [r["f"] for r in rows.select("id", expand_frequency(F.col("f")).alias("f")).orderBy("id").collect()] \
        == ["once daily", "weekly", None]
