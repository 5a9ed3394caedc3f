import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from caseloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def two_reports(spark):
    """Two complete reports, one serious."""
    columns = ("primaryid long, drugname string, route string, prod_ai string, reactions string, age int, wt int, "
               "sex string, dose_amt int, dose_freq string, dur int, drug_seq int, dechal string, rechal string, "
               "occr_country string, serious int")
    return spark.createDataFrame([
        (1, "Warfarin", "subcutaneous", "warfarin sodium", "bleeding nose", 71, 88, "M", 5, "twice weekly", 200, 6,
         "yes", "no", "FR", 1),
        (2, "Amlodipine", "oral", "amlodipine besylate", "swollen ankles", 48, 59, "F", 10, "every morning", 40, 3,
         "yes", "no", "FR", 0),
    ], columns)
