import pytest
SMALL = "/root/testdata/sf0.001"

# Names the operators use inside, as columns of the input.
CLASHING = ["fp", "position", "weight", "block", "label", "score", "start", "task", "part", "_found", "_row", "component_id",
            "row", "_own_tid", "_mix_weight", "_mix_position", "source_", "phase", "turn", "c0", "tid", "version", "rank", "range", "used", "at"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet").cache()


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty fields, copies, repeated rows, blank and very long texts."""
    words = " ".join(f"word{i * i % 977} and" for i in range(9_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    return [
        (1, passage + " one ending", "en", "a"), (2, "Other start " + passage, "en", "a"), (3, passage + " one ending", "en", "b"),
        (3, passage + " one ending", "en", "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \t\n ", "en", None),
        (7, "two words", None, "a"), (8, words, "en", "c"), (9, words + " more", "en", "c"), (None, "no id at all", "en", "a"),
        (None, passage, None, None), (10, "Ünïcode 漢字 ١٢٣ \u00a0 é " * 30, "xx", "a"), (11, "a" * 60_000, "en", "a"),
        (12, "the the " * 200, "en", "a"),
        (13, "Mr. John Smith, mail j.smith@mail.example.com, +1 (736) 555-2678; Smith pays with 4111 1111 1111 1111", "en", "a"),
        (14, 'J.SMITH@mail.example.com, Mrs Mary Smith, 10.1.2.3, token = "a3a1b97e25e5c1059743005344d08a6b96b1869b"', "en", "b"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*row, None if row[1] is None else len(row[1]), *["x"] * len(CLASHING)) for row in odd_rows]
    return spark.createDataFrame(rows, columns).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (8, 0, 0), (8, 0, 1)],
                                 "doc_id long, quality int, toxic int")
