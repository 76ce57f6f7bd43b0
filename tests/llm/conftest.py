import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYTHONPATH", os.getcwd())
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Texts that break things: null, empty, blank, ties, letters beyond ASCII, no spaces, long.
ODD = [
    None,
    "",
    " ",
    "  two  spaces ",
    "\t\n\r\x0b\x0c",
    "Same text",
    "same TEXT",
    "Same text",
    "é É ß ẞ ſ İ ı ǆ ª º ² ½ ﬁ",
    "a▁b ▁ c▁ ▁▁d",
    "x<s>y</s> <|endoftext|> <unk> <|startoftext|>z",
    "日本語のテキスト 漢字かな交じり文 한국어 текст на русском",
    "é ä ­ soft­hyphen ​ zero \U0001f600 \U0001f1e9\U0001f1ea",
    "don't we'll I'VE ''s !'s x's's 's",
    "_under_score_ __init__ 123 4567 1,234.5 3½ a1b2",
    "y" * 700,
    "1" * 300 + " " + "." * 300,
    "word " * 5000,
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "Same text", "clash", 2), (5, "Same text", None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n long").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, row string, n long")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
