import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sparkroll.llm.common import prepared, table  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls in any column, empty and wordless texts, a long text, ties and repeated rows.
ODD = [
    (None, None, None, None, None), (1, "", None, None, None), (1, "A b c d. e", "en", "s", 1), (1, "A b c d. e", "en", "s", 1), (2, "A b c d. e", "en", None, 1),
    (3, "é" * 70_000 + " x <|endoftext|>", "fr", "s", 5), (None, "zzz", "fr", "s", 5), (5, " \n\t ", "fr", "s", 5), (6, "12 34", None, "s", 5),
]


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, "/root/testdata/sf0.001", "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns whose names the operators use themselves."""
    prepared(spark)
    frame = spark.createDataFrame(ODD, SCHEMA)
    return frame.selectExpr("*", "1 as score", "2 as fold", "3 as bucket", "4 as fp", "5 as size", "6 as node", "7 as hits")


@pytest.fixture(scope="session")
def empty(spark):
    prepared(spark)
    return spark.createDataFrame([], SCHEMA)
