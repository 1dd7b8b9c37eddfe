from __future__ import annotations

import pytest

from tabwright.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tabwright-llm-tests", master="local[4]", shuffle_partitions=4,
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    """Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, other columns."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    prose = [" ".join(words[(i * j + j) % 12] for j in range(40)) for i in range(1, 6)]
    rows = [(1, prose[0], "en", "a"), (2, prose[0], "en", "b"), (3, prose[1] + "\n" + prose[2], None, "a"),
            (3, prose[1] + "\n" + prose[2], None, "a"), (3, "another text of one id", "en", None), (None, prose[3], "de", "a"),
            (None, None, None, None), (7, "", "en", "b"), (8, None, "en", "b"), (9, " \t\n\r\x0b\x0c ", "fr", ""),
            (10, "é ü ñ 漢字 𝒳 " * 30, "fr", "c"), (11, "long " * 30_000, "en", "a"), (-5, "$$$ ### MOST!! " * 20, "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, size string, target double")
