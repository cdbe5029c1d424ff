"""Documents of more lines than the given tables have, and of none, against the SQL."""

import duckdb
import pytest

from leafmill.plans.check import compare


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(0, "\n".join(f"Line {i}." for i in range(2050)), "en", "src1"), (1, "One line.", "en", "src1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return path, con


@pytest.mark.parametrize("name", ["encyclopedia_markdown", "formatted_footnotes"])
def test_notes_after_the_thousandth_line(spark, long, name):
    outcome = compare(spark, long[1], long[0], name)
    assert outcome.startswith("ok"), outcome


@pytest.fixture(scope="module")
def blank(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blank"))
    texts = ["", "\n\n\n", "Two words.", "   ", " \n \nA line.\n\n"]
    rows = [(i + 1, text, "en", "src1") for i, text in enumerate(t for t in texts for _ in range(4))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return path, con


@pytest.mark.parametrize("name", ["copyedit_guard", "chunked_transform_guarded"])
def test_blank_texts_have_no_chunks(spark, blank, name):
    outcome = compare(spark, blank[1], blank[0], name)
    assert outcome.startswith("ok"), outcome
