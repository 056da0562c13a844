"""status_counts against its SQL: on the smallest tables, on texts without lines or names, and on empty tables."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
DOCUMENTS = [(0, "The one\nthe two\n\n  12", "en", "web"), (1, None, "en", "web"), (2, "", "de", "books"), (3, "\n\n", "de", "books"), (4, "- 7\r\nname", "fr", "web")]
TURNS = [(0, 0, "user", "ask"), (0, 1, "assistant", None), (1, 0, "user", "")]


def both(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    got, want = catalogue.QUERIES["status_counts"](spark, str(folder)), con.sql(catalogue.ORACLES["status_counts"])
    assert got.columns == want.columns
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


def test_equals_its_sql(spark):
    got, want = both(spark, SF)
    assert got == want and len(got) == 3


@pytest.mark.parametrize(("kept", "want"), [(True, [("chunks", 3), ("files", 5), ("symbols", 3)]), (False, [("chunks", 0), ("files", 0), ("symbols", 0)])])
def test_odd_texts_and_empty_tables(spark, tmp_path, kept, want):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").where(str(kept)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").where(str(kept)).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got, sql = both(spark, tmp_path)
    assert got == want and sql == want
