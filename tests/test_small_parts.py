"""Parts without a query of their own: overriding renderings, comments above a definition, quantiles and means."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, evaluation
from tessera.settings import Settings


def test_a_rendering_is_stored_only_where_it_differs(spark):
    rows = spark.createDataFrame([("src/aFile.py", "body text")], "path string, body string")
    shown = lambda **s: rows.select(text.lexical_override(F.col("path"), F.col("body"), Settings(**s)).alias("x")).first().x
    assert shown() is None and shown(lexical_mode="capped", lexical_cap_chars=100) is None
    assert shown(lexical_mode="capped", lexical_cap_chars=4).endswith("\nbody")
    assert shown(lexical_enrich=True) == "body text aFile aFile src"


@pytest.mark.parametrize(("start", "want"), [(1, []), (3, ["# a", "// b"]), (6, ["# d"]), (16, ["# c"] * 6)])
def test_comments_above_a_line(spark, start, want):
    lines = ["# a", "// b", "def f():", "    pass", "# d", "def g():", "x = 1", *["# c"] * 8, "def h():"]
    got = spark.range(1).select(chunking.leading_comments(F.array(*map(F.lit, lines)), F.lit(start)).alias("x")).first().x
    assert got == want


def test_quantiles_and_means(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x) for x in (5, 1, 3, 2, 4)], "ms double, other double")
    assert [evaluation.quantile_at(rows, "ms", q).first().ms for q in (0.0, 0.5, 0.95)] == [1.0, 3.0, 5.0]
    assert tuple(evaluation.means(rows, ["ms", "other"]).first()) == (3.0, 6.0, 5)
