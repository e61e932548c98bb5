"""Twins that state a rule of their own must state the query's."""
import duckdb
from pyspark.sql import functions as F

from massloom.functions import text
from massloom.plans.q_rows import REFERENCES, _names_sql, _visible_sql


def test_twin_reads_references_as_the_query_does(spark):
    pages = ["<title>and&amp</title><p>x &lt y &copyright &AMP;&#x1F600 &ampamp;</p>", "&amp;lt;&nbsp", f"<p>{REFERENCES}</p>", "plain &", ""]
    ours = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(text.visible_text(F.col("h"))).collect()]
    con = duckdb.connect()
    sql = f"WITH names AS ({_names_sql()}), p AS (SELECT ? AS h) SELECT {_visible_sql('h')} FROM p, names"
    assert [con.execute(sql, [p]).fetchone()[0] for p in pages] == ours
    assert ours[0].startswith("and&\n")
