"""Likeness to descriptors is counted in the row of a text and equals its SQL."""

import duckdb

from folioloom.plans import load
from folioloom.plans.classify import DESCRIPTORS, nearest_descriptor


def test_terms_stay_in_their_row(spark, tmp_path):
    words = [w for _, _, t in DESCRIPTORS for w in t.split()]
    texts = [" ".join(words[i : i + 5] + ["Other"] * (i % 4)) for i in range(len(words))] + ["nothing here", "", None, f"{words[0].upper()}-{words[-1]} {words[0]}"]
    rows = [(i // 2 + 1, 1 + 100 * (i % 2) - 100 * (i % 3 == 0), "user", t) for i, t in enumerate(texts)]  # some turns of two conversations have one id
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(load().SQL["C2_similarity"])
    got = load().QUERIES["C2_similarity"](spark, str(tmp_path)).select(*want.columns).collect()
    assert len(got) > 5 and sorted(map(tuple, got)) == sorted(want.fetchall())
    plan = nearest_descriptor(spark.createDataFrame([(1, "a")], "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
