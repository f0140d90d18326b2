"""Candidate scores against sums done by hand, and the ways from score to bucket."""

from folioloom.plans import load

LONG = " the that with for und" * 12


def test_scores_by_hand(spark, tmp_path):
    texts = {
        1: "The Board Rules." + LONG,  # 3.5 + 1 + 3 + 1 + 2 - 0.125 - 1.5
        2: "The Rules and Der Ways." + LONG,  # 3.5 + 3 + 1 + 2 + 1.125
        3: "see also",  # 3.5 - 5.5 - 5.5 - 1 + 1
        23: "The Rules and Der Ways." + LONG,  # the same without its place: 1 less
        4: "Mary Jones." + LONG,  # 3.5 + 1 - 5.5 + 3 - 1.5 + 1 + 2
        5: "The Rules and Der Ways | fees." + LONG + "\n1. pay the fee",  # 7 words: -1, a bar: -5.5, a procedure: usefulness 4.5 + 2
        17: LONG,  # no title: -2 - 1.5 + 3 + 1 + 2
    }
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = load().QUERIES
    got = {r.doc_id: r for r in q["C25_candidate_score"](spark, str(tmp_path)).collect()}
    assert {i: r.quality for i, r in got.items()} == {1: 8.875, 2: 10.625, 3: -7.5, 23: 9.625, 4: 3.5, 5: -1 - 5.5 + 3 + 1 + 2 + 1.625, 17: 2.5}
    assert {i: r.usefulness for i, r in got.items()} == {1: -0.5, 2: 4.5, 3: 0.0, 23: 4.5, 4: 0.0, 5: 6.5, 17: 0.0}
    assert got[1].reasons == "low_usefulness" and got[2].reasons == "" and got[23].reasons == "title_from_body"
    assert set(got[3].reasons.split(",")) == {"content_too_short", "low_category_confidence", "action_step_fragment", "table_row_fragment"}
    bucket = {r.doc_id: (r.needs_review, r.bucket) for r in q["C26_buckets"](spark, str(tmp_path)).collect()}
    assert bucket[1] == (True, "needs_review") and bucket[2] == (False, "recommended") and bucket[3] == (True, "low_quality")
    assert bucket[4] == (True, "needs_review") and bucket[5][1] == "low_quality" and bucket[17][1] == "low_quality" and bucket[23] == (True, "needs_review")
