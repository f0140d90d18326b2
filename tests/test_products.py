"""Queries whose result is a product: it is dealt out, and what one side alone decides is made before it."""

from folioloom.plans import load

SF = "/root/testdata/sf0.001"


def test_notifications_are_dealt_out(spark):
    df = load().QUERIES["J8_notify_staff"](spark, SF)
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism  # one file of orders was one part, whose task made all rows
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "concat" in plan.split("Join", 1)[1] and "concat" not in plan.split("Join", 1)[0]  # a text for each ticket, not for each row


def test_repair_copies_no_step_for_a_rule(spark):
    from folioloom.operators import repair
    from folioloom.plans import charters

    one = repair.one_pass(charters.services(spark, SF).selectExpr("*", "0 AS passes", f"cast(array() AS {repair.LOG}) AS log"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("named_struct(client") <= 2  # made by services and at the end; before, twice a rule
    assert "Join" not in load().QUERIES["X13_repair"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()  # grades go along with the services


def test_a_first_pass_of_repair_is_not_written_by_itself(spark, monkeypatch):
    """It changes nearly all services, so its checkpoint would hold next to nothing that is done."""
    from pyspark.sql.classic.dataframe import DataFrame

    from folioloom.operators import repair
    from folioloom.plans import charters

    written, checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **b: written.append(1) or checkpoint(self, *a, **b))
    done = repair.repaired(charters.services(spark, SF).where("title <> ''"))
    passes = done.agg({"passes": "max"}).first()[0]
    assert passes >= 1 and len(written) == passes // 2 + 1  # before: one each pass, and one for the pass that changed nothing
