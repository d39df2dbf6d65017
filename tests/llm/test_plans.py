"""Plans of every job that an operator runs, those it runs while its query is built included."""

import re

import pytest

import corpus_pipeline
from anchorline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plans_of(spark, action):
    """Plan texts of the executions that ``action`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()

    def known():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.executionsList()
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}
    before = set(known())
    action()
    return [plan for number, plan in known().items() if number not in before]


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_no_cross_join_and_no_rows_in_one_task(spark, name):
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    plans = plans_of(spark, lambda: run(spark, SF).write.format("noop").mode("overwrite").save())
    assert plans
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        # what meets in one partition has been aggregated to a row a task, or cut to a fixed number of rows
        for block in re.split(r"Exchange SinglePartition|SinglePartition", plan.split("== Initial Plan ==")[0])[1:]:
            following = "\n".join(block.split("\n")[1:6])
            assert re.search(r"Aggregate|LocalLimit|TakeOrdered|CollectLimit|GlobalLimit", following), (name, following)
