"""The fit runs by small plans: the driver keeps and plans each of them, and memory there went to plans of many joins."""

import random

from voluma.llm import mixing


def test_no_plan_of_the_fit_has_many_joins(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choices(["en", "de", "fr"], [8, 3, 1])[0], rng.choices("abcd", [9, 4, 2, 1])[0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    before = ids()
    mixing.mixture(docs, topic="lang", targets={}).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    joins = []
    for i in ids() - before:
        nodes = store.planGraph(i).allNodes()
        joins.append(sum("Join" in nodes.apply(k).name() for k in range(nodes.size())))
    assert len(joins) > 10
    assert max(joins) <= 3  # a goal for each of three dimensions; a step of a sweep has one
    assert sum(j > 1 for j in joins) <= 2
