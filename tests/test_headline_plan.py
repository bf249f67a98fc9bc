"""Headlines take only the texts that are shown in words."""

from larkmill.plans import search


def test_texts_are_split_after_the_join(spark, small):
    plan = search.fts_headline(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("regexp_extract_all") < plan.index("Join") and "LeftSemi" in plan
