"""Queries of words send texts or asked words, never a row for each word of a document."""

from embedlens.plans import registry

SF = "/root/testdata/sf0.001"


def sent(spark, name):
    df = registry.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return df, plan


def test_first_words_are_grouped_where_their_text_lies(spark):
    df, _ = sent(spark, "first_word_value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Exchange" in x and "word" in x] == []


def test_words_not_asked_for_are_dropped_before_the_grouping(spark):
    _, plan = sent(spark, "matched_words")
    lines = plan.splitlines()
    grouping = next(i for i, x in enumerate(lines) if "min_by" in x)
    assert any("LeftSemi" in x and "word" in x for x in lines[grouping:])
