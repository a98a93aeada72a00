"""A judge reply's lists are parsed one time each."""

from scribeval.functions import judge as J


def test_reply_lists_are_parsed_once_each(spark):
    d = spark.createDataFrame([('{"word_count": 3, "no_penalty_errors": "", "major_errors": "[\\"a\\"]", "minor_errors": "b", "total_penalty": 1, "score": 0.5}',),
                               (None,), ("[]",)], "raw string")
    p = J.with_parsed_reply(d)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 + len(J.LIST_FIELDS)
    good, none, other = [r.reply for r in p.collect()]
    assert (good.valid, good.no_penalty_errors, good.major_errors, good.minor_errors) == (True, [], ["a"], ["b"])
    assert (none.reason, other.reason) == ("empty content", "missing or invalid field")
    assert p.columns == ["raw", "reply"]
