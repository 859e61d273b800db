"""Evidence in all its forms gives the same attempts."""

import json

from pagewake.operators import evidence

ONE = {"schema_version": "capture-attempt.v1", "adapter": "web_http", "status": "blocked", "url": "https://a.org", "recommended_next_adapter": "browser", "word_count": 3}
FORMS = [ONE, [ONE], {"attempt": ONE}, {"attempts": [ONE]}, {"attempt": ONE, "attempts": [ONE, ONE], "profile": {"default_adapter": "x"}}]


def run(spark, payloads):
    rows = spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload string")
    told = evidence.attempts(rows, "id", "payload")
    return told, {r.id: r for r in evidence.summaries(told, "id").collect()}


def test_forms_agree(spark):
    told, summary = run(spark, FORMS)
    rows = told.collect()
    assert len(rows) == 5 and {(r.n, r.adapter, r.status, r.url, r.recommended_next_adapter, r.error) for r in rows} == {(0, "web_http", "blocked", "https://a.org", "browser", None)}
    assert {r.next_action for r in summary.values()} == {"try_adapter:browser"}


def test_errors_and_empty_evidence(spark):
    told, s = run(spark, [None, "null", "{", "", "3", '"text"', [], {}, [ONE, 1], {"attempts": [None]}, {"attempt": [ONE]}, {"profile": {"default_adapter": "rss"}}, {"attempts": [ONE | {"status": "passed"}], "next_action": "mine"}])
    errors = {r.id: r.error for r in s.values()}
    assert errors == {0: None, 1: None, 2: "json_invalid", 3: "json_invalid", 4: "root_invalid", 5: "root_invalid", 6: None, 7: None, 8: "attempt_invalid", 9: "attempt_invalid", 10: None, 11: None, 12: None}
    assert [s[i].next_action for i in (0, 6, 7, 10)] == ["review_acquisition_inputs"] * 4 and s[11].next_action == "use_profile_default:rss" and (s[12].next_action, s[12].status) == ("mine", "passed")
    assert sorted({r.id for r in told.collect()}) == list(range(13))
