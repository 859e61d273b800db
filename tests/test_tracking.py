"""Versions of tracked files: links between the tables, replays, conflicts."""

from pagewake.operators import tracking

CAPTURES = "scope_id string, run_id bigint, page_id bigint, url string, sha256 string, seq bigint, attempt_id bigint"
ATTEMPTS = "attempt_id bigint, scope_id string, run_id bigint, kind string, accepted boolean"


def test_versions(spark, tmp_path):
    v = tracking.Versions(str(tmp_path))
    attempts = spark.createDataFrame([(1, "s", 1, "document", True), (2, "s", 1, "document", True), (3, "s", 2, "document", True), (4, "s", 2, "document", False), (5, "s", 2, "page", True), (6, "t", 2, "document", True), (8, "s", 2, "document", None)], ATTEMPTS)
    first = spark.createDataFrame([("s", 1, 10, "u", "a", 1, 1), ("s", 1, 10, "u", "b", 2, 2), ("s", 1, 11, "u", "a", 1, 1)], CAPTURES)
    second = spark.createDataFrame([("s", 2, 10, "u", "c", 1, 3), ("s", 2, 10, "w", "d", 2, 4), ("s", 2, 10, "w", "d", 3, 5), ("s", 2, 10, "w", "d", 4, 6), ("s", 2, 10, "w", "d", 5, 7), ("s", 2, 10, "w", "d", 6, 8), ("t", 2, 12, "u", "c", 7, 6)], CAPTURES)
    read = lambda n, name: sorted(map(tuple, v.read(spark, n, name).collect()))
    v.apply(first, attempts, 0)
    v.apply(second, attempts, 1)
    once = {name: read(1, name) for name in tracking.SCHEMAS}
    v.apply(second, attempts, 1)
    assert {name: read(1, name) for name in tracking.SCHEMAS} == once
    assert [r[1:] for r in once["documents"]] == [("u", "c", 1, 2)]
    assert sorted((r[1], r[2], r[4:]) for r in once["files"]) == [("s", "u", ("c", 1, 2)), ("t", "u", ("c", 2, 2))]
    assert sorted((r[1], r[2], r[3], r[7], r[8]) for r in once["observations"]) == [("s", 1, 10, "b", 2), ("s", 1, 11, "a", 1), ("s", 2, 10, "c", 3), ("t", 2, 12, "c", 6)]
    files, documents = {r[0] for r in once["files"]}, {r[0] for r in once["documents"]}
    assert {r[4] for r in once["observations"]} == files and {r[5] for r in once["observations"]} == documents == {r[3] for r in once["files"]}
    assert sorted((r[0], r[4]) for r in once["conflicts"]) == [(4, "attempt_not_accepted"), (5, "attempt_of_other_kind"), (6, "attempt_of_other_run"), (7, "attempt_unknown"), (8, "attempt_not_accepted")]
    assert read(0, "conflicts") == []


def test_keys_tell_parts_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a:b", "c"), (None, "abc"), ("", "abc")], "x string, y string")
    keys = [r[0] for r in rows.select(tracking.key("x", "y")).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]
