"""Extraction of rows without ids, of repeated rows, and of rules with bad patterns."""

import re

from pyspark.sql import functions as F

from weftlog.operators import declare, discover, extract


def event(**more):
    return {"mode": "event", "event_type": {"type": "column", "column": "kind"}, "timestamp": {"type": "column", "column": "at"}, **more}


def rows_of(spark):
    return spark.createDataFrame([("a", "2024-01-01 00:00:00", None), ("a", "2024-01-01 00:00:00", None), ("b", "2024-01-02 00:00:00", "own"), ("b", None, "x")], "kind string, at string, id string")


def test_equal_rows_are_events_of_their_own(spark):
    blueprint = {"tables": [{"source": "t", "usages": [event(attributes=[{"attribute": "k", "column": "kind"}])]}]}
    log, report = extract.extract(spark, blueprint, {"t": rows_of(spark)})
    ids = {r["ev_id"] for r in log.events.collect()}
    assert len(ids) == 3 and {r["ev_id"] for r in log.event_attrs.collect()} == ids
    said = report.summary()
    assert (said["success"], said["total_events"], said["total_objects"], said["event_types"], said["object_types"]) == (True, 3, 0, ["a", "b"], [])


def test_a_missing_id_is_given(spark):
    blueprint = {"tables": [{"source": "t", "usages": [event(id={"type": "column", "column": "id"})]}]}
    ids = [r["ev_id"] for r in extract.extract(spark, blueprint, {"t": rows_of(spark)})[0].events.collect()]
    assert len(set(ids)) == 3 and "own" in ids


def test_a_bad_rule_is_skipped(spark):
    rules = [{"condition": {"type": "column-matches", "column": "kind", "pattern": "("}, "event_type": "bad"}, {"condition": {"type": "column-equals", "column": "kind", "value": "a"}, "event_type": "good"}]
    blueprint = {"tables": [{"source": "t", "usages": [{"mode": "change-table", "timestamp": {"type": "column", "column": "at"}, "rules": rules}]}]}
    log, report = extract.extract(spark, blueprint, {"t": rows_of(spark)})
    assert [r["ev_type"] for r in log.events.collect()] == ["good", "good"]
    assert not report.success and len(report.errors) == 1 and re.search("rule 'bad'", report.errors[0])


def test_the_first_type_of_an_object_stays(spark):
    objects = lambda kind: {"mode": "object", "object_id": {"type": "column", "column": "kind"}, "object_type": {"type": "constant", "value": kind}}
    blueprint = {"tables": [{"source": "t", "usages": [objects("z"), objects("y")]}]}
    log, _ = extract.extract(spark, blueprint, {"t": rows_of(spark)})
    assert {(r["ob_id"], r["ob_type"]) for r in log.objects.collect()} == {("a", "z"), ("b", "z")}


def test_windows_over_an_object_against_pairs(spark):
    """Delays and arcs, where one pass over an object's events stands for all pairs of them; with equal times and types."""
    import random

    from weftlog.log import Log

    rng = random.Random(4)
    rows = [(f"e{i}", rng.choice("abc"), f"2024-01-01 00:00:{rng.randrange(12):02}", f"o{rng.randrange(4)}") for i in range(60)]
    rows += [(e, k, t, "o9") for e, k, t, _ in rows[:10]]
    e2o = spark.createDataFrame(rows, "ev_id string, ev_type string, t string, ob_id string").selectExpr("ev_id", "ev_type", "cast(t as timestamp) as ev_time", "ob_id", "'x' as ob_type", "'' as qualifier")
    none = Log.empty(spark)
    log = Log(e2o.select("ev_id", "ev_type", "ev_time").distinct(), e2o.select("ob_id", "ob_type").distinct(), none.event_attrs, none.object_attrs, e2o, none.o2o, none.types)
    own = [(e, k, int(t[-2:]), o) for e, k, t, o in rows]
    want = {}
    for e, k, t, o in own:
        for f, j, u, p in own:
            if o == p and e != f and u >= t:
                key = (k, j, o, e)
                want[key] = min(want.get(key, 99), u - t)
    assert {(r["first"], r["then"], r["ob_id"], r["ev_id"]): r["seconds"] for r in discover.delays(log, "x").collect()} == want
    for arrow, after in (("EF", lambda t, u: u > t), ("EP", lambda t, u: u < t), ("AS", lambda t, u: True)):
        for source, target in (("a", "b"), ("a", "a")):
            arc = declare.Arc(source, target, arrow, "each", "x")
            hits = {(e, o): [u for f, j, u, p in own if j == target and p == o and f != e and after(t, u)] for e, k, t, o in own if k == source}
            assert {(r["ev_id"], r["ob_id"]): r["targets"] for r in declare.obligations(log, arc).collect()} == {x: len(u) for x, u in hits.items()}
            times = {e: t for e, _, t, _ in own}
            assert sorted((r["s"], r["ms"]) for r in declare.edge_durations(log, arc).collect()) == sorted((e, 1000 * (min(u) - times[e])) for (e, _), u in hits.items() if u)


def test_many_equal_rows_are_made_by_several_tasks_and_never_broadcast(spark):
    n = 2 * extract.EQUAL_ROWS + 5
    rows = spark.range(n).selectExpr("'a' AS kind", "'2024-01-01 00:00:00' AS at")
    blueprint = {"tables": [{"source": "t", "usages": [event(attributes=[{"attribute": "k", "column": "kind"}])]}]}
    log, _ = extract.extract(spark, blueprint, {"t": rows})
    joined = log.events.join(log.event_attrs.select("ev_id", "name"), "ev_id", "left").agg(F.count("*").alias("n"), F.count_distinct("ev_id").alias("ids"))
    assert tuple(joined.first()) == (n, n)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    by_task = extract.numbered(rows, F.lit("t-")).groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 1 and sum(r["count"] for r in by_task) == n
