"""Connected sources and streamed ingestion."""

import gzip
import json
import sqlite3
from xml.etree import ElementTree

import pytest

from weftlog.sources.connect import connect, connect_all
from weftlog.streaming.ingest import ingest, windowed_counts


def test_connect(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.sqlite")
    db.executescript("CREATE TABLE p (id INTEGER PRIMARY KEY, n TEXT); CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p(id)); INSERT INTO p VALUES (1, 'x'), (2, NULL)")
    db.commit()
    db.close()
    s = connect(spark, {"type": "sqlite", "path": str(tmp_path / "a.sqlite")})
    assert s.tables["p"].primary_key == ["id"] and s.tables["c"].foreign_keys == [("p", "p", "id")] and s.tables["p"].preview == [{"id": "1", "n": "x"}, {"id": "2", "n": None}]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "t.csv").write_text("a,b\n1,\n2,y\n")
    got = connect_all(spark, {"f": {"type": "csv", "path": str(tmp_path / "csv")}, "d": {"type": "sqlite", "path": str(tmp_path / "a.sqlite")}})
    assert set(got) == {"f.t", "d.p", "d.c"} and got["f.t"].count() == 2


def test_ingest(spark, tmp_path):
    events = spark.sql("SELECT * FROM VALUES ('e1', 'a', TIMESTAMP '2024-01-01 00:10:00'), ('e1', 'a', TIMESTAMP '2024-01-01 00:10:00'), ('e2', 'b', TIMESTAMP '2024-01-01 01:10:00') AS t(ev_id, ev_type, ev_time)")
    events.write.parquet(str(tmp_path / "in"))
    events.selectExpr("*", "'o' AS ob_id", "'x' AS ob_type", "'q' AS qualifier").write.parquet(str(tmp_path / "rel"))
    stream = lambda p: spark.readStream.schema(spark.read.parquet(str(tmp_path / p)).schema).parquet(str(tmp_path / p))
    for q in ingest(stream("in"), stream("rel"), str(tmp_path / "log"), str(tmp_path / "cp")):
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log/events")).count() == 2 and spark.read.parquet(str(tmp_path / "log/e2o")).count() == 2
    assert windowed_counts(events).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from test_parts import LOG, RELATED

    from weftlog import __main__ as cli

    (tmp_path / "log.json").write_text(json.dumps(LOG))
    (tmp_path / "q" / "related").mkdir(parents=True)
    (tmp_path / "q" / "related" / "tree.json").write_text(json.dumps(RELATED))
    tree, log, q, results = (str(tmp_path / x) for x in ("q/related/tree.json", "log.json", "q", "r.jsonl"))
    shown = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    cli.main(["evaluate", "--log", log, "--tree", tree, "--out", str(tmp_path / "out")])
    said = shown()[0]
    assert said["nodes"] == [{"node": 0, "situations": 3, "violated": 0}] and spark.read.json(said["written"]).count() == 3
    cli.main(["translate", "--tree", tree, "--target", "cypher"])
    assert capsys.readouterr().out.startswith("MATCH")
    cli.main(["bench", "--log", log, "--queries-dir", q, "-n", "2", "-l", "a", "-r", results])
    cli.main(["bench-root", "--log", log, "--queries-dir", q, "-n", "1", "-w", "0", "-l", "b", "-r", results, "--only", "related"])
    cli.main(["bench-summary", "-r", results])
    (s,) = shown()
    assert set(s["labels"]) == {"a", "b"} and s["labels"]["b"]["stddev"] == 0 and s["change_percent"] is not None
    cli.main(["plan-profile", "--log", log, "--queries-dir", q])
    assert [(r["step"], r["n"], r["factor"]) for r in shown()] == [(0, 2, None), (1, 3, 1.5)]
    with pytest.raises(SystemExit):
        cli.trees(q, ["none"])


def test_xml_and_bytes(spark, tmp_path):
    from test_parts import LOG, same

    from weftlog.sources import files

    odd = json.loads(json.dumps(LOG))
    odd["objects"].append({"id": 'o"<&3', "type": "order", "attributes": [], "relationships": []})
    data = json.dumps(odd).encode()
    log = files.read_bytes(spark, gzip.compress(data), "json.gz", str(tmp_path))
    files.write_log(log, str(tmp_path / "log.xml"))
    same(log, files.read_log(spark, str(tmp_path / "log.xml")))
    (written,) = (tmp_path / "log.xml").glob("part-*")
    ElementTree.fromstring(written.read_text())
    files.write_log(log, str(tmp_path / "log.sqlite"))
    same(log, files.read_bytes(spark, (tmp_path / "log.sqlite").read_bytes(), "db", str(tmp_path)))


def test_sql_over_a_relational_log(spark, tmp_path):
    from test_parts import LOG

    from weftlog.operators.translate import Mappings, to_sql
    from weftlog.plans.engine import evaluate
    from weftlog.queries import AT, SOMETIME, box, childs, ev_attr, number, o2e, o2o, ob_attr, sized, tree
    from weftlog.sources import files

    (tmp_path / "log.json").write_text(json.dumps(LOG))
    log = files.read_log(spark, str(tmp_path / "log.json"))
    path = str(tmp_path / "log.sqlite")
    files.write_sqlite(log, path)
    maps = Mappings({"pay": "event_pay", "ship": "event_ship"}, {"order": "object_order", "customer": "object_customer"})
    db, duck = sqlite3.connect(path), pytest.importorskip("duckdb").connect()
    for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
        columns = [(c[1], {"INTEGER": "BIGINT", "REAL": "DOUBLE"}.get(c[2], "VARCHAR")) for c in db.execute(f'PRAGMA table_info("{name}")')]
        duck.execute(f'CREATE TABLE "{name}" ({", ".join(f"{n} {t}" for n, t in columns)})')
        for r in db.execute(f'SELECT * FROM "{name}"').fetchall():
            duck.execute(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(r))})', r)
    whole = {"events": {0: ["pay", "ship"]}, "objects": {0: ["order"]}}
    for t in (
        tree(box(**whole, filters=[o2e(0, 0)])),
        tree(box({0: ["pay"]}, {0: ["order"], 1: ["customer"]}, [o2e(0, 0, "of"), o2o(0, 1, "by"), ev_attr(0, "n", number("Integer", 4, None))])),
        tree(box(objects={0: ["order"]}, filters=[ob_attr(0, "price", SOMETIME, number("Float", 3.0, None))])),
        tree(box({0: ["pay"]}, {0: ["order"]}, [o2e(0, 0), ob_attr(0, "price", AT(0), number("Float", None, 3.0))])),
        tree(box(objects={0: ["order"]}, constraints=[sized(childs("A", 1, None))], children=[1]), box({0: ["pay"]}, filters=[o2e(0, 0)]), edges={(0, 1): "A"}),
    ):
        df = evaluate(t, log).node(0)
        want = sorted(tuple(map(str, r)) for r in df.select(*[c for c in df.columns if c != "violation"], "violation").collect())
        assert want
        for got, dialect in ((db.execute(to_sql(t, "sqlite", maps)).fetchall(), "sqlite"), (duck.execute(to_sql(t, "duckdb", maps)).fetchall(), "duckdb")):
            assert sorted(tuple(map(str, r)) for r in got) == want, dialect
    db.close()


def test_a_large_document_is_parts_in_order(spark, tmp_path, monkeypatch):
    from test_parts import LOG, same

    from weftlog.sources import files

    monkeypatch.setattr(files, "LARGE", 0)
    (tmp_path / "log.json").write_text(json.dumps(LOG))
    log = files.read_log(spark, str(tmp_path / "log.json"))
    for kind in ("json", "xml"):
        files.write_log(log, str(tmp_path / f"out.{kind}"))
        parts = sorted((tmp_path / f"out.{kind}").glob("part-*.gz"))
        whole = b"".join(gzip.decompress(p.read_bytes()) for p in parts)
        assert len(parts) > 1 and not (tmp_path / f"out.{kind}-tables").exists()
        if kind == "json":
            assert len(json.loads(whole)["events"]) == log.events.count()
        else:
            ElementTree.fromstring(whole)
        same(log, files.read_log(spark, str(tmp_path / f"out.{kind}")))
        (tmp_path / f"whole.{kind}").write_bytes(whole)
        same(log, files.read_log(spark, str(tmp_path / f"whole.{kind}")))


def test_what_a_document_shuffled_goes_when_it_is_written(spark, tmp_path):
    import time

    from test_parts import LOG, same

    from weftlog.sources import files

    def shuffled():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    (tmp_path / "log.json").write_text(json.dumps(LOG))
    log = files.read_log(spark, str(tmp_path / "log.json"))
    for kind in ("json", "xml"):
        before = shuffled()
        files.write_log(log, str(tmp_path / f"out.{kind}"))
        until = time.time() + 10
        while shuffled() - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffled() - before
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
        same(log, files.read_log(spark, str(tmp_path / f"out.{kind}")))


def test_xml_elements_are_parsed_for_what_is_asked(spark, tmp_path):
    from test_parts import LOG, same

    from weftlog.sources import files

    (tmp_path / "log.json").write_text(json.dumps(LOG))
    log = files.read_log(spark, str(tmp_path / "log.json"))
    files.write_log(log, str(tmp_path / "out.xml"))
    back = files.read_log(spark, str(tmp_path / "out.xml"))
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(attributes," in shown(back.event_attrs) and "StructField(objects," not in shown(back.event_attrs)
    assert "StructField(attributes," not in shown(back.events) + shown(back.o2o)
    same(log, back)
