import hashlib
import json

import pytest

import __spark_entry__
from loomtext.plans import catalog
from loomtext.sources import readers, sinks
from loomtext.streaming import log

SF = "/root/testdata/sf0.001"


def test_segment_triplets_and_tree(spark, tmp_path):
    for name, data in {"root": {"a:1": "x", "a:2": "y"}, "en": {"a:1": "X"}, "note": {"a:2": "n"}}.items():
        (tmp_path / f"{name}.json").write_text("﻿" + json.dumps(data), encoding="utf-8")
    parts = [readers.segments(spark, f"{tmp_path}/{n}.json", n).drop("file") for n in ("root", "en", "note")]
    assert sorted(map(tuple, readers.triplets(*parts).collect())) == [("a:1", "x", "X", None), ("a:2", "y", None, "n")]
    assert sorted(r["uid"] for r in readers.file_tree(spark, str(tmp_path), r"/([a-z]+)\.json$").collect()) == ["en", "note", "root"]


def test_manifest_finds_edited_text(spark, tmp_path):
    good = hashlib.sha256(b"text").hexdigest()
    m = {"schema_version": 1, "mode": "preview", "total_units": 2, "items": [{"text": "text", "text_sha256": good}, {"text": "edited", "text_sha256": good}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    assert sorted(str(r["problem"]) for r in readers.manifest(spark, str(tmp_path / "m.json"), 1, "preview").collect()) == ["None", "hash"]
    assert {r["problem"] for r in readers.manifest(spark, str(tmp_path / "m.json"), 2, "preview").collect()} == {"version"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", None)], "id int, name string, note string")
    got = sinks.insert_statements(df, "t", ["id", "note"]).first()["value"]
    assert got == "insert into t (id, name, note) select 1, 'it''s', null where not exists (select 1 from t where id is not distinct from 1 and note is not distinct from null);"
    sinks.write_snapshot(df, str(tmp_path / "s"))
    with pytest.raises(Exception):
        sinks.write_snapshot(df, str(tmp_path / "s"))
    fb = spark.createDataFrame([(" ",), ("a" * 9,)], "message string")
    assert [r["message"] for r in sinks.feedback(fb, 5).collect()] == ["aaaaa"]
    parents = spark.createDataFrame([(1, "x\n\ny"), (2, "z")], "id int, body string")
    assert sorted(map(tuple, sinks.split_body(parents, "id", "body", parents.filter("id = 2").select("id")).collect())) == [(1, 1, "x"), (1, 2, "y")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = log.read_log(spark, str(tmp_path / "in"), events.schema, 1)
    log.append(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(map(tuple, log.windowed_counts(df, "ts", "event_type").collect()))
    assert key(out) == key(events)
    seen = {}
    merge = lambda batch, i: seen.update({r["event_id"]: i for r in batch.select("event_id").collect()})
    log.upsert_batches(log.read_log(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "c2"), merge).awaitTermination(120)
    assert len(seen) == events.count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_a_callable_and_sql_names_a_query():
    known, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 70


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in readers.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda x: f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)
    canon = lambda df: sorted(tuple(map(plain, r)) for r in df.astype(object).where(df.notna(), None).values.tolist())
    assert canon(got) == canon(want)


def test_filters_reach_the_scan(spark):
    plan = catalog.queries()["semi_docs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(quality,1)" in plan
    assert "text" not in plan.split("ReadSchema")[1][:60]


def test_settings_and_orders(spark):
    assert readers.database_url("postgresql://h/db?sslmode=require&schema=x&options=a%3Db") == "postgresql://h/db?sslmode=require&options=a%3Db"
    assert readers.database_url("postgresql://h/db?schema=x") == "postgresql://h/db"
    spark.conf.set("loomtext.size", "7")
    assert readers.options(spark, {"size": "3", "other": "x"}) == {"size": "7", "other": "x"}
    rows = readers.in_book_order(spark.createDataFrame([("mn10",), ("dn2",), ("dn10",), ("an1.10",), ("an1.2",)], "uid string"), "uid", ["dn", "mn"])
    assert [r["uid"] for r in rows.orderBy("book_order").collect()] == ["dn2", "dn10", "mn10", "an1.2", "an1.10"]


def test_settings_file_html_and_large_files(spark, tmp_path):
    (tmp_path / "notice.json").write_text('{"version": 3}')
    assert tuple(readers.settings_row(spark, str(tmp_path / "notice.json"), {"version": "1", "text": "none"}).first()) == ("3", "none")
    (tmp_path / "a.html").write_text("<p>x</p>\n<p>y</p>")
    assert readers.web_pages(spark, str(tmp_path / "a.html")).first()["html"] == "<p>x</p>\n<p>y</p>"
    files = spark.createDataFrame([("a", 9), ("b", 20_000)], "path string, length long")
    assert [r["path"] for r in readers.large_enough(files).collect()] == ["b"]
    (tmp_path / "w.txt").write_text("One\n two \n\none\n")
    assert sorted(r["word"] for r in readers.vocabulary(spark, str(tmp_path / "w.txt")).collect()) == ["one", "two"]


def test_previews_are_written_with_a_manifest(spark, tmp_path):
    sinks.write_previews(spark.createDataFrame([(1, "abc")], "id int, text string"), "id", "text", str(tmp_path))
    m = spark.read.json(str(tmp_path / "manifest")).first()
    assert (m["chars"], m["text_sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())
    assert spark.read.text(str(tmp_path / "texts")).first()["value"] == "abc"
