"""Load journal: loads that fail are taken up again, without loss or copy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tableproof.sources.journal import LoadJournal

DAY = dt.datetime(2024, 1, 1)
CONTROL = "table_name string, watermark_col string, watermark_value timestamp_ntz, last_run_ts timestamp_ntz, status string"


def at(d):
    return DAY + dt.timedelta(days=d)


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(30).select("id", (F.lit(DAY) + F.make_dt_interval(F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts")).coalesce(1)


def control(spark, names="abcde"):
    return spark.createDataFrame([(n, "ts", at(5), None, "NEW") for n in names] + [("ahead", "ts", at(99), None, "NEW")], CONTROL).coalesce(1)


def test_a_failed_load_is_retried_without_loss_or_copy(spark, tmp_path, data):
    journal, broken = LoadJournal(spark, str(tmp_path), group=2), {"b", "e"}

    def read(name):
        if name in broken:
            raise OSError(f"{name} is away")
        return data

    journal.plan(control(spark), at(20), "r1")
    journal.plan(control(spark), at(25), "r1")  # the plan stands
    journal.load("r1", read)
    states = {r["table_name"]: (r["state"], r["error"]) for r in journal.state().collect()}
    assert states == {n: ("failed", f"{n} is away") if n in broken else ("landed", None) for n in "abcde"}
    stored = []
    journal.advance(control(spark), "r1", at(30), lambda df: stored.append(df.collect()))
    assert {r["table_name"]: r["watermark_value"] for r in stored[0]} == {n: at(5) if n in broken else at(20) for n in "abcde"} | {"ahead": at(99)}
    broken.clear()
    asked = []
    journal.load("r1", lambda name: asked.append(name) or read(name))
    assert sorted(asked) == ["b", "e"]
    journal.advance(control(spark), "r1", at(30), lambda df: stored.append(df.collect()))
    assert {r["state"] for r in journal.state().collect()} == {"advanced"}
    assert all(sorted(r["id"] for r in journal.landed(n).collect()) == list(range(6, 21)) for n in "abcde")
    asked.clear()
    journal.load("r1", lambda name: asked.append(name) or read(name))
    assert not asked


def test_a_stop_between_landing_and_journal_and_before_marking(spark, tmp_path, data, monkeypatch):
    journal = LoadJournal(spark, str(tmp_path))
    journal.plan(control(spark, "a"), at(20), "r1")
    with monkeypatch.context() as m:
        m.setattr(LoadJournal, "_record", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            journal.load("r1", lambda _: data)
    assert [r["state"] for r in journal.state().collect()] == ["planned"]
    journal.load("r1", lambda _: data)
    assert journal.landed("a").count() == 15
    tables = [control(spark, "a")]

    def advance():
        journal.advance(tables[-1], "r1", at(30), lambda df: tables.append(spark.createDataFrame(df.collect(), CONTROL)))

    with monkeypatch.context() as m:
        m.setattr(LoadJournal, "_record", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            advance()
    advance()
    assert sorted(tables[1].collect()) == sorted(tables[2].collect())
    journal.plan(tables[-1], at(28), "r2")
    journal.load("r2", lambda _: data)
    assert sorted(r["id"] for r in journal.landed("a").collect()) == list(range(6, 29))


def test_empty_control_and_empty_extracts(spark, tmp_path, data):
    journal = LoadJournal(spark, str(tmp_path))
    journal.plan(control(spark, ""), at(20), "r1")
    journal.load("r1", lambda _: data)
    assert journal.state().count() == 0
    journal.plan(control(spark, "a"), at(20), "r2")
    journal.load("r2", lambda _: data.where("false"))
    row = journal.state().first()
    assert (row["state"], row["loaded_rows"], row["wm"]) == ("landed", 0, None) and journal.landed("a").count() == 0
    stored = []
    journal.advance(control(spark, "a"), "r2", at(30), lambda df: stored.extend(df.collect()))
    assert {r["table_name"]: r["watermark_value"] for r in stored}["a"] == at(5)
