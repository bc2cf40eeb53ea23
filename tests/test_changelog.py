"""Levelled change log: the rows of all batches applied at once, bounded folders, batches that fail or repeat."""

import random
from collections import Counter

import pytest
from tableproof.operators import merge
from tableproof.operators.changelog import ChangeLog

SCHEMA = "k int, v int, op string, seq bigint"


def batches(n=11, size=12, seed=3):
    """Keys old, new and null; sequence numbers in any order over the batches."""
    rnd = random.Random(seed)
    seqs = list(range(n * size))
    rnd.shuffle(seqs)
    keys = [None, *range(60)]
    return [[(rnd.choice(keys), rnd.randrange(99), rnd.choice("IUDD"), seqs.pop()) for _ in range(size)] for _ in range(n)]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(k, -k) for k in range(40)] + [(7, 1), (None, 5)], "k int, v int").coalesce(2)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_equals_one_batch_and_folders_stay_few(spark, tmp_path, base):
    log = ChangeLog(base, str(tmp_path), ["k"], "op", "seq", fanout=3, fold_at=0.9)
    done, folded = [], 0
    for i, batch in enumerate(batches()):
        log.append(spark.createDataFrame(batch, SCHEMA).coalesce(1), i)
        done += batch
        state = log.manifest()
        per_level = Counter(x["level"] for x in state["levels"])
        assert state["last"] == i and all(n < 3 for n in per_level.values()) and len(per_level) <= 3
        folded += not state["levels"]
        if i % 5 == 0 or i == 10:
            want = merge.delta_apply(base, spark.createDataFrame(done, SCHEMA), ["k"], "op", "seq")
            assert rows(log.table()) == rows(want)
    assert folded and log.manifest()["base"]
    again = ChangeLog(base, str(tmp_path), ["k"], "op", "seq")
    assert rows(again.table()) == rows(log.table())


@pytest.mark.parametrize("fold_at", [0.1, 9.0])
def test_a_batch_that_fails_before_the_manifest_leaves_the_table(spark, tmp_path, base, monkeypatch, fold_at):
    first, second, *_ = batches()
    log = ChangeLog(base, str(tmp_path), ["k"], "op", "seq", fanout=2, fold_at=fold_at)
    log.append(spark.createDataFrame(first, SCHEMA), 0)
    before = rows(log.table())
    with monkeypatch.context() as m:
        m.setattr(ChangeLog, "_publish", lambda self, state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.append(spark.createDataFrame(second, SCHEMA), 1)
    assert rows(log.table()) == before
    for _ in range(2):  # the second time the number is in already
        log.append(spark.createDataFrame(second, SCHEMA), 1)
        want = merge.delta_apply(base, spark.createDataFrame(first + second, SCHEMA), ["k"], "op", "seq")
        assert rows(log.table()) == rows(want)


def test_late_changes_and_deletions_after_a_fold(spark, tmp_path, base):
    log = ChangeLog(base, str(tmp_path), ["k"], "op", "seq", fold_at=0.0)
    for i, change in enumerate([(1, 0, "D", 50), (1, 77, "U", 20), (2, 5, "U", 60), (2, 0, "D", 10), (90, 1, "I", 70)]):
        log.append(spark.createDataFrame([change], SCHEMA), i)
    got = rows(log.table())
    assert not [k for k in got if k[0] == 1] and got[(2, 5)] == 1 and got[(90, 1)] == 1 and got[(3, -3)] == 1


def test_a_manifest_slot_that_was_lost_leaves_the_other(spark, tmp_path, base):
    log = ChangeLog(base, str(tmp_path), ["k"], "op", "seq", fold_at=9.0)
    first, second, *_ = batches()
    log.append(spark.createDataFrame(first, SCHEMA), 0)
    before = rows(log.table())
    log.append(spark.createDataFrame(second, SCHEMA), 1)
    # As a writer leaves the slot that stops after clearing it.
    spark.createDataFrame([], "version bigint").write.mode("overwrite").parquet(f"{tmp_path}/manifest-1")
    assert rows(log.table()) == before


def test_empty_batches_and_an_empty_base(spark, tmp_path, base):
    none = spark.createDataFrame([], SCHEMA)
    log = ChangeLog(base, f"{tmp_path}/a", ["k"], "op", "seq")
    assert rows(log.table()) == rows(base)
    log.append(none, 0)
    assert rows(log.table()) == rows(base) and log.manifest()["levels"] == []
    log = ChangeLog(base.where("false"), f"{tmp_path}/b", ["k"], "op", "seq")
    log.append(spark.createDataFrame([(1, 2, "I", 1), (3, 4, "D", 2)], SCHEMA), 0)
    assert rows(log.table()) == {(1, 2): 1}
