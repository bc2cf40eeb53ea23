import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from tableproof.llm.exact_dedup import keep_first_copies, new_index


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), sha) for i in ids]
    return sorted(out, key=str)


def test_groups_ties_and_nulls(docs):
    got = new_index(docs.sparkSession, 4).ingest(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_later_batches_meet_the_index(spark, docs):
    index = new_index(spark, 4)
    first = index.ingest(docs.where("doc_id <= 5"))
    assert sum(r.kept for r in first.collect()) == 3
    second = {(r.doc_id, r.keep_id, r.kept) for r in index.ingest(docs.where("doc_id IN (2, 3, 12)")).collect()}
    assert second == {(2, 2, False), (3, 3, False), (12, 12, True)}
    before = index.table().count()
    assert not any(r.kept for r in index.ingest(docs.where("doc_id = 12")).collect())
    assert index.table().count() == before


def test_a_named_batch_is_retried_without_loss(spark, docs):
    index = new_index(spark, 4)
    sure = lambda df: sorted((str(r.doc_id), r.text_sha256) for r in df.where("kept").collect())
    one, two = docs.where("doc_id <= 5"), docs.where("doc_id > 2 OR doc_id IS NULL")
    first = sure(index.ingest(one, batch="one"))
    second = sure(index.ingest(two, batch="two"))
    size = index.table().count()
    assert len(first) + len(second) == size == len({r.text or "" for r in docs.collect()})
    # Rows may lie in other partitions and another order when a batch is run again.
    assert sure(index.ingest(two.repartition(7), batch="two")) == second
    assert sure(index.ingest(one.orderBy(F.desc("doc_id")), batch="one")) == first
    assert index.table().count() == size
    assert {r.text or "" for r in keep_first_copies(one, index, batch="one").collect()} == {r.text or "" for r in one.collect()}


def test_a_batch_that_failed_before_all_its_digests_were_added(spark, docs):
    index = new_index(spark, 4)
    index.ingest(docs.where("doc_id IN (2, 12)"), batch="b")
    again = index.ingest(docs, batch="b")
    assert len({r.text_sha256 for r in again.where("kept").collect()}) == len({r.text or "" for r in docs.collect()}) == again.where("kept").count()


def test_plan_has_no_python_and_anti_joins_by_merge(spark, docs):
    index = new_index(spark, 4)
    plan = index.ingest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Bucket" in spark.sql(f"DESCRIBE EXTENDED {index.name}").toPandas().to_string()


def test_keep_first_copies_keeps_columns_and_one_row_per_text(docs):
    out = keep_first_copies(docs, new_index(docs.sparkSession, 4))
    assert out.columns == docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})


def test_empty_table(docs):
    assert new_index(docs.sparkSession, 2).ingest(docs.limit(0)).count() == 0
    assert keep_first_copies(docs.limit(0), new_index(docs.sparkSession, 2)).count() == 0


def test_hot_text(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = new_index(spark, 4).ingest(rows)
    assert got.where("kept").count() == 4001
    assert got.where("group_size = 2000 AND keep_id = 5997").count() == 2000
