"""The index of live digests: who is asked, who is verified, and what a delete leaves."""

from pyspark.sql import functions as F

from stratus.llm import cuckoo


def _docs(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5000).cast("string")).alias("text"))


def test_only_hits_are_verified_and_full_filters_grow(spark):
    index = cuckoo.CuckooIndex(spark, 100)
    index.insert(cuckoo.digests(_docs(spark, 100)))
    assert (index.probed, index.verified) == (100, 0)
    index.insert(cuckoo.digests(_docs(spark, 3000)))  # far more than the first table holds
    assert index.probed == 3100 and 100 <= index.verified < 130
    got = index.lookup(cuckoo.digests(_docs(spark, 6000, 0))).groupBy("group_size").count().collect()
    assert {r.group_size: r["count"] for r in got} == {2: 200, 1: 3800, None: 2000}


def test_a_delete_leaves_other_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "c"), (7, None), (8, "")], "doc_id long, text string")
    index = cuckoo.CuckooIndex(spark, 7)
    found = cuckoo.digests(docs)
    index.insert(found)
    index.delete(cuckoo.digests(spark.createDataFrame([(1, "a"), (3, "b"), (None, "c"), (9, "a"), (7, "zzz")], docs.schema)))
    state = lambda i: {(r.doc_id, r.length, r.keep_id, r.group_size) for r in i.lookup(found).collect()}
    want = {(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 3, 1), (None, 1, None, None), (7, 0, 7, 2), (8, 0, 7, 2)}
    assert state(index) == want
    again = cuckoo.CuckooIndex(spark, 7, index.path)  # goes on from the folder
    assert state(again) == want
    again.delete(cuckoo.digests(spark.createDataFrame([(2, "a")], docs.schema)))
    assert (1, 1, None, None) in state(again)
    again.insert(cuckoo.digests(spark.createDataFrame([(1, "a")], docs.schema)))
    assert (2, 1, 1, 1) in state(again)


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "x  y", 0), (1, "x y", 0), (1, "z", 0), (None, "x\ty", 0), (None, None, 0)], "doc_id long, text string, keep_id int")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in cuckoo.exact_dedup(docs).collect())
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (1, 1, 1, True), (0, 1, 3, False), (0, 0, 1, True)])
