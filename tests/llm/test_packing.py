import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodeweave.llm import packing as P


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=120))
def test_every_item_once_and_no_container_overfull(cap, lengths):
    lengths = np.array([x for x in lengths if x <= cap], np.int64)
    patterns = P.plan(np.bincount(lengths, minlength=cap + 1))
    assert all(sum(p) <= cap for p, _ in patterns)
    numbers, seen = np.zeros(len(lengths), np.int64), {}
    for i, x in enumerate(lengths.tolist()):
        numbers[i] = seen.get(x, 0)
        seen[x] = numbers[i] + 1
    a = P.Assignment(patterns, cap)
    where = a.containers_of(lengths, numbers)
    load = np.bincount(where, lengths, a.containers) if len(where) else np.zeros(0)
    assert len(load) == a.containers and (load <= cap).all() and (load > 0).all()
    assert sorted(x for p, t in patterns for x in p * t) == sorted(lengths.tolist())


def test_exact_sums_are_found():
    g = P.Gaps(np.bincount([7, 11, 13, 13], minlength=100))
    assert g.close(13) == (13,) and g.close(24) == (13, 11) and g.close(26) == (13, 13) and g.close(31) == (13, 11, 7) and g.close(39) == () and g.close(5) == ()


def test_frame(spark):
    rows = [(i, "word " * (i % 50 + 1), "x") for i in range(400)] + [(1000, None, "x"), (1001, "", "x"), (1002, "word " * 1300, "x"), (None, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string")
    targets = spark.createDataFrame([(1, 64), (2, 512)], "target_id int, capacity_tokens int")
    packed = P.pack_documents(docs, targets).cache()
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    assert set(counts) == {*range(400), 1002}
    total = {r.doc_id: r.n for r in packed.where("target_id = 1").groupBy("doc_id").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert total == counts
    load = packed.groupBy("target_id", "container_id").sum("n_tokens").collect()
    assert all(r[2] <= (64 if r[0] == 1 else 512) for r in load)
    pieces = packed.where("doc_id < 1000").groupBy("target_id", "doc_id").count().where("count > 1").count()
    assert pieces == 0  # only a text that is too long is split
    fill = {r.target_id: r for r in P.filling(packed, targets).collect()}
    assert fill[1].unused_share < 0.02 and fill[2].containers == fill[2].least_containers
    assert P.pack_documents(docs.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(docs, spark.createDataFrame([(1, 0)], "target_id int, capacity_tokens int"))


def test_hot_length_is_numbered_in_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 500)
    counts = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 7L, id % 20 + 1) AS n_tokens")
    packed = P.pack(counts, spark.createDataFrame([(1, 21)], "target_id int, capacity_tokens int"))
    assert packed.count() == 6000
    assert packed.groupBy("container_id").sum("n_tokens").selectExpr("max(`sum(n_tokens)`)").first()[0] <= 21
