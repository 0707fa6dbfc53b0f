from cograph.operators import neighbours


def test_mixed_lengths(spark):
    """A longer vector in a batch, or a longer query in a group, drops no other row."""
    kb = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 0.0, 0.0], "c"), (4, None, "d")], "kb_id long, vector array<float>, label string").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.1]), (3, None)], "query_id long, vector array<float>")
    got = neighbours.nearest(queries, kb, 1).collect()
    assert sorted((r.query_id, r.kb_id) for r in got) == [(1, 1), (2, 3)]
