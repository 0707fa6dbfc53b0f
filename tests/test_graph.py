import random

from pyspark.sql import functions as F

from cograph.functions import graph as G


def brute_longest(ids, adjacency):
    def walk(u, seen):
        return 1 + max((walk(v, seen | {v}) for v in adjacency.get(u, ()) if v not in seen), default=0)

    return max((walk(i, {i}) for i in ids), default=0)


def brute_cycle(ids, adjacency):
    def reach(u):
        seen, todo = set(), list(adjacency.get(u, ()))
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += adjacency.get(v, ())
        return seen

    return any(i in reach(i) for u in ids for i in {u, *reach(u)})


def test_random_graphs():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 7)
        ids = rng.sample(range(10), n)
        adjacency = G._adjacency([{"src": rng.randint(0, 9), "dst": rng.randint(0, 9)} for _ in range(rng.randint(0, 10))])
        assert G.longest_path(ids, adjacency) == brute_longest(ids, adjacency)
        assert G.has_cycle(ids, adjacency) == brute_cycle(ids, adjacency)
        assert sorted(G.visiting_order(ids, adjacency)) == sorted(ids)


def test_path():
    assert G.path_of([1, 2, 1], ["a", "b", "c"], {1: [2]}) == ["c", "b"]
    assert G.path_of([3, 1, 2], ["x", "x", "y"], {1: [2], 2: [3], 3: [1]}) == ["x", "y", "x"]
    assert G.longest_path(range(40), {i: [(i + 1) % 40] for i in range(40)}) == 30


def test_dense_graphs():
    """Cyclic graphs that an exhaustive walk never ends on; and small dense ones against that walk."""
    for n in (16, 25, 200):
        every = {i: [j for j in range(n) if j != i] for i in range(n)}
        assert G.longest_path(range(n), every) == min(30, n)
    two = {i: [j for j in range(12) if j != i and i // 6 == j // 6] for i in range(12)}
    two[3].append(8)
    assert G.longest_path(range(12), two) == 12
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(4, 8)
        adjacency = G._adjacency([{"src": rng.randrange(n), "dst": rng.randrange(n)} for _ in range(rng.randint(n, 3 * n))])
        ids = rng.sample(range(n), rng.randint(1, n))
        assert G.longest_path(ids, adjacency) == brute_longest(ids, adjacency)
        assert G.longest_path(ids, adjacency, 4) == min(4, brute_longest(ids, adjacency))
    chain = {i: [i + 1] for i in range(20_000)}
    assert G.longest_path([0], chain) == 30 and not G.has_cycle([0], chain)


def test_degree(spark):
    rows = [([1, 2, 3], [(1, 2), (1, 3), (9, 1), (9, 2), (9, 3), (2, 1)], 2), ([], [(1, 2)], 0), ([5], [], 0), ([1, 2], [(2, 1), (2, 1), (2, 9)], 3)]
    df = spark.createDataFrame(rows, "ids array<long>, edges array<struct<src long, dst long>>, want int")
    assert all(r.got == r.want for r in df.select("want", G.max_out_degree(F.col("ids"), F.col("edges")).alias("got")).collect())


LINES = ["$r1 = virtualinvoke $r0.<com.u1.A: void go(int)>(1)", "if $r1 != null goto return", "$r2 := @parameter0: android.content.Context", "x = (java.lang.String) $r1", "return $r1", "$r1 = $r2", "goto 5", "nop", "  IF $x == $y", "$é = @x", "y := @this: a.b.C"]


def test_statements_are_read_alike(spark):
    """The reading of one line in Python is the one of the column expressions."""
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = df.select("line", G.statement_type(F.col("line")).alias("kind"), G.path_token(F.col("line")).alias("token")).collect()
    for r in got:
        kind, token = G.read_statement(r.line)
        assert (G.TYPES[kind], token) == (r.kind, r.token), r.line
