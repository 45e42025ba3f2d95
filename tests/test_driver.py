from recordloom.plans.driver import Breaker, Cache, Hooks, due, embedded


def test_cache_forgets_by_time_and_use():
    now = [0.0]
    c = Cache(ttl=10, most=20, clock=lambda: now[0])
    assert Cache.key("  The  Query ", 5, ["a"]) == ("the query", 5, ("a",))
    for i in range(20):
        c.put(i, i)
    assert all(c.get(i) == i for i in range(2, 20))
    c.put(99, "x")
    assert c.get(0) is None and c.get(1) is None and c.get(5) == 5 and c.get(99) == "x"
    now[0] = 11
    assert c.get(5) is None


def test_breaker():
    now = [0.0]
    b = Breaker(most=3, within=10, rest=5, clock=lambda: now[0])
    for t in (0, 20, 21):
        now[0] = t
        b.failed("x")
    assert b.allows("x")
    b.failed("x")
    assert not b.allows("x") and b.allows("y")
    now[0] = 26.5
    assert b.allows("x")


def test_due_and_hooks():
    assert due({"maintenance": 0.0, "reflection": 0.0, "consolidation": 0.0}, 6 * 3600.0) == ["reflection"] and len(due({}, 0.0)) == 3
    h, got = Hooks(), []
    h.on("store", got.append, tags={"a"})
    h.on("store", got.append, level=4)
    assert h.fire("store", 1, {"a", "b"}, 1) == 1 and h.fire("store", 2, {"c"}, 4) == 1 and h.fire("recall", 3) == 0 and got == [1, 2]


def test_embeddings_by_a_function(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [list(r.embedding) for r in embedded(df, df["t"], lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()] == [[2.0, 1.0], [0.0, 1.0]]
