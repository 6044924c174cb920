import random

from codequarry.operators import intel


def test_reach_by_bits_equals_joins(spark, monkeypatch):
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(100)}
    pairs = set()
    for a in {a for a, _ in edges}:
        todo = [b for x, b in edges if x == a]
        while todo:
            x = todo.pop()
            if (a, x) not in pairs:
                pairs.add((a, x))
                todo += [b for y, b in edges if y == x]
    e = spark.createDataFrame([*edges, (None, "a"), ("a", None)], "src string, dst string")
    monkeypatch.setattr(intel, "BLOCK_TARGETS", 16)
    for most in (intel.MOST_EDGES, 10):
        monkeypatch.setattr(intel, "MOST_EDGES", most)
        assert sorted(tuple(r) for r in intel.reach(e).collect()) == sorted(pairs)
        assert sorted(r[0] for r in intel.circles(e).collect()) == sorted(a for a, b in pairs if a == b)
    assert intel.reach(e.limit(0)).count() == intel.circles(e.limit(0)).count() == 0


def test_a_long_chain_takes_no_rounds(spark, monkeypatch):
    cuts = []
    own = intel.cut
    monkeypatch.setattr(intel, "cut", lambda df: cuts.append(1) or own(df))
    e = spark.range(3000).selectExpr("cast(id as string) src", "cast(id + 1 as string) dst")
    assert intel.reach(e).count() == 3000 * 3001 // 2 and len(cuts) == 1
