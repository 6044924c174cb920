import hashlib
import random

from codequarry.operators import intel
from codequarry.queries import QUERIES


def test_closures_of_all_units(spark, tmp_path):
    rng = random.Random(2)
    names = [f"{rng.choice('abuxz')}{chr(97 + k % 26)}unit{k}" for k in range(60)]
    uses = {n: rng.sample(names, rng.randrange(3)) for n in names}
    rows = [(n.upper(), "unit", f"unit {n}; interface uses {', '.join(u)}; implementation end." if u else "unit x;") for n, u in uses.items()]
    spark.createDataFrame([*rows, (None, "unit", "uses a;"), ("c", "class", "uses a;")], "name string, type string, content string").write.parquet(f"{tmp_path}/symbols.parquet")
    pairs = set()
    for n in names:
        todo = list(uses[n])
        while todo:
            x = todo.pop()
            if (n, x) not in pairs:
                pairs.add((n, x))
                todo += uses[x]
    circles = {r["unit"] for r in QUERIES["unit_circles"](spark, str(tmp_path)).collect()}
    assert circles == {a for a, b in pairs if a == b}
    got = QUERIES["unit_closure"](spark, str(tmp_path)).collect()
    assert {(r["root"], r["unit"]) for r in got} == {p for p in pairs if p[0] != p[1]}
    assert circles and any(not a.startswith("ua") for a, _ in pairs)


def test_no_limit_of_levels_by_default(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(intel, "count", lambda k: asked.append(k) or iter(range(k, 10)))
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    r = spark.createDataFrame([("a",)], "root string")
    assert intel.transitive_uses(e, r).count() == 3 and asked == [1]
    assert intel.transitive_uses(e, r, 2).count() == 2


def test_caches_and_packages_of_all_symbols(spark, tmp_path):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(k, "U", "unit", f"d/u{k}.pas", f"unit u{k};", md5(f"unit u{k};"), "RTL") for k in range(1, 62)]
    spark.createDataFrame(rows, "id long, name string, type string, file_path string, content string, content_hash string, framework string").write.parquet(f"{tmp_path}/symbols.parquet")
    got = {r["query_hash"]: r["still_valid"] for r in QUERIES["cache_validate"](spark, str(tmp_path)).collect()}
    assert got == {md5(f"q{k}"): k % 53 != 0 and (k % 5 == 0 or k % 31 != 0) for k in range(1, 62)}
    got = {r["file_path"]: (r["framework"], r["tier"]) for r in QUERIES["framework_coalesce"](spark, str(tmp_path)).collect()}
    assert len(got) == 61 and set(got.values()) == {("RTL", "package")}
