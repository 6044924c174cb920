import random

import pytest

from codequarry.operators.hierarchy import descendants, hierarchy

SCHEMA = "folder_path string, parent_folder_path string, indexed_at int, root_path string"


def brute(rows):
    key = lambda p: p.replace("\\", "/").lower().rstrip("/") if p and p.strip() else None
    best = {}
    for path, parent, at, _ in rows:
        k = key(path)
        if k is not None and (k not in best or (at, path) > best[k][:2]):
            best[k] = (at, path, key(parent))
    out = {}
    for k in best:
        seen, c = [], k
        while c is not None and c not in seen:
            seen.append(c)
            p = best[c][2]
            c = p if p in best else None
        if c is None:
            out[best[k][1]] = (best[seen[-1]][1], len(seen) - 1)
        else:
            out[best[k][1]] = (min(best[x][1] for x in seen[seen.index(c) :]), -1)
    return out


def run(spark, rows):
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), "folder_path", "parent_folder_path", "indexed_at")
    return {r["path"]: r for r in tree.collect()}, tree


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_circles(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        parent = rng.choice([None, "", "missing", *(f"f{rng.randrange(120)}" for _ in range(12))]) if rng.random() < 0.3 else f"F{rng.randrange(max(i, 1))}\\"
        rows.append((f"f{i}", parent, rng.randrange(100), "x"))
        if rng.random() < 0.2:
            rows.append((f"F{i}/", f"f{rng.randrange(120)}", 100 + i, "x"))
    got, _ = run(spark, rows)
    assert {p: (r["root_path"], r["depth"]) for p, r in got.items()} == brute(rows)


def test_deep_chain_star_and_descendants(spark):
    rows = [("c0", None, 1, "")] + [(f"c{i}", f"c{i - 1}", 1, "") for i in range(1, 70)] + [(f"s{i}", "C5/", 1, "") for i in range(200)]
    got, tree = run(spark, rows)
    assert got["c69"]["depth"] == 69 and got["c69"]["names"] == [f"c{i}" for i in range(70)]
    assert got["c0"]["n_descendants"] == 269 and got["c5"]["n_descendants"] == 264 and got["s7"]["n_descendants"] == 0
    assert sorted(r["preorder"] for r in got.values()) == list(range(270))
    below = descendants(tree, spark.createDataFrame([("c60",)], "path string")).collect()
    assert sorted(r["descendant"] for r in below) == sorted(f"c{i}" for i in range(61, 70))


def test_self_parent_empty_and_nulls(spark):
    got, _ = run(spark, [("a", "A", 1, None), (None, "a", 1, None), (" ", None, 2, None), ("b", "a", None, None), ("b", "a", None, None)])
    assert {p: (r["root_path"], r["depth"]) for p, r in got.items()} == {"a": ("a", -1), "b": ("a", -1)}
    got, _ = run(spark, [])
    assert got == {}
