import math
import random

import numpy as np
import pytest

from codequarry.llm import handwritten, mixing, neighbours

# ---------------------------------------------------------------- neighbours


def clustered(n, clusters, dim, spread, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, dim))
    x = c[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return (x * rng.uniform(0.1, 5, size=(n, 1))).astype(np.float32)


def exact(x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), j))[:k] if s[i, j] >= least}


def found(spark, x, **kw):
    df = spark.createDataFrame([(i, v.tolist(), -1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, src int")
    return {(r["src"], r["dst"]) for r in neighbours.similar(df, dim=x.shape[1], **kw).collect()}


def test_recall_against_brute_force(spark):
    x = clustered(1500, 150, 64, 0.2)
    want = exact(x, 10, 0.9)
    assert len(want) > 5000
    got = found(spark, x, k=10, least=0.9)
    assert len(got & want) >= 0.98 * len(want)
    assert len(found(spark, x, k=5) & exact(x, 5, -1)) >= 0.9 * 1500 * 5


@pytest.mark.parametrize("n", [700, 3000, 6000])
def test_recall_without_a_floor(spark, n):
    """Vectors without any structure are the hardest; nine in ten neighbours are found at every size."""
    x = np.concatenate([np.random.default_rng(n).normal(size=(n - 200, 64)), clustered(200, 20, 64, 0.2)]).astype(np.float32)
    asking = range(0, n, 7)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[list(asking)] @ u.T
    s[np.arange(len(s)), list(asking)] = -2
    want = {(i, int(j)) for i, row in zip(asking, np.argsort(-s, axis=1)[:, :10]) for j in row}
    df = spark.createDataFrame([(i, v.tolist(), -1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, src int")
    got = {(r["src"], r["dst"]) for r in neighbours.similar(df, k=10, queries=df.where("vec_id % 7 = 0")).collect()}
    assert {i for i, _ in got} == set(asking) and len(got) <= 10 * len(asking)
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_settings_follow_the_recall(spark, hashes):
    """With any number of hashes, tables and probes are added until pairs at the floor are found."""
    rng = np.random.default_rng(hashes)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.normal(size=(1000, 64))
    w -= (w * x).sum(1, keepdims=True) * x
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    x = np.concatenate([x, y]).astype(np.float32)
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    real = [s for s in neighbours.fitted(reps, 10 ** (3 + 2 * hashes), 10 ** (3 + 2 * hashes), 64, 10, 0.9, 0.98, hashes)]
    assert 1 <= real[0] <= hashes
    got = {(r["src"], r["dst"]) for r in neighbours.class_neighbours(reps.selectExpr("*", "true asks"), 64, 10, 0.9, settings=tuple(real)).collect()}
    assert sum((i, i + 1000) in got for i in range(1000)) >= 960


def test_unreachable_recall_is_exact(spark):
    """One bucket cut into blocks is the last resort."""
    x = clustered(300, 300, 16, 0.2, 3)
    assert found(spark, x, k=4, settings=(0, 1, 0)) == exact(x, 4, -1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(0).normal(size=(400, 64)))], "id long, vec array<double>").selectExpr("id", "cast(vec as array<float>) vec", "true asks")
    assert neighbours.fitted(df, 400, 400, 64, 10, -1.0, 1.1) == (0, 1, 0)


def test_split_buckets_lose_nothing(spark, monkeypatch):
    x = clustered(400, 2, 16, 0.02, 1)
    whole = found(spark, x, k=4, least=0.9)
    assert len(whole & exact(x, 4, 0.9)) >= 0.95 * len(whole)
    monkeypatch.setattr(neighbours, "BUCKET", 24)
    split = found(spark, x, k=4, least=0.9)
    assert len(split ^ whole) <= 0.02 * len(whole)


def test_copies_ties_and_dirt(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.99, 0.14, 0.0, 0.0]
    rows = [(i, a) for i in range(30)] + [(100, b), (101, [0.0] * 4), (102, None), (103, [1.0]), (104, [float("nan"), 1.0, 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0, 1.0]), (106, []), (None, a), (100, b), (107, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.similar(df, dim=4, k=3, least=0.9).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    assert set(got) == {*range(30), 100}
    assert [d for _, d in sorted(got[0])] == [1, 2, 3] and [d for _, d in sorted(got[2])] == [0, 1, 3] and [d for _, d in sorted(got[100])] == [0, 1, 2]
    assert neighbours.similar(df.limit(0), dim=4).count() == 0 and neighbours.similar(df, dim=4, queries=df.limit(0)).count() == 0
    some = neighbours.similar(df, dim=4, k=3, least=0.9, queries=df.where("vec_id in (2, 100)")).collect()
    assert sorted((r["src"], r["rank"], r["dst"]) for r in some) == [(2, 1, 0), (2, 2, 1), (2, 3, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32)).astype(np.float32)
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)])
    assert np.allclose(neighbours.hadamard(np.ascontiguousarray(x.T)), h @ x.T, atol=1e-4)
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 0, 0), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    assert (neighbours.rotated(x, 0, 0) == neighbours.rotated(x, 0, 0)).all() and not np.allclose(neighbours.rotated(x, 0, 0), neighbours.rotated(x, 1, 0))


# ---------------------------------------------------------------- source files

NAMES = "Invoice Ledger Cursor Report Stream Panel Wizard Barcode Shipment Archive Voucher Tariff Payroll Column Buffer Session".split()


def routine(rng):
    n = lambda: "".join(rng.sample(NAMES, 2))
    body = "".join(f"  {rng.choice(['Update', 'Check', 'Store', 'Merge'])}{n()}(F{n()}, {rng.randrange(999)});\n" for _ in range(rng.randrange(3, 12)))
    return f"procedure T{n()}.{rng.choice(['Run', 'Load', 'Save'])}{n()}(const A{n()}: Integer);\nbegin\n{body}end;"


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(3)
    rows, truth = [], set()

    def add(path, parts, cat="user", head=None, case=False):
        unit = "unit U;\n\ninterface"
        rows.append((path, "unit", unit, head, cat))
        rows.extend((path, "procedure", p, None, cat) for p in parts)
        if case:
            truth.add(path)

    lib = [[routine(rng) for _ in range(12)] for _ in range(12)]
    for i, parts in enumerate(lib):  # a third-party tree, labels partly wrong
        add(f"D:\\Src\\Lib\\u{i}.pas", parts, "user" if i % 5 == 0 else "third_party", case=True)
    for i in range(40):
        add(f"C:\\Work\\Team\\Core\\h{i}.pas", [routine(rng) for _ in range(10)], "third_party" if i % 9 == 0 else "user", "Team, internal use." if i % 2 else "Written here; prints generated numbers without a licence.")
    add("C:\\Work\\Team\\Core\\sentence.pas", [routine(rng) for _ in range(10)], head="Never sends a report without a licence: the copy goes first. Prints numbers generated by the invoice module.")
    add("C:\\Work\\Team\\label.pas", [routine(rng) for _ in range(10)], head="// Some unit.\n// Licence: X-3", case=True)
    add("C:\\Work\\Team\\claim.pas", [routine(rng) for _ in range(10)], head="* Generated with maker 3.", case=True)
    for i in range(12):
        add(f"/mnt/w/Std/s{i}.pas", [routine(rng) for _ in range(8)], "stdlib")
    add("/mnt/w/Std/vendor/v.pas", [routine(rng) for _ in range(8)], "stdlib")  # its vendor folders are no case
    edited = [p.replace("Update", "Refresh", 1) for p in lib[1][:10]] + [routine(rng)]
    add("C:\\Work\\Team\\copied.pas", edited, case=True)
    add("C:\\Work\\Team\\copied2.pas", lib[2], case=True)
    add("C:\\Work\\Team\\vendor\\x.pas", [routine(rng)], case=True)
    add("C:\\Work\\Team\\licensed.pas", [routine(rng)], head="Licensed under the terms in LICENSE-X.txt", case=True)
    add("C:\\Work\\Team\\gen.pas", [routine(rng)], head="Generated by Tool. Do not edit.", case=True)
    add("C:\\Work\\Team\\gen_de.pas", [routine(rng)], head="Automatisch erzeugt, bitte nicht aendern", case=True)
    add("/mnt/w/Std/gen.pas", [f"function TRow.GetField{i:03d}: Integer;\nbegin\n  Result := FRow.Values[{i}];\nend;" for i in range(20)], "stdlib", case=True)
    rows.append(("C:\\Work\\Team\\m.js", "unknown", "!function(e,t){" + "".join(f"var {a}=q({b},{i});if(!{b}){{{a}={b}|{i}}}" for i, (a, b) in enumerate([("aa", "b"), ("c", "d")] * 40)) + "}", None, "user"))
    rows.append(("C:\\Work\\Team\\blob.inc", "const", "cData: array[0..499] of Byte = (" + ", ".join(f"${rng.randrange(256):02X}" for _ in range(500)) + ");", None, "user"))
    truth |= {"C:\\Work\\Team\\m.js", "C:\\Work\\Team\\blob.inc"}
    rows += [("C:\\Work\\Team\\null.pas", None, None, None, None), (None, "unit", "x", None, "user"), ("C:\\Work\\Team\\notes.txt", "unit", "Generated by X", None, "user")]
    rows += rows[:40]  # rows inserted again
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_path string, type string, content string, comments string, source_category string, lines string")
    folders = spark.createDataFrame([("D:\\Src\\Lib", "third_party"), ("C:\\Work\\Team", "user"), (None, None)], "folder_path string, source_category string")
    return df, folders, truth


def test_not_handwritten(spark, tree):
    df, folders, truth = tree
    got = {r["file_path"]: r for r in handwritten.not_handwritten(df, folders).collect()}
    assert None not in got and "C:\\Work\\Team\\notes.txt" not in got and not got["C:\\Work\\Team\\null.pas"]["not_handwritten"]
    assert {p for p, r in got.items() if r["not_handwritten"]} == truth
    assert got["C:\\Work\\Team\\copied.pas"]["contained_in"] is not None and got["C:\\Work\\Team\\m.js"]["minified"] and got["C:\\Work\\Team\\blob.inc"]["blob"]
    assert handwritten.not_handwritten(df.limit(0), folders.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        src = ["a", "A ", "b-c", "b_c", "big", "big", "big", None][i % 8]
        rows.append((i, " ".join(rng.choice(NAMES) for _ in range(rng.randrange(5, 120))), src, 0))
    rows += [(5000 + i, rows[0][1], "a", 0) for i in range(50)] + [(9000, None, "a", 0), (9001, "  ", "a", 0)]
    plan = [(1, "a", 0.3, 4, 1.0), (1, "B_C", 0.2, 2, 1.0), (1, "big", 0.5, 3, 1.0), (2, "a", 0.5, 1, 0.2), (2, "none", 0.5, 3, 0.2), (3, "b-c", 1.0, 2, 5.0), (1, "a", 0.3, 4, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate int"), spark.createDataFrame(plan, "mix_id int, source string, target_share double, max_repeats int, total_factor double")


def test_mix(spark, corpus):
    docs, plan = corpus
    mixed = mixing.mix(docs, plan)
    rows = mixed.collect()
    caps = {(1, "a"): 4, (1, "b_c"): 2, (1, "big"): 3, (2, "a"): 1, (3, "b_c"): 2}
    assert all(1 <= r["copies"] <= caps[r["mix_id"], r["source"]] for r in rows)
    assert not {r["doc_id"] for r in rows} & {*range(5000, 5050), 9000, 9001}  # a text counts once
    again, outcomes = mixing.mix_and_outcomes(docs, plan)
    sh = {(r["mix_id"], r["source"]): r for r in mixing.shares(again, plan, outcomes).collect()}
    assert {k: r["outcome"] for k, r in sh.items()} == {(1, "a"): "solved", (1, "b_c"): "solved", (1, "big"): "solved", (2, "a"): "solved", (2, "none"): "no_texts", (3, "b_c"): "cap_reached"}
    assert all(abs(r["reached"] - 1) < 0.02 for r in sh.values() if r["outcome"] == "solved") and sh[3, "b_c"]["reached"] < 1
    for s, want in (("a", 0.3), ("b_c", 0.2), ("big", 0.5)):
        assert abs(sh[1, s]["actual_share"] - want) < 0.02
    assert sh[2, "none"]["n_texts"] == 0 and sh[2, "none"]["actual_share"] == 0 and sh[3, "b_c"]["most_copies"] == 2
    assert {r["copies"] for r in rows if r["mix_id"] == 3} == {2}  # out of reach: the cap
    assert mixing.shares(mixing.mix(docs.limit(0), plan), plan).agg({"n_tokens": "sum"}).first()[0] == 0
    assert sorted(map(tuple, mixing.mix(docs, plan).collect())) == sorted(map(tuple, rows))  # the same again


def test_newton_meets_both_constraints(spark):
    rng = random.Random(2)
    hist = [("s", n, rng.randrange(1, 30)) for n in range(5, 400, 7)]
    n, w = sum(c for *_, c in hist), sum(k * c for _, k, c in hist)
    df = spark.createDataFrame(hist, "source string, n_tokens long, count long")
    plan = [{"mix_id": m, "source": "s", "target_share": 1.0, "max_repeats": cap, "total_factor": f} for m, (cap, f) in enumerate([(1, 0.9), (3, 2.5), (6, 0.05), (2, 1.0)])]
    for (m, _), (a, b, mean) in mixing.rates(df, plan, w).items():
        cap, f = plan[m]["max_repeats"], plan[m]["total_factor"]
        r = {k: min(cap, math.exp(min(60, a + b * k / mean))) for _, k, _ in hist}
        assert abs(sum(c * k * r[k] for _, k, c in hist) / (f * w) - 1) < 1e-4
        assert abs(sum(c * r[k] for _, k, c in hist) / (f * n) - 1) < 1e-4
