import random

from codequarry.queries import QUERIES


def brute(t):
    """The heading character by character."""
    if t is None or len(t) < 300:
        return t
    i = depth = 0
    while i < len(t):
        skip = next((end for start, end in (("{", "}"), ("(*", "*)"), ("//", "\n"), ("'", "'")) if t.startswith(start, i) for end in [end]), None)
        if skip:
            i = t.find(skip, i + (2 if t[i] in "(/" else 1))
            if i < 0:
                break
            i += len(skip)
            continue
        depth += (t[i] == "(") - (t[i] == ")")
        if depth == 0 and t[i] == ";":
            return t[: i + 1]
        word = ""
        while i < len(t) and (t[i].isalnum() or t[i] == "_"):
            word += t[i]
            i += 1
        if depth == 0 and word.lower() in ("var", "const", "begin", "asm"):
            return t[: i - len(word)].rstrip() or t[:300]
        i += not word
    return t.rstrip()


def test_headings_of_all_routines(spark, tmp_path):
    rng = random.Random(7)
    rows = [(1, "function", None), (2, "procedure", "procedure A;"), (3, "class", "x" * 400), (4, "Procedure", "procedure B(" + "; ".join(f"A{i}: Integer" for i in range(60)) + ")"), (5, "function", "begin " + "x; " * 200), (6, "FUNCTION", "function C: Integer\nbegin\n" + "y; " * 200)]
    for i in range(10, 60):
        head = rng.choice(["", "{ a; begin }\n", "// it's; var\n", "(* const; ) *)\n"])
        params = "; ".join(rng.choice([f"const A{k}: string = ';'", f"var B{k}: Integer", f"C{k}: T{k} { '{;}' }"]) for k in range(rng.randrange(1, 30)))
        rows.append((i, rng.choice(["function", "procedure"]), f"{head}procedure P{i}({params}){rng.choice([';', ';', chr(10) + 'var q: Integer;'])}\nbegin\n" + "z := 1;\n" * rng.randrange(60) + "end;"))
    spark.createDataFrame(rows, "id long, type string, content string").write.parquet(f"{tmp_path}/symbols.parquet")
    got = {r["id"]: r["heading"] for r in QUERIES["method_signatures"](spark, str(tmp_path)).collect()}
    assert sum(len(t or "") >= 300 for _, _, t in rows) > 20
    assert got == {i: brute(t) for i, kind, t in rows if kind != "class"}
