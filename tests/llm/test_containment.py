import random
from collections import defaultdict

from pyspark.sql import functions as F

from codequarry.llm import handwritten


def test_versions_copies_and_forks_against_brute_force(spark):
    rng = random.Random(5)
    line = lambda: f"  Call{rng.randrange(10**9)}(Value);"
    common = [line() for _ in range(10)]
    parts = {}
    # the copied version has the highest hash of three, so that the others own the lines they share with it
    hashed = spark.createDataFrame([(f"C:\\Work\\vendor\\v{i}.pas",) for i in range(3)], "p string").select("p", F.xxhash64("p").alias("h")).orderBy("h").collect()
    v1, v3, v2 = (r["p"] for r in hashed)
    body = [line() for _ in range(100)]
    parts[v2], parts[v1], parts[v3] = body, body[:40] + [line() for _ in range(60)], body[40:65] + [line() for _ in range(60)]
    parts["C:\\Work\\Team\\full.pas"] = body
    for i in range(30):  # versions and exact copies of a library
        parts[f"C:\\Work\\vendor\\lib{i}.pas"] = common + (parts[f"C:\\Work\\vendor\\lib{i - 1}.pas"][10:] if i % 3 == 2 else rng.sample(body, 20) + [line() for _ in range(15)])
    for i in range(30):
        source = parts[f"C:\\Work\\vendor\\lib{rng.randrange(30)}.pas"]
        taken = rng.sample(source, rng.randrange(8, len(source)))
        parts[f"C:\\Work\\Team\\t{i}.pas"] = taken + [line() for _ in range(len(taken) + rng.choice([-6, -1, 0, 1, 8]))]
    rows = [(p, "procedure", "\n".join(x), None, "user") for p, x in parts.items()]
    df = spark.createDataFrame(rows, "file_path string, type string, content string, comments string, source_category string")
    folders = spark.createDataFrame([], "folder_path string, source_category string")
    got = {r["file_path"]: r for r in handwritten.not_handwritten(df, folders).collect()}
    fid = {r["file_path"]: r["h"] for r in df.select("file_path", F.xxhash64("file_path").alias("h")).collect()}
    lines = {p: set(x) for p, x in parts.items()}
    classes = defaultdict(list)
    for p in parts:
        if "vendor" in p:
            classes[frozenset(lines[p])].append(fid[p])
    seen = set()
    for p in parts:
        if "vendor" not in p:
            n, owner = max((len(lines[p] & c), -min(f)) for c, f in classes.items())
            want = -owner if n >= handwritten.CONTAINED * len(lines[p]) else None
            seen.add(want is not None)
            assert got[p]["contained_in"] == want, p
    assert seen == {True, False} and got["C:\\Work\\Team\\full.pas"]["contained_in"] == fid[v2]
