"""Merkle proofs against a plain tree."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from fleetloom.llm import merkle, queries
from fleetloom.llm.common import LOWER, UPPER

TABLE = str.maketrans(UPPER, LOWER)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fan):
    """Root, and the steps of every leaf."""
    steps, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p // fan * fan
            steps[i].append(("".join(level[first:p]), "".join(level[p + 1 : first + fan])))
            at[i] = p // fan
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], steps


def expected(rows, fan=16):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (first(r[0]), leaf_of(r)))
        trees.append((ordered, *tree([leaf_of(r) for r in ordered], fan)))
    root, over = tree([t[1] for t in trees], fan)
    out = []
    for (ordered, subroot, steps), more in zip(trees, over):
        for r, own in zip(ordered, steps):
            own = own + more
            tampered = r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            at = leaf_of((*r[:4], r[4].translate(TABLE))) if tampered else leaf_of(r)
            for left, right in own:
                at = h(left, at, right)
            out.append((r[0], leaf_of(r), subroot, root, h(*[x for s in own for x in s]), at, at == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, **extra):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("k", "g", "h", "c", "tie", "tree", "pos", "up", "slot", "steps", "row_no", "first"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES["op13_merkle_windows"](spark, str(tmp_path))


def awkward(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "b", "Bé", "京", "", None]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["A b", "x" * i, "", None, "Ü" * 5 + "Z"])) for i in range(n)]
    return rows + [(None, "b", None, None, None), (None, "b", None, None, "Q"), (7, "b", "en", 1, "Same"), (7, "b", "en", 1, "Same"), (7, "b", "en", 1, "Other"), (10_000, "alone", "en", 3, "Only One")]


@pytest.mark.parametrize("n", [0, 40, 700])
def test_proofs_equal_a_plain_tree(spark, tmp_path, n):
    rows = awkward(n)
    found = run(spark, rows, tmp_path)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == expected(rows)
    assert n == 0 or {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    (r,) = run(spark, [(1, None, None, None, "long " * 100_000)], tmp_path / "one").collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == h()
    assert run(spark, [], tmp_path / "none").collect() == []


def test_other_fan_and_fields(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(29)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.merkle_proofs(df, ["doc_id", "text"], "source", "doc_id", fan=3).orderBy("doc_id").collect()
    root, steps = tree([leaf_of((r[0], r[4])) for r in rows], 3)
    assert [[(s["left"], s["right"]) for s in r.steps] for r in found] == steps
    assert {r.root for r in found} == {root} and all(r.leaf == r.claimed for r in found)
