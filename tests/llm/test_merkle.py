"""The Merkle manifest against a tree built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("docflow.llm")
from docflow.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    found = []
    for level in tree[:-1]:
        run = i // 3 * 3
        found.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return found


def brute(rows):
    """By (doc_id, leaf): subroot, root, proof, folded root, verified."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(((r[0] is not None, r[0] or 0), leaf(r, r[4])) for r in groups[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = {}
    for k, s in enumerate(order):
        mine = sorted((((r[0] is not None, r[0] or 0), leaf(r, r[4]), r) for r in groups[s]), key=lambda x: x[:2])
        for i, (_, own, r) in enumerate(mine):
            path = siblings(trees[s], i) + siblings(top, k)
            even = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for left, right in path:
                node = H("".join(left) + node + "".join(right))
            out.setdefault((r[0], own), []).append((trees[s][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return out


def held(frame, rows, depth):
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    got = {}
    for r in merkle.manifest(frame, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))), depth).collect():
        got.setdefault((r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]))
    want = brute(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 9, 10, 28, 82, 100])
def test_traversal(n):
    leaves = [H(str(i)) for i in range(n)]
    tree = levels(leaves)
    assert merkle.height(n) == len(tree) - 1 and merkle.root_of(leaves, merkle.height(n)) == tree[-1][0]
    want = [[("".join(a), "".join(b)) for a, b in siblings(tree, i)] for i in range(n)]
    assert list(merkle.traverse(leaves, merkle.height(n))) == want


def test_manifest(spark):
    odd = [(None, None, None, None, None), (None, None, None, None, None), (7, None, "en", 0, ""), (1, "", "ü", -3, "é\n🙂\n"), (2, "one", None, 1, "\n"), (2, "one", None, 1, "\n"), (2, "one", "x", 1, "other"), (5, "ß", "de", 9, "x\n" * 50_000)]
    rows = odd + [(i, "hot", "en", i, f"text {i}\nmore") for i in range(130)] + [(i, f"s{i}", "en", i, "y") for i in range(200, 231)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", leaf string")
    for depth in (1, 2, 5):  # blocks of 3 and of 9 leaves need several storeys
        held(frame, rows, depth)
    assert merkle.manifest(frame.limit(0)).count() == 0
    assert merkle.manifest(frame).where("not verified").count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows)
    got = merkle.op12_merkle(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    assert all(want[r["doc_id"], r["leaf"]] == [(r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])] for r in got)
    assert {r["verified"] for r in got} == {True, False}
