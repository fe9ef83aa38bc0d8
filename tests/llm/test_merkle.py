import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crawlspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string, root string, __tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests, arity):
    """(the top, the siblings of each leaf as (before, after) for each level)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, place in enumerate(at):
            run = digests[place // arity * arity : place // arity * arity + arity]
            paths[leaf].append(("".join(run[: place % arity]), "".join(run[place % arity + 1 :])))
        at = [place // arity for place in at]
        digests = [h(*digests[i : i + arity]) for i in range(0, len(digests), arity)]
    return digests[0], paths


def brute(rows, arity):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g])], arity) for g in order}
    root, upper = climb([tops[g][0] for g in order], arity) if order else (None, [])
    out = []
    for g, above in zip(order, upper, strict=True):
        for (_, i, leaf), path in zip(sorted(groups[g]), tops[g][1], strict=True):
            out.append((i, leaf, tops[g][0], root, tuple(path + above)))
    return sorted(out)


def run(spark, rows, arity):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    docs = docs.withColumn("leaf", merkle.leaf_digest("doc_id", "source", "lang", "n_chars", "text"))
    out = merkle.merkle_paths(docs, "lang", ["doc_id"], carry=["doc_id"], arity=arity)
    return out.withColumn("folded", merkle.folded("leaf")).withColumn("proof", merkle.proof_digest())


@pytest.mark.parametrize("arity", [2, 8])
def test_against_brute_force(spark, arity):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ü") for i in range(75)]
    rows += [(100 + i, None, "de", None, None if i % 2 else "") for i in range(9)]
    rows += [(200, "s", "fr", 1, "alone"), (201, "s", None, 1, "x" * 100_000), (202, "s", None, 1, "y"), (None, None, "de", None, None), (203, "s", "", 1, "empty lang")]
    rows += [(50, "again", "en", 1, "repeated id"), (100, None, "de", None, "")]
    out = run(spark, rows, arity).collect()
    got = sorted((r.doc_id or 0, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in out)
    assert got == brute(rows, arity)
    assert all(r.folded == r.root and r.proof == h(*[s.before + s.after for s in r.path]) for r in out)


def test_one_row_and_no_rows(spark):
    (one,) = run(spark, [(1, "s", "en", 1, "t")], 8).collect()
    assert one.leaf == one.subroot == one.root == one.folded and one.path == [] and one.proof == h("")
    assert run(spark, [], 8).collect() == []


def test_a_changed_leaf_gives_another_root(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(20)]
    out = run(spark, rows, 8).withColumn("other", merkle.folded(F.sha2(F.lit("other").cast("binary"), 256)))
    assert out.where("other = root").count() == 0


def test_a_group_of_equal_rows(spark):
    rows = [(1, "s", "en", 1, "same")] * 100
    out = run(spark, rows, 8)
    assert out.count() == 100 and out.where("folded <> root").count() == 0
