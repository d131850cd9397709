"""Merkle manifest against a plain tree, with small partitions so that several butterfly rounds run."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from msgsift.llm import merkle

# extra columns named like internal ones
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, path string, root int, at int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", n, "x", "y", 1, 2) for i, t, lang, n in rows], SCHEMA)


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(i, t, lang, n):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, "s", lang, n, t)])


def _tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([_h(*row[k:k + fanout]) for k in range(0, len(row), fanout)])
    return out


def _path(tree, k, fanout):
    path = []
    for level in tree[:-1]:
        lo = k - k % fanout
        path.append((k - lo, [level[x] for x in range(lo, min(lo + fanout, len(level))) if x != k]))
        k //= fanout
    return path


def _brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        leaves = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        trees[lang] = (leaves, _tree([_leaf(*r) for r in leaves], fanout))
    top = _tree([trees[x][1][-1][0] for x in langs], fanout)
    return [(r[0], _leaf(*r), _path(tree, k, fanout) + _path(top, j, fanout), tree[-1][0], top[-1][0])
            for j, lang in enumerate(langs) for leaves, tree in [trees[lang]] for k, r in enumerate(leaves)]


def _rows(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, "text %d é" % rng.randrange(9), rng.choice(["en"] * 6 + ["fr", "de", "É", ""]), rng.randrange(99)) for i in range(n)]
    rows += [(None, "no id", "en", 3), (None, None, None, None), (4, "", "lone", 0), (7, "again", "en", 1), (7, "again", "en", 1),
             (7, "other", "en", 1), (n + 5, "long " * 50_000, "fr", 9)]
    rng.shuffle(rows)
    return rows


def _got(df):
    return sorted(((r.doc_id, r.leaf, [(s["at"], s["others"]) for s in r.path], r.subroot, r.root) for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout,leaves", [(2, 4), (3, 9), (2, 4096), (5, 4)])
def test_manifest_matches_plain_trees(spark, fanout, leaves):
    rows = _rows(75)
    got = _got(merkle.manifest(_docs(spark, rows), fanout=fanout, partition_leaves=leaves))
    assert got == sorted(_brute(rows, fanout), key=str)


def test_empty_and_lone_rows(spark):
    docs = _docs(spark, [(1, "a", "en", 1)])
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs).first()
    assert one.path == [] and one.leaf == one.subroot == one.root == _leaf(1, "a", "en", 1)


def test_tampered_rows_do_not_verify(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "fr", None if i % 5 == 0 else i) for i in range(60)]
    docs = _docs(spark, rows)
    found = merkle.leaf_digest([*({c: docs[c] for c in merkle.FIELDS} | {"n_chars": docs["n_chars"] + 1}).values()])
    out = merkle.manifest(docs, leaves={"leaf": merkle.leaf_digest([docs[c] for c in merkle.FIELDS]), "found": found},
                          partition_leaves=8)
    got = out.select("doc_id", "root", merkle.root_from(F.col("leaf"), F.col("path")).alias("as_written"),
                     merkle.root_from(F.col("found"), F.col("path")).alias("as_found"),
                     merkle.proof_digest(F.col("path")).alias("proof"), "path").collect()
    for r in got:
        assert r.as_written == r.root
        assert (r.as_found == r.root) == (r.doc_id % 5 == 0)       # adding to a null changes nothing
        assert r.proof == _h(*[x for s in r.path for x in s["others"]])


def test_query_checks_the_rows_its_rule_names(spark):
    from msgsift.llm.queries import op12_merkle_manifest
    got = op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got)
