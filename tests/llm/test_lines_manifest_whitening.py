"""Line dedup, Merkle manifest and whitening against brute force, on nulls, ties, repeated rows, hot keys and clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm import line_dedup, merkle_manifest, whitening

SPACE = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOCS = "doc_id long, text string, source string, lang string, n_chars long, n_lines string, row string, lines int, path string, hash long, key string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# lines


def brute_lines(rows, least):
    key = lambda line: line.strip(SPACE).translate(UPPER)
    seen = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                seen[key(line)].add(("id", doc_id) if doc_id is not None else ("text", text or ""))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(seen[key(x)]) < least]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows():
    rnd = random.Random(5)
    pool = ["Subscribe now", "  SUBSCRIBE NOW\t", "subscribe\x85now", "É page", "é page", "", " ", "\r", "unique", "All rights reserved.\r"]
    rows = [(i, "\n".join(rnd.choice(pool) + (f" {i}" if rnd.random() < 0.3 else "") for _ in range(rnd.randint(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n"), rows[3], rows[3], (3, "All rights reserved.\nagain"), (104, "x\n" * 3000 + "unique")]
    rows += [(None, "unique\nno id"), (None, "unique\nno id"), (None, "other\nno id"), (None, None)]
    return rows


@pytest.mark.parametrize("least", [1, 2, 10])
def test_lines_of_many_documents_go(spark, least):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "s", "en", 1, "clash", "r", 5, "p", 6, "k") for i, t in rows], DOCS).repartition(3)
    got = line_dedup.drop_frequent_lines(docs, least)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    found = got.collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=str) == brute_lines(rows, least)
    assert {(r.row, r["lines"], r.path, r.key) for r in found} == {("r", 5, "p", "k")}


def test_short_keys_and_empty_tables(spark):
    rows = [(i, "ab\nabc\n ABC ") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_frequent_lines(docs, 3, least_chars=3).collect()} == {("ab", 3, 2)}
    assert line_dedup.drop_frequent_lines(docs.limit(0)).count() == 0


def test_a_hot_text_and_a_hot_line(spark):
    """A third of the rows are one text without ids, all rows share a line; every row keeps its result."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("Shared\nrow "), F.col("id"))).otherwise("shared\ncopy").alias("text"),
    )
    got = line_dedup.drop_frequent_lines(docs).groupBy("n_lines", "n_dropped", (F.col("text") == "copy").alias("copy")).count().collect()
    assert sorted(map(tuple, got)) == [(2, 1, False, 2000), (2, 1, True, 1000)]


def test_line_dedup_uses_no_python_worker(spark):
    docs = spark.createDataFrame(line_rows(), "doc_id long, text string")
    plan = line_dedup.drop_frequent_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# manifest


def brute_leaf(doc_id, source, lang, n_chars, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(part, (doc_id, source, lang, n_chars, text)))


def brute_proofs(rows, tampers):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
        return levels

    def steps(levels, at):
        out = []
        for nodes in levels[:-1]:
            run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
            out.append((at % 2, run[1 - at % 2] if len(run) == 2 else ""))
            at //= 2
        return out

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted(langs[x], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r))) for x in order}
    trees = {x: tree([brute_leaf(*r) for r in members[x]]) for x in order}
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for at, r in enumerate(members[x]):
            path = steps(trees[x], at) + steps(top, k)
            node = brute_leaf(*r[:3], r[3] + 1, r[4]) if tampers(r) else brute_leaf(*r)
            for side, sibling in path:
                node = sha(sibling, node) if side else sha(node, sibling)
            out.append((r[0], brute_leaf(*r), trees[x][-1][0], top[-1][0], sha(*[s for _, s in path]), node, node == top[-1][0]))
    return sorted(out, key=str)


def proofs_of(spark, rows, levels=merkle_manifest.LEVELS):
    docs = spark.createDataFrame([(r[0], r[4], r[1], r[2], r[3], "clash", "r", 5, "p", 6, "k") for r in rows], DOCS).repartition(4)
    changed = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle_manifest.proofs(docs, {"n_chars": changed}, levels)
    return sorted(map(tuple, got.collect()), key=str), brute_proofs(rows, lambda r: r[0] is not None and r[0] % 5 == 0 and r[3] is not None)


def test_manifest_equals_a_plain_tree(spark):
    rnd = random.Random(9)
    ids = [*range(700), *(rnd.randint(-(1 << 62), 1 << 62) for _ in range(40)), -(1 << 63), (1 << 63) - 1, 32767, 32768, -1, -32768]
    rows = [(i, rnd.choice(["a", None, ""]), rnd.choice(["en", "de", None, "", "é", "-", "="]), rnd.choice([None, 0, 12]), rnd.choice([None, "", "text", "ü" * 9000])) for i in ids]
    rows += [rows[0], rows[0], rows[1]] + [(7, "s", "en", 3, f"other {k}") for k in range(60)] + [(None, "s", "en", 3, "no id")] * 5 + [(None, None, None, None, None)]
    got, want = proofs_of(spark, rows)
    assert got == want and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2049])
def test_manifest_of_one_language_at_the_block_bounds(spark, n):
    got, want = proofs_of(spark, [(i * 3 + 1, "s", "en", i, "t") for i in range(n)])
    assert got == want


def test_many_tiers_and_hot_rows(spark):
    """Blocks of four slots give many tiers; a third of the rows are one row, and a third share an id."""
    rows = [(5, "s", "en", 1, "same")] * 60 + [(6, "s", "en", 1, f"t{i}") for i in range(60)] + [(100 + i, "s", f"l{i % 23}", 1, "t") for i in range(60)]
    got, want = proofs_of(spark, rows, 2)
    assert got == want


def test_manifest_of_an_empty_table(spark):
    assert merkle_manifest.proofs(spark.createDataFrame([], DOCS)).count() == 0


# whitening


def brute_whitening(rows, components):
    good = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}), dtype=float)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    out = {}
    for i, v in good:
        for k, c in enumerate(order[:components]):
            w = (np.array(v) - s / n) @ vectors[:, c] / np.sqrt(values[c])
            deviation = sum((n * a - int(b)) ** 2 for a, b in zip(v, s))
            out[(i, k + 1)] = (n, deviation, abs(w), values[c] / values.sum())
    return out


def vector_rows(dim=6, n=300):
    rnd = np.random.default_rng(3)
    scales = np.linspace(2, 0.3, dim)
    rows = [(i, [float(c) for c in rnd.normal(size=dim) * scales]) for i in range(n)]
    return rows + [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [None] + [0.0] * (dim - 1))]


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)  # blocks of 64 rows, so that blocks are ragged and many
    monkeypatch.setattr(whitening, "BLOCKS_PER_GROUP", 2)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, hash string, block int").repartition(3)
    got = whitening.whiten(df, 4).collect()
    want = brute_whitening(rows, 4)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, rel=1e-8, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [float("nan")])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0  # one distinct vector: no variance
    mixed = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (None, [0.0, 0.0]), (2, [-1.0, 0.0]), (5, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(mixed, kind)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(r.whitened, 6)) for r in got) == [(0, 1, 3, 0.0), (1, 1, 3, 1.224745), (2, 1, 3, -1.224745), (2, 1, 3, -1.224745)]
    assert {(r.explained, r.deviation) for r in got} == {(1.0, 0), (1.0, 768**2)}


def test_hot_vector_and_huge_entries(spark):
    """A third of the rows are one vector; entries of any size do not crash, and deviations beyond 64 bits are null."""
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("v"))
    df = hot.select(F.col("id").alias("vec_id"), F.array(F.sin("v"), F.cos("v")).cast("array<float>").alias("embedding"))
    got = whitening.whiten(df, 2)
    assert got.count() == 6000 and got.select("n").distinct().collect()[0].n < 2002
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge, 1).collect()
    assert len(found) == 3 and all(np.isfinite(r.whitened) for r in found) and {r.deviation for r in found if r.vec_id < 3} == {None}
