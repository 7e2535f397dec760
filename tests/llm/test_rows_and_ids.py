"""Rows that share an id or have none, and the classifier's numbers, against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm import decontaminate, ngram_join, seed_extend, shards, toxicity
from tests.llm.test_text_operators import brute_set, prose, sha, words

TWO = "doc_id long, text string"


# substring dedup


def brute_kept_rows(rows, least=20):
    """Per row (doc_id, text): words that stay.  A window goes if it starts earlier in a smaller doc_id, or earlier in the same text."""
    key = lambda d: (d is not None, d or 0)
    windows = {}
    for d, t in rows:
        w = words(t or "")
        for i in range(len(w) - least + 1):
            windows.setdefault(tuple(w[i : i + least]), []).append((key(d), t or "", i))
    out = []
    for d, t in rows:
        w, gone = words(t or ""), set()
        for i in range(len(w) - least + 1):
            if any(k < key(d) or (k == key(d) and text == (t or "") and j < i) for k, text, j in windows[tuple(w[i : i + least])]):
                gone |= set(range(i, i + least))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def test_each_text_of_one_id_loses_its_own_words(spark):
    a, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("a", 30), ("x", 10), ("y", 60)))
    rows = [(1, " ".join(a)), (5, " ".join(x + a)), (5, " ".join(y)), (5, " ".join(y[:25] + y)), (None, prose(1, 50)), (None, prose(2, 50)), (None, prose(1, 50) + " tail"), (9, prose(2, 60) + " " + prose(1, 50))]
    rows += [rows[1], (None, prose(1, 50)), (7, None)]
    got = seed_extend.kept_words(spark.createDataFrame(rows, TWO).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_kept_rows(rows)


# shards


def test_a_group_without_ids_is_split(spark):
    rows = [(None, "x" * 500)] * 400 + [(i, prose(i, 2)) for i in range(100)] + [(7, "y" * 500)] * 200
    got = shards.assign(spark.createDataFrame(rows, TWO), 4).collect()
    size, slots = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and set(size) == {0, 1, 2, 3} and max(size.values()) < 1.35 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (3, "bb"), (3, "other"), (3, "bb"), (4, None)] + [(i, prose(i, 20)) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, TWO)
    shards.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    per = {r.shard: (r.n, r.top) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert set(per) == {0, 1, 2, 3} and all(n == top + 1 for n, top in per.values())


# the pipeline's filters


def test_one_row_of_each_group_stays(spark):
    """Texts equal under several ids, no id and one id twice; another text under a removed id stays."""
    base, other = prose(1, 60), prose(2, 60)
    near = base.replace(base.split()[30], "changed", 1)
    rows = [(None, base, 0), (7, base, 1), (8, near, 2), (8, other, 3), (9, other, 4), (9, other, 5), (10, "", 6), (10, "", 7), (None, None, 8), (11, prose(3, 60), 9), (11, prose(3, 60), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    kept = ngram_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("None", base), ("8", other), ("10", ""), ("10", ""), ("None", ""), ("11", prose(3, 60))])
    assert ngram_join.first_of_groups(docs.limit(0)).count() == 0


def test_contaminated_texts_without_ids_go(spark):
    items = [(1, prose(10, 30)), (None, prose(11, 30)), (1, prose(12, 30)), (2, None), (3, "")]
    bad = [prose(50 + k, 10) + " " + t + " tail" for k, (_, t) in enumerate(items[:3])]
    rows = [(1, bad[0]), (None, bad[0]), (None, bad[1]), (5, bad[2]), (5, prose(70, 40)), (5, bad[2]), (None, None), (6, ""), (7, prose(71, 40))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], TWO + ", keys string")
    kept = decontaminate.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    sets = [brute_set(t) for _, t in items if t]
    want = [r for r in rows if not any(len(s & brute_set(r[1] or "")) >= 0.75 * len(s) for s in sets)]
    assert len(want) == 4 and kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


# toxicity


def toxic_rows(n=240):
    rnd = random.Random(3)
    return [(i, prose(i, rnd.randint(5, 40)) + (" vile scoundrel" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(n)]


def test_counts_ratios_and_scores_by_hand(spark):
    """Counts of every bucket over all labelled rows, their log ratios, and a score from weights and bias."""
    rows = toxic_rows()
    df = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int").repartition(4)
    ratio = toxicity.log_count_ratios(df)
    count = np.zeros((2, len(ratio)))
    for _, t, y in rows:
        count[y, toxicity.features(t)] += 1
    n = [sum(y == k for *_, y in rows) for k in (0, 1)]
    want = np.log((count[1] + 1) / (n[1] + 2)) - np.log((count[0] + 1) / (n[0] + 2))
    assert ratio == pytest.approx(np.where(count.sum(axis=0) > 0, want, 0.0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], TWO)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).collect():
        z = sum(float(model.weights[b]) for b in toxicity.features(r.text)) + model.bias
        assert r.toxicity == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
    held = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(held[i] == y for i, _, y in rows if i in held) >= 0.9 * len(held)


def test_the_regression_stands_at_its_minimum(spark):
    """Steps summed by Spark reach the point where the gradient, taken in one go, is nearly zero."""
    rows = toxic_rows(80)
    scale = np.zeros(1 << toxicity.BUCKET_BITS)
    found = [np.unique(toxicity.features(t) % 40) for _, t, _ in rows]
    scale[:40] = np.linspace(-1, 1, 40)
    sample = spark.createDataFrame([(y, 1 / len(rows), bytearray(f.astype("<i4").tobytes())) for f, (_, _, y) in zip(found, rows)], "label int, share double, buckets binary").repartition(3)
    weights, bias = toxicity.logistic(sample, scale, 0.0, ridge=1e-2, steps=100)
    x = np.zeros((len(rows), 40))
    for i, f in enumerate(found):
        x[i, f] = scale[f]
    y = np.array([r[2] for r in rows])
    w = np.divide(weights[:40], scale[:40], out=np.zeros(40), where=scale[:40] != 0)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - y) / len(y) + 1e-2 * w).max() < 2e-3 and abs((p - y).mean()) < 2e-3
    loss, grad, error = toxicity.gradient(sample, weights, bias)
    assert loss == pytest.approx(-(np.log(np.where(y == 1, p, 1 - p))).mean()) and error == pytest.approx((p - y).mean(), abs=1e-9)


def test_spot_signatures_stage_no_results(spark, monkeypatch):
    from cellframe.llm import spot_signatures

    monkeypatch.setattr(spot_signatures, "materialise", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    rows = [(None, "z y"), (None, "a b"), (3, None), (3, "x"), (7, "the cat and the dog"), (2, "of a thing " * 40), (9, "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = spot_signatures.against_next(docs, chars_per_task=60).collect()
    order = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sets = [spot_signatures.signatures(t) for _, t in order]
    want = [spot_signatures.compared(*order[i], sets[i], order[(i + 1) % len(order)][1], sets[(i + 1) % len(order)]) for i in range(len(order))]
    assert sorted(map(str, (r.asDict() for r in got))) == sorted(map(str, want))
