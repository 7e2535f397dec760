"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import os
import random

import pytest

import corpus_pipeline
from cellframe.functions.lineage import materialise
from cellframe.llm import toxicity
from tests.llm.test_text_operators import BYTE_BPE, brute_groups, brute_secrets, brute_set, local, prose

pytestmark = pytest.mark.skipif(not os.path.isfile(BYTE_BPE), reason="tokenizer files absent")


def test_stages_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd, item = random.Random(8), prose(900, 30)
    rows = [(i, prose(i, rnd.randint(20, 60)) + (" vile scoundrel" if i % 6 == 0 else ""), "en", f"s{i % 3}", 7) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " again", "en", "s", 7) for i in range(1, 20)]
    rows += [(300, "before " + item + " after", "en", "s", 7), (301, "password=abcdef99 " + prose(950, 20), None, None, None), (302, None, None, None, None), (303, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "secret_scan", "bpe"]
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = local(docs)
        out = materialise(stage(spark, docs, str(tmp_path)))
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out
        after = local(out)
        if name == "toxicity":
            assert after == [r for r in before if model.score(r[1]) < toxicity.THRESHOLD]
            assert len(after) < len(before)
        elif name == "ngram_join":
            assert [d for d, _ in after] == sorted(d for d, _, root in brute_groups(before) if d == root)
        elif name == "decontamination":
            s = brute_set(item)
            assert after == [r for r in before if len(s & brute_set(r[1])) < 0.75 * len(s)] and len(after) < len(before)
        elif name == "secret_scan":
            assert [r for r in before if not brute_secrets(r[1])] == [r for r in after if "[SECRET]" not in r[1]]
            assert dict(after)[301].startswith("[SECRET] ")
        else:
            library = Tokenizer.from_file(BYTE_BPE)
            want = {d: library.encode(t, add_special_tokens=False).ids for d, t in before}
            assert {r.doc_id: r.ids for r in out.collect()} == want and after == before
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == [d for d, _ in local(docs)]
