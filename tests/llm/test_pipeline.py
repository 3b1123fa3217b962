import re
from collections import Counter

import corpus_pipeline
from marlow.llm import packing
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as personal
from tests.llm.test_substring import brute as repeats


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == names
            out = corpus_pipeline.written(out, name)
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        elif name == "near_copies":
            assert set(after) == {d for d, c, _ in near(before) if d == c}
        elif name == "passages":
            want = {d: t for d, n, k, t in repeats(before, 50) if not n or k < n}
            assert {d: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in after.items()} == want
        elif name == "personal_data":
            assert not any(personal(t) for t in after.values()) and any(personal(t) for _, t in before)
            assert all(after[d] == t or "[IBAN]" in after[d] or "[US_SSN]" in after[d] for d, t in before if not personal(t))
        else:
            check(out.collect(), Counter({d: n for d, t in before if (n := len(re.findall(r"[^\x20\x09-\x0D]+", t)))}), packing.LONGEST, packing.BUDGET)
        docs = out


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
