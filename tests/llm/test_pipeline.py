"""The pipeline against a plain version of its stages, on the smallest tables."""

import os
import re

import pytest

import corpus_pipeline
from tests.llm.test_dealt import brute_components, brute_fingerprint
from wickline.llm import pii, toxicity
from wickline.llm.common import table
from wickline.llm.queries import default_vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_run_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels", "doc_id", "toxic"))
    left = {r.doc_id: r for r in toxicity.score(docs, model).collect() if r.score < toxicity.THRESHOLD}
    prints = {i: brute_fingerprint(r.text) for i, r in left.items()}
    roots = brute_components(list(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    left = {i: left[i] for i in first.values()}
    items = [g for g in (grams(r.text) for r in table(spark, SF, "benchmark").collect()) if g]
    left = {i: r for i, r in left.items() if not any(len(g & grams(r.text)) >= 0.8 * len(g) for g in items)}
    finder, own = pii.Finder(pii.train(pii.training_table())), Tokenizer.from_file(default_vocabulary())
    want = {}
    for i, r in left.items():
        out, at = "", 0
        for _, s, e, kind in sorted((0, s, e, k) for k, s, e, _ in finder.spans([r.text or ""])[0]):
            if s >= at:
                out += r.text[at:s] + f"<{kind}>"
            at = max(at, e)
        want[i] = own.encode(out + (r.text or "")[at:], add_special_tokens=False).ids
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.restored for r in got)
    assert len(got) == len(want)


def test_every_stage_on_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names, an empty table."""
    from pyspark.sql import functions as F

    from tests.llm.test_dealt import prose

    a, b = prose(80, 71), prose(90, 72)
    rows = [(1, a, "en", "s", 1), (None, b, None, None, None), (None, prose(60, 73), "en", "s", 2), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "  \n ", "en", "s", 4), (5, a, "en", "s", 1), (5, a, "en", "s", 1), (5, prose(70, 74), "en", "s", 9), (6, prose(20000, 75), "en", "s", 7), (7, 'key: "04dbebab91ab85687d33eeaaf9ac699e1188f962" a.b@c.example', "en", "s", 3)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit(c) for c in ("id", "key", "fp", "ids", "decoded", "digest", "score", "pii", "__n", "item", "h", "t", "n", "n_tokens", "first")}
    docs = spark.createDataFrame(rows, kinds).withColumns(clash)
    kept = {"toxicity": len(rows), "simhash_near_dedup": 7, "benchmark_decontamination": len(rows), "pii_masking": len(rows), "bpe_encoding": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert len(got) == kept[name], name
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "bpe_encoding":
            assert out.columns == docs.columns and all(r.n_tokens == "n_tokens" for r in got), name
            assert sum(r.doc_id is None for r in got) == 2, name
        else:
            assert all(r.restored for r in got) and sum(r.n_tokens == 0 for r in got) == 2
        if name == "simhash_near_dedup":
            left = sorted(str((r.doc_id, (r.text or "")[:20])) for r in got)
            assert left == sorted(map(str, [(1, a[:20]), (None, b[:20]), (None, rows[2][1][:20]), (2, ""), (5, rows[8][1][:20]), (6, rows[9][1][:20]), (7, rows[10][1][:20])]))
        if name == "pii_masking":
            masked = next(r for r in got if r.doc_id == 7)
            assert masked.text == 'key: "<secret>" <email>' and masked.n_chars == len(masked.text) and next(r for r in got if r.doc_id == 2).text is None
