"""The pipeline against a brute-force version of its decisions."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aislegrid.llm import bpe, language_id, pii
from aislegrid.llm.common import fold
from aislegrid.llm.queries import tokenizer_path

from .test_operators import LUHN, brute_components, brute_containment

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, in order."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA)).checkpoint()
        out.append(docs)
    return out


def test_decisions(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs, fold(F.col("doc_id"), 3) != 1))
    kept = {r.doc_id for r in found.where("NOT rejected").collect()}
    assert {r.doc_id for r in stages[0].collect()} == kept
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    firsts = {i for i, (_, _, first) in brute_components(rows).items() if first}
    assert {r.doc_id for r in stages[1].collect()} == firsts and len(firsts) < len(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [r for r in rows if r[0] in firsts]
    leaked = {d for d, _ in brute_containment(rows, items)}
    assert {r.doc_id for r in stages[2].collect()} == firsts - leaked and leaked
    assert all(s.columns == docs.columns for s in stages[:4])


def test_texts_and_ids(spark, stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert {*before} == {*after}
    personal = re.compile(r"[\w.]+@[\w.]+|\d{1,3}(?:\.\d{1,3}){3}|\d{16}|\(\d{3}\) \d{3}-\d{4}|AKIA\w{16}")
    found = lambda text: [x for x in personal.findall(text) if not x.isdigit() or LUHN(x)]  # noqa: E731 - digits with a wrong check digit are no card
    changed = 0
    for i, r in after.items():
        old = {*found(before[i].text)}
        assert not old & {*found(r.text)}
        assert len(found(before[i].text)) == len(found(r.text)) and r.n_chars == len(r.text)
        changed += bool(old)
        if not old and not re.search(pii.HINT.replace(r"\p{L}", "A-Za-z"), before[i].text):
            assert r.text == before[i].text
    assert changed
    wanted = dict(zip(after, bpe.encode_texts(tokenizer_path("word_bpe_49k.json"), [r.text for r in after.values()]), strict=True))
    final = stages[4].collect()
    assert {r.doc_id for r in final} == {*after}
    assert all(np.array_equal(r.ids, wanted[r.doc_id]) for r in final)


def test_run_equals_stages(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(DATA)).collect()) == sorted(r.doc_id for r in stages[4].collect())


def test_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "an item of the benchmark that is quite long")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = "the river and the stone of the garden with silver clouds over the market"
    rows = [(i, f"{words} {i} {words}", "en", None, None) for i in range(30)] + [(40, None, None, None, None), (41, "", "en", "s", 0), (None, words, None, "s", 1), (5, f"{words} 5 {words}", "en", None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).checkpoint()
            if name != "bpe":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert bool(docs.count()) == bool(data)


def test_near_dedup_stage_treats_rows_alike(spark):
    text = "one text of more than five words for this test"
    rows = [(None, text, "b"), (None, text, "b"), (7, "another text that has some words of its own", "z"), (7, "another text that has some words of its own", "a"), (7, "a second text under the same number seven here", "a")]
    for extra in ([], [(9, "a repeated row with other words than all those", "q")] * 2):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string, source string")
        got = sorted((r.doc_id or 0, r.text, r.source) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(DATA)).collect())
        assert got == sorted([(0, text, "b"), (0, text, "b"), (7, rows[3][1], "a"), (7, rows[4][1], "a")] + [(i, t, s) for i, t, s in extra[:1]])
