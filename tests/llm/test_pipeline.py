"""The pipeline against plain Python on the smallest table."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from .test_operators import SF, plain_lines, plain_near, plain_substrings, plain_verdict


@pytest.fixture(scope="module")
def plain(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {i: t for i, t in texts.items() if plain_verdict(t, 1)}
    texts = {i: t for i, (t, _) in plain_lines(texts).items()}
    first = plain_near(texts)
    texts = {i: t for i, t in texts.items() if first[i] == i}
    out = {}
    for i, spans in plain_substrings(texts).items():
        t, at, own = texts[i], 0, ""
        for a, e in spans:
            own, at = own + t[at:a], e
        out[i] = own + t[at:]
    return out


def test_run_equals_the_plain_version(spark, plain):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in plain.items():
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        want |= {(i, k // 4096): (k, min(4096, n - k)) for k in range(0, n, 4096)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length) for r in got} == want and len(got) == len(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "substring dedup", "best-fit packing"]
