import pytest

from tracemill.llm import packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_the_packed_stage_emits_the_token_ids(spark, documents):
    from tokenizers import Tokenizer

    texts = ["some words here, and more", "other words " * 3000, None]
    rows = corpus_pipeline.packed(spark, documents(texts), "").collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for doc, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
