"""The pipeline against a plain version of each stage, on the smallest tables."""

import pytest

from tests.llm.test_near_copies import plain
from tracemill.llm import decontaminate, near_copies, pii, simhash, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        columns = docs.columns
        docs = stage(spark, docs, sf_dir).cache()
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            model = toxicity.model_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
            margins = model.margins([r.text for r in before], model.gram_scores())
            assert ids == {r.doc_id for r, m in zip(before, margins, strict=True) if toxicity.logistic(model.slope * m + model.shift) < 0.5}
        if name == "near_dedup":
            rows = sorted(before, key=lambda r: r.doc_id)
            assert ids == {rows[i].doc_id for i in plain([r.text for r in rows])}  # from all pairs of sets of five words
        if name == "decontamination":
            index = decontaminate.index_of([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
            hit = [sum(b - a for a, b in cover) for _, cover, *_ in decontaminate.searched([r.text for r in before], index)]
            n = [len(decontaminate.words_of(r.text)) for r in before]
            assert ids == {r.doc_id for r, h, k in zip(before, hit, n, strict=True) if not (h and 20 * h >= k)}
        if name == "pii":
            model, cuts = pii.trained()
            want = {r.doc_id: pii.redacted(r.text, pii.personal_data(r.text, model, cuts)) for r in before}
            assert {r.doc_id: r.text for r in after} == want
            assert not any("@" in s for t in want.values() for s in t.split() if pii.base_spans(s))
        if name == "packing":
            assert ids == {r.doc_id for r in before} and sum(r.piece == 0 for r in after) == len(before)


def small(spark, documents, tables, texts, ids=None, extra=()):
    from pyspark.sql import functions as F

    docs = documents(texts, ids).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in extra})
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nothing like it"), (None, None)], "item_id long, text string")
    return docs, tables(documents=docs, labels=labels, benchmark=items)


def test_stages_on_an_empty_table(spark, documents, tables):
    docs, folder = small(spark, documents, tables, [])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        assert after.count() == 0 and (name == "packing" or after.columns == docs.columns)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_on_odd_rows(spark, documents, tables):
    """Nulls, empty and very long texts, ties, repeated rows and ids, columns that clash with helpers."""
    texts = [None, "", " ", "some words here", "some words here", "other words are there", "mail a@b.co now", "word " * 200_000, "one more of these"]
    ids = [4, 5, 6, 2, 2, 2, 7, 8, None]
    clashes = ["_score", "_id", "_th", "_cover", "_items", "_n_words", "_matches", "s0", "key", "fp", "ids", "length", "component_id", "y"]
    docs, folder = small(spark, documents, tables, texts, ids, clashes)
    rows = sorted(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        found = after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        if name in ("toxicity", "decontamination"):
            assert sorted(map(str, found)) == rows
        if name == "near_dedup":
            assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, "one more of these"), (2, "other words are there"), (2, "some words here"), (4, None), (7, "mail a@b.co now"), (8, "word " * 200_000)]
        if name == "pii":
            assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in found if r.doc_id not in (8, 2)) == [(0, "one more of these", 17), (4, "", 0), (5, "", 0), (6, " ", 1), (7, "mail <EMAIL> now", 16)]
        if name == "packing":
            assert sum(r.piece == 0 for r in found) == len(texts) and all(len(r.ids) == r.length for r in found)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_run_leaves_its_last_table_only(spark, documents, tables, tmp_path, monkeypatch):
    from tracemill.llm import common

    _, folder = small(spark, documents, tables, ["some words here", "other words there", None])
    monkeypatch.setattr(common, "checkpoint_dir", lambda spark: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, folder).count() == 3
    assert [p.name.split("-")[0] for p in (tmp_path / "shared").iterdir() if p.is_dir()] == ["packing"]


def test_a_cluster_names_its_shared_folder(spark):
    from types import SimpleNamespace

    from tracemill.llm import common

    told = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    assert common.checkpoint_dir(told("local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.checkpoint_dir(told(master))


def test_stages_keep_columns_that_clash(spark, documents):
    from pyspark.sql import functions as F

    names = ["_score", "_id", "_th", "_cover", "_items", "_n_words", "_matches"]
    docs = documents(["some words here", "other words there", None]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nothing like it")], "item_id long, text string")
    for after in (toxicity.accepted(docs, labels), simhash.one_of_each(docs), near_copies.one_of_each(docs), decontaminate.decontaminated(docs, items), pii.redact(docs)):
        assert after.columns == docs.columns and sorted(map(str, after.collect())) == sorted(map(str, docs.collect()))
