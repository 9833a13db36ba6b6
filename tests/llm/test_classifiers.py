"""Held-out accuracy, and the defined results at the edges."""

import random
import zlib

import numpy as np
import pytest

from tracemill.llm import labelled, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "ha", "es"]) for _ in range(rng.randint(1, 4)))
    insult = lambda: rng.choice(["idiot", "stupid", "moron", "loser"]) + rng.choice(["", "s", "ic", word()[:2]])
    texts, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        words = [word() for _ in range(rng.randint(20, 200))]
        if toxic:
            words[rng.randrange(len(words))] = insult()
        if not good:
            words = [w.upper() + "!!" if not toxic or not w.startswith(("idiot", "stupid", "moron", "loser")) else w for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(good), int(toxic)))
    return texts, labels


@pytest.mark.parametrize(("op", "column", "least"), [("toxicity", 2, 0.9), ("quality", 1, 0.95)])
def test_held_out_accuracy(spark, documents, tables, op, column, least):
    texts, labels = corpus()
    docs = documents([*texts, None, ""], [*range(len(texts)), 1000, 1001]).withColumnRenamed("source", "score").withColumnRenamed("lang", "y")
    folder = tables(documents=docs, labels=spark.createDataFrame(labels, LABELS))
    run = toxicity.op10_toxicity if op == "toxicity" else quality.op2_quality
    rows = {r.doc_id: r for r in run(spark, folder).collect()}
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows.values())
    threshold = 0.5 if op == "toxicity" else 0.3
    right = []
    for i, row in rows.items():
        assert row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and row.predicted == int(row.score >= threshold)
        if row.held_out and i < len(texts):
            right.append(row.predicted == labels[i][column])
    assert np.mean(right) >= least
    # held-out labels are never learnt from
    other = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in run(spark, tables(documents=docs, labels=spark.createDataFrame(other, LABELS))).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in rows.items())


@pytest.mark.parametrize("run", [toxicity.op10_toxicity, quality.op2_quality])
def test_edges(spark, documents, tables, run):
    none = spark.createDataFrame([], LABELS)
    assert run(spark, tables(documents=documents([]), labels=none)).count() == 0
    expect = 0 if run is toxicity.op10_toxicity else 1
    assert [r.predicted for r in run(spark, tables(documents=documents(["a", None]), labels=none)).collect()] == [expect] * 2
    one = spark.createDataFrame([(1, 1, 1), (1, None, None), (None, 1, 1)], LABELS)
    assert [r.predicted for r in run(spark, tables(documents=documents(["a", "b", "word " * 30_000]), labels=one)).collect()] == [1] * 3


def test_accepted_keeps_clean_documents(spark, documents):
    texts, labels = corpus(300, 1)
    kept = toxicity.accepted(documents(texts), spark.createDataFrame(labels, LABELS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(clean & ids) >= 0.95 * len(clean) and len(ids - clean) <= 0.15 * (len(labels) - len(clean))


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.sign(x @ np.array([1.0, -2, 0.5, 0, 1]) + 0.3)
    rows = [np.arange(5)] * 200
    w, b = quality.dual_descent(rows, list(x), y, np.full(200, 10.0), 5, epochs=200)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97


def test_misspellings_share_vectors():
    texts, labels = corpus(400, 2)
    model = toxicity.train([(t, y) for t, (_, _, y) in zip(texts, labels, strict=True)], {0: 1.0, 1: 1.0})
    margins = model.margins(["stupidd", "idiott", "moronn", "anerti", "hationes"], model.gram_scores())
    assert margins[:3].min() > margins[3:].max()


def test_platt_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    m = rng.normal(size=4000)
    y = (rng.random(4000) < labelled.logistic(3 * m - 1)).astype(float)
    a, b = labelled.platt(m, y, np.ones(4000))
    assert abs(a - 3) < 0.4 and abs(b + 1) < 0.2


def test_long_clean_texts_stay_clean():
    texts, labels = corpus(500, 4)
    model = toxicity.train([(t, y) for t, (_, _, y) in zip(texts[:400], labels, strict=False)], {0: 1.0, 1: 1.0})
    clean = [t for t, (_, _, y) in zip(texts[400:], labels[400:], strict=True) if not y][:10]
    called = lambda many: toxicity.logistic(model.slope * model.margins(many, model.gram_scores()) + model.shift) >= 0.5
    for k in (1, 10, 100, 1000):
        assert not called([f"{t} " * k for t in clean]).any()
    assert called([f"{t} moron " * 100 for t in clean]).all()


def plain_grams(word):
    marked, out = f"<{word}>", [zlib.crc32(word.encode()) % toxicity.BUCKETS]
    for n in range(toxicity.SHORT, toxicity.LONG + 1):
        for i in range(len(marked) - n + 1):
            h = sum(ord(c) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(marked[i : i + n])) + (n << 50)
            out.append((h * 0x9E3779B97F4A7C15) % (1 << 64) >> 48)
    return out


def test_toxicity_scores_as_defined():
    texts, labels = corpus(60, 5)
    model = toxicity.train([(t, y) for t, (_, _, y) in zip(texts, labels, strict=True)], {0: 1.0, 1: 1.0}, epochs=(3, 3))
    some = ["Idiot", "réunion été 日本語 x", None, "", "a a b", texts[0]]
    side = model.softmax[:, 1] - model.softmax[:, 0]
    for text, margin in zip(some, model.margins(some, model.gram_scores()), strict=True):
        words = [w.decode() for w in toxicity.words_of(text)] or [""]
        odds = [np.mean([model.embedding[b] for b in plain_grams(w)], axis=0) @ side for w in words]
        assert abs(margin - (np.log(np.mean(np.exp(odds))) + model.bias[1] - model.bias[0])) < 1e-4


@pytest.mark.parametrize("plain", [True, False])
def test_toxicity_gradients_against_differences(plain):
    texts, labels = corpus(12, 6)
    sample = toxicity.sample_of([(t, i % 2) for i, t in enumerate(texts)])
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.WIDTH)), rng.normal(0, 0.3, (toxicity.WIDTH, 2)), rng.normal(0, 0.3, 2))
    weight, decay = rng.random(12), 1e-3

    def loss():
        m = sample.margins(model)
        each = [m[a : a + n] for a, n in zip(sample.first, sample.lengths, strict=True)]
        z = np.array([x.mean() if plain else np.log(np.exp(x).mean()) for x in each])
        return (weight * (np.logaddexp(0, z) - sample.y * z)).sum() + 0.5 * decay * (model.embedding**2).sum()

    for part, gradient in zip((model.embedding, model.softmax, model.bias), sample.gradients(model, weight, plain, decay), strict=True):
        for at in np.argsort(-np.abs(gradient).ravel())[:4]:
            place, step, before = np.unravel_index(at, part.shape), 1e-5, part.ravel()[at]
            part[place] = before + step
            up = loss()
            part[place] = before - step
            down = loss()
            part[place] = before
            assert abs((up - down) / (2 * step) - gradient[place]) < 1e-5 * max(1, abs(gradient[place]))


def test_dual_descent_solves_the_program():
    rng = np.random.default_rng(2)
    x, y, cost = rng.normal(size=(40, 6)), rng.choice([-1.0, 1.0], 40), rng.uniform(0.2, 2, 40)
    w, b = quality.dual_descent([np.arange(6)] * 40, list(x), y, cost, 6, epochs=5000, tolerance=1e-9)
    z = np.hstack([x, np.ones((40, 1))]) * y[:, None]
    dual, rate = np.zeros(40), 1 / np.linalg.eigvalsh(z @ z.T)[-1]
    for _ in range(60_000):  # projected gradient ascent of the dual
        dual = np.clip(dual + (1 - z @ (z.T @ dual)) * rate, 0, cost)
    value = lambda v: 0.5 * (v @ v) + (cost * np.maximum(0, 1 - z @ v)).sum()
    assert abs(value(np.append(w, b)) - value(z.T @ dual)) < 1e-4 * value(z.T @ dual)


def plain_indicators(text):
    import re

    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    forms = [quality.REPEAT if i and t == tokens[i - 1] else zlib.crc32(quality.shape(t).encode()) for i, t in enumerate(tokens)]
    out, mix = {zlib.crc32(t.lower().encode()) % quality.BUCKETS for t in tokens}, 0x9E3779B97F4A7C15
    for i in range(len(forms)):
        h = forms[i] * mix % (1 << 64)
        out.add(h >> 46)
        for n in (1, 2):
            if i + n < len(forms):
                h = (h ^ (forms[i + n] + n)) * mix % (1 << 64)
                out.add(h >> 46)
    return sorted(out)


def test_quality_as_defined(spark):
    texts, labels = corpus(80, 7)
    for t in [*texts[:10], None, "", "Aa bb bb BB !! 1x", "één, één"]:
        assert quality.indicators(t).tolist() == plain_indicators(t)
    rows = [(t, q) for t, (_, q, _) in zip(texts, labels, strict=True)]
    ratio = quality.ratios(spark.createDataFrame(rows, "text string, y int").repartition(3))
    counts = np.ones((2, quality.BUCKETS))
    for t, q in rows:
        counts[q, plain_indicators(t)] += 1
    assert np.allclose(ratio, np.log(counts[1] / counts[1].sum() * counts[0].sum() / counts[0]), atol=1e-5)
    model = quality.train(rows, ratio, {0: 1.0, 1: 1.0})
    for t in [*texts[:5], None]:
        at = plain_indicators(t)
        margin = sum(float(model.weight[i]) for i in at) / (np.sqrt(sum(float(ratio[i]) ** 2 for i in at)) or 1) + model.bias
        assert abs(model.score(t) - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-6


def test_a_repeated_id_gives_one_row_to_learn_from(spark, documents):
    docs = documents([f"text {i}" for i in range(50)] + ["other", None], [7] * 50 + [8, 8])
    known = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, y int")
    rows = labelled.sample(docs, known, {1: 5, 0: 5}).collect()
    assert sorted((r.id, r.y) for r in rows) == [(7, 1), (8, 0)]
    assert labelled.sample(docs, known, {1: 5, 0: 5}, most_bytes=6).count() < 2
