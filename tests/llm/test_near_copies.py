import numpy as np
import pytest

from tracemill.llm import near_copies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain(texts):
    """The kept positions, from all pairs of sets of five words."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return {g for i, g in enumerate(group) if g == i}


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.mark.parametrize("bucket_rows", [1024, 4])
def test_against_all_pairs(spark, documents, bucket_rows):
    rng, texts = np.random.default_rng(3), [None, "", " ", "one two", "ONE two", "one two three"]
    for _ in range(12):
        words = [f"w{rng.integers(5000)}" for _ in range(150)]
        texts += [" ".join(words), *(edited(rng, words, n) for n in (1, 2, 3, 4, 6, 10))]
    docs = documents(texts)
    found = near_copies.near_duplicates(docs, bucket_rows=bucket_rows).collect()
    assert {r.component_id for r in found} == plain(texts)
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == plain(texts)


def test_pipeline_stage_drops_copies_beyond_three_bits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = {rows[i].doc_id for i in plain([r.text for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()} == want


def test_samples_come_in_rounds_that_leave_none_out():
    for n in (1, 3_000, 3_000_000):
        made = near_copies.rounds(n)
        assert [m for r in made for _, m in r] == near_copies.samples(n) and [k for r in made for k, _ in r] == list(range(len(near_copies.samples(n))))
        assert max(map(len, made)) <= near_copies.ROUND


def test_texts_are_shuffled_once_to_find_representatives(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = spark.createDataFrame([(1, 2, 3, 1)], "doc_id long, th long, root long, component_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.representatives(docs, found)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(_row") == 1, plan


def test_the_distance_table_discards_pairs_and_loses_none():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, (4, 2), dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 2, 7), dtype=np.uint64), axis=2)
    s = np.concatenate([base[rng.integers(0, 4, 400)] ^ flips, rng.integers(0, 1 << 64, (400, 2), dtype=np.uint64)])
    refs = np.concatenate([base, rng.integers(0, 1 << 64, (4, 2), dtype=np.uint64)])
    table = near_copies.distances(s[:, 0], s[:, 1], refs)
    far = np.abs(table[:, None] - table[None]).max(axis=2) > near_copies.MOST_BITS
    differing = np.bitwise_count(s[:, None] ^ s[None]).sum(axis=2, dtype=int)
    assert far.any() and (differing[far] > near_copies.MOST_BITS).all()
    i, j = near_copies.proposed(np.zeros(800, np.int64), np.arange(800), s[:, 0].view(np.int64), s[:, 1].view(np.int64), np.full(800, 2), refs)
    want = {(a, b) for a, b in zip(*np.nonzero(differing <= near_copies.MOST_BITS), strict=True) if a < b}
    assert {(min(a, b), max(a, b)) for a, b in zip(i, j, strict=True)} == want and len(i) == len(want)


def test_sets_are_compared_only_of_pairs_from_the_distance_table(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{rng.integers(5000)}" for _ in range(150)]
    texts = [" ".join(words), *(edited(rng, words, n) for n in (1, 1, 2, 20)), "a b c d e f", "a b c d e f g"] * 2
    s = np.array([near_copies.sketch(near_copies.shingles(t)) for t in texts])
    refs = rng.integers(0, 1 << 64, (4, 2), dtype=np.uint64)
    key, side = np.repeat([1, 2], 7), np.repeat([2, 2], 7)
    given = key, np.arange(14), s[:, 0], s[:, 1], np.array(texts, object), side, 5, refs
    own = near_copies.proposed
    seen = []
    monkeypatch.setattr(near_copies, "proposed", lambda *a: seen.append(own(*a)) or seen[-1])
    i, j = near_copies.decided(*given)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(0, 1), (0, 2), (0, 3), (7, 8), (7, 9), (7, 10)} and len(seen) == 2
    monkeypatch.setattr(near_copies, "distances", lambda s0, s1, refs: 200 * np.arange(len(s0) * len(refs)).reshape(len(s0), -1))
    assert not len(near_copies.decided(*given)[0])  # a table that holds all apart leaves no pair


def test_unlike_texts_are_not_chained_to_one_group(spark, documents, monkeypatch):
    rng, own, sizes = np.random.default_rng(7), near_copies.written, []

    def written(df, label):
        found = own(df, label)
        if label == "loose":
            sizes.extend(r["count"] for r in found.groupBy("key").count().collect())
        return found

    monkeypatch.setattr(near_copies, "written", written)
    docs = documents([" ".join(f"w{w}" for w in rng.integers(0, 1 << 30, 6)) for _ in range(300)])
    assert near_copies.one_of_each(docs).count() == 300
    assert max(sizes, default=0) < 10  # by 128 bits nearly all are one group, whose texts are copied to each of its chunks
