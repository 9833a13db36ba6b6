"""Packing, media and shards: exact round trips and the laws they promise."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracemill.llm import media, packing, sharding


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plans_respect_every_capacity(score):
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([8, 16, 64])
        docs, cost = rng.choice([None, 2, 3]), rng.choice([None, capacity * capacity * 0.75])
        counts = {}
        for _ in range(rng.randint(0, 60)):
            n = rng.randint(1, int(capacity * 0.8))
            counts[n] = counts.get(n, 0) + rng.randint(1, 5)
        runs = packing.plan(counts, capacity, docs, cost, score=score)
        bins, order = {}, runs["length"] * (1 << 44) + runs["rank"]
        for n, many in counts.items():
            for k in range(many):
                r = runs[np.searchsorted(order, n * (1 << 44) + k, "right") - 1]
                j = k - r["rank"]
                bins.setdefault(int(r["sequence"] + j // r["per"]), []).append((int(r["offset"] + j % r["per"] * n), n))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity and (docs is None or len(b) <= docs) and (cost is None or sum(n * n for _, n in b) <= cost)
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_tokens_equal_the_tokenizers():
    known = packing.words(packing.default_tokenizer())
    rng = random.Random(5)
    bits = [*"aAéÉßſΣσςİıÅ .,'s!1²ªº́", "<|endoftext|>", "<|STARTOFTEXT|>", "don't", "\n", "\t", "\x85", "ﬁ", "가", "日本", "😀", "É,", "...", "word."]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(packing.encoded(text, known), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers

    cased, spaced = str(tmp_path / "cased.json"), str(tmp_path / "spaced.json")
    told = json.load(open(packing.default_tokenizer()))
    json.dump(told | {"normalizer": None}, open(cased, "w"))
    told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    json.dump(told, open(spaced, "w"))
    for path in (public_tokenizers.path("byte_bpe_50k.json"), cased, spaced):
        known = packing.words(path)
        assert not known.apart
        for text in ("Hello World  again", " x\ny", "", "É<|endoftext|>"):
            assert np.frombuffer(packing.encoded(text, known), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.words(packing.default_tokenizer()).apart


def test_generations_bound_the_memory():
    known = packing.Words(packing.default_tokenizer(), 10)
    for i in range(100):
        assert known["the"] and known[f"w{i}"]
    assert len(known) <= 11 and len(known.old) <= 11


def test_packing(spark, documents, tables):
    texts = [None, "", "hello world", "hello world", "a " * 9000, "b " * 4095, "c " * 4096, "word. " * 50]
    folder = tables(documents=documents(texts, [0, 1, 2, 2, 4, 5, 6, 7]).withColumnRenamed("lang", "length").withColumnRenamed("source", "offset"))
    rows = packing.op1_packing(spark, folder).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in zip([0, 1, 2, 2, 4, 5, 6, 7], texts, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(x := ids[k : k + 4096]), zlib.crc32(np.array(x, "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(n for *_, n, _ in want) // 4096)
    assert packing.op1_packing(spark, tables(documents=documents([]))).count() == 0
    ids = packing.pack(documents(["hello world"]), packing.default_tokenizer()).first().ids
    assert ids == [*tokenizer.encode("hello world", add_special_tokens=False).ids, 1]


def test_chunks_are_content_defined():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    cut = media.chunks(data)
    assert b"".join(cut) == data and all(len(c) <= media.MOST for c in cut) and all(len(c) >= media.LEAST for c in cut[:-1])
    moved = media.chunks(b"some bytes before" + data)
    assert len({*cut} & {*moved}) >= len(cut) - 3
    assert [len(c) for c in media.chunks(bytes(20_000))] == [8192, 8192, 3616] or sum(map(len, media.chunks(bytes(20_000)))) == 20_000


def test_media(spark, documents, tables):
    long = " ".join(str(i * i) for i in range(9000))
    texts = [None, "", "x" * 64, "x" * 65, "é", long, long, long[:30_000] + "changed" + long[30_000:], long]
    folder = tables(documents=documents(texts).withColumnRenamed("lang", "media").withColumnRenamed("source", "list"))
    rows = {r.doc_id: r for r in media.op4_media(spark, folder).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = media.header(len(payload)) + payload
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        crossings = sum((x >= 128) != (y >= 128) for x, y in zip(payload, payload[1:], strict=False))
        levels = "/".join(str(sum(x // 32 == k for x in payload)) for k in range(8))
        assert r.feature == f"sum={sum(payload)};squares={sum(x * x for x in payload)};crossings={crossings};levels={levels}"
    assert rows[5].feature == rows[6].feature != rows[7].feature
    assert media.op4_media(spark, tables(documents=documents([]))).count() == 0


def test_store_keeps_shared_chunks_once(spark, documents):
    long = " ".join(str(i * i) for i in range(9000))
    lists, chunks = media.store(documents([long, long, long + "more"]))
    kept = chunks.collect()
    assert len({r.digest for r in kept}) == len(kept) > 3
    stored = sum(len(r.data) for r in kept) + sum(len(r.data) for r in lists.collect())
    assert stored < 1.2 * len(long)


def test_damage_is_found():
    payload = media.padded(b"some payload")
    listed = [{"digest": media.digest(payload), "n": len(payload), "apart": False}]
    digest = hashlib.sha256(media.header(64) + payload).digest()
    assert media.samples(media.rebuilt(digest, listed, payload, {})) == payload
    for bad in (payload[:-1] + b"!", b""):
        with pytest.raises(ValueError):
            media.rebuilt(digest, listed, bad, {})
    with pytest.raises(ValueError):
        media.rebuilt(bytes(32), listed, payload, {})


def test_shards(spark, documents, tables):
    texts = [None, "", *["hot"] * 300, *[f"pair {i // 2}" for i in range(200)], *[f"alone {i}" for i in range(400)], "é" * 1000]
    folder = tables(documents=documents(texts).withColumnRenamed("lang", "shard").withColumnRenamed("source", "grp"))
    rows = {r.doc_id: r for r in sharding.op6_sharding(spark, folder).collect()}
    assert len(rows) == len(texts)
    per = {}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None)
        per.setdefault(r.shard, []).append(r.slot)
    assert set(per) == set(range(16)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    found = sharding.cut_groups(sharding.shard_documents(documents(texts))).first()
    assert found.cut_groups <= 20  # the hot group has to be cut, few pairs are
    assert sharding.op6_sharding(spark, tables(documents=documents([]))).count() == 0
    assert sharding.op6_sharding(spark, tables(documents=documents(["a", "a", "b"]))).count() == 3


def test_few_groups_are_cut_where_all_rows_are_linked(spark, documents):
    texts = ["hot"] * 1200 + [f"pair {i % 500}" for i in range(1800)]
    found = sharding.cut_groups(sharding.shard_documents(documents(texts))).first()
    assert found.groups == 501 and found.cut_groups <= 15 and found.cut_rows <= 1200 + 15 * 4


def least_cut(n, edges, shards):
    """The fewest cut edges over all ways to put n rows into shards of equal size."""
    import itertools

    best = len(edges)
    for split in itertools.combinations(range(n), n // shards):
        if shards == 2:
            best = min(best, sum((a in split) != (b in split) for a, b in edges))
    return best


GRAPHS = {
    "two cliques and a bridge": [(a, b) for part in (range(5), range(5, 10)) for a in part for b in part if a < b] + [(4, 5)],
    "chain": [(i, i + 1) for i in range(9)],
    "ring": [(i, (i + 1) % 10) for i in range(10)],
    "two stars": [(0, i) for i in range(1, 5)] + [(5, i) for i in range(6, 10)],
    "pairs": [(2 * i, 2 * i + 1) for i in range(5)],
    "no edge": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_cut_edges_against_the_least(spark, name):
    """Ordinary edges: sizes are even, and the cut is within half of the edges from the least one to all of them."""
    edges = GRAPHS[name]
    rows = sharding.written(spark.range(10).select("id"), "rows")
    links = spark.createDataFrame([(int(x), f"{a}-{b}") for a, b in edges for x in (a, b)], "id long, grp string")
    shard = {r.id: r.shard for r in sharding.shard_rows(rows, links, shards=2).collect()}
    assert sorted(list(shard.values()).count(s) for s in (0, 1)) == [5, 5]
    cut, least = sum(shard[a] != shard[b] for a, b in edges), least_cut(10, edges, 2)
    print(name, cut, least, len(edges))
    assert least <= cut <= (least + len(edges)) / 2


def test_overlapping_groups_stay_together(spark):
    """Groups that share rows in chains: rows end mostly beside those they are linked with."""
    rows = sharding.written(spark.range(800).select("id"), "rows")
    pairs = [(100 * k + i, f"{k}/{i // 10 + j}") for k in range(8) for i in range(100) for j in (0, 1)]
    links = spark.createDataFrame(pairs, "id long, grp string")
    shard = {r.id: r.shard for r in sharding.shard_rows(rows, links, shards=4).collect()}
    assert sorted(list(shard.values()).count(s) for s in range(4)) == [200] * 4
    members = {}
    for i, g in pairs:
        members.setdefault(g, []).append(shard[i])
    outside = lambda s: sum(len(m) - max(m.count(x) for x in set(m)) for m in s)
    rng = random.Random(1)
    drawn = [[rng.randrange(4) for _ in m] for m in members.values()]
    print(outside(members.values()), outside(drawn))
    assert outside(members.values()) < 0.5 * outside(drawn)


def test_grants_keep_the_capacity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        load = rng.integers(0, 100, 6).astype(float)
        asked = np.zeros((6, 6, sharding.GAINS))
        for a in range(6):
            left = load[a]
            for _ in range(4):
                n = float(rng.integers(0, int(left) + 1))
                asked[a, rng.integers(0, 6), rng.integers(0, sharding.GAINS)] += n
                left -= n
            asked[a, a] = 0
        capacity = max(load.max(), 60.0)
        moved = asked * sharding.granted(asked, load, capacity)
        assert (load - moved.sum(axis=(1, 2)) + moved.sum(axis=(0, 2)) <= capacity + 1e-6).all()
