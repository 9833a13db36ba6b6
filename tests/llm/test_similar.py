"""SimHash links, decontamination and components against brute force."""

import random
import re

import numpy as np
import pytest

from tracemill.llm import decontaminate, graph, simhash


def plain_components(ids, fps, distance=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(fps))]


def plain_fingerprint(text, n=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in (None, "", "  \n", "A", "a B", "A b\tc", "É é a b c a b c", "x " * 20_000, "a\x1cb c\x0bd e"):
        for n in (1, 3, 5):
            assert simhash.fingerprint(text, n) == plain_fingerprint(text, n)


@pytest.mark.parametrize("bucket_rows", [2048, 7])
def test_links_lose_nothing(spark, bucket_rows):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):  # clusters, chains and loners
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            fps.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                at ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(rows, bucket_rows=bucket_rows)).collect()}
    assert [roots.get(s, s) for s in signed] == plain_components(signed, fps)


@pytest.mark.parametrize("distance", [3, 5])
def test_cells_lose_no_pair_and_meet_it_once(spark, distance):
    """One bucket of many fingerprints, dealt to cells: every pair within the distance meets in one cell, not twice."""
    rng = random.Random(8)
    fps = sorted({rng.getrandbits(64) for _ in range(300)} | {(b := rng.getrandbits(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)} | {b ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(7, s) for s in signed], "key long, fp long")
    refs = simhash.spread_pivots(rows, 8)
    cells = {}
    for r in simhash.in_cells(rows, 50, distance, refs).collect():
        cells.setdefault(r.key, []).append((r.fp, r.guest))
    met = {}
    for own in cells.values():
        for i, (x, gx) in enumerate(own):
            for y, gy in own[:i]:
                if not (gx and gy):
                    met[frozenset((x, y))] = met.get(frozenset((x, y)), 0) + 1
    near = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance}
    assert len(near) > 100 and near <= met.keys() and set(met.values()) == {1}
    assert max(sum(x == s for own in cells.values() for x, _ in own) for s in signed[:50]) <= 14


def test_the_table_makes_the_pairs():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    fp[1000:] = fp[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64))
    refs, examined = simhash.pivots(32), []
    i, j = simhash.linked(np.zeros(2000, np.int64), fp, np.full(2000, 2), np.zeros(2000, bool), 3, refs, examined)
    want = {(a, b) for a in range(2000) for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp) <= 3).tolist() if a < b}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
    assert sum(examined) < 0.55 * 2000 * 1999 / 2


def test_pivot_bounds_hold():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
    table = simhash.distance_table(fp, simhash.pivots(16)).astype(int)
    for i in range(50):
        for j in range(50):
            assert abs(table[i] - table[j]).max() <= int(np.bitwise_count(fp[i] ^ fp[j]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1), (2, 1)] + [(100, i) for i in range(200, 260)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 100: 100} | {i: 100 for i in range(200, 260)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_and_stage(spark, documents, tables):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " more", None, "", "  ", "alone here now", "alone here now", base.upper(), "other text entirely so"]
    docs = documents(texts, [5, 3, 9, 8, 7, 2, 2, 6, 1]).withColumnRenamed("source", "component_id")
    found = simhash.op9_simhash(spark, tables(documents=docs)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(zip([5, 3, 9, 8, 7, 2, 2, 6, 1], [f"{f:016x}" for f in fps], plain_components([5, 3, 9, 8, 7, 2, 2, 6, 1], fps), strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    kept = simhash.one_of_each(docs, shingle_words=3)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})
    assert simhash.op9_simhash(spark, tables(documents=documents([]))).count() == 0


def plain_hits(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, window + 1):
                if k + n <= len(w) and tuple(w[k : k + n]) in wins:
                    found |= wins[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def fixture():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["a", "b", "É", "the", "x1"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([0, 1, 3, 12, 13, 14, 30])] + [(7, None), (8, "a, B. the"), (None, "zq zr"), (5, "x1 x1")]
    texts = [None, "", "zq-ZR!", items[6][1], "q " * 30 + items[6][1].upper() + " q" * 30] + [say(40) + " zz " + items[4][1] + " zz " + say(9) for _ in range(20)] + ["q " * 5000]
    return texts, items


@pytest.mark.parametrize("block_chars", [16_000_000, 40])
def test_contamination(spark, documents, block_chars):
    texts, items = fixture()
    docs = documents(texts).withColumnRenamed("lang", "_items").withColumnRenamed("source", "n_hit")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars, shard_rows=4).select("doc_id", "_n_words", decontaminate.hits().alias("h"), "_items").orderBy("doc_id").collect()
    assert [(r._n_words, r.h, r._items) for r in found] == plain_hits(texts, items)


def test_contamination_query(spark, documents, tables):
    texts, items = fixture()
    folder = tables(documents=documents(texts), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: r for r in decontaminate.op8_decontaminate(spark, folder).collect()}
    for i, (n, hit, found) in enumerate(plain_hits(texts, items)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].contaminated) == (n, hit, len(found), hit > 0 and 20 * hit >= n)
    empty = tables(documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert decontaminate.op8_decontaminate(spark, empty).count() == 0
    none = tables(documents=documents(["a b"]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert decontaminate.op8_decontaminate(spark, none).first().n_hit == 0


def plain_matches(text, items, window=13):
    """Every stretch of the text that is in an item, a window long at least, and in no longer one; first place in the item."""
    w, out = decontaminate.words_of(text), []
    for name, t in items:
        x = decontaminate.words_of(t)
        least, found = min(window, len(x)), {}
        for a in range(len(w)):
            for n in range(len(w) - a, max(least, 1) - 1, -1):
                at = next((k for k in range(len(x) - n + 1) if x[k : k + n] == w[a : a + n]), None)
                if at is not None:
                    found[a, a + n] = at
                    break
        out += [(None if name is None else str(name), a, at, b - a) for (a, b), at in found.items() if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in found)]
    return sorted(out, key=str)


def test_longest_matches():
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    cases = [
        ([f"x {say(5, 30)} y"], [(1, say(0, 40))]),
        ([say(0, 20)], [(1, say(0, 13)), (2, "z " + say(0, 20))]),  # a window of two items
        ([say(0, 30)], [(1, f"{say(0, 20)} mid {say(0, 30)}")]),  # a window twice in an item
        (["a " * 60, "a " * 13, "b"], [(1, "a " * 30), (1, "a " * 20), (None, "a " * 14), (2, "b")]),
        ([noise(80), noise(40) + " c " + noise(40)], [(i, noise(n)) for i, n in enumerate([5, 13, 20, 40, 60])]),
        ([say(0, 30) + " " + say(10, 25)], [(1, say(0, 15) + " q " + say(12, 30)), (2, say(3, 28))]),
    ]
    for texts, items in cases:
        index = decontaminate.index_of(items)
        for text, (_, _, _, matches) in zip(texts, decontaminate.searched(texts, index), strict=True):
            assert sorted(((m["item_id"], m["doc_word"], m["item_word"], m["n_words"]) for m in matches), key=str) == plain_matches(text, items)


def test_repeated_words_take_linear_time():
    index = decontaminate.index_of([(i, "a " * (20_000 + i)) for i in range(3)])
    (n, cover, items, matches), = decontaminate.searched(["a " * 30_000], index)
    assert (n, cover, items) == (30_000, [(0, 30_000)], ["0", "1", "2"]) and max(m["n_words"] for m in matches) == 20_002


def test_repeated_items_are_sent_once(spark):
    rows = spark.createDataFrame([(1, "a b")] * 50 + [(2, "c")], "item_id long, text string")
    assert [part.count() for part in decontaminate.blocks(rows, "item_id", "text", 1000)] == [2]
