"""Benchmark decontamination with suffix arrays over shards of the training texts.

Documents are cut into shards of whole texts. For each shard a suffix array orders its word positions by the words that
follow, to the depth of a window; positions from which no window can begin, because one of the next words occurs in no
test item, are left out, which loses no match. Every test suffix is binary-searched in the array of every shard; the range
found gives all places of its window, and the words they cover are the hits. Around the hits test suffixes are compared to
their ends: a stretch of hits is followed through the suffix automaton of each item found there, which gives the longest
verbatim matches in time linear in the stretch, however often words repeat. Documents with enough hits are removed.

Matches are told for each item as (item_id, doc_word, item_word, n_words): all stretches of the document that occur in the
item, are a window long at least, and lie in no longer such stretch; the place in the item is the first one.

Test items are broadcast, each once, in blocks of at most ``block_chars`` characters (an item is never split); further
blocks add further passes over the texts, whose results accumulate in columns, so that neither side is ever collected whole
when it is large.

Defined results: a null text has no words; an item without words matches nothing; an item of fewer words than a window is
one window; repeated rows give repeated results, repeated items one entry; an item whose id is null hits words, but isn't
listed; without items no word is hit; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, own_names, set_aside, table

WINDOW = 13
#: Bytes to bytes: A-Z to lower case; what is in no word to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of the items whose automata a worker keeps at once.
MOST_STATES = 200_000
MATCH = "array<struct<item_id: string, doc_word: int, item_word: int, n_words: int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Automaton:
    """The suffix automaton of a sequence: its states stand for the sets of places where parts of the sequence end."""

    def __init__(self, words: list[int]):
        self.next, self.link, self.size, self.first = [{}], [-1], [0], [-1]
        last = 0
        for at, word in enumerate(words):
            new, state, last = self._state({}, 0, self.size[last] + 1, at), last, len(self.next) - 1
            while state >= 0 and word not in self.next[state]:
                self.next[state][word], state = new, self.link[state]
            if state < 0:
                continue
            to = self.next[state][word]
            if self.size[to] != self.size[state] + 1:
                copy = self._state(dict(self.next[to]), self.link[to], self.size[state] + 1, self.first[to])
                while state >= 0 and self.next[state].get(word) == to:
                    self.next[state][word], state = copy, self.link[state]
                self.link[to] = copy
                to = copy
            self.link[new] = to

    def _state(self, following: dict[int, int], link: int, size: int, first: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.next) - 1

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(begin, begin in the sequence, length) of the parts of ``words`` that occur and lie in no longer such part."""
        out, state, n = [], 0, 0
        for end, word in enumerate([*words, None]):
            if word not in self.next[state]:
                if n >= least:
                    out.append((end - n, self.first[state] - n + 1, n))
                while state and word not in self.next[state]:
                    state = self.link[state]
                    n = self.size[state]
            state, n = (self.next[state][word], n + 1) if word in self.next[state] else (0, 0)
        return out


@dataclass
class Index:
    """A block of test items: the vocabulary, the items' words, and each distinct window as a key, its length and the
    numbers of the items it is in."""

    vocabulary: dict[bytes, int]
    names: list[str | None]
    words: list[np.ndarray]
    keys: np.ndarray
    above: np.ndarray
    size: np.ndarray
    items: list[tuple[int, ...]]
    window: int
    automata: dict[int, Automaton] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automata": {}}

    @property
    def least(self) -> int:
        return int(self.size.min()) if len(self.size) else self.window

    def automaton(self, item: int) -> Automaton:
        if item not in self.automata:
            if sum(len(self.words[i]) for i in self.automata) + len(self.words[item]) > MOST_STATES:
                self.automata.clear()
            self.automata[item] = Automaton(self.words[item].tolist())
        return self.automata[item]


def keyed(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The next ``depth`` word numbers from each position, as bytes that sort like the numbers."""
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    return padded[at[:, None] + np.arange(depth)].astype(">u4").view(f"S{4 * depth}").reshape(-1) if len(at) else np.zeros(0, f"S{4 * depth}")


def index_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Index:
    vocabulary: dict[bytes, int] = {}
    at: dict[tuple[int, ...], set[int]] = defaultdict(set)
    names, words = [], []
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for k in range(max(1, len(ids) - window + 1) if ids else 0):
            at[tuple(ids[k : k + window])].add(len(names))
        names.append(None if item is None else str(item))
        words.append(np.array(ids, np.uint32))
    windows = list(at)
    size = np.array([len(w) for w in windows], dtype=np.int64)
    grid = np.zeros((len(windows), window), dtype=">u4")
    over = np.full((len(windows), window), 0xFFFFFFFF, dtype=">u4")
    for i, w in enumerate(windows):
        grid[i, : len(w)] = over[i, : len(w)] = w
    as_keys = lambda g: g.view(f"S{4 * window}").reshape(-1) if len(g) else np.zeros(0, f"S{4 * window}")
    return Index(vocabulary, names, words, as_keys(grid), as_keys(over), size, [tuple(sorted(at[w])) for w in windows], window)


def suffix_array(ids: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) in suffix order, of the positions followed by at least ``least`` known words."""
    unknown = np.flatnonzero(ids == 0)
    ends = np.append(unknown, len(ids))
    at = np.arange(len(ids))
    at = at[ends[np.searchsorted(unknown, at)] - at >= least]
    keys = keyed(ids, at, depth)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def searched(texts: list[str | None], index: Index) -> list[tuple[int, list[tuple[int, int]], list[str], list[dict]]]:
    """Per text of a shard: number of words, covered stretches of words, items found, longest matches."""
    known, parts, starts, at = index.vocabulary.get, [], [], 0
    for text in texts:
        words = words_of(text)
        starts.append(at)
        parts.append(np.fromiter((known(w, 0) for w in words), dtype=np.uint32, count=len(words)))
        parts.append(np.zeros(1, np.uint32))
        at += len(words) + 1
    ids = np.concatenate(parts)
    counts = np.diff([*starts, at]) - 1
    out = [(int(n), [], [], []) for n in counts]
    where, keys = suffix_array(ids, index.least, index.window)
    if not len(where) or not len(index.keys):
        return out
    low, high = np.searchsorted(keys, index.keys, "left"), np.where(index.size == index.window, np.searchsorted(keys, index.keys, "right"), np.searchsorted(keys, index.above, "right"))
    found = np.flatnonzero(high > low)
    n = (high - low)[found]
    win = np.repeat(found, n)
    place = where[np.repeat(low[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    order = np.argsort(place, kind="stable")
    place, win = place[order], win[order]
    doc = np.searchsorted(starts, place, "right") - 1
    for d in np.unique(doc):
        own = slice(*np.searchsorted(doc, [d, d + 1]))
        p, w = place[own] - starts[d], win[own]
        out[d][1].extend(merged(list(zip(p.tolist(), (p + index.size[w]).tolist(), strict=True))))
        rows = {i for k in set(w.tolist()) for i in index.items[k]}
        out[d][2].extend(sorted({index.names[i] for i in rows if index.names[i] is not None}))
        out[d][3].extend(longest(ids[starts[d] : starts[d] + out[d][0]], p.tolist(), w.tolist(), index))
    return out


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def longest(words: np.ndarray, places: list[int], windows: list[int], index: Index) -> list[dict]:
    """The longest matches with each item, by place in the document, given the places where its windows begin."""
    hit: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, w in zip(places, windows, strict=True):
        for item in index.items[w]:
            hit[item].append((p, p + int(index.size[w])))
    out = []
    for item, stretches in hit.items():
        least = min(index.window, len(index.words[item]))
        for a, b in merged(stretches):
            out += [(a + begin, index.names[item], at, n) for begin, at, n in index.automaton(item).matches(words[a:b].tolist(), least)]
    out.sort(key=lambda m: (m[0], -m[3], m[1] is None, m[1] or "", m[2]))
    return [{"item_id": name, "doc_word": begin, "item_word": at, "n_words": n} for begin, name, at, n in out]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> list[DataFrame]:
    items = own_names(benchmark, [item_col, text_col]).distinct()
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = int(total // block_chars) + 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = 16_000_000, shard_rows: int = 2048) -> DataFrame:
    """The documents, all columns kept, and the columns _n_words, _cover, _items and _matches."""
    fields = [T.StructField("_n_words", T.LongType()), T.StructField("_cover", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_matches", T._parse_datatype_string(MATCH))]
    out = T.StructType([f for f in docs.schema if f.name not in {g.name for g in fields}] + fields)
    df = docs.select(*[f.name for f in docs.schema if f.name in out.names[: -len(fields)]])
    for part in blocks(benchmark, item_col, item_text, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(index_of([tuple(r) for r in part.collect()], window))

        def work(batches: Iterator[dict[str, list]], index=index) -> Iterator[dict[str, list]]:
            for b in shards(batches, text_col, shard_rows):
                rows = searched(b[text_col], index.value)
                cover = [c for _, c, _, _ in rows]
                if "_cover" in b:
                    cover = [merged([*zip(o[::2], o[1::2], strict=True), *c]) for o, c in zip(b["_cover"], cover, strict=True)]
                yield b | {
                    "_n_words": [n for n, *_ in rows],
                    "_cover": [[x for s in c for x in s] for c in cover],
                    "_items": [sorted({*o, *i}) for o, (_, _, i, _) in zip(b.get("_items", [[]] * len(rows)), rows, strict=True)],
                    "_matches": [o + m for o, (*_, m) in zip(b.get("_matches", [[]] * len(rows)), rows, strict=True)],
                }

        df = map_rows(df, work, out)
    return df


def shards(batches: Iterator[dict[str, list]], text_col: str, rows: int, chars: int = 8_000_000) -> Iterator[dict[str, list]]:
    """Joins small batches to shards of about so many rows or characters; a text is never split."""
    held: dict[str, list] = {}
    size = 0
    for b in batches:
        held = {k: held.get(k, []) + v for k, v in b.items()}
        size += sum(len(t or "") for t in b[text_col])
        if len(held[text_col]) >= rows or size >= chars:
            yield held
            held, size = {}, 0
    if held and held[text_col]:
        yield held


def hits() -> F.Column:
    """Number of covered words, from the flat list of the covered stretches' bounds."""
    return F.aggregate("_cover", F.lit(0).cast("long"), lambda n, x: x - n)


def contaminated() -> F.Column:
    return (hits() > 0) & (20 * hits() >= F.col("_n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns kept, without those of whose words a twentieth or more are hit."""
    helpers = ["_n_words", "_cover", "_items", "_matches"]
    own, back = set_aside(docs, helpers)
    return back(contamination(own, benchmark, **options).where(~contaminated()).drop(*helpers)).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(own_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), hits().alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, list_aggregate(w[k:k + {WINDOW} - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
places AS (SELECT r, k, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.r, p.k, p.n, x.item_id FROM places p JOIN windows x USING (n, g)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
