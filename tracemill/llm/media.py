"""Media columns: content-defined payload chunking with a deduplicated chunk store.

A payload is kept as 8-bit mono samples in a RIFF/WAVE form. Its bytes are cut where a rolling gear hash has given bits
zero, so equal stretches of different payloads give equal chunks. Chunk digests are counted and joined in Spark: a chunk
that occurs once stays beside its payload's ordered chunk list, a chunk that may occur more often goes to a store keyed by
its digest, where each is kept once. To read a payload, its list is joined with the store, every chunk's digest and the
whole form's digest are verified, and the samples are parsed from the form.

Which chunks may occur more often is told to the tasks by a Bloom filter of fixed size over the repeated digests; a false
hit only sends one more chunk to the store, so results are exact at every size.

Defined results: a null text is empty; an empty payload is 64 zero bytes; repeated rows share all chunks and are rebuilt
once; an empty table gives an empty one; further columns are not read. A damaged chunk or form raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, own_names, table, written

BLOCK, RATE = 64, 8000
LEAST, MOST, ZERO_BITS = 512, 8192, 10
GEAR = np.random.default_rng(64).integers(0, 1 << 16, 256, dtype=np.uint16)
MASK = np.uint16(((1 << ZERO_BITS) - 1) << (16 - ZERO_BITS))
FILTER_BITS, FILTER_PROBES = 26, 4
SEEN = 100_000


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def header(n: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def samples(form: bytes) -> bytes:
    """The samples of the form, found by walking its sections."""
    if form[:4] != b"RIFF" or form[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE form")
    at = 12
    while at + 8 <= len(form):
        name, n = struct.unpack_from("<4sI", form, at)
        if name == b"data":
            return form[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data section")


def chunks(payload: bytes) -> list[bytes]:
    """Cuts after bytes at which the gear hash of the last 16 bytes has its upper bits zero, within the size limits."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step)
    ends, out, at = np.flatnonzero((h & MASK) == 0) + 1, [], 0
    while at < len(payload):
        k = int(np.searchsorted(ends, at + LEAST))
        cut = min(int(ends[k]) if k < len(ends) else len(payload), at + MOST, len(payload))
        out.append(payload[at:cut])
        at = cut
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def probes(d: bytes) -> list[int]:
    return [x & ((1 << FILTER_BITS) - 1) for x in struct.unpack(">4I", d)]


def repeated_filter(digests: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter over the digests that occur more than once; made of sums per word, 8 MB in all."""
    twice = digests.groupBy("d").count().where("count > 1")
    bit = F.explode(F.array(*[F.conv(F.hex(F.substring("d", 1 + 4 * i, 4)), 16, 10).cast("long").bitwiseAND((1 << FILTER_BITS) - 1) for i in range(FILTER_PROBES)]))
    words = twice.select(bit.alias("bit")).select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    found = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    found[words["word"]] = words["bits"]
    return found.view(np.uint64)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lists, chunks), both written: per row its form's digest, the ordered chunk list and the chunks that are its alone;
    and each other chunk once, by digest."""
    own = own_names(docs, [id_col, text_col])
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {"d": [digest(c) for t in b[text_col] for c in chunks(padded((t or "").encode()))]}

    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(map_rows(own.select(text_col), cut, "d binary")))

    def put(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        bits, seen = shared.value, set()
        maybe = lambda d: all(int(bits[x >> 6]) >> (x & 63) & 1 for x in probes(d))
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("kind", id_col, "n_bytes", "media", "list", "data")}
            add = lambda *row, out=out: [out[k].append(v) for k, v in zip(out, row, strict=True)]
            for doc, text in zip(b[id_col], b[text_col], strict=True):
                data = (text or "").encode()
                payload = padded(data)
                media, mine, listed = hashlib.sha256(header(len(payload)) + payload).digest(), [], []
                for c in chunks(payload):
                    d = digest(c)
                    if apart := maybe(d):
                        if d not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(d)
                            add(1, None, None, d, None, c)
                    else:
                        mine.append(c)
                    listed.append({"digest": d, "n": len(c), "apart": apart})
                add(0, doc, len(data), media, listed, b"".join(mine))
            yield out

    parts = written(map_rows(own, put, f"kind int, `{id_col}` {kind}, n_bytes long, media binary, list array<struct<digest: binary, n: int, apart: boolean>>, data binary"), "media", "kind")
    kept = parts.where("kind = 1").groupBy("media").agg(F.min("data").alias("data")).select(F.col("media").alias("digest"), "data")
    return parts.where("kind = 0").drop("kind"), written(kept, "chunks")


def rebuilt(media: bytes, listed: list[dict], mine: bytes, fetched: dict[int, bytes]) -> bytes:
    """The form, from its chunk list; every digest is verified."""
    parts, at = [], 0
    for i, c in enumerate(listed):
        part = fetched.get(i, b"") if c["apart"] else mine[at : at + c["n"]]
        at += 0 if c["apart"] else c["n"]
        if digest(part) != c["digest"]:
            raise ValueError(f"chunk {i} of {media.hex()} is missing or damaged")
        parts.append(part)
    payload = b"".join(parts)
    form = header(len(payload)) + payload
    if hashlib.sha256(form).digest() != media:
        raise ValueError(f"the form {media.hex()} is damaged")
    return form


def feature(payload: bytes) -> str:
    """Sum, sum of squares, crossings of the middle level, and samples per eighth of the range."""
    x = np.frombuffer(payload, np.uint8)
    above = x >= 128
    bins = np.bincount(x >> 5, minlength=8)
    return f"sum={int(x.sum(dtype=np.int64))};squares={int((x.astype(np.int64) ** 2).sum())};crossings={int((above[1:] != above[:-1]).sum())};levels={'/'.join(map(str, bins))}"


RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(form: bytes) -> tuple:
    payload = samples(form)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)


def read(lists: DataFrame, chunks_: DataFrame, id_col: str = "doc_id", describe=described, result: str = RESULT) -> DataFrame:
    """(id, n_bytes, result columns) of every row, computed by ``describe`` from the verified form.

    Forms without shared chunks are rebuilt where they are read; the others once per distinct form.
    """
    kind, names = lists.schema[id_col].dataType.simpleString(), [c.split()[0] for c in result.split(", ")]
    alone = ~F.exists("list", lambda c: c["apart"])

    def local(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            rows = [describe(rebuilt(m, c, d, {})) for m, c, d in zip(b["media"], b["list"], b["data"], strict=True)]
            yield {id_col: b[id_col], "n_bytes": b["n_bytes"]} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    here = map_rows(lists.where(alone), local, f"`{id_col}` {kind}, n_bytes long, {result}")
    others = lists.where(~alone)
    forms = others.groupBy("media").agg(F.first(F.struct("list", "data")).alias("form")).select("media", "form.list", "form.data")
    wanted = others.select("media", "list").distinct().select("media", F.posexplode("list").alias("at", "c")).where("c.apart").select("media", "at", F.col("c.digest").alias("digest"))
    fetched = wanted.join(chunks_.withColumnRenamed("data", "part"), "digest").groupBy("media").agg(F.collect_list(F.struct("at", "part")).alias("parts"))

    def joined(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            rows = [describe(rebuilt(m, c, d, {p["at"]: p["part"] for p in parts or []})) for m, c, d, parts in zip(b["media"], b["list"], b["data"], b["parts"], strict=True)]
            yield {"media": b["media"]} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    once = map_rows(forms.join(fetched, "media", "left"), joined, f"media binary, {result}")
    there = others.select(id_col, "n_bytes", "media").join(once, "media").select(id_col, "n_bytes", *names)
    return here.unionByName(there)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(*store(table(spark, sf_dir, "documents")))
