"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns at the hits, then embedded checksums.

One pass over the texts finds every keyword occurrence. Only there a pattern is tried, anchored at the hit, so that the
cost of a pattern follows the number of hits and not the text. Kinds that carry a checksum or a decodable structure are
kept only if it holds.

Defined results: a null or empty text has no spans; repeated rows are scanned each; an empty table gives an empty one;
columns other than the id and the text are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, own_names, table

Span = tuple[str, int, int]
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}+")
#: Words that begin a pattern, in lower case: keyword, kind of pattern.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}
CHECKED = re.compile(r"(gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,}+)\.(eyJ[A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]{16,}+)")
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
FOOT = re.compile(r"-----END ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """The six base-62 digits, zero-padded, of the CRC-32 of a token's random part."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def jwt_holds(head: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


class Feet:
    """Where the footers of a text end, by their label; looked up once, at the first header."""

    def __init__(self, text: str):
        self.text, self.found = text, None

    def after(self, label: str, at: int) -> int | None:
        if self.found is None:
            self.found = defaultdict(list)
            for m in FOOT.finditer(self.text):
                self.found[m[1]].append(m.end())
        ends = self.found.get(label, [])
        k = bisect.bisect_left(ends, at + len(label) + 14)
        return ends[k] if k < len(ends) else None


def tried(kind: str, text: str, at: int, feet: Feet) -> tuple[int, bool] | None:
    """Up to where the anchored try at ``at`` uses the text, and whether it holds; None where it uses none."""
    if kind == "assign":
        m = ASSIGN.match(text, at)
        return m and (m.end(), m.end(2) - m.start(2) >= 12)
    if kind == "access":
        m = ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= 18)
    if kind in ("github", "npm"):
        m = CHECKED.match(text, at)
        return m and (m.end(), base62_crc(m[2][:30]) == m[2][30:])
    if kind == "jwt":
        if m := JWT.match(text, at):
            return m.end(), jwt_holds(m[1])
        run = JWT_RUN.match(text, at)  # a try at a later place of the same run would fail as well
        return run and (run.end(), False)
    m = PEM.match(text, at)
    end = m and feet.after(m[1], m.end())
    return end and (end, True)


def secrets(text: str | None) -> list[Span]:
    """All spans: per kind leftmost and not overlapping; a match that fails its test still uses up its text."""
    if not text:
        return []
    found, used, feet = [("hex", m.start(), m.end()) for m in HEX.finditer(text)], {}, Feet(text)
    for end, (size, kind) in automaton().iter(text.encode().lower().decode()):
        at = end + 1 - size
        if at >= used.get(kind, 0) and (hit := tried(kind, text, at, feet)):
            used[kind] = hit[0]
            if hit[1]:
                found.append((kind, at, hit[0]))
    return found


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the kinds as listed (others after them by name), then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[0], s[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): ``spans`` lists kind, begin and stop of every secret of the whole text."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {id_col: b[id_col], "spans": [[{"kind": k, "begin": a, "stop": z} for k, a, z in secrets(t)] for t in b[text_col]]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(own_names(docs, [id_col, text_col]), work, f"`{id_col}` {kind}, spans array<struct<kind: string, begin: int, stop: int>>")


def digests(spans: list[dict], kinds: tuple[str, ...]) -> tuple[list[int], str, str]:
    plain = [(s["kind"], s["begin"], s["stop"]) for s in spans]
    base = [s for s in plain if s[0] in kinds]
    return [sum(s[0] == k for s in base) for k in kinds], hashlib.sha256(in_order(base, kinds).encode()).hexdigest(), in_order(plain, kinds)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            rows = [digests(s, BASE_KINDS) for s in b["spans"]]
            yield {"doc_id": b["doc_id"]} | {f"n_{k}": [r[0][i] for r in rows] for i, k in enumerate(BASE_KINDS)} | {"base_sha256": [r[1] for r in rows], "spans": [r[2] for r in rows]}

    return map_rows(find_secrets(table(spark, sf_dir, "documents")), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
