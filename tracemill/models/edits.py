"""Edit distances of many strings at once, 64 pairs to a machine word.

The differences between neighbouring cells of the table of distances are -1, 0 or 1. Each is kept as two bits, whose
complements are stored, and words hold these bits for 64 pairs, so a cell of all pairs takes eight bitwise operations.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of distances that are held in memory where they need not be, and of those that are made at once for a file.
HELD, MADE = 1 << 27, 1 << 25
#: How far sums of three numbers up to 1 may be off in 32 bits, with room to spare.
NEAR = 2e-6
#: Words of a step, texts of a sheet, which is as long as its longest text, and symbols whose places are kept.
WORDS, SHEET, MOST_PLANES = 8192, 2048, 256


def _numbers(codes: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(c.encode("utf-32-le", "surrogatepass"), "<u4") for c in codes]


def _by_length(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return lengths, np.argsort(lengths, kind="stable")


def edits(left: list[str], right: list[str]) -> np.ndarray:
    """The Levenshtein distances of all strings of one list to all of the other, as the least unsigned kind that holds them."""
    a, b = _numbers(left), _numbers(right)
    (of_a, order_a), (of_b, order_b) = _by_length(a), _by_length(b)
    out = np.zeros((len(a), len(b)), np.min_scalar_type(int(max(of_a.max(initial=0), of_b.max(initial=0)))))
    symbols = np.unique(np.concatenate([np.zeros(0, "<u4"), *a]))
    at = [np.searchsorted(symbols, x) for x in a]
    for lo in range(0, len(b), SHEET):
        own = order_b[lo : lo + SHEET]
        longest, words = int(of_b[own[-1]]), -(-len(own) // 64)
        text = np.full((longest, words * 64), 0xFFFFFFFF, "<u4")
        for k, t in enumerate(own):
            text[: of_b[t], k] = b[t]
        packed = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view("<u8")
        inside = text != 0xFFFFFFFF
        planes: dict[int, np.ndarray] = {}
        step = max(1, WORDS // words)
        for first in range(0, len(a), step):  # of nearly equal length
            some = order_a[first : first + step]
            used = np.unique(np.concatenate([at[p] for p in some]))
            if len(planes) + len(used) > MOST_PLANES:
                planes = {}
            for c in used:
                if c not in planes:
                    planes[c] = packed(text != symbols[c])
            chars = np.zeros((len(some), of_a[some[-1]]), np.int64)
            for k, p in enumerate(some):
                chars[k, : of_a[p]] = np.searchsorted(used, at[p])
            table = np.stack([planes[c] for c in used], axis=1) if len(used) else np.zeros((longest, 0, words), "<u8")
            out[np.ix_(some, own)] = _sheet(chars, of_a[some], table, inside)[:, : len(own)]
    return out


def _sheet(chars: np.ndarray, lengths: np.ndarray, table: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Distances (patterns, texts); patterns come by length, ``table`` has where texts differ from a symbol, per place, and
    ``inside`` which places texts have."""
    (longest, width), words = inside.shape, inside.shape[1] // 64
    ones, shape = ~np.uint64(0), (len(chars), words)
    # of each column: not up, and not down, of the step to its cell in this row
    up, down = np.zeros((longest, *shape), np.uint64), np.full((longest, *shape), ones)
    not_up, not_down, e, x = (np.empty(shape, np.uint64) for _ in range(4))
    total, done = np.repeat(lengths[:, None], width, axis=1), 0
    for i in range(chars.shape[1] + 1):
        while done < len(chars) and lengths[done] == i:  # a pattern's last row: its steps add up to the distance
            rise, fall = (np.unpackbits((~d[:, done]).view(np.uint8), axis=-1, bitorder="little") for d in (up, down))
            total[done] += (rise & inside).sum(axis=0, dtype=np.int32) - (fall & inside).sum(axis=0, dtype=np.int32)
            done += 1
        if i == chars.shape[1]:
            return total
        not_up[:], not_down[:], own = 0, ones, chars[:, i]
        for j in range(longest):
            b, d = up[j], down[j]
            np.take(table[j], own, axis=0, out=e, mode="clip")
            np.bitwise_and(e, not_down, out=e)
            np.bitwise_and(e, d, out=e)
            np.bitwise_and(e, b, out=x)
            np.bitwise_xor(x, d, out=x)  # the next not_up, of b and d as the row before left them
            np.bitwise_or(e, not_up, out=d)
            np.bitwise_and(e, not_up, out=not_up)
            np.bitwise_or(e, b, out=e)  # the next not_down
            np.bitwise_xor(not_up, not_down, out=b)
            not_up, x, not_down, e = x, not_up, e, not_down


class Normalised:
    """Edit distances by the length of the longer string, kept as whole numbers; parts of it are made when asked for."""

    most = 1.0

    def __init__(self, counts: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.counts, self.left, self.right = counts, np.maximum(left, 1.0), np.maximum(right, 1.0)
        self.shape = counts.shape

    @classmethod
    def of(cls, left: list[str], right: list[str]) -> Normalised:
        return cls(edits(left, right), *(np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)))

    def whole(self, lo: int, hi: int) -> np.ndarray:
        return self.counts[lo:hi]

    def rows(self, lo: int, hi: int) -> np.ndarray:
        return self.whole(lo, hi) / np.maximum(self.left[lo:hi, None], self.right)

    def zeros(self, lo: int, hi: int) -> np.ndarray:
        """The first column of each row where the distance is zero, or -1."""
        counts = self.whole(lo, hi)
        at = counts.argmin(axis=1)
        return np.where(counts[np.arange(len(at)), at] == 0, at, -1)

    def below(self, lo: int, hi: int, u: np.ndarray, v: np.ndarray, zero: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row from lo, column, distance, gain), by rows, where distance - u + v is below zero and half of the row's least.
        Numbers of 32 bits tell which cells may be, and only these are worked out; u and v are between -1 and 1."""
        counts = self.whole(lo, hi)
        near = counts.astype(np.float32)
        near /= np.maximum(self.left[lo:hi, None].astype(np.float32), self.right.astype(np.float32))
        near += v.astype(np.float32)
        most = np.minimum(0.5 * (near.min(axis=1) - u), 0) + NEAR + u
        i, j = np.nonzero(near < most.astype(np.float32)[:, None])
        own = counts[i, j] / np.maximum(self.left[lo + i], self.right[j])
        gain = own - u[i]
        gain += v[j]
        least = np.zeros(len(counts))
        np.minimum.at(least, i, gain)
        use = gain < np.minimum(0.5 * least, -zero)[i]
        return i[use], j[use], own[use], gain[use]

    def part(self, i: np.ndarray, j: np.ndarray) -> Normalised:
        return Normalised(self.counts[np.ix_(i, j)], self.left[i], self.right[j])


class Filed:
    """The same of any size, in a file of the process that asks first: only the strings are sent from one to another."""

    def __init__(self, left: list[str], right: list[str]):
        self.codes = left, right
        self.left, self.right = (np.maximum(np.fromiter(map(len, x), np.int64, len(x)), 1.0) for x in (left, right))
        self.shape, self.kind, self.file = (len(left), len(right)), least_kind(left, right), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"file": None}

    def row(self, i: int) -> np.ndarray:
        if self.file is None:
            (left, right), step = self.codes, max(1, MADE // self.shape[1])
            # without a name, so that it goes with the process
            made = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)  # noqa: SIM115
            for lo in range(0, len(left), step):
                made.write(edits(left[lo : lo + step], right).astype(self.kind).data)
            made.flush()
            self.file = made
        size = self.shape[1] * self.kind.itemsize
        return np.frombuffer(os.pread(self.file.fileno(), size, i * size), self.kind)

    def part(self, i: np.ndarray, j: np.ndarray) -> Chosen:
        return Chosen(self, i, j)


class Chosen(Normalised):
    """Rows and columns of distances in a file."""

    def __init__(self, filed: Filed, i: np.ndarray, j: np.ndarray):
        self.filed, self.i, self.j, self.shape = filed, i, j, (len(i), len(j))
        self.left, self.right = filed.left[i], filed.right[j]

    def whole(self, lo: int, hi: int) -> np.ndarray:
        some = self.i[lo:hi].tolist()
        counts = np.empty((len(some), len(self.j)), self.filed.kind)
        for k, i in enumerate(some):
            counts[k] = self.filed.row(i)[self.j]
        return counts

    def part(self, i: np.ndarray, j: np.ndarray) -> Chosen:
        return Chosen(self.filed, self.i[i], self.j[j])


def least_kind(left: list[str], right: list[str]) -> np.dtype:
    """The least unsigned kind that holds the distances."""
    return np.min_scalar_type(max(map(len, [*left, *right]), default=0))


def fits(left: list[str], right: list[str]) -> bool:
    """Whether the distances may be held in memory."""
    return len(left) * len(right) * least_kind(left, right).itemsize <= HELD


class Dense:
    """Any costs, with the same parts."""

    def __init__(self, values: np.ndarray):
        self.values, self.shape = np.asarray(values, float), np.shape(values)
        self.most = float(self.values.max())

    def rows(self, lo: int, hi: int) -> np.ndarray:
        return self.values[lo:hi]

    def zeros(self, lo: int, hi: int) -> np.ndarray:
        at = self.values[lo:hi].argmin(axis=1)
        return np.where(self.values[np.arange(lo, hi), at] == 0, at, -1)

    def part(self, i: np.ndarray, j: np.ndarray) -> Dense:
        return Dense(self.values[np.ix_(i, j)])

    def below(self, lo: int, hi: int, u: np.ndarray, v: np.ndarray, zero: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        gain = self.values[lo:hi] - u[:, None]
        gain += v
        i, j = np.nonzero(gain < np.minimum(0.5 * gain.min(axis=1), -zero)[:, None])
        return i, j, self.values[lo + i, j], gain[i, j]
