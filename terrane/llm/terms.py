"""Words of ASCII letters, digits and anything beyond ASCII, as hashes; bounded sieves of hashes; running top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.substrings import mixed

#: Bits of a sieve's address, whatever goes in: 2 ** 26 bits are 8 MB.
SIEVE_BITS = 26
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 256

U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True
#: Masks of the lowest k bytes of a long.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and the number of words up to each text's end.

    A-Z are lower-cased; a word is a longest run of a-z, 0-9 and characters beyond ASCII. Words of up to eight
    bytes and one length never share a hash.
    """
    from xxhash import xxh3_64_intdigest

    data = _FOLD[np.frombuffer(b" ".join([*texts, bytes(8)]), np.uint8)]
    edges = np.flatnonzero(np.diff(_IN_WORD[data].view(np.int8), prepend=0))
    begin, end = edges[::2], edges[1::2]
    length = end - begin
    longs = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mixed(longs[begin] & _LOW[np.minimum(length, 8)], 70) + length.astype(np.uint64)
    more, at = np.flatnonzero(length > 8), 8
    while len(more := more[length[more] > at]) and at < LONG_WORD:
        out[more] = mixed(out[more] ^ (longs[begin[more] + at] & _LOW[np.minimum(length[more] - at, 8)]), 71)
        at += 8
    if len(more):
        raw = data.tobytes()
        out[more] = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin[more].tolist(), end[more].tolist(), strict=True)), np.uint64, len(more))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mixed(out, 72), np.searchsorted(begin, text_ends)


def sieve(hashes: DataFrame) -> np.ndarray:
    """Longs of a bit set of SIEVE_BITS, in which the bit of every hash of the only column of `hashes` is set.

    It is joined in Spark by the long that a hash falls into, so at most 2 ** (SIEVE_BITS - 6) rows come to the
    driver however many hashes there are. With more of them it lets more of the others through, never less.
    """
    slots = hashes.select(F.shiftrightunsigned(hashes.columns[0], 64 - SIEVE_BITS).alias("slot"))
    bits = slots.select(F.shiftright("slot", 6).alias("long"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    found = bits.groupBy("long").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
    out[found.column("long").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a sieve: all that are, and few others."""
    slot = hashes >> U(64 - SIEVE_BITS)
    return (bits[slot >> U(6)] >> (slot & U(63))) & U(1) == 1


class Tops:
    """The `k` rows of highest score of each key, equal scores by ascending order, rows without order last.

    Rows are added in arrays and kept in a pool of about `most`; one that is still as large once it is pruned is
    given out, so that a task's memory doesn't follow the number of keys.
    """

    NAMES = ("key", "score", "order", "absent", "extra")

    def __init__(self, k: int, most: int = 1 << 18):
        self.k, self.most = k, most
        self.clear()

    def clear(self) -> None:
        self.parts, self.size = [], 0
        self.keys, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floors(self, keys: np.ndarray) -> np.ndarray:
        """A score below which no row of each key is among its first k; the least long where that isn't known."""
        out = np.full(len(keys), np.iinfo(np.int64).min)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.least[at[known]]
        return out

    def add(self, key: np.ndarray, score: np.ndarray, order: np.ndarray, absent: np.ndarray, extra: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Takes rows; gives out the pool if it stays large."""
        if not len(key):
            return
        self.parts.append((key, score, order, absent, extra))
        self.size += len(key)
        if self.size > self.most or not len(self.keys):
            self.prune()
            if 2 * self.size > self.most:
                yield self.parts[0]
                self.clear()

    def prune(self) -> None:
        if not self.parts:
            return
        key, score, order, absent, extra = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.lexsort((extra, order, absent, -score, key))
        key = key[by]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        nth = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
        stay = nth < self.k
        by, key = by[stay], key[stay]
        full = nth[stay] == self.k - 1
        self.parts, self.size = [(key, score[by], order[by], absent[by], extra[by])], len(key)
        self.keys, self.least = key[full], score[by][full]

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        self.prune()
        if self.parts:
            yield self.parts[0]
            self.clear()
