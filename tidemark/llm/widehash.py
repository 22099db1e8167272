"""Wide SimHash fingerprints of shingle sets, and pairs near in them, found by deletion-variant signatures.

A fingerprint has 384 bits in 48 bytes. Its segments are all 48 pairs of neighbouring bytes, the last and
the first among them. A segment's signatures are its 16 deletion variants, each with another bit replaced
by a wildcard; two segments that differ in at most one bit have one in common. Two fingerprints that
differ in at most 47 bits always share one: among 24 segments that do not overlap, one differs in at most
one bit. Sets of Jaccard similarity 0.8 differ in 58 +- 7 bits and share one but for 14 in a million (9 in
100,000 for the worst of very small sets). Who shares one is compared in all bits.

Rows are not multiplied by the variants: they are dealt by each of their bytes. Of two segments that
differ in at most one bit, one byte is equal; the variants of the other are made where that is dealt to.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longs of a fingerprint.
LONGS = 6
BYTES, BITS = 8 * LONGS, 64 * LONGS
#: The columns of a fingerprint.
NAMES = [f"f{k}" for k in range(LONGS)]
#: Bits by which the fingerprints of a candidate may differ.
FAR_BITS = 92
#: Longs that are compared first, and the bits by which they may differ: 29 +- 5 are expected at 0.8.
FIRST, FIRST_BITS = 3, 64
#: Members of one signature beyond which they are compared row by row, and beyond which all are candidates.
WIDE, BUCKET = 1024, 1 << 15

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 64, 2 * LONGS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, 2 * LONGS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The longs of the SimHash of distinct 64-bit hashes. Each adds -3, -1, 1 or 3 to each bit's sum, by
    two bits of its own: with 1 and -1 alone, sums of few shingles are often zero."""
    ones = np.zeros(2 * BITS, dtype=np.int64)
    for k in range(0, len(shingles), 255):
        h = (shingles[k : k + 255, None] ^ _XOR) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * (2 * ones[:BITS] + ones[BITS:]) > 3 * len(shingles)).view(np.int64)


def far(a, b) -> np.ndarray:
    """Differing bits of rows of fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray, label: np.ndarray, near=None, split: int | None = None) -> list[tuple[int, int]]:
    """Index pairs that join the labels of all pairs of near fingerprints for which `near(i, j)` holds;
    with `split`, of the pairs across that index. Pairs of one label are not looked at. Changes label."""
    out = []
    for i in range(len(prints) - 1 if split is None else split):
        lo = i + 1 if split is None else split
        js = np.flatnonzero(label[lo:] != label[i]) + lo
        js = js[far(prints[js], prints[i]) <= FAR_BITS]
        for j in js.tolist():
            if label[j] != label[i] and (near is None or near(i, j)):
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _near(prints: np.ndarray, longs: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the index pairs are near."""
    d = np.zeros(len(a), dtype=np.uint8)
    for f in longs:
        d += np.bitwise_count(f[a] ^ f[b])
    out = np.flatnonzero(d <= FIRST_BITS)
    return out[far(prints[a[out]], prints[b[out]]) <= FAR_BITS]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after the rows of each pair have got one."""
    parent: dict[int, int] = {}

    def root(x):
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for x, y in zip(label[a].tolist(), label[b].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
    to = np.arange(len(label))
    for x in list(parent):
        to[x] = root(x)
    return to[label]


def _same_variant(key: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Of rows dealt by bytes, whole by key (the byte's place and value): a label for each, a row's index,
    that all have in common which a chain of near pairs with a signature in common connects."""
    n, every = len(key), np.arange(len(key))
    longs = [np.ascontiguousarray(prints[:, k]) for k in range(FIRST)]
    label = every
    for beside, bit in product((1, BYTES - 1), range(8)):
        place = ((key >> 8) + beside) % BYTES
        other = (prints[every, place // 8] >> (place % 8 * 8).astype(np.uint64)).astype(np.int64) & 255
        variant = key.astype(np.int64) << 8 | other & ~(1 << bit)
        order = np.argsort(variant, kind="stable")
        v = variant[order]
        start = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        size = np.diff(start, append=n)
        for g in np.flatnonzero(size > WIDE).tolist():
            rows = order[start[g] : start[g] + size[g]]
            if size[g] > BUCKET:
                label = _joined(label, rows[:-1], rows[1:])
            elif links := forest(prints[rows], label[rows]):
                label = _joined(label, *rows[np.array(links).T])
        # each with the member `step` places on, as far as there is one
        at, step = np.flatnonzero(np.repeat(size <= WIDE, size)), 1
        while len(at := at[at < n - step]) and len(at := at[v[at] == v[at + step]]):
            a, b = order[at], order[at + step]
            apart = np.flatnonzero(label[a] != label[b])
            a, b = a[apart], b[apart]
            hits = _near(prints, longs, a, b)
            if len(hits):
                label = _joined(label, a[hits], b[hits])
            step += 1
    return label


def _stars(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the least node of each label to the others, so that the same are found by many keys."""
    order = np.lexsort((node, label))
    node, label = node[order], label[order]
    first = np.concatenate([[True], label[1:] != label[:-1]])
    least = node[first][np.cumsum(first) - 1]
    return least[~first], node[~first]


def _links(batches):
    """Over batches of (key, node, fingerprint) sorted by key: links among the rows of each key."""

    def found(parts):
        key, node, *longs = (np.concatenate(c) for c in zip(*parts))
        links = _stars(node, _same_variant(key, np.stack(longs, axis=1).view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    held: list = []  # rows of keys that the next batch may continue
    for b in batches:
        if not len(b):
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and (cut or held[-1][0][-1] != cols[0][0]):
            # all before the last key is whole
            yield found([*held, [c[:cut] for c in cols]])
            held = []
        elif cut:
            yield found([[c[:cut] for c in cols]])
        held.append([c[cut:] for c in cols])
    if held:
        yield found(held)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """nodes: (node, fingerprint), distinct. Links (a, b) whose components are those of all pairs that
    share a signature and differ in at most FAR_BITS bits; for each key not more than rows."""
    keys = []
    for place in range(BYTES):
        byte = F.shiftrightunsigned(NAMES[place // 8], place % 8 * 8).bitwiseAND(F.lit(255))
        keys.append((byte + (place << 8)).cast("int"))
    index = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", *NAMES)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "a long, b long").distinct()
