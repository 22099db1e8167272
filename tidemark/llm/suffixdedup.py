"""Removal of repeated byte strings, by a distributed difference-cover suffix sort.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller id.

1. Candidates. Every WIDTH-byte window has an anchor: the leftmost least hash of its GRAM-byte grams.
   Equal windows have equal anchors, so a window whose anchor occurs in one document only is unique.
   The rest forms chunks, cut at anchors that a hash selects; chunks of equal bytes are one, owned by
   their least document. The same filter on distinct chunks leaves the fragments to be sorted. Both
   filters drop only windows that provably have no equal elsewhere.
2. Suffix sort of the fragments to depth WIDTH. Positions i with i mod 3 in {1, 2} are sampled.
   Eight-byte words are order-preserving names; triples of them are range-partitioned, sorted and
   named (24 bytes), and the recursion sorts triples (name, name 24 bytes on, last bytes), which
   names the sampled suffixes to depth WIDTH and, from the same order, to WIDTH - 1 and WIDTH - 2.
3. The remaining suffixes (i mod 3 = 0) merge with them: next to class 1 by (byte, name of i + 1),
   next to class 2 by (two bytes, name of i + 2). Adjacent suffixes with equal prefixes of WIDTH
   bytes share their least owner, and where that is less than a fragment's own, the window goes.
   An equal chunk in a later document goes whole: its owner's suffixes are equal to all of its own.
4. Removed windows return to chunks, to documents, and there to bytes.

Blocks hold about BLOCK_BYTES of text, so a task's memory does not follow the table's size; only
packed arrays of hashes, names and places move. A packed row holds what one block sends to one bucket
or range, at least one item, so there are never more rows than items. Sort ranges are cut by DEPTH
bytes, so that a frequent beginning is spread over many ranges. Counts and the cuts of the ranges, 48
bytes for each BUCKET_ITEMS suffixes, are all that comes to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import distinct, forget, materialize, trim

WIDTH = 50
GRAM = 40
#: The same for the second filter, which only sees distinct chunks.
FINE_GRAM = 40
#: One in so many anchors begins a new chunk, and so does every LONGEST-th window of a run.
CUT = 16
LONGEST = 1 << 16
#: Blocks hold about BLOCK_BYTES; there are LEAST_BLOCKS at least, so that small tables use many tasks.
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 24
#: Blocks of the sort, whose arrays take some 60 bytes for each byte of text.
FRAGMENT_BYTES = 2 << 20
#: Hash buckets and sort ranges: at least LEAST_BUCKETS, and so many that each holds about BUCKET_ITEMS.
LEAST_BUCKETS = 64
BUCKET_ITEMS = 1_000_000
#: Bytes that cut the sort ranges: the shortest depth to which suffixes are named in the end.
DEPTH = 48
#: One in so many sampled sort keys becomes a cut.
OVERSAMPLE = 32
#: Bits of a row's number within its block.
ROW_BITS = 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the offsets of its rows."""
    arr = pa.chunked_array(column.chunks, column.type).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary()) if len(arr) else pa.array([], pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hash of the `gram` bytes from each place, by doubling."""
    cur, have, power = buf.astype(np.uint32) + np.uint32(1), 1, 0x01000193
    out, got, n = None, 0, gram
    while True:
        if n & 1:
            out, got = (cur, have) if out is None else (out[: len(out) - have] * np.uint32(power) + cur[got : got + len(out) - have], got + have)
        n >>= 1
        if not n:
            break
        cur = cur[: len(cur) - have] * np.uint32(power) + cur[have:]
        have, power = 2 * have, power * power % (1 << 32)
    out = out ^ (out >> np.uint32(15))
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place but the last seven, as integers of the same order, by doubling."""
    w = (buf[:-1].astype(np.uint64) << np.uint64(8)) | buf[1:]
    w = (w[:-2] << np.uint64(16)) | w[2:]
    return (w[:-4] << np.uint64(32)) | w[4:]


def _names64(words: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the `gram` bytes from each of the given places."""
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(0, gram, 8):
        word = words[at + k]
        if gram - k < 8:
            word >>= np.uint64(8 * (8 - gram + k))
        out = (out ^ word) * _M1
        out ^= out >> np.uint64(32)
        out *= _M2
        out ^= out >> np.uint64(29)
    return out


def _anchor_runs(buf: np.ndarray, offsets: np.ndarray, gram: int, size: int = 1 << 17):
    """All windows that lie in one row, as maximal runs with the same anchor: (row, first window, last + 1,
    hash of the anchor), a slab at a time, in order. A slab's edge may cut a run."""
    begin, end = offsets[:-1], offsets[1:] - WIDTH + 1  # a row's windows
    keep = end > begin
    row_id, begin, end = np.flatnonzero(keep), begin[keep], end[keep]
    span = WIDTH - gram + 1
    for a in range(0, len(buf) - WIDTH + 1, size):
        b = min(a + size, len(buf) - WIDTH + 1)
        h = _gram_hashes(buf[a : b + WIDTH - 1], gram)
        # hash first, then place: the minimum is the leftmost least
        m, have = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * have <= span:
            m = np.minimum(m[: len(m) - have], m[have:])
            have *= 2
        m = np.minimum(m[: b - a], m[span - have : span - have + b - a])
        lo, hi = np.searchsorted(end, a, side="right"), np.searchsorted(begin, b)
        if lo >= hi:
            continue
        edges = [np.flatnonzero(m[1:] != m[:-1]) + 1 + a, np.maximum(begin[lo:hi], a), np.minimum(end[lo:hi], b)]
        cuts = distinct(np.concatenate(edges))
        first, last = cuts[:-1], cuts[1:]
        if not len(first):
            continue
        r = np.searchsorted(begin, first, side="right") - 1
        good = (r >= 0) & (first < end[np.maximum(r, 0)])
        first, last, r = first[good], last[good], r[good]
        place = (m[first - a] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        words = _words(np.concatenate([buf[a : b + WIDTH - 1], np.zeros(8, np.uint8)]))
        yield row_id[r], first, last, _names64(words, place, gram)


def _zip(x: np.ndarray) -> bytes:
    """The bytes of an array, compressed."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unzip(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), dtype)


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as (bucket, rest): the rest, at most 32 bits, in the low half. Two hashes of one code only
    keep a window that the filter might have dropped."""
    rest = min(32, 64 - ROW_BITS - buckets.bit_length())
    return ((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(64 - rest))


def _repeated_anchors(rows: DataFrame, buckets: int, gram: int) -> DataFrame:
    """rows: (blk, text). (blk, bucket, rests): codes of each block's anchors that occur in several rows."""
    rest = min(32, 64 - ROW_BITS - buckets.bit_length())

    def gather(t):
        trim()
        buf, off = _texts(t["text"])
        got = [(h, row) for row, _, _, h in _anchor_runs(buf, off, gram)]
        code = _codes(np.concatenate([h for h, _ in got]) if got else np.zeros(0, np.uint64), buckets)
        row = np.concatenate([r for _, r in got]).astype(np.uint64) if got else np.zeros(0, np.uint64)
        # (bucket, rest, row) in one integer
        key = ((code >> np.uint64(32)) << np.uint64(rest + ROW_BITS)) | ((code & np.uint64(0xFFFFFFFF)) << np.uint64(ROW_BITS)) | (row & np.uint64((1 << ROW_BITS) - 1))
        key = distinct(key)
        new = _runs(key >> np.uint64(ROW_BITS))
        at = np.flatnonzero(new)
        # rows whose numbers do not fit may look alike: then every anchor counts as repeated
        many = (np.diff(np.append(at, len(key))) > 1) | (len(off) > 1 << ROW_BITS)
        key = key[at] >> np.uint64(ROW_BITS)
        cut = np.searchsorted(key >> np.uint64(rest), np.arange(buckets + 1, dtype=np.uint64))
        low = (key & np.uint64((1 << rest) - 1)).astype(np.uint32)
        full = np.flatnonzero(np.diff(cut)).tolist()
        blk = t["blk"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "blk": pa.array([blk] * len(full), pa.int32()),
                "h": pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()),
                "many": pa.array([np.packbits(many[cut[k] : cut[k + 1]]).tobytes() for k in full], pa.binary()),
            }
        )

    def meet(t):
        parts = [np.frombuffer(x, np.uint32) for x in t["h"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(t["many"].to_pylist(), parts)])
        ids, which = np.unique(np.asarray(t["blk"]), return_inverse=True)
        from_ = np.repeat(which, [len(p) for p in parts]).astype(np.uint64)
        key = np.sort((np.concatenate(parts).astype(np.uint64) << np.uint64(32)) | (from_ << np.uint64(1)) | many)
        at = np.flatnonzero(_runs(key >> np.uint64(32)))
        size = np.diff(np.append(at, len(key)))
        keep = np.repeat((size > 1) | (np.bitwise_or.reduceat(key & np.uint64(1), at) > 0), size)
        key = key[keep]
        # by block, then hash
        key = np.sort((((key & np.uint64(0xFFFFFFFF)) >> np.uint64(1)) << np.uint64(32)) | (key >> np.uint64(32)))
        cut = np.searchsorted(key >> np.uint64(32), np.arange(len(ids) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cut)).tolist()
        low = key.astype(np.uint32)
        return pa.table(
            {
                "blk": pa.array(ids[full], pa.int32()),
                "bucket": pa.array([t["bucket"][0].as_py()] * len(full), pa.int32()),
                "rests": pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()),
            }
        )

    sent = rows.select("blk", "text").groupBy("blk").applyInArrow(gather, "bucket int, blk int, h binary, many binary")
    return sent.groupBy("bucket").applyInArrow(meet, "blk int, bucket int, rests binary")


def _found(t: pa.Table) -> np.ndarray:
    """The sorted codes of a block's repeated anchors."""
    parts = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(t["bucket"].to_pylist(), t["rests"].to_pylist())]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _candidate_runs(buf, off, found: np.ndarray, buckets: int, cut: int, gram: int):
    """(row, first window, last window + 1) of each maximal run of windows whose anchors are in `found`,
    cut before windows whose anchor's hash selects it, and every LONGEST windows."""
    out = []
    for row, first, last, h in _anchor_runs(buf, off, gram):
        if len(found):
            code = _codes(h, buckets)
            good = found[np.minimum(np.searchsorted(found, code), len(found) - 1)] == code
            out.append((row[good], first[good], last[good], h[good]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    row, lo, hi, h = (np.concatenate(x) for x in zip(*out))
    if not len(row):
        return row, lo, hi
    joined = (lo[1:] == hi[:-1]) & (row[1:] == row[:-1])
    if cut:
        joined &= ((h[1:] >> np.uint64(7)) % np.uint64(cut) != 0) | (h[1:] == h[:-1])
    row, lo, hi = row[np.concatenate([[True], ~joined])], lo[np.concatenate([[True], ~joined])], hi[np.concatenate([~joined, [True]])]
    parts = -(-(hi - lo) // LONGEST)
    if len(parts) and parts.max() > 1:
        row, begin, end = np.repeat(row, parts), np.repeat(lo, parts), np.repeat(hi, parts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo = begin + step * LONGEST
        hi = np.minimum(lo + LONGEST, end)
    return row, lo, hi


def _block(key: str, total: int, salt=None):
    """The number of a key's block, of blocks of about BLOCK_BYTES each; a salt of 0 changes nothing."""
    n = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    return F.pmod(F.xxhash64(F.col(key), F.lit(9) + (F.lit(0) if salt is None else salt)), F.lit(n)).cast("int")


def _buckets(items: int) -> int:
    return max(LEAST_BUCKETS, -(-items // BUCKET_ITEMS))


def _chunks(rows: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """rows: (blk, dkey, doc_id, text). One row for each chunk's occurrence: ckey, doc_id, dkey, blk,
    start, windows, text."""

    def cut(t, f):
        trim()
        buf, off = _texts(t["text"])
        row, lo, hi = _candidate_runs(buf, off, _found(f), buckets, CUT, GRAM)
        raw = buf.tobytes()
        texts = [raw[a : b + WIDTH - 1] for a, b in zip(lo.tolist(), hi.tolist())]
        take = pa.array(row, pa.int64())
        return pa.table(
            {
                "ckey": pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary()),
                "doc_id": t["doc_id"].combine_chunks().take(take) if len(row) else pa.array([], pa.int64()),
                "dkey": t["dkey"].combine_chunks().take(take) if len(row) else pa.array([], pa.int64()),
                "blk": pa.array([t["blk"][0].as_py()] * len(row) if len(row) else [], pa.int32()),
                "start": pa.array(lo - off[row], pa.int64()),
                "windows": pa.array(hi - lo, pa.int64()),
                "text": pa.array(texts, pa.binary()),
            }
        )

    return rows.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(cut, "ckey binary, doc_id long, dkey long, blk int, start long, windows long, text binary")


def _fragments(chunks: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """chunks: (blk, ckey, owner, text). (ckey, off, owner, text): the parts that other chunks may hold too."""

    def cut(t, f):
        trim()
        buf, off = _texts(t["text"])
        row, lo, hi = _candidate_runs(buf, off, _found(f), buckets, 0, FINE_GRAM)
        raw = buf.tobytes()
        take = pa.array(row, pa.int64())
        texts = [raw[a : b + WIDTH - 1] for a, b in zip(lo.tolist(), hi.tolist())]
        return pa.table(
            {
                "near": pa.array(_least_anchor(texts), pa.int64()),
                "ckey": t["ckey"].combine_chunks().take(take) if len(row) else pa.array([], pa.binary()),
                "off": pa.array(lo - off[row], pa.int64()),
                "owner": t["owner"].combine_chunks().take(take) if len(row) else pa.array([], pa.int64()),
                "text": pa.array(texts, pa.binary()),
            }
        )

    return chunks.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(cut, "near long, ckey binary, off long, owner long, text binary")


def _least_anchor(texts: list[bytes]) -> np.ndarray:
    """The least anchor hash of each text: similar texts mostly share it."""
    if not texts:
        return np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [(row, h) for row, _, _, h in _anchor_runs(np.frombuffer(b"".join(texts), np.uint8), off, GRAM)]
    out = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
    for row, h in got:
        np.minimum.at(out, row, h)
    return out.view(np.int64)


class _Block:
    """A block of fragments in a fixed order, and its positions: every step finds them alike."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("ckey", "ascending"), ("off", "ascending")])
        self.table = t
        buf, self.off = _texts(t["text"])
        self.buf = np.concatenate([buf, np.zeros(WIDTH + 32, np.uint8)])
        n = np.diff(self.off).astype(np.int32)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.pos = np.arange(len(buf), dtype=np.int32) - np.repeat(self.off[:-1].astype(np.int32), n)
        self.left = np.repeat(n, n) - self.pos
        self.words = _words(self.buf)

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at]

    def sampled(self, depth: int) -> np.ndarray:
        return np.flatnonzero((self.pos % 3 != 0) & (self.left >= depth))

    def windows(self) -> np.ndarray:
        return np.flatnonzero(self.left >= WIDTH)


def _by_part(part: np.ndarray) -> np.ndarray:
    """A stable order by range; small integers sort by radix."""
    return np.argsort(part.astype(np.uint16) if not len(part) or part.max() < 1 << 16 else part, kind="stable")


def _deal(part: np.ndarray, n: int, blk: int, **columns: np.ndarray) -> pa.Table:
    """One packed row for each sort range, in the block's order."""
    order = _by_part(part)
    cut = np.searchsorted(part[order], np.arange(n + 1))
    full = [k for k in range(n) if cut[k] < cut[k + 1]]
    out = {"part": pa.array(full, pa.int32()), "blk": pa.array([blk] * len(full), pa.int32())}
    for name, c in columns.items():
        c = c[order]
        out[name] = pa.array([_zip(c[cut[k] : cut[k + 1]]) for k in full], pa.binary())
    return pa.table(out)


def _packed(t: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([_unzip(x, dtype) for x in t[name].to_pylist()]) if t.num_rows else np.zeros(0, dtype)


def _sizes(t: pa.Table, name: str, width: int) -> list[int]:
    """How many items of `width` bytes each packed row has."""
    return [int.from_bytes(x[:8], "little") // width for x in t[name].to_pylist()]


def _returned(t: pa.Table, sizes: list[int], **columns: np.ndarray) -> pa.Table:
    """The columns cut back into the rows of t (part, blk) that they came from."""
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    out = {"part": t["part"], "blk": t["blk"]}
    for name, c in columns.items():
        out[name] = pa.array([_zip(c[a:b]) for a, b in zip(at, at[1:])], pa.binary())
    return pa.table(out)


def _restore(part: np.ndarray, t: pa.Table, name: str, dtype) -> np.ndarray:
    """Undoes _deal for returned rows: values in the order of `part`."""
    out = np.zeros(len(part), dtype)
    got = {p: x for p, x in zip(t["part"].to_pylist(), t[name].to_pylist())}
    order = _by_part(part)
    at = np.flatnonzero(_runs(part[order]))
    ids, at = part[order][at], np.append(at, len(order))
    for k, p in enumerate(ids.tolist()):
        out[order[at[k] : at[k + 1]]] = _unzip(got[p], dtype)
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted sequence of keys changes."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, bool)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _cuts(frags: DataFrame, n: int, total: int) -> np.ndarray:
    """About n - 1 ascending, distinct rows of six words: what the sort ranges begin with. Quantiles of
    the first DEPTH bytes of randomly drawn suffixes, OVERSAMPLE for each range, sorted in Spark."""
    rate = min(1.0, OVERSAMPLE * n / max(1, total))

    def draw(batches):
        rng = np.random.default_rng(7)
        for b in batches:
            buf, off = _texts(b.column(0))
            left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))
            at = np.flatnonzero((rng.random(len(buf)) < rate) & (left >= DEPTH))
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + DEPTH] for i in at.tolist()], pa.binary())], names=["k"])

    def every(batches):
        seen = OVERSAMPLE // 2
        for b in batches:
            take = np.arange((-seen) % OVERSAMPLE, len(b), OVERSAMPLE)
            seen += len(b)
            yield b.take(pa.array(take, pa.int64()))

    keys = frags.select("text").mapInArrow(draw, "k binary").repartitionByRange(max(1, n // 256), "k").sortWithinPartitions("k")
    got = sorted({bytes(r["k"]) for r in keys.mapInArrow(every, "k binary").toLocalIterator()})
    return np.frombuffer(b"".join(got), ">u8").reshape(-1, DEPTH // 8).astype(np.uint64)


def _ranges(cuts: np.ndarray, word) -> np.ndarray:
    """How many rows of `cuts` are not above each key; word(j) gives the keys' j-th words, and as many
    words as the cuts have columns count."""
    first = word(0)
    part = np.searchsorted(cuts[:, 0], first, side="right")
    tie = np.flatnonzero((part > 0) & (cuts[np.maximum(part - 1, 0), 0] == first)) if len(cuts) else np.zeros(0, np.int64)
    if not len(tie) or cuts.shape[1] == 1:
        return part
    keys = np.stack([word(j)[tie] for j in range(cuts.shape[1])], axis=1)
    lo, hi = np.searchsorted(cuts[:, 0], keys[:, 0], side="left"), part[tie]
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = cuts[np.minimum(mid, len(cuts) - 1)]
        differ = at != keys
        j = np.argmax(differ, axis=1)
        i = np.arange(len(keys))
        above = differ.any(axis=1) & (at[i, j] > keys[i, j])
        lo, hi = np.where((lo < hi) & ~above, mid + 1, lo), np.where((lo < hi) & above, mid, hi)
    part[tie] = lo
    return part


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the distinct values, as uint64."""
    order = np.argsort(key)
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(_runs(key[order])) - 1
    return out


def _joint(code: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs (code, rank), both below 2^32."""
    return _dense((code << np.uint64(32)) | rank.astype(np.uint64))


def _least(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each element the least owner among those with equal keys: sort, compare adjacent, spread."""
    out = np.empty(len(owner), owner.dtype)
    if not len(owner):
        return out
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    starts = np.flatnonzero(_runs(*(k[order] for k in keys)))
    low = np.minimum.reduceat(owner[order], starts)
    out[order] = np.repeat(low, np.diff(np.append(starts, len(order))))
    return out


def _pair(short: np.ndarray, bits: int, name: np.ndarray, n: int) -> tuple:
    """(short, name) in one integer where that fits; names are range << 32 | rank, of n ranges."""
    if n <= 1 << (32 - bits):
        return ((short.astype(np.uint64) << np.uint64(64 - bits)) | name,)
    return short, name


def suffix_matches(frags: DataFrame, total: int) -> DataFrame:
    """frags: (blk, ckey, off, owner, text), materialized. (ckey, starts): windows of each chunk, as packed
    int64 offsets, that also start in a fragment of a lesser owner. The difference-cover sort."""
    n = _buckets(total * 2 // 3)
    cuts = _cuts(frags, n, total)
    ranges = frags.sparkSession.sparkContext.broadcast((np.unique(cuts[:, :3], axis=0) if len(cuts) else cuts[:, :3], cuts))
    n = len(cuts) + 1
    wide = np.uint16 if n <= 1 << 16 else np.uint32
    merged = ("counts", "head", "xh", "xl", "yh", "yl", "owners", "which")
    merged_ddl = "part int, blk int, " + ", ".join(f"{c} binary" for c in merged)

    def triples_of(b):
        """The sampled places, the distinct 24-byte keys of a block, and which key each place has."""
        at = b.sampled(24)
        keys = [b.word(at), b.word(at + 8), b.word(at + 16)]
        mixed = keys[0] * _M1
        for k in keys[1:]:
            mixed = (mixed ^ (mixed >> np.uint64(31)) ^ k) * _M2
        order = np.argsort(mixed)
        if (_runs(mixed[order]) != _runs(*(k[order] for k in keys))).any():  # two keys of one hash
            order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = _runs(*keys)
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        # near keys side by side compress well
        first = np.argsort(keys[0][new])
        back = np.empty(len(first), np.int64)
        back[first] = np.arange(len(first))
        return at, [k[new][first] for k in keys], back[which]

    def short(keys):
        """The range of each 24-byte key."""
        return _ranges(ranges.value[0], lambda j: keys[j])

    def long(b, at):
        """The range of the suffix at each place, by its first DEPTH bytes."""
        return _ranges(ranges.value[1], lambda j: b.word(at + 8 * j))

    def triples(t):
        b = _Block(t)
        _, keys, _ = triples_of(b)
        part = short(keys)
        return _deal(part, n, t["blk"][0].as_py(), key=np.stack(keys, axis=1).astype(">u8"))

    def name_triples(t):
        a, b, c = _packed(t, "key", ">u8").reshape(-1, 3).T.astype(np.uint64)
        names = _joint(_joint(_dense(a), _dense(b)), _dense(c)).astype(np.uint32)
        return _returned(t, _sizes(t, "key", 24), name=names)

    def named24(b, names):
        """The 24-byte names of all sampled places: range in the high half, rank in the low."""
        at, keys, which = triples_of(b)
        part = short(keys)
        got = (part.astype(np.uint64) << np.uint64(32)) | _restore(part, names, "name", np.uint32)
        full = np.zeros(len(b.pos) + WIDTH, np.uint64)
        full[at] = got[which]
        return full

    def recurse(t, names):
        b = _Block(t)
        name = named24(b, names)
        at = b.sampled(WIDTH - 2)
        first = name[at]
        # the tail of a suffix too short for it is never looked at
        tail = (b.buf[at + 48].astype(np.uint16) << np.uint16(8)) | b.buf[at + 49]
        second = name[at + 24]
        high = [(v >> np.uint64(32)).astype(wide) for v in (first, second)]
        return _deal(long(b, at), n, t["blk"][0].as_py(), ah=high[0], a=first.astype(np.uint32), bh=high[1], b=second.astype(np.uint32), c=tail)

    def name_suffixes(t):
        first, second = ((_packed(t, f"{x}h", wide).astype(np.uint64) << np.uint64(32)) | _packed(t, x, np.uint32) for x in "ab")
        c = _packed(t, "c", np.uint16)
        d48 = _joint(_dense(first), _dense(second))
        d49 = _joint(d48, c >> np.uint16(8))
        d50 = _joint(d49, c)
        # a shorter depth's name is the least name of its group, sent as the mostly small step back to it
        out = {"d50": d50.astype(np.uint32)}
        place = np.arange(int(d50.max()) + 1 if len(d50) else 0, dtype=np.uint32)
        for name, code in (("d49", d49), ("d48", d48)):
            group = np.empty(len(place), np.uint64)
            group[d50] = code
            first = np.maximum.accumulate(np.where(_runs(group), place, 0))
            out[name] = (out["d50"] - first[d50]).astype(np.uint32)
        return _returned(t, _sizes(t, "a", 4), **out)

    def remaining(t, names):
        b = _Block(t)
        at = b.sampled(WIDTH - 2)
        part = long(b, at)
        deep = {}
        for d in ("d50", "d49", "d48"):
            full = np.zeros(len(b.pos) + WIDTH, np.uint64)
            got = _restore(part, names, d, np.uint32)
            got = got if d == "d50" else deep["d50"][at].astype(np.uint32) - got
            full[at] = (part.astype(np.uint64) << np.uint64(32)) | got
            deep[d] = full
        i = b.windows()
        # by range, then class, then place: the class of an element follows from two counts
        cls = b.pos[i] % 3
        part = long(b, i)
        order = _by_part(part * 3 + cls)
        i, cls, part = i[order], cls[order], part[order]
        # the two names that place a suffix: class 0 has (i + 1, i + 2), class 1 (i, i + 1), class 2 (i, i + 2)
        x = np.where(cls == 0, deep["d49"][i + 1], deep["d50"][i])
        y = np.where(cls == 1, deep["d49"][i + 1], deep["d48"][i + 2])
        owner = np.asarray(b.table["owner"])[b.row[i]]
        cut = np.searchsorted(part, np.arange(n + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[k], cut[k + 1])
            owners, which = np.unique(owner[s], return_inverse=True)
            high = [_zip((v[s] >> np.uint64(32)).astype(wide)) for v in (x, y)]
            low = [_zip(v[s].astype(np.uint32)) for v in (x, y)]
            head = _zip(np.concatenate([b.buf[i[s]], b.buf[i[s] + 1]]))
            counts = np.bincount(cls[s], minlength=3).astype(np.int64).tobytes()
            rows.append((k, counts, head, high[0], low[0], high[1], low[1], owners.astype(np.int64).tobytes(), _zip(which.astype(np.uint16 if len(owners) <= 1 << 16 else np.uint32))))
        cols = list(zip(*rows)) or [[]] * 9
        out = {"part": pa.array(cols[0], pa.int32()), "blk": pa.array([t["blk"][0].as_py()] * len(rows), pa.int32())}
        return pa.table(out | {c: pa.array(v, pa.binary()) for c, v in zip(merged, cols[1:])})

    def merge(t):
        trim()
        cls, heads, xs, ys, owners, sizes = [], [], [], [], [], []
        for counts, head, xh, xl, yh, yl, ids, which in zip(*(t[c].to_pylist() for c in merged)):
            c = np.frombuffer(counts, np.int64)
            m = int(c.sum())
            sizes.append(m)
            cls.append(np.repeat(np.arange(3, dtype=np.uint8), c))
            h = _unzip(head, np.uint8).reshape(2, m).astype(np.uint16)
            heads.append((h[0] << np.uint16(8)) | h[1])
            for to, hi, lo in ((xs, xh, xl), (ys, yh, yl)):
                to.append((_unzip(hi, wide).astype(np.uint64) << np.uint64(32)) | _unzip(lo, np.uint32))
            own = np.frombuffer(ids, np.int64)
            owners.append(own[_unzip(which, np.uint16 if len(own) <= 1 << 16 else np.uint32)])
        cls, head, x, y, owner = (np.concatenate(v) for v in (cls, heads, xs, ys, owners))
        low = owner.copy()
        one = head >> np.uint16(8)
        # sampled suffixes among themselves; class 0 with class 1; class 0 with class 2
        for keep, keys in ((cls != 0, (x,)), (cls != 2, _pair(one, 8, np.where(cls == 0, x, y), n)), (cls != 1, _pair(head, 16, y, n))):
            at = np.flatnonzero(keep)
            low[at] = np.minimum(low[at], _least(owner[at], *(k[at] for k in keys)))
        return _returned(t, sizes, gone=low < owner)

    def back(t, gone):
        trim()
        b = _Block(t)
        i = b.windows()
        part = long(b, i)
        order = _by_part(part * 3 + b.pos[i] % 3)
        i, part = i[order], part[order]
        hit = np.sort(i[_restore(part, gone, "gone", bool)])
        row = b.row[hit]
        start = b.pos[hit] + np.asarray(b.table["off"])[row]
        at = np.flatnonzero(_runs(row))
        ids, at = row[at], np.append(at, len(row))
        keys = b.table["ckey"].combine_chunks().take(pa.array(ids, pa.int64())) if len(ids) else pa.array([], pa.binary())
        return pa.table({"ckey": keys, "starts": pa.array([start[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())})

    def groups(f, side, schema):
        def run(t, s):
            if not t.num_rows:
                return pa.table({c.split()[0]: pa.array([], pa.binary() if "binary" in c else pa.int32()) for c in schema.split(", ")})
            return f(t, s)

        return frags.groupBy("blk").cogroup(side.groupBy("blk")).applyInArrow(run, schema)

    sent = frags.groupBy("blk").applyInArrow(triples, "part int, blk int, key binary")
    names = materialize(sent.groupBy("part").applyInArrow(name_triples, "part int, blk int, name binary"), "names24")
    sent = groups(recurse, names, "part int, blk int, ah binary, a binary, bh binary, b binary, c binary")
    deep = materialize(sent.groupBy("part").applyInArrow(name_suffixes, "part int, blk int, d50 binary, d49 binary, d48 binary"), "names50")
    forget(names)
    sent = groups(remaining, deep, merged_ddl)
    gone = materialize(sent.groupBy("part").applyInArrow(merge, "part int, blk int, gone binary"), "gone")
    forget(deep)
    return groups(back, gone, "ckey binary, starts binary")


def removed_spans(docs: DataFrame, total: int) -> DataFrame:
    """docs: (dkey, doc_id, text), no null. (blk, dkey, start, windows, starts): windows to remove, all from start on
    or, where starts is given, those (packed, relative to start); blk is _block("dkey", total)."""
    rows = docs.withColumn("blk", _block("dkey", total))
    buckets = _buckets(total // 6)
    found = materialize(_repeated_anchors(rows, buckets, GRAM), "anchors")
    occ = materialize(_chunks(rows, found, buckets), "chunks")
    forget(found)
    # chunks are one only if their bytes are equal
    chunks = materialize(occ.groupBy("ckey", "text").agg(F.min("doc_id").alias("owner")), "distinct-chunks")
    if not chunks.groupBy("ckey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("two different chunks have the same 128-bit key")
    whole, occ = occ, materialize(occ.drop("text"), "occurrences")
    forget(whole)
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocked = chunks.withColumn("blk", _block("ckey", size))
    buckets = _buckets(size // 6)
    again = materialize(_repeated_anchors(blocked, buckets, FINE_GRAM), "anchors")
    frags = materialize(_fragments(blocked, again, buckets), "fragments")
    forget(again)
    whole, chunks = chunks, materialize(chunks.drop("text"), "owners")
    forget(whole)
    left = frags.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # fragments that share text meet in a block where they can, so that equal keys are sent once; ranges
    # of the key that they share, then of a hash, split what many share
    blocks = max(1, -(-left // FRAGMENT_BYTES))
    blocked = frags.repartitionByRange(blocks, "near", F.xxhash64("ckey", "off")).withColumn("blk", F.spark_partition_id())
    blocked = materialize(blocked.drop("near"), "blocks")
    forget(frags)
    hits = materialize(suffix_matches(blocked, left), "hits")
    forget(blocked)
    # a chunk has as many rows as fragments; written, so that the join below has plain exchanges, which can be split
    again, hits = hits, materialize(hits.groupBy("ckey").agg(F.collect_list("starts").alias("starts")), "hits")
    forget(again)
    info = chunks.select("ckey", "owner").join(hits, "ckey", "left")
    per = occ.select("ckey", "doc_id", "dkey", "blk", "start", "windows").join(info, "ckey").filter("doc_id > owner OR starts IS NOT NULL")
    return per.select("blk", "dkey", "start", "windows", F.when(F.col("doc_id") > F.col("owner"), F.lit(None)).otherwise(F.col("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty. A row with a null id is smaller than none, so it neither loses bytes
    nor makes others lose any. Rows that share an id lose nothing to each other. An id must be an
    integer; other columns play no part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.col(id_col).alias("_id")).alias("rest"))
    cut = _cut_rows(rows, give_text=False)
    return cut.select(F.col("rest._id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with the removed bytes gone from the text, and n_chars, if there is
    such a column, counted anew. Bytes of a character that was cut in two go as well; null stays null."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.col(text_col).isNull().alias("_null"), *others).alias("rest"))
    cut = _cut_rows(rows, give_text=True)
    text = F.when(~F.col("rest._null"), F.col("kept_text")).alias(text_col)
    fresh = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col(f"rest.{chars_col}")).alias(chars_col) if chars_col in others else None
    return cut.select(*[text if c == text_col else fresh if c == chars_col else F.col(f"rest.{c}").alias(c) for c in docs.columns])


def _cut_rows(rows: DataFrame, give_text: bool) -> DataFrame:
    """rows: (doc_id, text, rest). rest and the figures of each row, in which its bytes are cut."""
    rows = rows.withColumn("dkey", F.xxhash64("doc_id", "text"))
    size = F.octet_length("text")
    total = rows.agg(F.sum(size)).first()[0] or 0
    # rows that are repeated over and over are searched once and cut in several blocks
    hot = rows.groupBy("dkey").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(size) / BLOCK_BYTES).cast("int").alias("parts"))
    hot = materialize(hot.filter("n > 1 AND parts > 1").drop("n"), "hot")
    docs = rows.filter(F.col("doc_id").isNotNull() & (size >= WIDTH)).select("dkey", "doc_id", "text")
    many = not hot.isEmpty()
    if many:
        once = docs.join(hot, "dkey").groupBy("dkey").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        docs = docs.join(hot, "dkey", "left_anti").unionByName(once)
    spans = removed_spans(docs, total)
    # short rows lose nothing, so they may lie anywhere
    loose = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    salt = F.when(size < WIDTH, loose)
    if many:
        rows = rows.join(hot, "dkey", "left")
        salt = salt.otherwise(F.pmod(loose, F.coalesce("parts", F.lit(1))))
        spans = spans.join(hot, "dkey", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        spans = spans.withColumn("blk", _block("dkey", total, F.col("salt"))).drop("parts", "salt")
    else:
        salt = salt.otherwise(F.lit(0))
    blocked = rows.withColumn("blk", _block("dkey", total, salt)).select("dkey", "text", "rest", "blk")

    def finish(t, s):
        trim()
        buf, off = _texts(t["text"])
        off = off[: t.num_rows + 1]
        edge = np.zeros(len(buf) + 1, np.int64)
        if s.num_rows and t.num_rows:
            # a span holds for all rows of its key
            mine, theirs = np.asarray(t["dkey"]), np.asarray(s["dkey"])
            order = np.argsort(mine, kind="stable")
            lo, hi = (np.searchsorted(mine[order], theirs, side=x) for x in ("left", "right"))
            span = np.repeat(np.arange(len(theirs)), hi - lo)
            row = order[np.arange(len(span)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[span]]
            begin = off[row] + np.asarray(s["start"])[span]
            lists = s["starts"].combine_chunks()
            some = ~np.asarray(lists.is_null())
            whole = ~some[span]
            np.add.at(edge, begin[whole], 1)
            np.add.at(edge, begin[whole] + np.asarray(s["windows"])[span[whole]] + WIDTH - 1, -1)
            packed = [b"".join(x) for x in lists.filter(pa.array(some)).to_pylist()]
            count = np.zeros(len(theirs), np.int64)
            count[some] = [len(x) // 8 for x in packed]
            at, first = np.frombuffer(b"".join(packed), np.int64), np.cumsum(count) - count
            part = np.flatnonzero(~whole)
            n = count[span[part]]
            place = np.repeat(begin[part], n) + at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[span[part]], n)]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + WIDTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[off]
        begins = gone & ~np.concatenate([[False], gone[:-1]])
        begins[off[:-1][np.diff(off) > 0]] |= gone[off[:-1][np.diff(off) > 0]]
        runs = np.concatenate([[0], np.cumsum(begins)])[off]
        raw, kept = buf[~gone].tobytes(), off - removed
        texts = [raw[a:b] for a, b in zip(kept.tolist(), kept[1:].tolist())]
        return pa.table(
            {
                "rest": t["rest"],
                "n_bytes": pa.array(np.diff(off), pa.int64()),
                "n_removed": pa.array(np.diff(removed), pa.int64()),
                "n_spans": pa.array(np.diff(runs), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                "kept_text": pa.array([x.decode("utf-8", "ignore") if give_text else None for x in texts], pa.string()),
            }
        )

    schema = StructType([rows.schema["rest"], *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())])
    return blocked.groupBy("blk").cogroup(spans.groupBy("blk")).applyInArrow(finish, schema)
