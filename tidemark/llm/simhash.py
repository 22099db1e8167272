"""SimHash fingerprints and near-duplicate groups, found by deletion-variant signatures.

A 64-bit fingerprint is cut into m segments. If two fingerprints differ in at most 2m - 1 bits, one
segment differs in at most one bit. Every segment is indexed with each of its bits in turn replaced by
a wildcard; such a pair then has an index key in common. Fingerprints with equal keys are compared,
true links are reduced to a spanning forest for each key, and components follow from these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, forget, materialize

#: Distinct fingerprints under one key that are compared in memory at once; larger groups are
#: compared block by block by many tasks.
BLOCK = 2048
BITS = 64


def _sums(hashes: np.ndarray) -> int:
    """Fingerprint of 64-bit feature hashes: a bit is 1 if set in over half of them."""
    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> list[int]:
    """XXH64 of the shingles, repeats included, of the A-Z-lower-cased words. bytes.lower() and
    bytes.split() know exactly A-Z and the six ASCII white-space characters."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [h(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())]


def word_hashes(text: str | None, seed: int = 42) -> list[int]:
    """XXH64 of the distinct A-Z-lower-cased words."""
    import xxhash

    return [xxhash.xxh64_intdigest(w, seed) for w in set((text or "").encode().lower().split())]


def fingerprint(hashes: list[int]) -> int:
    """Unsigned 64-bit SimHash; 0 if there are no features."""
    return _sums(np.array(hashes, dtype=np.uint64)) if hashes else 0


def _print(text: str | None, feature: str) -> int:
    if not feature.startswith("words"):
        return fingerprint(shingle_hashes(text, int(feature[7:])))
    h = np.array(word_hashes(text), dtype=np.uint64)
    if feature == "wordsagain":
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return _sums(h) if len(h) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, features: tuple[str, ...] = ("shingle3",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp_<feature> long ...) for each row: "shingleN" takes N-word shingles with repeats,
    "words" the set of words, "wordsagain" the same with hashes mixed anew. Null and blank texts have
    fingerprint 0."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = [id_col, *(f"fp_{f}" for f in features)]
    schema = StructType([StructField(id_col, rows.schema["_id"].dataType), *(StructField(n, LongType()) for n in names[1:])])

    def make(batches):
        for b in batches:
            texts = b.column(1)
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                cols = [pa.array([_signed(_print(t, f)) for t in part], pa.int64()) for f in features]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), *cols], names=names)

    return rows.mapInArrow(make, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs in at most one bit."""
    m = (max_bits + 2) // 2
    cuts = [round(k * BITS / m) for k in range(m + 1)]
    return [(BITS - hi, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _forest(fp: np.ndarray, more: np.ndarray, bits: int, more_bits: int, split: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among the fingerprints; with `split`, of the links
    between those before that index and those from it on."""
    parent = list(range(len(fp)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(fp) - 1 if split is None else split):
        lo = i + 1 if split is None else split
        near = np.bitwise_count(fp[i] ^ fp[lo:]) <= bits
        if more_bits < BITS:
            near &= np.bitwise_count(more[i] ^ more[lo:]) <= more_bits
        for j in np.flatnonzero(near).tolist():
            a, b = root(i), root(j + lo)
            if a != b:
                parent[b] = a
                out.append((i, j + lo))
    return out


class _Found:
    """Links, and the rows of hot groups, gathered for one output batch."""

    FIELDS = "a long, b long, seg int, key long, node long, fp long, more long"

    def __init__(self, bits: int, more_bits: int):
        self.bits, self.more_bits, self.links, self.hot = bits, more_bits, [], []

    def compare(self, rows: list[np.ndarray], split: int | None = None) -> None:
        node, fp, more = rows[-3:]
        self.links += [(int(node[i]), int(node[j])) for i, j in _forest(fp.view(np.uint64), more.view(np.uint64), self.bits, self.more_bits, split)]

    def batch(self) -> pa.RecordBatch:
        n, m = len(self.links), sum(len(r[0]) for r in self.hot)
        none = lambda k, t: pa.nulls(k, t)
        cols = [pa.concat_arrays([pa.array([x[k] for x in self.links], pa.int64()), none(m, pa.int64())]) for k in (0, 1)]
        for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())):
            cols.append(pa.concat_arrays([none(n, t), *(pa.array(r[k], t) for r in self.hot)]))
        self.links, self.hot = [], []
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "seg", "key", "node", "fp", "more"])


def _compare(bits: int, more_bits: int):
    """Over batches sorted by (seg, key): the links within each key's group. The members of a group of
    over BLOCK fingerprints are passed on as hot rows, so that no group is ever held whole."""

    def run(batches):
        out = _Found(bits, more_bits)
        held: list[np.ndarray] | None = None  # the group that the next batch may continue
        passing = False  # that group is hot, its rows are passed on as they come

        def close():
            if held is not None and not passing and len(held[0]) > 1:
                out.compare(held)

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            n = len(cols[0])
            if not n:
                continue
            cuts = np.concatenate([[0], np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1, [n]])
            size = np.diff(cuts)
            first = held is not None and held[0][-1] == cols[0][0] and held[1][-1] == cols[1][0]
            for g in sorted({0, len(size) - 1} | set(np.flatnonzero(size > 1).tolist())):
                rows = [c[cuts[g] : cuts[g + 1]] for c in cols]
                if not (g == 0 and first):
                    close()
                    held, passing = rows, False
                elif passing:
                    held = [r[-1:] for r in rows]
                    out.hot.append(rows)
                else:
                    held = [np.concatenate(x) for x in zip(held, rows)]
                if not passing and len(held[0]) > BLOCK:
                    out.hot.append(held)
                    held, passing = [r[-1:] for r in held], True
            yield out.batch()
        close()
        yield out.batch()

    return run


def _blocks(bits: int, more_bits: int):
    """Over one pair of blocks of a hot group: the links within it (one block) or across (two)."""

    def run(key, rows):
        out = _Found(bits, more_bits)
        i, j = key[2].as_py(), key[3].as_py()
        own = np.asarray(rows["block"])
        order = np.argsort(own != i, kind="stable")
        cols = [np.asarray(rows[c])[order] for c in ("node", "fp", "more")]
        out.compare(cols, None if i == j else int((own == i).sum()))
        return pa.Table.from_batches([out.batch()]).select(["a", "b"])

    return run


def links(nodes: DataFrame, max_bits: int, more_bits: int = BITS) -> DataFrame:
    """nodes: distinct (node, fp, more) longs, fp or, to be indexed each by itself, an array of them. Links (a, b) that connect exactly those nodes which a
    chain of pairs with at most max_bits differing bits of fp, and more_bits of more, connects."""
    keys = []
    several = nodes.schema["fp"].dataType.typeName() == "array"
    nodes = nodes.select("node", "more", F.posexplode("fp").alias("copy", "fp")) if several else nodes.withColumn("copy", F.lit(0))
    for s, (shift, width) in enumerate(segments(max_bits)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            # the wildcard's place goes into the key's high part
            keys.append(F.struct((F.col("copy") * 4096 + s * BITS + bit).cast("int").alias("seg"), part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit))).alias("key")))
    index = nodes.select("node", "fp", "more", F.explode(F.array(*keys)).alias("k")).select("k.seg", "k.key", "node", "fp", "more")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "seg", "key").sortWithinPartitions("seg", "key")
    found = materialize(dealt.mapInArrow(_compare(max_bits, more_bits), _Found.FIELDS), "links")
    plain = found.filter(F.col("a").isNotNull()).select("a", "b")
    hot = found.filter(F.col("node").isNotNull())
    sizes = hot.groupBy("seg", "key").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return plain
    spread = hot.select("seg", "key", "node", "fp", "more").join(sizes, ["seg", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = spread.withColumn("other", other).select("seg", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "fp", "more")
    return plain.unionByName(pairs.groupBy("seg", "key", "i", "j").applyInArrow(_blocks(max_bits, more_bits), "a long, b long"))


def components(rows: DataFrame, max_bits: int, more_bits: int = BITS, id_col: str = "doc_id") -> DataFrame:
    """rows: (id, fp[, more]), materialized. Adds component_id, the smallest id reachable. Copies (equal
    fingerprints) take part once; null ids name no component unless all of its ids are null."""
    has_more = "more" in rows.columns
    rows = rows.withColumn("node", F.xxhash64("fp", "more") if has_more else F.col("fp"))  # fp may be an array
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), (F.first("more") if has_more else F.lit(0).cast("long")).alias("more"), F.min(id_col).alias("least"))
    nodes = materialize(nodes, "nodes")
    found = connected_components(links(nodes.drop("least"), max_bits, more_bits))
    named = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return rows.join(named, "node").drop("node")


def simhash_groups(docs: DataFrame, size: int = 3, max_bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint hex, component_id) for each row, on size-word shingles and links of at most
    max_bits differing bits. Fingerprint zero (no words) links like any other."""
    fps = fingerprints(docs, (f"shingle{size}",), id_col).withColumnRenamed(f"fp_shingle{size}", "fp")
    out = components(materialize(fps, "fps"), max_bits, id_col=id_col)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, one of each group of near copies: that with the smallest id.

    Near copies are linked by a Jaccard similarity of their five-word shingles of 0.8 and more, computed
    exactly for candidates that deletion-variant signatures of 384-bit SimHashes give, see widehash. Rows
    go by a key of id and text, so that rows that share an id are judged each by its text; of those with
    the smallest id one stays. Rows with null or blank text or null id are kept."""
    from . import minhash, widehash

    rows = docs.withColumn("_words", F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    named = rows.filter("_words").select(F.col(id_col).alias("_id"), F.xxhash64(id_col, "text").alias("_key"), F.col("text"))
    fps = materialize(minhash.sketches(named, shingle), "sketches")
    firsts = [F.first(c).alias(c) for c in widehash.NAMES]
    # the row that stays; null ids name none
    row = F.struct("_id", "_key")
    least = F.min(F.when(F.col("_id").isNotNull(), row)).alias("least")
    nodes = materialize(fps.groupBy("node").agg(*firsts, least, F.min("_key").alias("rep")), "nodes")
    found = minhash.near_components(nodes, named, shingle)
    part = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = part.join(part.groupBy("component").agg(F.min("least").alias("stays")), "component").select("node", "stays")
    # rows with a null id stay
    drop = fps.join(part, "node").filter(F.col("_id").isNotNull() & (row != F.col("stays"))).select("_key").distinct()
    key = F.xxhash64(docs[id_col], docs["text"])
    kept = docs.join(drop, key == drop["_key"], "left_anti")
    again = fps.filter("_id IS NOT NULL").groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_again"))
    if again.isEmpty():
        return kept
    # of equal rows one stays
    same = F.xxhash64(kept[id_col], kept["text"]) == again["_again"]
    once = kept.join(again, same, "left_semi").dropDuplicates([id_col, "text"])
    return kept.join(again, same, "left_anti").unionByName(once)
