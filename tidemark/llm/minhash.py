"""Near copies by their five-word shingles: candidates by SimHash, see widehash, links by exact Jaccard.

Components of the candidates are clusters, so that a text's shingles are needed in one place only. (The
module's name is that of the method which gave the candidates before.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import widehash
from .common import connected_components, distinct, forget, materialize
from .simhash import shingle_hashes

#: Least similarity of a link.
LEAST = 0.8
#: Members and shingles of a cluster that are compared in memory at once; larger clusters are
#: compared block by block by many tasks.
MEMBERS, SHINGLES = 512, 1 << 20

_PRINT = widehash.NAMES


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return distinct(np.array(shingle_hashes(text, size), dtype=np.uint64))


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """rows: (_id, _key long, text), texts with words. Adds node, the hash of the shingle set, and the
    set's fingerprint in place of text."""
    import xxhash

    kind = rows.select("_id").schema[0].dataType.simpleString()

    def make(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t, size) for t in part.column(2).to_pylist()]
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                prints = np.array([widehash.fingerprint(s) for s in sets])
                cols = [pa.array(c, pa.int64()) for c in (node, *prints.T)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["_id", "_key", "node", *_PRINT])

    longs = ", ".join(f"{c} long" for c in ("_key", "node", *_PRINT))
    return rows.select("_id", "_key", "text").mapInArrow(make, f"_id {kind}, {longs}")


def _groups(batches, keys: int):
    """Over batches sorted by their first `keys` columns: the columns of each group of two rows or more,
    whole; and None at the end of each batch."""
    held = None
    for b in batches:
        if not len(b):
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        new = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(b)]])
        size = np.diff(cuts)
        for g in sorted({0, len(size) - 1} | set(np.flatnonzero(size > 1).tolist())):
            rows = [c[cuts[g] : cuts[g + 1]] for c in cols]
            if g == 0 and held is not None and all(h[0][-1] == r[0] for h, r in zip(held, rows[:keys])):
                for h, r in zip(held, rows):
                    h.append(r)
                continue
            if held is not None and (len(held[0]) > 1 or len(held[0][0]) > 1):
                yield [np.concatenate(h) for h in held]
            held = [[r] for r in rows]
        yield None
    if held is not None and (len(held[0]) > 1 or len(held[0][0]) > 1):
        yield [np.concatenate(h) for h in held]
    yield None


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def with_shingles(texts: DataFrame, size: int) -> DataFrame:
    """texts: (node, cluster, fingerprint, text). The number of shingles, n, and their set in place of text."""
    names = ["node", "cluster", *_PRINT]

    def make(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                sets = [shingle_set(t, size) for t in part.column(2 + len(_PRINT)).to_pylist()]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: 2 + len(_PRINT)], *cols], names=[*names, "n", "shingles"])

    fields = ", ".join(f"{c} long" for c in names)
    return texts.select(*names, "text").mapInArrow(make, f"{fields}, n long, shingles binary")


def _similar(sets: list[np.ndarray]):
    """Whether two sets have a Jaccard similarity of LEAST (4 / 5) or more."""

    def near(i: int, j: int) -> bool:
        x, y = len(sets[i]), len(sets[j])
        if 5 * min(x, y) < 4 * max(x, y):
            return False
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 5 * both >= 4 * (x + y - both)

    return near


def _set_links(keys: int):
    """Over batches sorted by `keys` columns, then side: links within each group or, where it has two
    sides, across."""

    def run(batches):
        found: list[tuple[int, int]] = []
        for rows in _groups(batches, keys):
            if rows is None:
                yield _batch(found)
                found = []
                continue
            side, node, label = rows[keys : keys + 3]
            *prints, shingles = rows[keys + 3 :]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in shingles]
            split = None if side[0] == 2 else int((side == 0).sum())
            found += [(int(node[i]), int(node[j])) for i, j in widehash.forest(np.stack(prints, axis=1).view(np.uint64), label, _similar(sets), split)]

    return run


def _compare(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "side", "node", "label", *_PRINT, "shingles").repartition(n, *keys).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(_set_links(len(keys)), "a long, b long")


def _blocks(rows, shingles):
    return F.greatest(F.ceil(rows / MEMBERS), F.ceil(shingles / SHINGLES)).cast("int")


def exact_links(members: DataFrame) -> DataFrame:
    """members: (node, cluster, fingerprint, n, shingles), materialized. Links that connect exactly those
    nodes of a cluster which a chain of pairs of near fingerprints and of Jaccard LEAST or more connects.

    A large cluster is compared within random blocks first, then the least nodes of what is linked so far
    among themselves, again in blocks. Pairs that are still apart, which one of them has not in the
    cluster's largest part, are compared block by block."""
    level, found, first, seed = members, None, None, 0
    while True:
        hot = materialize(level.groupBy("cluster").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")).filter("blocks > 1"), "hot")
        block = F.pmod(F.xxhash64("node", F.lit(seed)), F.coalesce("blocks", F.lit(1))).cast("int")
        rows = level.join(hot, "cluster", "left").withColumns({"block": block, "side": F.lit(2), "label": F.col("node")})
        more = materialize(_compare(rows, ["cluster", "block"]), "links")
        found = more if found is None else found.unionByName(more)
        first = hot if first is None else first
        if hot.isEmpty():
            break
        parts = connected_components(found)
        before = level.join(hot, "cluster", "left_semi")
        reps = materialize(before.join(parts, "node", "left_anti"), "reps")
        forget(parts)
        shrunk = reps.count() <= 0.8 * before.count()
        if level is not members:
            forget(level)
        level, seed = reps, seed + 1
        if not shrunk:
            break
    if first.isEmpty():
        return found
    parts = connected_components(found)
    named = members.join(first.select("cluster"), "cluster", "left_semi").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    sizes = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("label", "c").alias("main"), F.sum("c").alias("c"), F.max("c").alias("mc"), F.sum("s").alias("s"), F.max_by("s", "c").alias("ms"))
    sizes = materialize(sizes.filter("c > mc").select("cluster", "main", _blocks(F.col("c") - F.col("mc"), F.col("s") - F.col("ms")).alias("ub"), _blocks(F.col("c"), F.col("s")).alias("ab")), "sizes")
    if sizes.isEmpty():
        return found
    apart = named.join(sizes, "cluster")
    deal = lambda n, k: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = apart.filter("label <> main").withColumns({"side": F.lit(0), "i": deal("ub", -1)}).withColumn("j", every("ab"))
    right = apart.withColumns({"side": F.lit(1), "j": deal("ab", -2)}).withColumn("i", every("ub"))
    across = materialize(_compare(left.unionByName(right), ["cluster", "i", "j"]), "links")
    forget(parts)
    return found.unionByName(across)


def near_components(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """nodes: (node, fingerprint, rep), materialized, where rep is the _key of a row of texts
    (_key, text) with that shingle set. (node, component) as of connected_components."""
    near = connected_components(widehash.candidate_links(nodes))
    members = near.select("node", F.col("component").alias("cluster"))
    members = members.unionByName(near.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct())
    members = materialize(members.join(nodes.select("node", "rep", *_PRINT), "node"), "members")
    sets = materialize(with_shingles(texts.join(members, texts["_key"] == members["rep"]).dropDuplicates(["node"]), size), "sets")
    forget(near, members)
    out = connected_components(exact_links(sets))
    forget(sets)
    return out
