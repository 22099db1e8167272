"""Candidates of near-dedup: wide SimHashes and their deletion-variant signatures against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import minhash, widehash
from tidemark.llm.common import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def flipped(r, x, n):
    for k in r.sample(range(384), n):
        x ^= 1 << k
    return x


def longs(x):
    return [np.uint64(x >> 64 * k & (1 << 64) - 1).view(np.int64).item() for k in range(6)]


def segment(x, k):
    """Byte k and the next one; the first follows the last."""
    return (x | x << 384) >> 8 * k & 0xFFFF


def is_candidate(x, y):
    """A segment in which at most one bit differs, and at most 92 of all bits, 64 of the first half."""
    d = x ^ y
    return any(segment(d, k).bit_count() <= 1 for k in range(48)) and d.bit_count() <= 92 and (d & (1 << 192) - 1).bit_count() <= 64


def prints():
    """Fingerprints with copies at many distances, chains, and a group of 150 near ones."""
    r, out = random.Random(1), []
    for n in range(0, 130, 2):
        base = r.getrandbits(384)
        out += [base, flipped(r, base, n), flipped(r, flipped(r, base, n), n)]
    hot = r.getrandbits(384)
    return [*dict.fromkeys([*out, *(flipped(r, hot, r.randint(1, 50)) for _ in range(150))])]


def groups(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = sorted((label[a], label[b]))
        label = [x if z == y else z for z in label]
    return label


def test_candidates_are_those_that_share_a_signature(spark):
    fps = prints()
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if is_candidate(fps[i], fps[j])]
    nodes = spark.createDataFrame([(i, *longs(x)) for i, x in enumerate(fps)], "node bigint, " + ", ".join(f"{c} bigint" for c in widehash.NAMES))
    got = [tuple(x) for x in widehash.candidate_links(nodes).collect()]
    named = {x.node: x.component for x in connected_components(spark.createDataFrame(got, "a bigint, b bigint")).collect()}
    want = groups(len(fps), brute)
    assert [named.get(i, i) for i in range(len(fps))] == want and 60 < len(set(want)) < len(fps) - 150
    # up to 47 bits a signature is always shared
    assert all(want[i] == want[j] for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 47)


@pytest.mark.parametrize("wide", [1024, 4, 1])
def test_groups_of_one_signature(monkeypatch, wide):
    """However its rows are compared, the same are connected."""
    monkeypatch.setattr(widehash, "WIDE", wide)
    r = random.Random(4)
    # the first byte is equal, the next differs in some bits
    fps = [x >> 8 << 8 | 0x5A for x in prints()]
    fps = [x & ~0xFF00 | r.choice([0, 1, 2, 3, 8, 255]) << 8 for x in fps]
    rows = np.array([longs(x) for x in fps]).view(np.uint64)
    got = widehash._same_variant(np.full(len(fps), 0x5A, dtype=np.int32), rows)
    near = lambda x, y: min(segment(x ^ y, k).bit_count() for k in (0, 47)) <= 1 and is_candidate(x, y)
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if near(fps[i], fps[j])]
    assert brute and [got.tolist().index(x) for x in got] == groups(len(fps), brute)


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    r = random.Random(6)
    base = r.getrandbits(384)
    rows = [(r.getrandbits(62), *longs(flipped(r, base, r.randint(20, 40)))) for _ in range(1000)]
    nodes = spark.createDataFrame(rows, "node bigint, " + ", ".join(f"{c} bigint" for c in widehash.NAMES))
    assert 999 <= widehash.candidate_links(nodes).count() < 20_000


@pytest.mark.parametrize("common, left, right", [(4, 0, 1), (8, 1, 1), (16, 0, 4), (40, 5, 5), (400, 50, 50), (400, 0, 100)])
def test_sets_of_similarity_of_four_fifths_share_a_signature(common, left, right):
    rng, found, n = np.random.default_rng(common), 0, 1500
    for _ in range(n):
        s = rng.integers(0, 1 << 64, common + left + right, dtype=np.uint64)
        x, y = (int.from_bytes(widehash.fingerprint(p).tobytes(), "little") for p in (s[: common + left], np.concatenate([s[:common], s[common + left :]])))
        found += is_candidate(x, y)
    assert found >= n - 2


def test_near_dedup_takes_its_candidates_from_signatures(spark, monkeypatch):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(base[:8])), (4, " ".join(base[:9]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = lambda: sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept() == [1, 3]
    monkeypatch.setattr(minhash.widehash, "candidate_links", lambda nodes: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).limit(0))
    assert kept() == [1, 2, 3, 4]
