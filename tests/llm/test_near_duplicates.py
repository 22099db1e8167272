"""near_duplicates against brute-force Jaccard of five-word shingles."""

import random

import pytest

from tidemark.llm import minhash, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def words(r, n, size):
    return [f"w{int(size ** r.random())}x" for _ in range(n)]


def copy_of(r, base, size, kind):
    """A substituted, inserted, appended or cut copy."""
    n, out = len(base), list(base)
    some = words(r, int(n * r.uniform(0.02, 0.4)) + 1, size)
    if kind == "substituted":
        for w in some[: max(1, len(some) // 5)]:
            out[r.randrange(n)] = w + "q"
    elif kind == "inserted":
        at = r.randrange(n)
        out[at:at] = some
    elif kind == "appended":
        out += some
    else:
        out = out[len(some) :]
    return " ".join(out)


@pytest.fixture(scope="module")
def pairs():
    r, out = random.Random(11), []
    for k in range(400):
        size = r.choice([400, 5000, 50000])
        base = words(r, r.randint(60, 800), size)
        out.append((" ".join(base), copy_of(r, base, size, ("substituted", "inserted", "appended", "cut")[k % 4])))
    return out


def test_near_copies_go(spark, pairs):
    """Whatever was changed in a copy, a similarity of 0.8 and more is found."""
    rows = [(i + 1000 * c, p[c]) for i, p in enumerate(pairs) for c in (0, 1)]
    kept = {x.doc_id for x in simhash.near_duplicates(table(spark, rows)).collect()}
    assert set(range(len(pairs))) <= kept
    near = [i for i, p in enumerate(pairs) if jaccard(*p) >= 0.8]
    assert len(near) > 100 and not [i for i in near if i + 1000 in kept]


def test_only_near_copies_go(spark, pairs):
    """A pair below 0.8 stays whole, however close."""
    rows = [(i + 1000 * c, p[c]) for i, p in enumerate(pairs) for c in (0, 1)]
    kept = {x.doc_id for x in simhash.near_duplicates(table(spark, rows)).collect()}
    far = [i for i, p in enumerate(pairs) if jaccard(*p) < 0.8]
    assert len(far) > 100 and not [i for i in far if i + 1000 not in kept]


def brute_groups(texts):
    """The index of the least text of each text's component."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return set(label)


@pytest.mark.parametrize("members", [512, 5])
def test_chains_and_large_clusters(spark, monkeypatch, members):
    """Chains of pairs around 0.8, in clusters of one block and of many."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    r, texts = random.Random(3), []
    for g in range(3):
        base = words(r, 120, 5000)
        for k in range(25):
            texts.append(" ".join(base))
            # the similarity of neighbours in a chain is around 0.8
            base = base[r.randint(4, 16) :]
            base += words(r, 120 - len(base), 5000)
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    got = {x.doc_id for x in simhash.near_duplicates(table(spark, list(enumerate(texts)))).collect()}
    assert got == brute_groups(texts)


def test_rows_that_share_an_id(spark):
    """Each row goes or stays by its own text."""
    r = random.Random(9)
    a, b, c = (words(r, 200, 50000) for _ in range(3))
    near = lambda x: " ".join([*x, "more"])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (2, ""), (3, " ".join(c)), (3, near(c)), (3, near(c))]
    got = [(x.doc_id, x.text) for x in simhash.near_duplicates(table(spark, rows)).collect()]
    assert len(got) == 4 and {(1, " ".join(a)), (2, " ".join(b)), (2, "")} <= set(got)
    assert sum(i == 3 for i, _ in got) == 1
