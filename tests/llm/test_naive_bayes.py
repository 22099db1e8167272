"""Language identification against naive Bayes in plain Python, and texts cut into parts."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid

TEXTS = ["Der Hund schläft.", "the dog sleeps; THE END", "", "  ", "12 34", "Ünï çödé 漢字 x", "a", "perro y gato " * 5]


def plain_grams(text):
    """Buckets of the 1- to 3-grams of letters and single characters of space between them."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    out = []
    for n in langid.ORDERS:
        for k in range(len(low) - n + 1):
            if low[k : k + n].strip(" "):
                h = 1469598103 + n
                for c in low[k : k + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % (1 << 64)
                    h ^= h >> 29
                out.append(h % langid.BUCKETS)
    return out


@pytest.mark.parametrize("chunk", [2, 3, 7, 400_000])
def test_features_do_not_depend_on_cuts(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    got = {i: Counter() for i in range(len(TEXTS))}
    letters = Counter()
    for parts in langid._chunks(TEXTS):
        rows, buckets, found = langid._features(parts)
        for i, b in zip(rows.tolist(), buckets.tolist()):
            got[i][b] += 1
        for (i, _, _), n in zip(parts, found.tolist()):
            letters[i] += n
    for i, t in enumerate(TEXTS):
        assert got[i] == Counter(plain_grams(t)) and letters[i] == sum(c.isalpha() for c in t)


def test_predictions_are_those_of_plain_naive_bayes(spark, monkeypatch):
    words = {"en": "the dog house sleeps under a green tree".split(), "de": "der hund schläft unter einem grünen baum".split(), "es": "el perro duerme bajo un árbol verde".split()}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[lang], 6)), lang) for i in range(60) for lang in [("en", "de", "es")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, dict(Counter(x for _, _, x in rows)))
    counts = {x: Counter() for x in words}
    for _, t, x in rows:
        counts[x].update(plain_grams(t))
    logp = {x: {b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for b in range(langid.BUCKETS)} for x, c in counts.items()}
    probe = [(100 + i, t) for i, t in enumerate(["the green hund", "un perro green", "baum unter dog", "tree", "árbol", "zzz qqq"])]
    got = langid.predict(spark.createDataFrame(probe, "doc_id bigint, text string"), model).collect()
    for r, (_, t) in zip(sorted(got), probe):
        like = {x: math.log(1 / 3) + sum(logp[x][b] for b in plain_grams(t)) for x in logp}
        best = max(like.values())
        assert like[r.lang_pred] == pytest.approx(best, rel=1e-4)
        share = min(1.0, 60.0 / len(plain_grams(t)))
        assert r.score == pytest.approx(1 / sum(math.exp((v - best) * share) for v in like.values()), rel=1e-2)


def test_more_languages_than_a_former_limit(spark):
    rows = [(i, chr(0x4E00 + i % 600) * 8, f"l{i % 600}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen, frequency = langid.sample_rows(docs, "doc_id")
    assert len(frequency) == 600
    model = langid.train(seen.select("text", "lang"), frequency)
    assert len(model[0]) == 600
    got = langid.predict(docs.filter("doc_id < 600"), model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id}" for r in got) > 560  # single letters may share a bucket
