"""Text operators against brute force, and their edge cases: nulls, empty and long texts, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, langid, mainhtml, mixing, packing, quality, queries, simhash, suffixdedup, tokens, urlfilter
from tidemark.llm.common import connected_components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("size", "key", "blk", "node", "part", "rest", "_id", "_text", "h")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} ünd" for i in range(30000))


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASH})


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (4, "one", "b"), (5, "one two three " * 30, "b"), (6, LONG, "ü"), (None, "no id here at all", None), (7, "!!! ??? 123", "a"), (8, "x\ny\nx\nx", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# ---- 1 ------------------------------------------------------------------------------------------


def test_language(spark, docs):
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_ignores_labels_of_held_out_rows(docs):
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = ({r.doc_id: r for r in langid.identify_languages(d).collect()} for d in (docs, swapped))
    assert a == b


def test_language_edges(spark, odd):
    got = langid.identify_languages(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 7)) and by[6].lang_pred == "en"
    assert langid.identify_languages(odd.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 2 ------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    pool, target = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in target]
        rest = pool - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 2 * sizes[s] for s in over}


def check_mix(got, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_fill(sizes)
    taken = defaultdict(int)
    for r in got:
        m = r["_mix"]
        assert m.taken <= 2 * m["size"] and m.source_size == sizes[r.source] and m.target == pytest.approx(want[r.source])
        assert sum(d.words for d in m.draws) == m.taken and all(d.shard is not None for d in m.draws)
        taken[r.source] += m.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mixing(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    figures = lambda df: mixing.mix_documents(df, whole_rows=True).select("_row.doc_id", "_row.source", "_mix").collect()
    got = figures(docs)
    check_mix(got, rows)
    shards = Counter(d.shard for r in got for d in r["_mix"].draws)
    assert len(shards) > 4 and max(shards.values()) < 3 * min(shards.values())
    again = figures(docs.repartition(7))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_edges(spark, odd):
    check_mix(mixing.mix_documents(odd, whole_rows=True).select("_row.doc_id", "_row.source", "_mix").collect(), ODD)
    assert mixing.mix_documents(odd.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix_documents(table(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    sizes = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert abs(sizes - 1.5 * sum(len(WORD.findall(t or "")) for _, t, _ in ODD)) <= 5


# ---- 3 ------------------------------------------------------------------------------------------


def test_nearest(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(ann, "CANDIDATES", 60)
    monkeypatch.setattr(ann, "QUERIES", 7)
    vecs = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vecs += [(1000 + i, vecs[20][1]) for i in range(60)] + [(20, vecs[20][1])]
    bad = [(400, None), (420, [0.0] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (500, []), (None, [1.0] * 8), (2000, [1.0, 2.0])]
    df = spark.createDataFrame(vecs + bad, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("i", "j", "dim", "v")})
    kept = [(x.vec_id, x.embedding) for x in df.collect() if x.vec_id is not None and x.vec_id < 2000 and x.vec_id not in (400, 420, 440, 460, 480, 500)]
    got = defaultdict(list)
    for x in ann.nearest(df).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    want = {q for q, _ in kept if q % 20 == 0}
    assert set(got) == want
    for q in want - {20}:
        v = next(e for i, e in kept if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, e)), i) for i, e in kept if i != q))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1] for m in mine] == [i for _, i in best]
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in best], rel=1e-12)
    assert ann.nearest(df.limit(0)).collect() == []
    few = ann.nearest(df.filter("vec_id IN (0, 1, 2)")).collect()
    assert sorted(x["rank"] for x in few) == [1, 2]


# ---- 4 ------------------------------------------------------------------------------------------

URLS = [None, "", "no-scheme.com/en/", "http://COM/en/x", "https://a.com/en/", "http://example.com/en/75?x", "http://b.example.com/en/8", "http://xcom/en/", "http://a.net/de/1#f", "http://example.net/de/81", "http://a.org/es/", "http://a.org/ES/", "http://a.com?x=/en/", "//a.com/en/", "http://a.com/en", "weird ://Ä.COM/en/\nx"]


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.GIVEN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[4])], "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("id", "host", "tokens", "items")})
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, lab).collect()}
        assert got == {i: brute_url(u) for i, u in enumerate(URLS)} | {None: brute_url(URLS[4])}
    assert urlfilter.filter_urls(pages.limit(0), labels).collect() == []


def test_url_mining(spark):
    """A planted association is found, and matching is that of its definition."""
    pages = [(i, f"http://{'bad-pills' if i % 4 == 0 else 'fine'}.example.edu/{i % 3}/{i}") for i in range(400)] + [(900, "http://bad-pills.example.edu/9"), (901, "http://fine.example.edu/9")]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert all(v == ("block" if "bad" in u else "allow") for (i, u) in pages for v in [got[i]])


# ---- 5 ------------------------------------------------------------------------------------------


def brute_print(text, n=3):
    import xxhash

    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(prints, bits):
    """prints: list of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[root(i)] = min(k, least[root(i)]) if least[root(i)] is not None else k
    return [least[root(i)] for i in range(len(prints))]


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = list(texts.items())
    prints = [(i, brute_print(t)) for i, t in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, p), c in zip(prints, brute_groups(prints, 2))}


@pytest.mark.parametrize("bits", [2, 5])
def test_components_of_chained_and_hot_fingerprints(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    r = random.Random(bits)
    base = r.getrandbits(64)
    prints, x = [], base
    for i in range(60):
        prints.append((i, x))
        for _ in range(r.choice([1, 2, bits, bits + 1, 9])):
            x ^= 1 << r.randrange(64)
    prints += [(100 + i, base ^ (1 << i)) for i in range(30)] + [(200, base), (200, base)]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "doc_id bigint, fp bigint")
    got = sorted((r.doc_id, r.component_id) for r in simhash.components(df, bits).collect())
    assert got == sorted((i, c) for (i, _), c in zip(prints, brute_groups(prints, bits)))


def test_simhash_edges(spark, odd):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect()), key=str)
    prints = [(i, brute_print(t)) for i, t, _ in ODD]
    assert got == sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_groups(prints, 2))), key=str)
    assert simhash.simhash_groups(odd.limit(0)).collect() == []


def test_near_duplicates(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    rows = []
    for g in range(30):
        base = [word() for _ in range(r.randint(60, 300))]
        rows.append((g, " ".join(base), "s"))
        for c in range(2):
            copy = list(base)
            copy[r.randrange(len(copy))] = word()
            rows.append((100 + 2 * g + c, " ".join(copy), "s"))
    rows += [(500, rows[0][1], "s"), (None, rows[1][1], "s"), (600, None, "s"), (601, "", "s"), (0, rows[0][1], "s")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    ids = sorted((x.doc_id for x in got), key=str)
    assert ids == sorted([*range(30), None, 600, 601], key=str)
    assert len(got[0]) == 5 + len(CLASH)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}


# ---- 6 ------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    ws = WORD.findall(t)
    n = len(ws)
    windows = [tuple(ws[i : i + 3]) for i in range(n - 2)]
    count = Counter(windows)
    repeat = len({k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)})
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars, symbols = sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t)
    base = n < 50 or 100 * repeat > 50 * n
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    bad = base or 10 * symbols > 3 * n or chars < 2 * n or chars > 20 * n or (dup > 3 and 100 * dup > 30 * lines)
    return n, chars, symbols, dup, repeat, base, not bad


def test_quality(spark, docs, texts, odd):
    for df, rows in ((docs, texts.items()), (odd, [(i, t) for i, t, _ in ODD])):
        got = sorted((tuple(r) for r in quality.quality_report(df).collect()), key=str)
        assert got == sorted(((i, *brute_quality(t)) for i, t in rows), key=str)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, t, _ in ODD if brute_quality(t)[-1]]
    assert quality.quality_report(odd.limit(0)).collect() == []


def test_rule_order_never_changes_the_verdict(docs):
    verdicts = []
    for rules in (quality.default_rules(), quality.default_rules()[::-1]):
        verdicts.append({r.doc_id: r.kept for r in quality.cascade(docs, rules).collect()})
    assert verdicts[0] == verdicts[1]


# ---- 7 ------------------------------------------------------------------------------------------


def brute_repeats(rows):
    """rows: (id, text). The removed bytes by the definition."""
    first: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for s in range(len(b) - 49):
                w = b[s : s + 50]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - 49):
                if first[b[s : s + 50]] < i:
                    gone[s : s + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def planted(seed, alphabet="ab cdé", docs=40):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 52, 80, 200, 700)]
    rows = []
    for i in range(docs):
        t = say(r.randrange(60))
        for _ in range(r.randrange(4)):
            x = r.choice(shared)
            if r.random() < 0.4:
                k = r.randrange(len(x))
                x = x[:k] + r.choice("xyz") + x[k + r.randrange(2) :]
            t += x + say(r.randrange(30))
        rows.append((r.randrange(docs * 2), t))
    return rows + [rows[0], (3, "a" * 300), (5, "a" * 100), (6, "ab" * 80), (7, "ab" * 60), (None, rows[1][1]), (90, None), (91, "")]


@pytest.mark.parametrize("seed, block", [(1, 1 << 22), (2, 800), (3, 300)])
def test_suffix_dedup(spark, monkeypatch, seed, block):
    """Small blocks and buckets, so that every step crosses blocks and sort ranges."""
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixdedup, "FRAGMENT_BYTES", block)
    monkeypatch.setattr(suffixdedup, "LONGEST", max(64, block // 8))
    monkeypatch.setattr(suffixdedup, "LEAST_BUCKETS", 5)
    rows = planted(seed)
    rows += [rows[5]] * 40 + [(None, "null id " * 20)] * 40  # one row over and over
    df = table(spark, [(i, t, "s") for i, t in rows])
    assert sorted((tuple(r) for r in suffixdedup.remove_repeats(df).collect()), key=str) == brute_repeats(rows)


def test_suffix_dedup_data_and_edges(spark, docs, texts, odd):
    assert sorted((tuple(r) for r in suffixdedup.remove_repeats(docs).collect()), key=str) == brute_repeats(texts.items())
    assert sorted((tuple(r) for r in suffixdedup.remove_repeats(odd).collect()), key=str) == brute_repeats([(i, t) for i, t, _ in ODD])
    assert suffixdedup.remove_repeats(odd.limit(0)).collect() == []
    cut = suffixdedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert {r.doc_id: r.text for r in cut.collect()}[1] is None


def test_ranges_of_frequent_beginnings():
    """Keys that share their first words are dealt by the later ones, as a search over whole keys deals them."""
    import bisect

    import numpy as np

    rng = np.random.default_rng(5)
    cuts = sorted({tuple(r) for r in rng.integers(0, 3, (40, 6)).tolist()})
    keys = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    got = suffixdedup._ranges(np.array(cuts, np.uint64), lambda j: keys[:, j])
    assert got.tolist() == [bisect.bisect_right(cuts, tuple(k)) for k in keys.tolist()]
    assert suffixdedup._ranges(np.zeros((0, 6), np.uint64), lambda j: keys[:, j]).tolist() == [0] * 500


def test_slab_edges_do_not_matter():
    import numpy as np

    text = "".join(random.Random(9).choice("abcd") for _ in range(2000)).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, 700, 700, 730, 2000])
    runs = []
    for size in (64, 1 << 17):
        spread = [(int(r), w, int(h)) for row, lo, hi, hash_ in suffixdedup._anchor_runs(buf, off, 26, size) for r, a, b, h in zip(row, lo, hi, hash_) for w in range(a, b)]
        runs.append(spread)
    assert runs[0] == runs[1] and len(runs[0]) == 700 - 49 + 1270 - 49


# ---- 8, 9 ---------------------------------------------------------------------------------------

TEXTS = ["", "  a  b", " \n x\n\ny", "a\nb c", "don't 's I'll", "naïve ÉCOLE ß ÿ", "école É", "x<|endoftext|> y <|endoftext|>", "<|startoftext|>", "tab\tx    y　z", "12 3,4 $5 %%%", "a\r\nb", "Σίσυφος ΣΑΣ İ", "word.\nNext line\n\nEnd ", "日本語 😀👍🏽", "a\x1cb \x85 c", "'''' it's. 'q' w'", " ª º ² ½ ǅ", "x " * 50, "\n", " ", "a" * 5000]


@pytest.mark.parametrize("file, style, kind", [("byte_bpe_50k.json", "byte", "length"), ("word_bpe_49k.json", "word", "ids"), ("byte_bpe_50k.json", "byte", "ids")])
def test_pieces_encode_like_whole_texts(file, style, kind, texts):
    from array import array

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.public_path(file))
    r = random.Random(4)
    some = TEXTS + list(texts.values())[:60] + ["".join(r.choice("ab A.'\n \té!1|<>") for _ in range(40)) for _ in range(400)]
    for memo in (300_000, 5):
        enc = tokens.encoder(tokens.public_path(file), style, kind, memo)
        for _ in range(2):
            got = enc.encode(some)
            want = [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
            assert got == [len(x) if kind == "length" else array("I", x).tobytes() for x in want]
            assert len(enc.memo) <= memo


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in tokens.token_counts(odd).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in ODD]
    assert got == sorted(want, key=str)
    assert tokens.token_counts(odd.limit(0)).collect() == []


def check_packing(pieces, rows, window=2048):
    from array import array

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    count = Counter(i for i, _ in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(array("I", part).tobytes())
    for i, n in count.items():
        assert sorted(k for p in by_doc[i] for k in range(p.start, p.start + p.length)) == sorted(list(range(len(ids[i]))) * n)
    used = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        used += at
    return used / (window * len(by_seq))


def test_packing(spark, docs, texts, odd):
    assert check_packing(packing.pack_documents(docs).collect(), list(texts.items())) > 0.9
    check_packing(packing.pack_documents(odd).collect(), [(i, t) for i, t, _ in ODD])
    assert packing.pack_documents(odd.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    r = random.Random(seed)
    h = Counter(min(2048, int(r.lognormvariate(5.5, 1.1)) + 1) for _ in range(20000))
    left = Counter(h)
    sequences = 0
    for pattern, n in packing.plan(dict(h)):
        assert n > 0 and sum(k * m for k, m in pattern) <= 2048
        sequences += n
        for k, m in pattern:
            left[k] -= m * n
    assert not any(left.values())
    assert sum(k * m for k, m in h.items()) / (2048 * sequences) > 0.995
    assert packing.plan({}) == []


# ---- 10 -----------------------------------------------------------------------------------------


def test_main_text_on_pages(spark):
    """The article's blocks of the test pages, whose layout is known, all and nothing else."""
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in mainhtml.extract_main_text(pages).collect():
        inner = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_main_text_on_held_out_layouts():
    model = mainhtml.fit(mainhtml.labelled_pages())
    right = total = 0
    for source in mainhtml.labelled_pages(150, seed=99):
        page = mainhtml.Page(source)
        for text, want, odds in zip(page.text, mainhtml._labels(page), mainhtml.marginals(page, model)):
            if text is not None:
                total += 1
                right += (odds >= 0) == want
    assert right > 0.98 * total


def test_marginals_are_those_of_enumeration():
    import itertools
    import math

    model = mainhtml.fit(mainhtml.labelled_pages(40))
    page = mainhtml.Page("<body><nav><a href=x>One</a></nav><article><p>Some words here.</p></article></body>")
    n = len(page.parent)
    mass = [[0.0, 0.0] for _ in range(n)]
    for y in itertools.product((0, 1), repeat=n):
        p = 1.0
        for k in range(1, n):
            f = page.features[k]
            edge = model["edge"].get(f[1]) or model["edge"].get(f[0]) or model["edge"]["*"]
            p *= edge[y[page.parent[k]]][y[k]] * (math.exp(sum(model["weight"].get(x, 0.0) for x in f[2:])) if y[k] else 1.0)
        for k in range(n):
            mass[k][y[k]] += p
    for k, odds in enumerate(mainhtml.marginals(page, model)):
        assert odds == pytest.approx(math.log(mass[k][1] / mass[k][0]), abs=1e-6)


def test_main_text_edges(spark):
    odd = [None, "", "plain text", "<p>unclosed &amp; &lt;b&gt; a &am", "<article><p>a<br>b  c\n d</article><p", "<script>var x='<p>no</p>'</script><article><p>yes</p></article>", "<article><p>1 < 2 and 3 > 2</p><!-- <p>gone</p>", "<div>" * 3000 + "deep"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(odd)] + [(None, None, "<article>x</article>"), (1, "u", "")], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = mainhtml.extract_main_text(pages).collect()
    assert len(got) == len(odd) + 2
    by = {r.page_id: r.text for r in got}
    assert by[0] == by[1] == "" and by[4] == "a b c d" and by[5] == "yes" and by[6] == "1 < 2 and 3 > 2"
    assert mainhtml.extract_main_text(pages.limit(0)).collect() == []


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    columns = docs.columns
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, stages[-1], DATA).cache()
        out.count()
        if name != "pack":
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        stages.append(out)
    good = {r.doc_id: r.text for r in stages[1].collect()}
    assert set(good) == {r.doc_id for r in docs.collect() if brute_quality(r.text)[-1]}
    unique = {r.doc_id: r.text for r in stages[2].collect()}
    assert unique.items() <= good.items()
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    assert set(unique) <= set(first.values())
    want = {i: (removed, sha) for i, _, removed, _, sha in brute_repeats(unique.items())}
    cut = {r.doc_id: r for r in stages[3].collect()}
    assert set(cut) == set(unique)
    for i, r in cut.items():
        assert r.n_chars == len(r.text) and (want[i][0] or r.text == unique[i])
    sizes = {i: len(WORD.findall(r.text)) for i, r in cut.items()}
    mixed = stages[4].collect()
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed) - 1.5 * sum(sizes.values())) <= len({r.source for r in cut.values()})
    tokens_in = sum(p.length for p in stages[5].collect())
    assert tokens_in == sum(n for n, in [(p.doc_tokens,) for p in stages[5].collect() if p.start == 0])
    again = corpus_pipeline.run(spark, DATA)
    assert again.count() == stages[5].count()


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
