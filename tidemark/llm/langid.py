"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, characters that are no letters become one space, and the 1-, 2- and 3-grams
are hashed into BUCKETS classes. Counts are added up by Spark; the log-probability matrix is broadcast,
128 KB for each language that the labels name, and batches are scored in numpy as a sparse matrix of
counts (text x bucket) times that matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on about so many labelled rows of each language, or all if there are fewer:
#: those whose hashed ids lie below that share of the range.
TRAIN_ROWS = 4_000
#: Code points handled at once, and numbers of one slab of the sparse product.
CHUNK = 400_000
SLAB = 1 << 22
_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code point its lower-case form if a letter, else a space."""
    if not _tables:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def _grams(c: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place; -1 for a gram that is only spaces."""
    n = len(c) - order + 1
    h = np.full(max(n, 0), 1469598103 + order, dtype=np.uint64)
    some = np.zeros(max(n, 0), dtype=bool)
    for k in range(order):
        part = c[k : k + n]
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        some |= part != 32
    return np.where(some, (h % np.uint64(BUCKETS)).astype(np.int32), -1)


def _chunks(texts: list[str]):
    """Lists of (row, part, code points before it that it repeats): each text with a space on either
    side, cut into parts of CHUNK code points, of which all but the first repeat the last ones before."""
    out, size, most = [], 0, max(ORDERS) - 1
    for i, t in enumerate(texts):
        t = f" {t} "
        for at in range(0, len(t), CHUNK):
            before = min(at, most)
            out.append((i, t[at - before : at + CHUNK], before))
            size += min(CHUNK, len(t) - at)
            if size >= CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def _features(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every gram of the parts, each counted where it ends, and the letters of each part."""
    c = _lower_letters()[np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    size = np.array([len(p) for _, p, _ in parts])
    row, before = np.array([i for i, _, _ in parts], dtype=np.int64), np.array([b for _, _, b in parts])
    part = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    rows, buckets = [], []
    for order in ORDERS:
        g = _grams(c, order)
        at = part[: len(g)]
        own = place[: len(g)] + order - 1
        keep = (g >= 0) & (own < size[at]) & (own >= before[at])
        rows.append(row[at[keep]])
        buckets.append(g[keep])
    letters = np.bincount(part[(c != 32) & (place >= before[part])], minlength=len(parts))
    return np.concatenate(rows), np.concatenate(buckets), letters


def train(rows: DataFrame, frequency: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """rows: (text, lang). Languages by name and their log probabilities; the prior, from their
    frequencies in all labelled rows, in the last column."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], dtype=np.int64)
            for parts in _chunks(texts):
                rows, buckets, _ = _features(parts)
                sums = np.bincount(code[rows] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, more in zip(names, sums):
                    total[name] = total[name] + more if name in total else more
        out = [(lang, int(k), int(v[k])) for lang, v in total.items() for k in np.flatnonzero(v)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64()))], names=["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, k, n in sums.toLocalIterator():  # at most BUCKETS rows a language
        found.setdefault(lang, np.zeros(BUCKETS))[k] = n
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), dtype=np.float32)
    counts = np.array([found[x] for x in langs]) + 0.5
    prior = np.array([frequency[x] for x in langs], dtype=float)
    logp = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return langs, np.hstack([logp, np.log(prior / prior.sum())[:, None]]).astype(np.float32)


def sample_rows(docs: DataFrame, id_col: str, rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """A sample by language, and the languages' frequencies. Ids are hashed to [0, 1); a language's
    share is rows / frequency, so a frequent language does not crowd out a rare one."""
    counts = docs.groupBy("lang").count()
    frequency = {r["lang"]: r["count"] for r in counts.collect()}
    if not frequency:
        return docs.limit(0), {}
    share = F.create_map(*[F.lit(x) for lang, n in frequency.items() for x in (lang, min(1.0, rows / n))])
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(7)), 11) / F.lit(float(1 << 53))
    return docs.filter(place < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))), frequency


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra columns, lang_pred, score). Null text or text without a letter: `und`, score 0.
    With nothing learned every text is `und`. The score is the posterior of the language that wins,
    with the likelihood of a text tempered to its geometric mean over LENGTH grams, so it stays
    informative for long texts; the winner is that of the untempered model."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"), *[F.col(x).alias(f"_x{i}") for i, x in enumerate(extra)])
    schema = rows.drop("_text").withColumnsRenamed({"_id": id_col} | {f"_x{i}": x for i, x in enumerate(extra)})
    schema = schema.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def score(batches):
        langs, logp = shared.value
        names = [id_col, *extra, "lang_pred", "score"]
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            like = np.zeros((len(texts), len(langs)))
            grams = np.zeros(len(texts))
            letters = np.zeros(len(texts), dtype=np.int64)
            for parts in _chunks(texts):
                rows, buckets, found = _features(parts)
                np.add.at(letters, [i for i, _, _ in parts], found)
                grams += np.bincount(rows, minlength=len(texts))
                if not langs or not len(rows):
                    continue
                # the sparse matrix: (row, bucket), in order, and its count
                key = np.sort(rows * BUCKETS + buckets)
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n = np.diff(np.append(at, len(key)))
                row, bucket = key[at] // BUCKETS, key[at] % BUCKETS
                step = max(1, SLAB // len(langs))
                for k in range(0, len(at), step):
                    s = slice(k, k + step)
                    first = np.flatnonzero(np.concatenate([[True], row[s][1:] != row[s][:-1]]))
                    like[row[s][first]] += np.add.reduceat(logp[bucket[s]] * n[s, None], first, axis=0, dtype=np.float64)
            if langs:
                like += logp[BUCKETS]
                best = like.argmax(axis=1)
                z = (like - like.max(axis=1, keepdims=True)) * (np.minimum(1.0, 60.0 / np.maximum(grams, 1)))[:, None]
                p = 1 / np.exp(z).sum(axis=1)
                named = letters > 0
                pred, sc = [langs[k] if y else "und" for k, y in zip(best, named)], np.where(named, p, 0.0)
            else:
                pred, sc = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(k) for k in range(2, b.num_columns)], pa.array(pred, pa.string()), pa.array(sc, pa.float64())], names=names)

    return rows.mapInArrow(score, schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit on rows with crc32(id) mod 5 <> 0 and a language, predict all rows.

    Returns (id, held_out, lang_pred, score). A null id is neither learned from nor held out. Only the
    text of a row takes part in its prediction: repeated rows are predicted alike, a null text or one
    without letters is `und`, a very long one is read whole, CHUNK code points at a time. An empty table
    gives an empty result. Other columns play no part, whatever their names."""
    fold = F.crc32(F.col(id_col).cast("string")) % 5
    seen = docs.filter((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(id_col, "text", "lang")
    model = train(*sample_rows(seen, id_col))
    marked = docs.select(id_col, "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return predict(marked, model, id_col, ("held_out",))
