"""The corpus pipeline: quality rules, near-dedup, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. run() writes each stage's result as Parquet in the shared scratch folder and rereads it.
"""

from __future__ import annotations

from tidemark.llm import mixing, packing, quality, simhash, suffixdedup
from tidemark.llm.common import forget, materialize, table


def quality_rules(spark, docs, sf_dir):
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.near_duplicates(docs)


def suffix_dedup(spark, docs, sf_dir):
    """Strings of 50 bytes and more that also stand in a document of smaller id leave the texts."""
    return suffixdedup.without_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    """A row for each copy that the mix takes of a document."""
    return mixing.mixed_rows(docs)


def pack(spark, docs, sf_dir):
    """Pieces of token ids and their places in sequences."""
    return packing.pack_documents(docs, memo=60_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Fingerprints, suffix sorting, hashing draws and tokenizers are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out = materialize(out, f"stage-{name}")
        if k:
            forget(docs)
        docs = out
    return docs
