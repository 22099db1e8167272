"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule has metrics (columns computed from the text) and a rejecting condition. A random sample of
about SAMPLE_ROWS rows of the whole table tells each rule's cost (seconds a row, without what a job
costs that computes nothing) and selectivity (share rejected); rules run in falling order of rejection
per cost, and a metric is computed only for rows that no earlier rule rejected. The order changes the
work, never the verdict: a row is kept if no rule rejects it. Where the metrics themselves are asked
for, as in `quality_report`, they are computed for all rows and the cascade only orders conditions.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS

#: Rows of the sample on which costs and selectivities are estimated, about, and how often each is timed.
SAMPLE_ROWS = 400
REPEATS = 3
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


@dataclass(frozen=True)
class Metric:
    """name: its column. steps: (helper column, function of the frame's columns) computed one after
    another, each as a projection of its own so that no step is evaluated more than once."""

    name: str
    steps: tuple = field(default=())


def n_words(text: str = "text") -> Metric:
    return Metric("n_words", (("n_words", lambda: F.size(_words(F.col(text))).cast("long")),))


def word_chars(text: str = "text") -> Metric:
    return Metric("word_chars", (("word_chars", lambda: _without(F.col(text), SPACE_CHARS).cast("long")),))


def n_symbols(text: str = "text") -> Metric:
    return Metric("n_symbols", (("n_symbols", lambda: (F.char_length(text) - _without(F.col(text), SYMBOLS)).cast("long")),))


def n_lines(text: str = "text") -> Metric:
    return Metric("n_lines", (("n_lines", lambda: F.size(_lines(text)).cast("long")),))


def _lines(text: str) -> Column:
    return F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: str = "text") -> Metric:
    return Metric("n_dup_lines", (("_ln", lambda: _lines(text)), ("n_dup_lines", lambda: (F.size("_ln") - F.size(F.array_distinct("_ln"))).cast("long"))))


def n_repeat_words(text: str = "text") -> Metric:
    """Words covered by 3-word windows that occur at least twice in the text. Windows are told apart by
    64-bit hashes; texts whose hashes are all distinct stop there, others sort (hash, place)."""
    return Metric(
        "n_repeat_words",
        (
            ("_w", lambda: _words(F.col(text))),
            # windows that begin at each word; the last two places have none
            ("_h", lambda: F.when(F.size("_w") >= 3, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.greatest(F.size("_w") - 2, F.lit(1))))),
            ("_s", lambda: F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
            ("_r", lambda: F.filter("_s", lambda x, j: (x["h"] == F.get("_s", j - 1)["h"]) | (x["h"] == F.get("_s", j + 1)["h"]))),
            ("n_repeat_words", lambda: F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("_r", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))), F.lit(0)).cast("long")),
        ),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    metrics: tuple[Metric, ...]
    rejects: str  # SQL over the metrics' columns


def base_rules(text: str = "text") -> list[Rule]:
    return [
        Rule("few_words", (n_words(text),), "n_words < 50"),
        Rule("repeated_words", (n_words(text), n_repeat_words(text)), "100 * n_repeat_words > 50 * n_words"),
    ]


def default_rules(text: str = "text") -> list[Rule]:
    """The base rules and three of the usual web-text rules."""
    return [
        *base_rules(text),
        Rule("symbols", (n_words(text), n_symbols(text)), "10 * n_symbols > 3 * n_words"),
        Rule("word_length", (n_words(text), word_chars(text)), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
        Rule("repeated_lines", (n_lines(text), n_dup_lines(text)), "n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ]


def with_metric(df: DataFrame, metric: Metric, alive: Column | None = None, have: frozenset = frozenset()) -> DataFrame:
    """Adds the metric's column; helpers go. Where `alive` is false the metric is null, uncomputed."""
    if metric.name in have:
        return df
    helpers = [name for name, _ in metric.steps[:-1]]
    for k, (name, make) in enumerate(metric.steps):
        value = make()
        df = df.withColumn(name, value if alive is None or k else F.when(alive, value))
    return df.drop(*helpers)


def measure_rules(texts: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[float, float]]:
    """texts: one column of text that is not null. (share rejected, seconds a row) of each rule; empty
    for an empty table. Each rule is timed in one task over REPEATS copies of the sample, the better of
    two runs, so that neither compilation nor the start of a job counts."""
    total = texts.count()
    if not total:
        return []
    sample = texts.sample(min(1.0, rows / total), seed=7).repartition(1).cache()
    try:
        n = sample.count()
        if not n:  # a small table may be missed whole
            return measure_rules(texts, rules, total)
        copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def timed(df, condition):
            best, out = float("inf"), 0
            for _ in range(2):
                began = time.perf_counter()
                out = df.agg(F.count_if(condition)).first()[0]
                best = min(best, time.perf_counter() - began)
            return out / (REPEATS * n), best

        nothing = timed(copies, F.col("_copy") < 0)[1]
        got = []
        for rule in rules:
            df, have = copies, frozenset()
            for m in rule.metrics:
                df = with_metric(df, m, None, have)
                have |= {m.name}
            share, seconds = timed(df, F.expr(rule.rejects))
            got.append((share, max(seconds - nothing, 1e-4) / (REPEATS * n)))
        return got
    finally:
        sample.unpersist()


def order_rules(texts: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[int]:
    """Places of the rules in falling order of rejection per cost; a rule that rejected nothing counts
    as half a row of the sample."""
    measured = measure_rules(texts, rules, rows)
    gain = [-(share + 0.5 / rows) / seconds for share, seconds in measured] or [0.0] * len(rules)
    return sorted(range(len(rules)), key=lambda k: (gain[k], k))


def cascade(df: DataFrame, rules: list[Rule], kept: str = "kept", have: tuple[str, ...] = ()) -> DataFrame:
    """Adds the boolean `kept`, applying rules in the given order. Columns named in `have` are metrics
    that the frame holds already; the others are computed where needed, and dropped."""
    held, added = frozenset(have), []
    df = df.withColumn(kept, F.lit(True))
    for rule in rules:
        for m in rule.metrics:
            if m.name not in held:
                df = with_metric(df, m, F.col(kept), held)
                held |= {m.name}
                added.append(m.name)
        df = df.withColumn(kept, F.col(kept) & ~F.coalesce(F.expr(rule.rejects), F.lit(False)))
    return df.drop(*added)


def _texts(docs: DataFrame, text_col: str, **others: Column) -> DataFrame:
    """The text, null as empty, and what else is carried, under names that only this module uses."""
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[c.alias(n) for n, c in others.items()])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each
    row. Null text has no words, so it fails. Repeated rows are judged alike; other columns play no
    part, whatever their names; an empty table gives an empty result."""
    rules = default_rules("_text")
    order = order_rules(_texts(docs, text_col), rules)
    df = _texts(docs, text_col, _id=F.col(id_col))
    shown = (n_words("_text"), word_chars("_text"), n_symbols("_text"), n_dup_lines("_text"), n_repeat_words("_text"))
    for m in shown:
        df = with_metric(df, m)
    names = [m.name for m in shown]
    df = cascade(df, [rules[k] for k in order], have=tuple(names))
    base = F.expr(" OR ".join(f"({r.rejects})" for r in base_rules("_text")))
    return df.select(F.col("_id").alias(id_col), *names, base.alias("base_failed"), "kept")


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with all their columns, whatever their names and values. Rules
    read the column `_text`. Null and empty texts have no words and go; equal rows go or stay together;
    an empty table stays empty; a very long text is judged whole, in its row's task."""
    rules = default_rules("_text") if rules is None else rules
    order = order_rules(_texts(docs, text_col), rules)
    work = _texts(docs, text_col, _row=F.struct(*[docs[c] for c in docs.columns]))
    judged = cascade(work, [rules[k] for k in order], kept="_kept")
    # the optimizer would move the filter below the projections and write out their steps inside each
    # other's lambdas, evaluating an array once for each element; a non-deterministic column stops it
    return judged.withColumn("_stop", F.monotonically_increasing_id()).filter("_kept AND _stop >= 0").select("_row.*")
