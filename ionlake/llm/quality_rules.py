"""Quality rules whose cutoffs carry an exact bound on the clean documents they reject.

Each rule is a score of the text that is higher for worse documents.  Labelled
texts, one row a distinct text, are dealt by a hash into a tuning and a holdout
half.  For
every stratum and rule the tuning half proposes the tightest cutoff worth
having; on the holdout, cutoffs are tested from the loosest towards that one.
A cutoff passes when a rejection rate of `risk / number of rules` among clean
documents would give as few rejections as were seen with a chance of at most
`delta / (strata * rules)` (exact binomial tail).  Testing stops at the first
failure, so cutoffs of one rule need no further correction; rules and strata
are corrected by Bonferroni.  With probability 1 - delta no stratum's rules
together reject more than `risk` of its clean documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .work import Workspace

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

#: Rule: its score in SQL over COUNTS, and the cutoffs that are tested.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "upper": ("n_upper / greatest(n_letters, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9]),
    "long_words": ("word_chars / greatest(n_words, 1)", [5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0]),
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys with their rows: whether it is found twice or more in its row, and whether an earlier one is the same."""
    own = K.mix(keys ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    a, b = np.empty(len(s), bool), np.empty(len(s), bool)
    a[order], b[order] = twice, same
    return a, b


def text_counts(column: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text; null is empty."""
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for lo, hi, buf, offsets in K.slices(column):
        n = hi - lo
        starts, ends, rows = K.spans(buf, offsets)
        words = K.span_hashes(buf, starts, ends, lower=False)
        space = K.IS_SPACE[buf]
        out[lo:hi, 0] = np.bincount(rows, minlength=n)
        out[lo:hi, 1] = _per_row(~space & _LEAD[buf], offsets)
        out[lo:hi, 2] = _per_row(_SYMBOL[buf], offsets)
        out[lo:hi, 6] = _per_row(_UPPER[buf], offsets)
        out[lo:hi, 7] = _per_row(_LETTER[buf], offsets)
        breaks = np.flatnonzero(buf == 10)
        line_start = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1)
        line_start = line_start[line_start < len(buf)]
        line_row = np.searchsorted(offsets, line_start, side="right") - 1
        line_end = np.minimum(np.append(line_start[1:], len(buf)), offsets[line_row + 1])
        line_end -= (line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 10)
        filled = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
        kept = filled[line_end] > filled[line_start]
        line_start, line_end, line_row = line_start[kept], line_end[kept], line_row[kept]
        out[lo:hi, 3] = np.bincount(line_row, minlength=n)
        if len(line_row):
            _, again = _repeats(K.span_hashes(buf, line_start, line_end, lower=False), line_row)
            out[lo:hi, 4] = np.bincount(line_row[again], minlength=n)
        if len(words) >= 3:
            whole = rows[:-2] == rows[2:]
            twice, _ = _repeats(K.ngram_hashes(words, 3)[whole], rows[:-2][whole])
            window = np.zeros(len(words) + 2, bool)
            window[2:][np.flatnonzero(whole)[twice]] = True
            covered = window[2:] | window[1:-1] | window[:-2]
            out[lo:hi, 5] = np.bincount(rows[covered], minlength=n)
    return out


def _count(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], names=names)

    return run


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if n <= 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(log - log.max()).sum() * math.exp(log.max())))


def choose_cutoff(above: dict[str, np.ndarray], totals: dict[str, int], risk: float, delta: float) -> int | None:
    """Index of the cutoff to use, or None.

    above[x][c]: documents of x whose score is over cutoff c, cutoffs ascending;
    x: tune_good, tune_bad, hold_good; totals: all documents of x.
    """
    tune_bad = above["tune_bad"] / max(totals["tune_bad"], 1)
    tune_good = above["tune_good"] / max(totals["tune_good"], 1)
    worth = (tune_good <= risk) & (tune_bad >= 0.01) & (tune_bad >= 4 * tune_good)
    if not worth.any():
        return None
    target = int(np.flatnonzero(worth)[0])
    found = None
    for c in range(len(tune_bad) - 1, target - 1, -1):
        if binomial_tail(int(above["hold_good"][c]), totals["hold_good"], risk) > delta:
            break
        found = c
    return found


def _choose(strata: int, risk: float, delta: float):
    import pandas as pd

    kinds = ("tune_good", "tune_bad", "hold_good")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": [pdf["stratum"].iloc[0]]}
        for rule, (_, cutoffs) in RULES.items():
            own = pdf[pdf["rule"] == rule]
            counts = {x: np.bincount(own["bin"].to_numpy(np.int64), weights=own[x], minlength=len(cutoffs) + 1) for x in kinds}
            above = {x: counts[x][::-1].cumsum()[::-1][1:] for x in kinds}
            chosen = choose_cutoff(above, {x: int(counts[x].sum()) for x in kinds}, risk / len(RULES), delta / (strata * len(RULES)))
            out[rule] = [None if chosen is None else cutoffs[chosen]]
        return pd.DataFrame(out)

    return run


def half_of(digest: str) -> Column:
    """Whether a text serves for tuning or as holdout."""
    return F.when(F.xxhash64(digest).bitwiseAND(1) == 1, "tune").otherwise("hold")


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = 0.05,
    delta: float = 0.1,
    min_words: int = 50,
    work: Workspace | None = None,
) -> DataFrame:
    """(id, COUNTS, base_failed, failed_rules, kept) for every row of docs.

    labels(doc_id, quality): 1 is clean; null ids or qualities are ignored and
    an id with several labels counts as its least.  base_failed: under
    `min_words` words, or over half of the words in repeated 3-word windows.
    The rules learn from labelled documents that pass that, by stratum; a
    stratum without enough labels has no active rule, so nothing is rejected
    there beyond the base.  A null stratum is a stratum of its own.  Copies of
    a text in a stratum are one label (the least of theirs), since a bound needs
    independent labels; near copies still count apart.

    Defined cases: null or empty text has zero counts and base_failed true
    unless min_words is 0 (the scores of a text without words are 0 then); a
    null id takes no part in learning and still gives a row; repeated rows each
    give a row; no labels leave the base alone; an empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))  # a null apart from ''
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), F.xxhash64(text).alias("digest"), text.alias("text"))
    kind = base.schema["id"].dataType
    counted = work.keep(base.mapInArrow(_count(["id", "stratum", "digest", *COUNTS]), f"id {kind.simpleString()}, stratum string, digest long, {SCHEMA}"), "counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)

    known = labels.select(F.col("doc_id").cast(kind).alias("id"), "quality").filter("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    seen = counted.filter("not base_failed").join(known, "id").groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), *(F.min(c).alias(c) for c in COUNTS))
    seen = seen.withColumn("half", half_of("digest"))
    bins = F.array(
        *(
            F.struct(F.lit(rule).alias("rule"), sum((F.expr(score) > c).cast("int") for c in cutoffs).alias("bin"))
            for rule, (score, cutoffs) in RULES.items()
        )
    )
    is_kind = {"tune_good": ("tune", 1), "tune_bad": ("tune", 0), "hold_good": ("hold", 1)}
    table = seen.select("stratum", "half", "quality", F.inline(bins)).groupBy("stratum", "rule", "bin").agg(
        *(F.sum(((F.col("half") == h) & (F.col("quality") == q)).cast("long")).alias(name) for name, (h, q) in is_kind.items())
    )
    table = work.keep(table, "table")
    strata = max(1, table.select("stratum").distinct().count())
    chosen = table.groupBy("stratum").applyInPandas(_choose(strata, risk, delta), "stratum string, " + ", ".join(f"{r} double" for r in RULES))
    chosen = work.keep(chosen, "cutoffs")
    work.drop(table)

    out = counted.join(chosen, "stratum", "left")
    broken = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(
        F.filter(F.array(*(F.when(F.expr(score) > F.col(rule), F.lit(rule)) for rule, (score, _) in RULES.items())), lambda x: x.isNotNull())
    )
    out = out.withColumn("failed_rules", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "failed_rules", "kept")
