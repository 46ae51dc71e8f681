"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts are learned by partial sums in the tasks and one small aggregation.  The
log-probability matrix is broadcast in blocks of BLOCK languages, each of a
bounded size; every block's scorer hands the best language so far to the next.
A slice of texts becomes one sparse matrix of n-gram counts, whose product with
a block is taken in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .work import Workspace

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Languages of one broadcast matrix at most (32 MB).
BLOCK = 512
#: Labelled texts that a language has at least, if it has so many, whatever max_rows is.
LEAST_ROWS = 20
UNKNOWN = "und"
#: Characters that are turned into n-grams at once.
CHARS = 1 << 19
#: Characters of a text whose n-grams are counted in a dense array.
LONG = 400
#: Numbers that a product holds at once.
CELLS = 1 << 22
#: Languages whose shares are broadcast at most.
MANY = 50_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> bytes:
    return text.lower().encode("utf-32-le", "surrogatepass")


def _grams(code: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each place."""
    out = []
    for n in ORDERS:
        m = max(0, len(code) - n + 1)
        h = np.full(m, n * 0x2545F491 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out


def _squeeze(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places kept, whether each was a letter) where every run of other characters is one space; starts: places that always stay."""
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    return np.where(letter, code, np.uint32(32))[keep], np.flatnonzero(keep), letter[keep]


def _long_counts(text: str) -> np.ndarray | None:
    """Counts by bucket of one text, CHARS characters at a time; None without a letter."""
    counts, tail, some = np.zeros(BUCKETS, np.int64), np.array([32], np.uint32), False
    for at in range(0, len(text) + CHARS, CHARS):
        code = np.frombuffer(_codes(text[at : at + CHARS]) if at < len(text) else _codes(" "), np.uint32)
        # the last character before goes along, for whether a space follows a letter
        code, place, letter = _squeeze(np.concatenate([tail[-1:], code]), np.array([0]))
        some |= bool(letter[1:].any())
        code = np.concatenate([tail[:-1], code])
        for n, bucket in zip(ORDERS, _grams(code), strict=True):
            # n-grams that end in the tail were counted with it
            counts += np.bincount(bucket[max(0, len(tail) - n + 1) if at else 0 :], minlength=BUCKETS)
        tail = code[-max(ORDERS) :]
    return counts if some else None


def counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, buckets, counts): the texts with a letter, a run of them at a time, as rows of a sparse matrix.

    Letters are lower-cased, every run of other characters is one space, as are
    both ends.
    """
    for lo, hi, _, _ in K.slices(column, CHARS):
        texts = column.slice(lo, hi - lo).to_pylist()
        if hi - lo == 1 and len(texts[0] or "") > CHARS:
            count = _long_counts(texts[0])
            if count is not None:
                at = np.flatnonzero(count)
                yield np.array([lo]), np.array([0, len(at)]), at, count[at]
            continue
        space = _codes(" ")
        parts = [space + _codes(t or "") + space for t in texts]
        sizes = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        code, place, letter = _squeeze(np.frombuffer(b"".join(parts), np.uint32), starts)
        row = np.searchsorted(starts, place, side="right") - 1
        first = np.searchsorted(row, np.arange(hi - lo + 1), side="left")
        some = np.bincount(row[letter], minlength=hi - lo) > 0
        grams = _grams(code)
        long = some & (np.diff(first) >= LONG)
        dense = []
        for k in np.flatnonzero(long):
            a, b = first[k], first[k + 1]
            count = np.bincount(np.concatenate([g[a : b - n + 1] for n, g in zip(ORDERS, grams, strict=True)]), minlength=BUCKETS)
            at = np.flatnonzero(count)
            dense.append((at, count[at]))
        if dense:
            yield np.flatnonzero(long) + lo, np.cumsum([0, *(len(x) for x, _ in dense)]), np.concatenate([x for x, _ in dense]), np.concatenate([x for _, x in dense])
        have = np.flatnonzero(some & ~long)
        if len(have):
            short = (some & ~long)[row]
            keys = []
            for n, g in zip(ORDERS, grams, strict=True):
                begin = np.flatnonzero(short[: len(g)] & (row[: len(g)] == row[n - 1 :]))
                keys.append(row[begin] * BUCKETS + g[begin])
            at, count = np.unique(np.concatenate(keys), return_counts=True)
            yield have + lo, np.searchsorted(at, np.append(have, hi - lo) * BUCKETS), at % BUCKETS, count


def products(offsets: np.ndarray, buckets: np.ndarray, counts: np.ndarray, by_bucket: np.ndarray) -> np.ndarray:
    """The sparse matrix's product with by_bucket (buckets x languages), a few rows at a time; each row has an entry at least."""
    out = np.empty((len(offsets) - 1, by_bucket.shape[1]))
    most = max(1, CELLS // by_bucket.shape[1])
    x = 0
    while x < len(out):
        y = max(x + 1, int(np.searchsorted(offsets, offsets[x] + most, side="right")) - 1)
        a, b = offsets[x], offsets[y]
        out[x:y] = np.add.reduceat(by_bucket[buckets[a:b]] * counts[a:b, None], offsets[x:y] - a, axis=0)
        x = y
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for rows, offsets, buckets, counts in counted(batch.column(1)):
            for k, a, b in zip(rows, offsets[:-1], offsets[1:], strict=True):
                own = sums.setdefault(langs[k], np.zeros(BUCKETS, np.int64))
                own[buckets[a:b]] += counts[a:b]
        if len(sums) > BLOCK:
            yield from _flush(sums)
    yield from _flush(sums)


def _flush(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])
    sums.clear()


def learn(labelled: DataFrame, max_rows: int, work: Workspace) -> DataFrame:
    """(lang, buckets, counts) of every language of labelled(lang, text, key).

    A language gives max_rows / number of languages texts at most, or LEAST_ROWS
    if that is more, chosen by a hash of key; so a rare one keeps all it has.
    """
    sizes = work.keep(labelled.groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    n = sizes.count()
    quota = max(max_rows // max(n, 1), LEAST_ROWS)
    shares = sizes.select("lang", (F.lit(float(quota << 30)) / F.col("texts")).alias("share"))
    place = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30))
    chosen = labelled.join(F.broadcast(shares) if n <= MANY else shares, "lang").filter(place < F.col("share")).select("lang", "text")
    counts = chosen.mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))
    learned = work.keep(packed.select("lang", F.col("c.bucket").alias("buckets"), F.col("c.n").alias("counts")), "counts")
    work.drop(sizes)
    return learned


def blocks(learned: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """(languages, log-probabilities by bucket) of up to BLOCK languages at a time, in order of name."""
    after = None
    while True:
        rest = learned if after is None else learned.filter(F.col("lang") > F.lit(after))
        rows = rest.orderBy("lang").limit(BLOCK).toArrow()
        if not rows.num_rows:
            return
        matrix = np.full((rows.num_rows, BUCKETS), 0.5)
        for k in range(rows.num_rows):
            matrix[k, np.asarray(rows.column("buckets")[k].values)] += np.asarray(rows.column("counts")[k].values)
        langs = rows.column("lang").to_pylist()
        yield langs, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
        after = langs[-1]
        if rows.num_rows < BLOCK:
            return


def train(labelled: DataFrame, max_rows: int = 20_000, work: Workspace | None = None) -> tuple[list[str], np.ndarray]:
    """All languages of labelled(lang, text, key) and their log-probabilities in one matrix, for scoring outside a cluster."""
    held = list(blocks(learn(labelled, max_rows, work or Workspace(labelled.sparkSession))))
    return [x for langs, _ in held for x in langs], np.concatenate([m for _, m in held]) if held else np.zeros((0, BUCKETS), np.float32)


def _predict(shared):
    """Scores texts against one block; the columns lang_pred, best and odds carry the winner so far, its log-likelihood and the sum of tempered odds against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        by_bucket = np.ascontiguousarray(matrix.T, np.float64)
        for batch in batches:
            names, best, odds = batch.column(3).to_pylist(), np.array(batch.column(4)), np.array(batch.column(5))
            for rows, offsets, buckets, counts in counted(batch.column(2)):
                total = products(offsets, buckets, counts, by_bucket)
                scale = np.sqrt(np.add.reduceat(counts, offsets[:-1]))
                win = total.argmax(axis=1)
                top = total[np.arange(len(win)), win]
                own = np.exp((total - top[:, None]) / scale[:, None]).sum(axis=1)
                new = top > best[rows]
                high = np.maximum(top, best[rows])
                with np.errstate(invalid="ignore"):
                    old = np.where(odds[rows] > 0, odds[rows] * np.exp((best[rows] - high) / scale), 0.0)
                odds[rows] = own * np.exp((top - high) / scale) + old
                best[rows] = high
                for k, w in zip(rows[new].tolist(), win[new].tolist(), strict=True):
                    names[k] = langs[w]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(best), pa.array(odds)], names=batch.schema.names)

    return run


def predict_language(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, work: Workspace | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of docs.

    learn_from: condition (a Column over docs) of the rows that may be learned
    from; those also need a lang, a text and an id.  held_out is its negation
    (null counts as held out).  The fit takes some max_rows texts, in equal
    parts of the languages, and LEAST_ROWS of a language in any case; all
    languages with a letter in a chosen text can be predicted.  score is the
    winner's posterior, tempered by the square root of the number of n-grams;
    ties go to the first language by name.

    Defined cases: null text or a text without a letter gives `und` and score 0,
    as does every text when nothing could be learned; a text of any length
    counts whole; any number of languages is scored, BLOCK at a time; repeated
    rows each give a row; an empty table gives none.  lang is never an input of
    a prediction.  Other columns are ignored.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(~learn_from, F.lit(True)).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = base.filter("not held_out and id is not null and lang is not null and text is not null").select("lang", "text", F.col("id").alias("key"))
    kind = base.schema["id"].dataType.simpleString()
    out = base.select("id", "held_out", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("odds"))
    learned = learn(labelled, max_rows, work)
    for block in blocks(learned):
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_predict(shared), f"id {kind}, held_out boolean, text string, lang_pred string, best double, odds double")
    work.drop(learned)
    score = F.when(F.col("odds") > 0, 1 / F.col("odds")).otherwise(0.0)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", score.alias("score"))
