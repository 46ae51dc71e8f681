"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL-proximal.

Features of a text are its words, word pairs and the pairs and triples of its
words' shapes (letter case, digits and marks, runs squeezed; a word that equals
the one before has a shape of its own), all hashed into BUCKETS.  The learner
sees a bounded sample of labelled rows once or a few times, in a fixed order;
scoring is a sparse dot product per text with the broadcast weights (4 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .work import Workspace

BUCKETS = 1 << 20
#: Steps in which a sample's share is measured.
SCALE = 1 << 30

#: Shape classes: 1 lower-case and other letters, 2 A-Z, 3 digits; marks stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = 1
_SHAPE[0x80:] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x30:0x3A] = 3
_SAME = np.uint64(0x5A4E)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct buckets, values of unit length) of each text; null and blank texts have none."""
    mask = np.uint64(BUCKETS - 1)
    for lo, hi, buf, offsets in K.slices(column):
        starts, ends, rows = K.spans(buf, offsets)
        words = K.span_hashes(buf, starts, ends)
        at = np.searchsorted(rows, np.arange(hi - lo + 1), side="left")
        shape = _SHAPE[buf]
        keep = np.ones(len(buf), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[starts] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        shapes = K.span_hashes(shape[keep], place[starts], place[ends], lower=False) if len(starts) else words
        if len(words) > 1:
            same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
            shapes[1:][same] = _SAME
        grams = [(words, 1), (K.ngram_hashes(words, 2) ^ np.uint64(0x11), 2), (K.mix(shapes) ^ np.uint64(0x21), 1), (K.ngram_hashes(shapes, 2) ^ np.uint64(0x22), 2), (K.ngram_hashes(shapes, 3) ^ np.uint64(0x23), 3)]
        grams = [((g & mask).astype(np.int32), n) for g, n in grams]
        for k in range(hi - lo):
            a, b = at[k], at[k + 1]
            own = [g[a : b - n + 1] for g, n in grams if b - a >= n]
            if own:
                bucket, count = np.unique(np.concatenate(own), return_counts=True)
                value = np.log1p(count)
                yield lo + k, bucket, value / np.sqrt((value * value).sum())
            else:
                yield lo + k, np.zeros(0, np.int32), np.zeros(0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, b, v = [], [], []
        for k, bucket, value in features(batch.column(2)):
            rows.append(k)
            b.append(bucket.tobytes())
            v.append(value.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(b, pa.binary()), pa.array(v, pa.binary())], names=["order", "label", "b", "v"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias after `epochs` passes over (label, buckets, values)."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for label, bucket, value in rows:
            zi, ni = z[bucket], n[bucket]
            w = weight(zi, ni)
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -30, 30)))
            g = (p - label) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[bucket] = zi + g - step * w
            n[bucket] = ni + g * g
            gb = p - label
            bias_z += gb - ((bias_n + gb * gb) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += gb * gb
    return weight(z, n), -bias_z / ((beta + bias_n**0.5) / alpha)


def order_of(*key: str) -> Column:
    """A fixed number in [0, SCALE) for each key."""
    return F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(SCALE))


def sample(docs: DataFrame, known: DataFrame, max_rows: int, max_bytes: int, work: Workspace) -> DataFrame:
    """(order, label, text) of about max_rows labelled texts and max_bytes of text at most.

    docs(id, text); known(id, label), an id at most once.  Rows of equal id and
    text count once.  Sizes meet the labels without their texts; the texts that
    are taken meet a table of at most some max_rows rows.
    """
    keyed = docs.withColumn("digest", F.xxhash64("text"))
    sizes = keyed.select("id", "digest", F.octet_length("text").alias("size")).groupBy("id", "digest").agg(F.max("size").alias("size"))
    sized = work.keep(sizes.join(known, "id").withColumn("order", order_of("id", "digest")), "sizes")
    total, size = sized.agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, max_rows / max(total, 1), max_bytes / max(size or 0, 1))
    chosen = work.keep(sized.filter(F.col("order") < int(share * SCALE)).select("id", "digest", "label", "order"), "chosen")
    work.drop(sized)
    few = chosen.count() <= 2 * max_rows
    held = keyed.join(F.broadcast(chosen) if few else chosen, ["id", "digest"])
    return held.groupBy("id", "digest", "order", "label").agg(F.first("text").alias("text")).select("order", "label", "text")


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from the driver-sized labelled(order, label, text), in that order; features take some seven times the texts' bytes."""
    table = labelled.mapInArrow(_pack, "order long, label int, b binary, v binary").orderBy("order", "label", "b").toArrow()
    rows = [(y, np.frombuffer(b, np.int32), np.frombuffer(v, np.float32).astype(float)) for y, b, v in zip(table.column("label").to_pylist(), table.column("b").to_pylist(), table.column("v").to_pylist(), strict=True)]
    weights, bias = ftrl(rows)
    return weights.astype(np.float32), float(bias)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for k, bucket, value in features(batch.column(batch.num_columns - 1)):
                scores[k] = 1 / (1 + np.exp(-np.clip(weights[bucket] @ value + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.3, max_rows: int = 6_000, max_bytes: int = 32_000_000, work: Workspace | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    labels(doc_id, quality): 1 is good; null ids and qualities are ignored, an
    id with several labels counts as its least.  learn_from: condition (a Column
    over docs) of the rows whose labels may be learned; held_out is its negation
    (null counts as held out).  The fit takes about max_rows labelled texts and
    max_bytes of text at most, chosen by a hash of id and text; labelled rows of
    equal id and text count once.  score is the model's chance of label 1,
    predicted whether it is `cutoff` or more.

    Defined cases: null, empty and blank texts get the score of the bias alone;
    without labels every score is 0.5; repeated rows each give a row; a text of
    any length is scored whole; an empty table gives no rows.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(~learn_from, F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType
    known = labels.select(F.col("doc_id").cast(kind).alias("id"), "quality").filter("id is not null and quality is not null").groupBy("id").agg(F.min("quality").cast("int").alias("label"))
    seen = sample(base.filter("not held_out").select("id", "text"), known, max_rows, max_bytes, work)
    model = spark.sparkContext.broadcast(train(seen))
    out = base.mapInArrow(_score(model), f"id {kind.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int")).withColumnRenamed("id", id_col)
