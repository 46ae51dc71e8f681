"""LM scores: a subword lattice model and the smoothed word unigram beside it.

Words are counted where they are read, so a frequent word costs one row a chunk
of texts, and summed by plain aggregation; runs of the vocabulary, dealt by
hash, become its packed rows.  The lattice's piece probabilities start from the
scores of an existing vocabulary and are re-estimated from all training words
(expected piece counts by forward and backward recursion, summed over packed
rows).  A text's score is the sum over its words of the log of the words'
probability, itself summed over all segmentations.

For the word unigram, words of at least 1 / HEAD of the training tokens (no
more than HEAD words) are broadcast and looked up in place.  A chunk of texts
asks for its rarer words in a join, one row a distinct word, and finishes its
sums where the answers meet it.  Rows grow with the texts, whatever the number
of chunks or packed rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .lattice import Vocabulary
from .work import Workspace

#: Entries of the broadcast word table at most (16 MB).
HEAD = 1 << 20
#: Documents for which a packed row of the vocabulary is made.
DOCS_PER_BUCKET = 4096
#: Weight of the vocabulary's own scores, in pieces, when probabilities are re-estimated.
PRIOR_PIECES = 32_000.0
LN10 = float(np.log(10.0))

#: Bytes of text that one chunk of either pass holds at most, unless one text is longer.
CHUNK_BYTES = 1 << 23

COUNT_SCHEMA = "hash long, word binary, n long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    return buf[np.arange(total) + shift]


class Types:
    """Distinct words of several slices with their counts, by hash."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, hashes, counts, lengths, words):
        self.parts.append((hashes, counts, lengths, words))

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes ascending, counts, lengths, words' bytes in that order)."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        hashes, counts, lengths = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        words = np.concatenate([p[3] for p in self.parts])
        starts = np.cumsum(lengths) - lengths
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        return distinct, total, lengths[first], _gather(words, starts[first], lengths[first])


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in chunks of about CHUNK_BYTES of text."""
    for batch in batches:
        for lo, hi, _, _ in K.slices(batch.column(column), CHUNK_BYTES):
            yield batch.slice(lo, hi - lo)


def _slice_types(buf, starts, ends, hashes):
    distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    lengths = ends[first] - starts[first]
    return distinct, counts, lengths, K.LOWER[_gather(buf, starts[first], lengths)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each chunk with their counts."""
    for batch in _chunks(batches, 0):
        types = Types()
        for _, _, buf, offsets in K.slices(batch.column(0)):
            starts, ends, _ = K.spans(buf, offsets)
            types.add(*_slice_types(buf, starts, ends, K.span_hashes(buf, starts, ends)))
        hashes, counts, lengths, words = types.merged()
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(words)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), column, pa.array(counts)], names=["hash", "word", "n"])


def _merge(table: pa.Table) -> pa.Table:
    """A packed row of the vocabulary from its (bucket, hash, word, n)."""
    hashes = np.asarray(table.column("hash").combine_chunks()).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    table = table.take(pa.array(order))
    counts = np.asarray(table.column("n").combine_chunks())
    words = table.column("word").combine_chunks().cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1])
    return pa.table(
        {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "words": pa.array([b"".join(words.to_pylist())], pa.binary()),
            "lengths": pa.array([lengths.astype(np.uint32).tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "tokens": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([len(counts)], pa.int64()),
        }
    )


MERGED_SCHEMA = "bucket int, words binary, lengths binary, counts binary, tokens long, types long"


def _unpack(words: bytes, lengths: bytes, counts: bytes):
    words, lengths, counts = np.frombuffer(words, np.uint8), np.frombuffer(lengths, np.uint32).astype(np.int64), np.frombuffer(counts, np.int64)
    ends = np.cumsum(lengths)
    return K.span_hashes(words, ends - lengths, ends, lower=False), counts, lengths, words


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_p = shared.value
        total = np.zeros(len(vocabulary.log_p))
        for batch in batches:
            for row in batch.to_pylist():
                _, counts, lengths, words = _unpack(row["words"], row["lengths"], row["counts"])
                if len(counts):
                    total += vocabulary.marginals(words, lengths, log_p, counts)[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "uses"])

    return run


def _entries(least: int, most: float):
    """(hash, n) of words that occur at least `least` and less than `most` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts, _, _ = _unpack(row["words"], row["lengths"], row["counts"])
                take = (counts >= least) & (counts < most)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[take].view(np.int64)), pa.array(counts[take])], names=["hash", "n"])

    return run


REQUEST_SCHEMA = "chunk long, hashes array<long>, words binary, docs binary, uses binary, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"


def _request(shared):
    """For each chunk of texts a row: what is known of its documents in place, its distinct rarer words, and their uses (place of the word, document, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_p, log_end, head, head_n = shared.value
        for batch in _chunks(batches, 2):
            n = batch.num_rows
            tokens, known = np.ones(n, np.int64), np.zeros(n, np.int64)
            base, score = np.zeros(n), np.full(n, log_end / LN10)
            rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            types, uses = Types(), []
            for lo, hi, buf, offsets in K.slices(batch.column(2)):
                starts, ends, rows = K.spans(buf, offsets)
                hashes = K.span_hashes(buf, starts, ends)
                distinct, inverse = np.unique(hashes, return_inverse=True)
                _, counts, lengths, words = _slice_types(buf, starts, ends, hashes)
                types.add(distinct, counts, lengths, words)
                pair, use = np.unique(rows * np.int64(len(distinct)) + inverse, return_counts=True)
                doc, word = pair // len(distinct) if len(distinct) else pair, pair % len(distinct) if len(distinct) else pair
                uses.append(((doc + lo).astype(np.uint32), distinct[word], use.astype(np.uint32)))
                tokens[lo:hi] += np.bincount(rows, minlength=hi - lo)
            hashes, _, lengths, words = types.merged()
            log_word = vocabulary.marginals(words, lengths, log_p) / LN10
            at = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
            in_head = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
            count = np.where(in_head, head_n[at], 0) if len(head) else np.zeros(len(hashes), np.int64)
            log_count = np.log10(count + 0.5)
            place = (np.cumsum(~in_head) - 1).astype(np.uint32)
            for doc, own, use in uses:
                word = np.searchsorted(hashes, own)
                score += np.bincount(doc, weights=log_word[word] * use, minlength=n)
                top = in_head[word]
                base += np.bincount(doc[top], weights=log_count[word[top]] * use[top], minlength=n)
                known += np.bincount(doc[top], weights=use[top], minlength=n).astype(np.int64)
                rest.append((place[word[~top]], doc[~top], use[~top]))
            uses.clear()
            packed = [np.concatenate([r[k] for r in rest]).tobytes() if rest else b"" for k in range(3)]
            rare = hashes[~in_head].view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(rare), batch.column(1), *(pa.array(x) for x in (tokens, known, base, score)), batch.column(0))]
            # the number that tells chunks apart is written once, with the row
            columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), lists[0], *(pa.array([x], pa.binary()) for x in packed), *lists[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in REQUEST_SCHEMA.split(", ")), "ids"])

    return run


def _finish(tokens: int, types: int, end_count: int, names: list[str]):
    scale = float(np.log10(tokens + 0.5 * (types + 1)))

    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        column = lambda c: asked.column(c).combine_chunks().flatten()
        base, known, n = (np.array(column(c)) for c in ("base", "n_known", "n_tokens"))
        hashes = np.array(column("hashes")).view(np.uint64)
        count = np.zeros(len(hashes), np.int64)
        count[np.searchsorted(hashes, np.array(answers.column("hash")).astype(np.int64).view(np.uint64))] = np.array(answers.column("n"))
        word, doc, use = (np.frombuffer(asked.column(c)[0].as_py(), np.uint32) for c in ("words", "docs", "uses"))
        base += np.bincount(doc, weights=np.log10(count + 0.5)[word] * use, minlength=len(n))
        known += np.bincount(doc, weights=np.where(count[word] > 0, use, 0), minlength=len(n)).astype(np.int64)
        base += np.log10(end_count + 0.5) - n * scale
        known += int(end_count > 0)
        return pa.table([column("ids"), column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), column("score")], names=names)

    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, rounds: int = 2, work: Workspace | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    held_out: condition (a Column over docs) of the rows that are not learned
    from (null counts as held out).  A text's tokens are its words, A-Z
    lower-cased, and one end.  base_score: sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))); n_known counts tokens with c > 0;
    train_tokens is N.  score: log10 probability of the text under the subword
    lattice: each word, behind a word mark, has the sum over all segmentations
    into pieces of the product of piece probabilities; the end is a piece of its
    own.  Piece probabilities are the vocabulary's own, re-estimated `rounds`
    times from the training words.  Words are told apart by 64-bit hashes.

    Defined cases: null and empty texts are one end token; without training
    rows all counts are 0 and the vocabulary's own scores hold; a null id is
    kept; repeated rows each count and each give a row; an empty table gives no
    rows.  Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type  # noqa: F401

    spark = docs.sparkSession
    work = work or Workspace(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    rows, texts = base.agg(F.count("*"), F.count_if(~F.col("held_out"))).first()
    bits = max(4, int(rows // DOCS_PER_BUCKET).bit_length())
    counted = base.filter("not held_out").select("text").mapInArrow(_count, COUNT_SCHEMA).groupBy("hash", "word").agg(F.sum("n").alias("n"))
    bucket = F.shiftrightunsigned("hash", 64 - bits).cast("int")
    words = work.keep(counted.select(bucket.alias("bucket"), "hash", "word", "n").groupBy("bucket").applyInArrow(_merge, MERGED_SCHEMA), "words")
    n, v = words.agg(F.sum("tokens"), F.sum("types")).first()
    n, v = n or 0, v or 0
    pieces = Vocabulary.load(vocabulary or default_vocabulary())
    log_p, log_end = pieces.log_p, float(np.log(1e-3))
    log_p = log_p + np.log1p(-1e-3)
    for _ in range(rounds if texts else 0):
        shared = spark.sparkContext.broadcast((pieces, log_p))
        uses = words.mapInArrow(_expect(shared), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        expected = np.zeros(len(log_p))
        expected[np.asarray(uses.column("piece"))] = np.asarray(uses.column("uses"))
        smooth = expected + PRIOR_PIECES * np.exp(pieces.log_p)
        total = smooth.sum() + texts
        log_p, log_end = np.log(smooth / total), float(np.log(texts / total))
        shared.unpersist()
    least = max(1, -(-n // HEAD))
    head = words.mapInArrow(_entries(least, np.inf), "hash long, n long").toArrow()
    head_hash = np.asarray(head.column("hash")).astype(np.int64).view(np.uint64)
    order = np.argsort(head_hash)
    shared = spark.sparkContext.broadcast((pieces, log_p, log_end, head_hash[order], np.asarray(head.column("n"))[order]))
    asked = work.keep(base.select("id", "held_out", "text").mapInArrow(_request(shared), f"{REQUEST_SCHEMA}, ids array<{kind}>"), "requests")
    rarer = words.mapInArrow(_entries(0, least), "hash long, n long")
    answers = work.keep(asked.select("chunk", F.explode("hashes").alias("hash")).join(rarer, "hash").select("chunk", "hash", "n"), "answers")
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return asked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _finish(n + texts, v + int(texts > 0), texts, names), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
