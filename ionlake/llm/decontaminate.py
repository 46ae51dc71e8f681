"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity, so one
signature length can't serve all sizes.  Documents are partitioned by the power
of two above their number of shingles; a partition's one-permutation signature
has BINS_PER_SHINGLE times as many bins, so a shingle keeps its place in the
signature with a chance of at least (1 - exp(-x)) / x at x = 1 / BINS_PER_SHINGLE
however long the document is.  The items' signatures with the same bins are the
index; a document and an item that agree in a bin are a candidate pair, which is
confirmed on the full sets.  Items too small for that chance to add up are
indexed and probed with every shingle, so they are found for certain.

Items of up to BLOCK_CHARS characters are an index that is broadcast.  More of
them meet the documents in a join by hash: an item gives its least hashes, one
more than it may lack (so a document that contains it has one of them), a text
all of its own, and candidates are confirmed on the full sets.  Its rows grow
with the texts and the items, not with their product, unless a shingle that is
among an item's least is frequent in both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .work import Workspace

BINS_PER_SHINGLE = 4
#: Characters of item texts that are held by the driver and each task; more items are joined.
BLOCK_CHARS = 4_000_000
#: Digests of contaminated texts that are broadcast at most.
FEW_TEXTS = 50_000


def small_below(containment: float, miss: float = 1e-6) -> int:
    """Items of fewer shingles than this would be missed with a chance over `miss`."""
    lose = 1 - (1 - math.exp(-1 / BINS_PER_SHINGLE)) * BINS_PER_SHINGLE
    n = 1
    while lose ** math.ceil(containment * n) > miss:
        n += 1
    return n


def _needed(size: int, num: int, den: int) -> int:
    return -(-num * size // den)


class ItemIndex:
    """Signatures of the items, by size partition of the documents."""

    def __init__(self, ids: list, texts: pa.Array, shingle: int, num: int, den: int):
        self.num, self.den = num, den
        self.ids, self.sets = [], []
        for k, hashes in K.shingle_sets(texts, shingle):
            if len(hashes):
                self.ids.append(ids[k])
                self.sets.append(hashes)
        limit = small_below(num / den)
        self.small = self._table([(k, s) for k, s in enumerate(self.sets) if len(s) < limit])
        self.large = [(k, s) for k, s in enumerate(self.sets) if len(s) >= limit]
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _table(entries) -> tuple[np.ndarray, np.ndarray]:
        if not entries:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        values = np.concatenate([s for _, s in entries])
        owner = np.repeat([k for k, _ in entries], [len(s) for _, s in entries])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    @staticmethod
    def signature(hashes: np.ndarray, bits: int) -> np.ndarray:
        """Least hash of every filled bin of 2**bits; hashes sorted and distinct."""
        bins = hashes >> np.uint64(64 - bits)
        first = np.ones(len(hashes), bool)
        first[1:] = bins[1:] != bins[:-1]
        return hashes[first]

    def part(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        if bits not in self.parts:
            self.parts[bits] = self._table([(k, self.signature(s, bits)) for k, s in self.large])
        return self.parts[bits]

    @staticmethod
    def _owners(table: tuple[np.ndarray, np.ndarray], probe: np.ndarray) -> np.ndarray:
        values, owner = table
        if not len(values) or not len(probe):
            return np.zeros(0, np.int64)
        lo = np.searchsorted(values, probe, side="left")
        lo_c = np.minimum(lo, len(values) - 1)
        hit = values[lo_c] == probe
        if not hit.any():
            return np.zeros(0, np.int64)
        hi = np.searchsorted(values, probe[hit], side="right")
        return np.unique(np.concatenate([owner[a:b] for a, b in zip(lo[hit], hi, strict=True)]))

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(item, common shingles) of every item contained in the set."""
        if not len(hashes):
            return []
        bits = (max(1, len(hashes) - 1).bit_length()) + (BINS_PER_SHINGLE - 1).bit_length()
        found = []
        for k in [*self._owners(self.part(bits), self.signature(hashes, bits)), *self._owners(self.small, hashes)]:
            common = K.intersection_size(self.sets[k], hashes)
            if common >= _needed(len(self.sets[k]), self.num, self.den):
                found.append((int(k), common))
        return found


def _pairs(shared, shingle: int, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            at, item, size, common = [], [], [], []
            for k, hashes in K.shingle_sets(batch.column(1), shingle):
                for i, n in index.matches(hashes):
                    at.append(k)
                    item.append(index.ids[i])
                    size.append(len(index.sets[i]))
                    common.append(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item, kinds[1]), pa.array(size, pa.int64()), pa.array(common, pa.int64())], names=["id", "item", "n_item", "n_common"])

    return run


def _clean(shared, shingle: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, hashes in K.shingle_sets(batch.column(text_at), shingle):
                keep[k] = not index.matches(hashes)
            yield batch.filter(pa.array(keep))

    return run


def _index(items: DataFrame, shingle: int, num: int, den: int):
    """Broadcast index of items(item, text), or None where they have more than BLOCK_CHARS characters."""
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK_CHARS:
        return None
    table = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(ItemIndex(table.column("item").to_pylist(), table.column("text"), shingle, num, den))


def _item_keys(shingle: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, h) for k, h in K.shingle_sets(batch.column(1), shingle) if len(h)]
            at = pa.array([k for k, _ in found], pa.int64())
            keys = [h[: len(h) - _needed(len(h), num, den) + 1].view(np.int64) for _, h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([h.tobytes() for _, h in found], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["code", "hashes", "keys"])

    return run


def _probes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, h in K.shingle_sets(batch.column(2), shingle):
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(0)[k].as_py())), pa.array(np.full(len(h), batch.column(1)[k].as_py())), pa.array(h.view(np.int64))], names=["d1", "d2", "hash"])

    return run


def _verify(shingle: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, own in K.shingle_sets(batch.column(2), shingle):
                for item in batch.column(3)[k].as_py():
                    hashes = np.frombuffer(item["hashes"], np.uint64)
                    common = K.intersection_size(hashes, own)
                    if common >= _needed(len(hashes), num, den):
                        out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), item["code"], len(hashes), common))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["d1", "d2", "code", "n_item", "n_common"])

    return run


DIGEST = ("d1", "d2")


def _digests(text: str) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2")]


def _joined(texts: DataFrame, items: DataFrame, shingle: int, num: int, den: int, work: Workspace) -> DataFrame:
    """(d1, d2, code, n_item, n_common) of texts(text) and items(code, text), each pair once."""
    keyed = work.keep(items.mapInArrow(_item_keys(shingle, num, den), "code long, hashes binary, keys array<long>"), "items")
    held = texts.filter("text is not null").select(*_digests("text"), "text")
    probes = held.mapInArrow(_probes(shingle), "d1 long, d2 long, hash long")
    found = probes.join(keyed.select("code", F.explode("keys").alias("hash")), "hash").select(*DIGEST, "code").distinct()
    found = work.keep(found, "candidates")
    wanted = found.join(keyed.select("code", "hashes"), "code").groupBy(*DIGEST).agg(F.collect_list(F.struct("code", "hashes")).alias("items"))
    once = held.join(found.select(*DIGEST).distinct(), list(DIGEST), "left_semi").groupBy(*DIGEST).agg(F.first("text").alias("text"))
    full = once.join(wanted, list(DIGEST)).select(*DIGEST, "text", "items")
    return work.keep(full.mapInArrow(_verify(shingle, num, den), "d1 long, d2 long, code long, n_item long, n_common long"), "pairs")


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", num: int = 4, den: int = 5, shingle: int = 5, work: Workspace | None = None) -> DataFrame:
    """(id, item, n_item, n_common): every row of docs and item with at least num/den of the item's shingles in the document.

    Sets are of distinct runs of `shingle` words, A-Z lower-cased; a text of
    fewer words has its whole sequence as one shingle, so a shorter item is
    found only where it is the whole document.

    Defined cases: null, empty or blank texts match nothing on either side; a
    null id or item id is kept as it is; repeated rows or items each give their
    pairs; empty tables give no rows.  Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = base.schema["id"].dataType, items.schema[item_col].dataType
    held = items.select(F.col(item_col).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    shared = _index(held, shingle, num, den)
    if shared is not None:
        arrow = tuple(to_arrow_type(k) for k in kinds)
        out = base.mapInArrow(_pairs(shared, shingle, arrow), f"id {kinds[0].simpleString()}, item {kinds[1].simpleString()}, n_item long, n_common long")
    else:
        work = work or Workspace(docs.sparkSession)
        code = F.xxhash64("text").alias("code")
        pairs = _joined(base, held.select(code, "text").distinct(), shingle, num, den, work)
        out = base.filter("text is not null").select("id", *_digests("text")).join(pairs, list(DIGEST)).join(held.select("item", code), "code").select("id", "item", "n_item", "n_common")
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", num: int = 4, den: int = 5, shingle: int = 5, work: Workspace | None = None) -> DataFrame:
    """The rows of docs that contain no item in the sense of contaminated_pairs; all columns stay, whatever their names.

    Defined cases: rows with a null, empty or blank text stay; null, empty or
    blank items match nothing; repeated rows go or stay together; texts of any
    length are held whole; without items all rows stay; an empty table gives no
    rows.
    """
    held = items.select(F.col(item_col).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    shared = _index(held, shingle, num, den)
    if shared is not None:
        return docs.mapInArrow(_clean(shared, shingle, docs.columns.index(text_col)), docs.schema)
    work = work or Workspace(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    pairs = _joined(docs.select(text.alias("text")), held.select(F.xxhash64("text").alias("code"), "text").distinct(), shingle, num, den, work)
    bad = work.keep(pairs.select(F.col("d1").alias("_bad_1"), F.col("d2").alias("_bad_2")).distinct(), "contaminated")
    same = (F.xxhash64(text) == F.col("_bad_1")) & (F.xxhash64(F.lit(7), text) == F.col("_bad_2"))
    return docs.join(F.broadcast(bad) if bad.count() <= FEW_TEXTS else bad, same, "left_anti")
