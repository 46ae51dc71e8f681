"""Near-duplicate documents: one-permutation MinHash, banded buckets, star links.

Plan.  One pass over the texts gives each document the size and a 128-bit digest
of its shingle set and a row of band keys; texts are not shuffled for that.
Documents of equal sets become one class, so a group of thousands of exact
copies costs one representative.  Representatives that share a band key form a
bucket; each bucket gives a star of candidate links to its least member, not all
its pairs.  Candidates are confirmed on the full sets.  A star can miss a link
between two outer members, so buckets that confirmed links leave in several
components get a second star around their best linked member, and what is still
open is compared in blocks inside tasks, giving only links that join components.
A block holds sorted hashes of a bounded number of shingles and members of one
size level; only blocks of the same or adjoining levels meet, since sizes
further apart can't be linked.  Components come from star contraction.

What a bucket's members need of the bucket (its hub, whether it is open) is
summed in the map tasks and written before it meets them, so that the members of
one bucket can be split among tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import kernel as K
from .components import connected_components
from .work import Workspace

#: Shingles and members of a block in the last step, about; a task holds two blocks.
BLOCK_SHINGLES = 1 << 20
BLOCK_MEMBERS = 2048
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_plan(similarity: float, bands: int = 36, miss: float = 2e-5) -> int:
    """Most rows a band can have so that a pair at the similarity shares no band with a chance of at most miss."""
    rows = 1
    while (1 - similarity ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


class Signer:
    """One-permutation MinHash with optimal densification.

    One hash a shingle: its high bits choose the bin, the least value stays.  An
    empty bin takes the value of another bin, chosen by a hash of the bin's
    number and the attempt alone, until it meets one that is filled.
    """

    def __init__(self, bands: int, rows: int, tries: int = 256):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        pick = K.mix(np.arange(self.bins * tries, dtype=np.uint64) + np.uint64(7919 << 20))
        self.pick = (pick % np.uint64(self.bins)).astype(np.int32).reshape(self.bins, tries)
        self.factor = K.constants(rows, 41)
        self.seed = K.constants(bands, 43)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted and distinct, one at least."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.ones(len(hashes), bool)
        first[1:] = bins[1:] != bins[:-1]
        sig = np.full(self.bins, _EMPTY)
        full = np.zeros(self.bins, bool)
        at = bins[first].astype(np.int64)
        sig[at] = hashes[first]
        full[at] = True
        empty = np.flatnonzero(~full)
        width = 8
        while len(empty):
            pick = self.pick[empty, :width]
            hit = full[pick]
            which = hit.argmax(axis=1)
            found = hit[np.arange(len(empty)), which]
            sig[empty[found]] = sig[pick[np.arange(len(empty)), which][found]]
            empty = empty[~found]
            if width >= self.pick.shape[1] and len(empty):  # next filled bin, in a circle
                order = np.flatnonzero(full)
                sig[empty] = sig[order[np.searchsorted(order, empty) % len(order)]]
                break
            width *= 4
        return sig

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.int64)
        sig = K.mix(self.signature(hashes)).reshape(self.bands, self.rows)
        return K.mix((sig * self.factor).sum(axis=1, dtype=np.uint64) ^ self.seed).view(np.int64)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that two equal sets share."""
    a = K.mix(hashes ^ np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = K.mix(hashes + np.uint64(0x89ABCDEF123)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for _, hashes in K.shingle_sets(batch.column(1), shingle):
                a, b = set_digest(hashes)
                n.append(len(hashes))
                d1.append(a)
                d2.append(b)
                keys.append(signer.keys(hashes))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                names=["id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def linked(common: int, a: int, b: int, num: int, den: int) -> bool:
    """Whether the sets' similarity is num/den or more, in whole numbers."""
    return den * common >= num * (a + b - common)


def _confirm(shingle: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs = batch.column(1).to_pylist()
            hub_texts = batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i, own in K.shingle_sets(batch.column(2), shingle):
                key = (hubs[i], hub_texts[i])
                if key != hub:
                    hub, hub_set = key, next(K.shingle_sets(hub_texts.slice(i, 1), shingle))[1]
                if den * min(len(own), len(hub_set)) >= num * max(len(own), len(hub_set)):
                    ok[i] = linked(K.intersection_size(own, hub_set), len(own), len(hub_set), num, den)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _sets(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            found = [(set_digest(h)[0], len(h), h.tobytes(), signer.keys(h).tolist()) for _, h in K.shingle_sets(batch.column(1), shingle)]
            columns = (pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["rep", "d1", "n", "hashes", "bands"])

    return run


class Postings:
    """Which of several sets hold a hash."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.n, self.owner = len(sets), owner[order]
        self.hashes, self.at = np.unique(flat[order], return_index=True)
        self.at = np.append(self.at, len(flat))

    def common(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the hashes each set holds."""
        at = np.searchsorted(self.hashes, hashes)
        at = at[at < len(self.hashes)] if len(at) and at[-1] == len(self.hashes) else at
        at = at[self.hashes[at] == hashes[: len(at)]]
        sizes = self.at[at + 1] - self.at[at]
        shift = np.repeat(self.at[at] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.owner[np.arange(len(shift)) + shift], minlength=self.n)


def block_links(key: int, bands: np.ndarray, sets: list[np.ndarray], comps: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Places of linked members, one of low and one of high, that lie in different components, as far as they join some.

    bands: a row of band keys a member; a pair is compared only where key is the
    first band key that it shares, so once among all buckets.
    """
    band = int(np.argmax(bands[0] == key))
    same_block = np.array_equal(low, high)
    sizes = np.array([len(s) for s in sets])
    label = comps.copy()
    postings = Postings([sets[y] for y in high]) if len(high) and label.min() != label.max() else None
    links = []
    for place, x in enumerate(low if postings else []):
        others = high[place + 1 :] if same_block else high
        fit = (label[others] != label[x]) & (den * np.minimum(sizes[others], sizes[x]) >= num * np.maximum(sizes[others], sizes[x]))
        others = others[fit]
        if not len(others):
            continue
        fit = (bands[others] == bands[x]).argmax(axis=1) == band
        others = others[fit]
        if not len(others):
            continue
        common = postings.common(sets[x])[np.searchsorted(high, others)]
        for y in others[den * common >= num * (sizes[others] + sizes[x] - common)]:
            if label[x] != label[y]:
                label[label == label[x]] = label[y]
                links.append((int(x), int(y)))
    return links


def _within_block(num: int, den: int, links: pa.Schema):
    """Links between members of one pair of blocks that lie in different components."""

    def run(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        _, comps = np.unique(np.array(table.column("comp").to_pylist(), dtype=object), return_inverse=True)
        block = np.array(table.column("block"))
        sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        found = block_links(key, np.array(table.column("bands").to_pylist(), np.int64), sets, comps, np.flatnonzero(block == i), np.flatnonzero(block == j), num, den)
        ids = table.column("rep").to_pylist()
        return pa.table([pa.array([ids[x] for x, _ in found], links.field(0).type), pa.array([ids[y] for _, y in found], links.field(1).type)], schema=links)

    return run


def deal_blocks(members: DataFrame, num: int, den: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(dealt, plan), the latter a kept table: members(key, rep, n, ...) with block, a row for each pair of blocks (i, j) of its bucket that its block belongs to, i <= j.

    A block's number has its level, which holds sizes n within a factor of about
    den/num, in the high bits.  Blocks of a level and of adjoining ones meet.
    """
    width = math.log(den / num) * (1 + 1e-9)  # sizes a factor of den/num apart are one level apart at most
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)) if width else F.col("n")
    held = members.withColumn("level", level.cast("long"))
    wanted = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("long")
    plan = held.groupBy("key", "level").agg(wanted.alias("blocks")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("plan"))
    plan = work.keep(plan, "plan")
    own = F.col("level")
    blocks = lambda shift: F.coalesce(F.try_element_at("plan", own + shift), F.lit(0).cast("long"))
    number = lambda shift, o: F.shiftleft(own + shift, 32) + o
    held = held.join(plan, "key").withColumn("block", number(0, F.pmod(F.xxhash64("rep"), blocks(0))))
    others = F.flatten(F.transform(F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1))), lambda d: F.when(blocks(d) > 0, F.transform(F.sequence(F.lit(0).cast("long"), blocks(d) - 1), lambda o: number(d, o))).otherwise(F.array().cast("array<long>"))))
    held = held.select(*members.columns, "block", F.explode(others).alias("other"))
    return held.select(*members.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), plan


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    num: int = 4,
    den: int = 5,
    shingle: int = 5,
    bands: int = 36,
    work: Workspace | None = None,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked when their sets of distinct shingles (runs of
    `shingle` words, A-Z lower-cased) have a Jaccard similarity of num/den or
    more; component_id is the least id reachable over links, kept is whether
    that is the row's own id.  Candidates come from `bands` bands whose rows are
    chosen by band_plan, and every link is confirmed on the full sets.

    Defined cases: fewer words than `shingle` make one shingle of the whole
    sequence; null, empty or blank texts have n_shingles 0 and are their own
    component, kept.  Equal sets are always linked.  Rows that share an id count
    as one document: what is linked with one of their texts is linked with all;
    each gives a row, with the size of its own set.  A null id gives
    component_id null and kept true.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    rows = band_plan(num / den, bands)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType
    signed = T.StructType(
        [T.StructField("id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    sig = work.keep(base.mapInArrow(_sign(shingle, bands, rows), signed), "signatures")

    digest = ["n_shingles", "d1", "d2"]
    live = sig.filter("n_shingles > 0 and id is not null")
    # equal sets have equal bands
    classes = work.keep(live.groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    shared = work.keep(sig.filter("id is not null").groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"), "shared")
    any_shared = shared.limit(1).count() > 0

    slots = classes.select("rep", F.explode("bands").alias("key"))
    hubs = work.keep(slots.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub <> last").select("key", "hub"), "hubs")
    slots = work.keep(slots.join(hubs, "key"), "buckets")
    work.drop(hubs)

    pairs = slots.filter("rep <> hub").select("rep", "hub").distinct()
    involved = slots.select(F.col("rep").alias("id")).distinct()
    texts = base.filter("id is not null")
    if any_shared:
        texts = texts.groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("id", "text")
    texts = work.keep(texts.join(involved, "id", "left_semi"), "texts")
    link_schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def confirm(candidates: DataFrame) -> DataFrame:
        both = candidates.join(texts.select(F.col("id").alias("rep"), F.col("text").alias("rep_text")), "rep")
        both = both.join(texts.select(F.col("id").alias("hub"), F.col("text").alias("hub_text")), "hub")
        return both.select("rep", "hub", "rep_text", "hub_text").mapInArrow(_confirm(shingle, num, den), link_schema)

    links = confirm(pairs)
    if any_shared:  # an id with texts in several classes links them
        one = sig.filter("n_shingles > 0").join(shared, "id", "left_semi").select("id", *digest).distinct()
        links = links.union(one.join(classes.select("rep", *digest), digest).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    links = work.keep(links, "confirmed")
    comps = connected_components(links, work)

    def still_open(slots: DataFrame, comps: DataFrame, least: int) -> DataFrame:
        """Bucket rows, with their components, of buckets of `least` members or more that lie in several components."""
        held = slots.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        held = work.keep(held, "held")
        split = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter(f"lo <> hi and members >= {least}")
        split = work.keep(split.select("key"), "split")
        out = work.keep(held.join(split, "key"), "open")
        work.drop(held, split)
        return out

    open_slots = still_open(slots, comps, 3)
    if open_slots.limit(1).count():
        degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("degree"))
        ranked = open_slots.filter("rep <> hub").join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        second = ranked.groupBy("key").agg(F.max(F.struct("degree", "rep", "comp")).alias("best")).select("key", F.col("best.rep").alias("hub2"), F.col("best.comp").alias("comp2"))
        second = work.keep(second, "second")
        again = open_slots.join(second, "key").filter("rep <> hub2 and rep <> hub and comp <> comp2").select("rep", F.col("hub2").alias("hub")).distinct()
        more = work.keep(links.union(confirm(again)), "confirmed")
        work.drop(links, open_slots, second, comps)
        links = more
        comps = connected_components(links, work)
        open_slots = still_open(slots, comps, 4)
        if open_slots.limit(1).count():
            members = texts.join(open_slots.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
            schema = T.StructType([T.StructField("rep", kind), T.StructField("d1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
            sets = work.keep(members.select(F.col("id").alias("rep"), "text").mapInArrow(_sets(shingle, bands, rows), schema), "members")
            ranked = open_slots.select("key", "rep", "comp").distinct().join(sets.select("rep", "d1", "n", "bands"), "rep").filter("array_contains(bands, key)").drop("bands")
            ranked = work.keep(ranked, "ranked")
            dealt, plan = deal_blocks(ranked, num, den, work)
            arrow = pa.schema([pa.field("a", _arrow_type(kind)), pa.field("b", _arrow_type(kind))])
            full = dealt.drop("n").join(sets.drop("n"), ["rep", "d1"])
            last = full.groupBy("key", "i", "j").applyInArrow(_within_block(num, den, arrow), link_schema)
            more = work.keep(links.union(last), "confirmed")
            work.drop(links, sets, comps, ranked, plan)
            links = more
            comps = connected_components(links, work)
        work.drop(open_slots)
    work.drop(links, texts, slots)

    found = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").filter("component is not null or copies > 1")
    found = found.select(*digest, F.coalesce("component", "rep").alias("found"))
    out = sig.select("id", *digest).join(found, digest, "left").withColumn("found", F.coalesce("found", "id"))
    if any_shared:  # rows without words follow their id
        by_id = out.join(shared, "id", "left_semi").groupBy("id").agg(F.min("found").alias("least"))
        out = out.join(by_id, "id", "left").withColumn("found", F.least("found", "least"))
    component = F.when(F.col("id").isNotNull(), F.col("found"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
