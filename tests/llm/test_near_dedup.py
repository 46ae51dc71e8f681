from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ionlake.llm import kernel as K, near_dedup as N
from ionlake.llm.components import connected_components
from ionlake.llm.work import Workspace

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall("[^ \t-\r]+", (text or "").translate(LOW))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, num, den):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in at[g]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(spark, rows, num=85, den=100):
    out = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), num=num, den=den).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB É  \t\n\x0b\x1cz"), max_size=30) | st.none(), max_size=8))
def test_kernel_splits_like_the_pattern(texts):
    column = pa.array(texts, pa.string())
    held = {}
    for lo, _, buf, offsets in K.slices(column, limit=8):
        s, e, rows = K.spans(buf, offsets)
        for a, b, r in zip(s, e, rows, strict=True):
            held.setdefault(lo + int(r), []).append(bytes(K.LOWER[buf[a:b]]).decode())
    assert [held.get(i, []) for i in range(len(texts))] == [words(t) for t in texts]


def test_kernel_sets_have_the_right_sizes():
    texts = ["a b c d e f", "A B C D E f", "a b", "", None, "x " * 50, " ".join(f"w{i}" for i in range(300_000))]
    sizes = [len(h) for _, h in K.shingle_sets(pa.array(texts, pa.string()))]
    assert sizes == [len(shingles(t)) for t in texts]
    both = [h for _, h in K.shingle_sets(pa.array(texts[:2], pa.string()))]
    assert np.array_equal(*both)


def test_signature_fills_bins_for_any_size():
    signer = N.Signer(36, 8)
    for n in (1, 2, 7, 400):
        h = np.unique(K.mix(np.arange(n, dtype=np.uint64)))
        assert not (signer.signature(h) == N._EMPTY).any()


def noisy(rng, base, share):
    out = list(base)
    for k in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[k] = f"n{rng.integers(1 << 40)}"
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(25):
        base = [f"v{rng.integers(4000)}" for _ in range(int(rng.integers(5, 250)))]
        for share in (0, 0, 0.004, 0.01, 0.02, 0.03, 0.2):
            rows.append((i, " ".join(noisy(rng, base, share) if share else base)))
            i += 1
    order = rng.permutation(len(rows))
    rows = [(int(k), rows[j][1]) for j, k in enumerate(order)]
    assert result(spark, rows) == brute(rows, 85, 100)
    assert result(spark, rows, 4, 5) == brute(rows, 4, 5)


def test_outer_members_of_a_star_are_found(spark):
    """Copies that are near one middle document and not one another, whose middle isn't the least."""
    rng = np.random.default_rng(5)
    base = [f"c{k}" for k in range(300)]
    rows = [(1000, " ".join(base))]
    for k in range(150):
        copy = list(base)
        for at in rng.choice(60, 4, replace=False):
            copy[at * 5] = f"u{k}_{at}"
        rows.append((k if k % 2 else 2000 + k, " ".join(copy)))
    expected = brute(rows, 85, 100)
    assert len({v[1] for v in expected.values()}) < 20
    assert result(spark, rows) == expected


@pytest.mark.parametrize("blocks", [(0, 0), (0, 1)])
def test_blocks_link_components_once(blocks):
    """The last step alone: a pair is compared in the first bucket it shares, and only there."""
    base = [f"c{k}" for k in range(200)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(f"z{k}" for k in range(50))]
    signer = N.Signer(36, 8)
    keys = [signer.keys(s) for _, s in K.shingle_sets(pa.array(texts))]
    shared = np.flatnonzero(keys[0] == keys[1])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(band, comps):
        n = len(comps)
        rows = {"key": [int(keys[0][band])] * n, "i": [0] * n, "j": [blocks[1]] * n, "rep": [10, 11], "comp": comps, "block": list(blocks), "bands": [k.tolist() for k in keys[:n]], "hashes": [s.tobytes() for _, s in K.shingle_sets(pa.array(texts[:n]))]}
        return N._within_block(85, 100, schema)(pa.table(rows)).to_pylist()

    assert len(shared) > 5
    assert links(shared[0], [10, 11]) == [{"a": 10, "b": 11}]
    assert links(shared[1], [10, 11]) == [] and links(shared[0], [10, 10]) == []


def test_blocks_against_all_pairs():
    """A bucket's blocks: postings give the same links as sets of Python, up to those that join nothing."""
    rng = np.random.default_rng(4)
    base = np.unique(K.mix(np.arange(300, dtype=np.uint64)))
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(200, 290)), replace=False), K.mix(np.arange(k * 1000 + 5000, k * 1000 + 5000 + int(rng.integers(0, 30)), dtype=np.uint64))])) for k in range(80)]
    bands = np.tile(np.arange(36), (80, 1))
    comps = rng.integers(0, 60, 80)
    for low, high in ((np.arange(80), np.arange(80)), (np.arange(30), np.arange(30, 80))):
        found = N.block_links(0, bands, sets, comps, low, high, 85, 100)
        plain = [(x, y) for x in low for y in high if x < y and 100 * len(a := {*sets[x].tolist()} & {*sets[y].tolist()}) >= 85 * (len(sets[x]) + len(sets[y]) - len(a))]
        assert {*found} <= {*plain} and 0 < len(found) < 60

        def groups(links):
            label = comps.copy()
            for x, y in links:
                label[label == label[x]] = label[y]
            return {frozenset(np.flatnonzero(label == v).tolist()) for v in label}

        assert groups(found) == groups(plain)


def test_blocks_that_can_hold_links_meet_once(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 600)
    rng = np.random.default_rng(6)
    size = {k: int(rng.integers(1, 400)) for k in range(120)} | {120: 17, 121: 20, 122: 20 * 17, 123: 400}
    rows = [(key, k, n) for key in (1, 2) for k, n in size.items() if key == 1 or k % 3 == 0]
    dealt = N.deal_blocks(spark.createDataFrame(rows, "key long, rep long, n long"), 85, 100, Workspace(spark))[0].collect()
    tasks = defaultdict(list)
    for r in dealt:
        tasks[r.key, r.i, r.j].append((r.rep, r.block))
    met = defaultdict(int)
    for (key, i, j), members in tasks.items():
        low, high = ([rep for rep, block in members if block == at] for at in (i, j))
        for x in low:
            for y in high:
                if i != j or x < y:
                    met[key, min(x, y), max(x, y)] += 1
    assert set(met.values()) == {1}
    can = {(key, x, y) for key, x, n in rows for other, y, m in rows if key == other and x < y and 100 * min(n, m) >= 85 * max(n, m)}
    assert can <= set(met) and len(met) < len(rows) ** 2 / 4
    # a row meets the blocks of three levels, which hold sizes within a factor of (20/17)^2 and more by rounding up
    reach = (20 / 17) ** 2
    assert len(dealt) <= sum(3 + sum(m for other, _, m in rows if other == key and n / reach <= m <= n * reach) / 600 for key, _, n in rows)


def test_rows_that_share_an_id_are_one_document(spark):
    rng = np.random.default_rng(9)
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [(5, text("A")), (7, text("A")), (7, text("B")), (3, text("B")), (20, text("C")), (20, text("D")), (21, text("D") + " end"), (22, text("E")), (22, ""), (11, text("E")), (30, None), (30, None), (40, text("F")), *[(41, text("F"))] * 50]
    for k in range(100, 160):
        rows.append((k, text(f"x{rng.integers(20)}")))
        rows.append((k, text(f"x{rng.integers(20)}") + (" tail" if rng.random() < 0.5 else "")))
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(shingles(t))
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in texts:
        for y in texts:
            if x < y and any(a and 100 * len(a & b) >= 85 * len(a | b) for a in texts[x] for b in texts[y]):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    out = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), num=85, den=100).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {(i, find(i), find(i) == i) for i in texts}
    assert sorted((r.doc_id, r.n_shingles) for r in out) == sorted((i, len(shingles(t))) for i, t in rows)


def test_odd_inputs(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " end"), (None, "one two"), (9, "a b c d e"), (9, "a b c d e"), (None, None)]
    out = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text as component_id", "1 as rep", "2 as id", "3 as key"), num=85, den=100).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 59_996, 7, True), (8, 59_997, 7, False), (None, 1, None, True), (9, 1, 9, True), (None, 0, None, True)}
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(60)] + [(200, 300), (300, 250), (5, 5), (None, 4), (700, 701), (701, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), Workspace(spark)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 250: 200, 300: 200, 700: 700, 701: 700}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark)).count() == 0


@pytest.mark.parametrize(("similarity", "rows"), [(0.85, 8), (0.8, 6)])
def test_band_plan(similarity, rows):
    assert N.band_plan(similarity) == rows
    assert (1 - similarity**rows) ** 36 <= 2e-5


def test_workspace_is_in_the_warehouse_where_no_folder_is_named(spark):
    class Unnamed:
        """The session as it is where spark.checkpoint.dir is unset."""

        conf = property(lambda self: self)

        def get(self, key, default=None):
            return default if key == "spark.checkpoint.dir" else spark.conf.get(key)

        def __getattr__(self, name):
            return getattr(spark, name)

    work = Workspace(Unnamed())
    assert "/warehouse" in work.dir and work.dir.startswith(("file:///", "/"))
    kept = work.keep(spark.range(5), "five")
    assert kept.count() == 5
    work.drop(kept)
    assert not work.fs.exists(spark._jvm.org.apache.hadoop.fs.Path(kept.kept_at))
