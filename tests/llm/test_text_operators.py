from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ionlake.llm import decontaminate as D, language_id as G, lm_score as M, quality_classifier as C, quality_rules as Q
from ionlake.llm.lattice import Vocabulary
from ionlake.llm.queries import fold
from ionlake.llm.work import Workspace

from .test_near_dedup import shingles, words

SCHEMA = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", None), (3, " \n ", "en"), (4, "word " * 30_000, "fr"), (5, "same text here", "en"), (5, "same text here", "en"), (None, "no id", "en")]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as id", "2 as score", "'x' as kept", "3 as n_words", "text as label", "5 as chunk")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op2


def counts(text):
    w = re.findall("[^ \t-\r]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text or "")), len(re.findall("[A-Za-z]", text or ""))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab #\n\té|Z"), max_size=60) | st.none(), max_size=6))
def test_counts(texts):
    assert Q.text_counts(pa.array(texts, pa.string())).tolist() == [counts(t) for t in texts]


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (40, 40, 0.5), (7, 500, 0.02)):
        assert Q.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_stop_at_the_first_failure():
    above = {"tune_good": np.array([50, 2, 1, 0]), "tune_bad": np.array([90, 80, 70, 60]), "hold_good": np.array([60, 30, 1, 0])}
    totals = {"tune_good": 1000, "tune_bad": 100, "hold_good": 1000}
    assert Q.choose_cutoff(above, totals, 0.01, 0.01) == 2  # 1 is worth having, but its 30 rejections fail the bound
    assert Q.choose_cutoff(above, totals | {"hold_good": 20}, 0.01, 0.01) is None


def test_rules_reject_junk_and_spare_clean(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(2400):
        bad = k % 4 == 0
        w = [f"w{rng.integers(5000)}" for _ in range(80)]
        rows.append((k, " ".join(x + ("***" if bad and rng.random() < 0.9 else "") for x in w), "en" if k < 2300 else "xx"))
        labels.append((k, int(not bad)))
    out = {r.doc_id: r for r in Q.quality_verdicts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")).collect()}
    assert sum(not out[k].kept for k in range(2300) if k % 4) <= 0.05 * 1725
    assert all(not out[k].kept for k in range(0, 2300, 4))
    assert all(out[k].kept for k in range(2300, 2400))  # too few labels for a bound


def test_rules_on_odd_inputs(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.quality_verdicts(odd(spark), labels).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert next(r for r in out if r.doc_id == 4).n_repeat_words == 30_000
    assert Q.quality_verdicts(empty(spark), labels).count() == 0


def test_verdicts_against_plain_ones(spark):
    """kept, end to end: base rules, one label a distinct text, cutoffs by exact tails in fractions, null apart from ''."""
    rng = np.random.default_rng(31)
    rows, labels = [], []
    for k in range(3600):
        bad = rng.random() < 0.3
        lang = ["en", "de", "", None][int(rng.choice(4, p=[0.5, 0.2, 0.15, 0.15]))]
        w = [f"w{rng.integers(900)}" for _ in range(int(rng.integers(40, 90)))]
        w = [x + "#" if bad and rng.random() < 0.6 else x.upper() if rng.random() < 0.02 else x for x in w]
        rows.append((k, " ".join(w), lang))
        if rng.random() < 0.8:
            labels.append((k, int(not bad)))
    rows += [(4000 + k, rows[int(rng.integers(40))][1], "en") for k in range(900)]
    labels += [(4000 + k, int(k % 5 > 0)) for k in range(900)] + [(4000, 0), (None, 1), (9, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in Q.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.2, delta=0.4).collect()}
    half = {r.doc_id: r.half for r in docs.select("doc_id", F.xxhash64("text").alias("d")).select("doc_id", Q.half_of("d").alias("half")).collect()}

    quality = {}
    for k, y in labels:
        if k is not None and y is not None:
            quality[k] = min(y, quality.get(k, 1))
    c = {k: dict(zip(Q.COUNTS, counts(t), strict=True)) for k, t, _ in rows}
    base = {k: v["n_words"] < 50 or 100 * v["n_repeat_words"] > 50 * v["n_words"] for k, v in c.items()}
    score = {
        "symbols": lambda v: v["n_symbols"] / max(v["n_words"], 1),
        "dup_lines": lambda v: v["n_dup_lines"] / max(v["n_lines"], 1),
        "repeats": lambda v: v["n_repeat_words"] / max(v["n_words"], 1),
        "upper": lambda v: v["n_upper"] / max(v["n_letters"], 1),
        "long_words": lambda v: v["word_chars"] / max(v["n_words"], 1),
    }
    seen = {}
    for k, t, lang in rows:
        if k in quality and not base[k]:
            seen.setdefault(lang, {}).setdefault(t, []).append(k)
    cut = {}
    for lang, texts in seen.items():
        groups = {"tune_good": [], "tune_bad": [], "hold_good": []}
        for ids in texts.values():
            name = f"{half[ids[0]]}_{'good' if min(quality[k] for k in ids) else 'bad'}"
            if name in groups:
                groups[name].append(c[ids[0]])
        for rule, (_, cutoffs) in Q.RULES.items():
            over = {g: [sum(score[rule](v) > x for v in vs) for x in cutoffs] for g, vs in groups.items()}
            rate = lambda g, i: over[g][i] / max(len(groups[g]), 1)  # noqa: E731, B023
            worth = [i for i in range(len(cutoffs)) if rate("tune_good", i) <= 0.2 / len(Q.RULES) and rate("tune_bad", i) >= 0.01 and rate("tune_bad", i) >= 4 * rate("tune_good", i)]
            for i in range(len(cutoffs) - 1, (worth or [len(cutoffs)])[0] - 1, -1):
                n, p = len(groups["hold_good"]), 0.2 / len(Q.RULES)
                if sum(math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(over["hold_good"][i] + 1)) > 0.4 / (len(seen) * len(Q.RULES)):
                    break
                cut[lang, rule] = cutoffs[i]
    assert {lang for lang, _ in cut} >= {"en", "de"}
    for k, _, lang in rows:
        broken = [] if base[k] else [r for r in Q.RULES if score[r](c[k]) > cut.get((lang, r), math.inf)]
        assert (out[k].base_failed, list(out[k].failed_rules), out[k].kept) == (base[k], broken, not base[k] and not broken)


def test_rules_without_a_least_number_of_words(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    out = Q.quality_verdicts(odd(spark), labels, min_words=0).collect()
    assert len(out) == len(ODD) and {r.kept for r in out if not r.n_words} == {True}


# --- op3


def test_contained_items_are_found(spark):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(100_000)}"
    items = [(k, " ".join(word() for _ in range(int(rng.integers(5, 60))))) for k in range(60)] + [(100, "two words"), (101, None), (102, "")]
    rows = []
    for k in range(200):
        w = [word() for _ in range(int(rng.integers(0, 4000)))]
        if k % 3 == 0:
            own = items[k % 60][1].split()
            if k % 2:
                own[len(own) // 2] = "changed"
            w[len(w) // 2 : len(w) // 2] = own
        rows.append((k, " ".join(w), "en"))
    rows += [(300, "TWO words", "en"), (301, None, "en"), (302, "", "en")]
    expected = set()
    for d, t, _ in rows:
        s = shingles(t)
        for i, q in items:
            g = shingles(q)
            if g and 5 * len(g & s) >= 4 * len(g):
                expected.add((d, i, len(g), len(g & s)))
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in D.contaminated_pairs(docs, table).collect()} == expected
    left = {r.doc_id for r in D.drop_contaminated(docs, table).collect()}
    assert left == {r[0] for r in rows} - {e[0] for e in expected}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(20)]
    docs = [(k, f"before {t} after", "en") for k, t in items]
    got = {(r.doc_id, r.item_id) for r in D.contaminated_pairs(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(20)}


def test_decontamination_of_odd_inputs(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "same text here"), (1, "same text here")], "item_id long, text string")
    assert D.contaminated_pairs(odd(spark), none).count() == 0
    assert D.contaminated_pairs(odd(spark), some).count() == 4
    out = D.drop_contaminated(odd(spark), some)
    assert out.count() == len(ODD) - 2 and out.columns == odd(spark).columns
    assert D.contaminated_pairs(empty(spark), some).count() == 0


def test_joined_items_give_the_pairs_of_the_index(spark, monkeypatch):
    """More items than the index may hold: the join gives the same pairs and the same rows left, repeats and ties included."""
    rng = np.random.default_rng(14)
    word = lambda: f"w{rng.integers(60)}"
    items = [(k, " ".join(word() for _ in range(int(rng.integers(0, 40))))) for k in range(60)] + [(100, "two words"), (101, None), (3, "two words"), (3, "two words")]
    rows = []
    for k in range(150):
        w = [word() for _ in range(int(rng.integers(0, 400)))]
        if k % 3 == 0:
            own = (items[k % 60][1] or "").split()
            own[len(own) // 2 : len(own) // 2 + k % 2] = ["changed"] * (k % 2)
            w[len(w) // 2 : len(w) // 2] = own
        rows.append((k, " ".join(w), "en"))
    rows += [(k, rows[3][1], "en") for k in range(200, 240)] + [(300, "TWO words", "en"), (301, None, "en"), (None, "two words", "en"), (302, "", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as d1", "2 as code", "text as hash", "'x' as item")
    table = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    pairs, left = key(D.contaminated_pairs(docs, table)), key(D.drop_contaminated(docs, table))
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert key(D.contaminated_pairs(docs, table)) == pairs and key(D.drop_contaminated(docs, table)) == left
    monkeypatch.setattr(D, "FEW_TEXTS", 0)
    assert key(D.drop_contaminated(docs, table)) == left
    assert len(pairs) > 30 and 20 < len(left) < len(rows) - 20


def test_joined_rows_grow_with_texts_and_items(spark, monkeypatch):
    """Twice the texts and twice the items: at most 2.2 times the candidates."""
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    rng = np.random.default_rng(15)
    seen = []

    class Watched(Workspace):
        def keep(self, df, name):
            out = super().keep(df, name)
            seen[-1][name] = out.count()
            return out

    text = lambda n: " ".join(f"w{rng.integers(3000)}" for _ in range(n))
    for n in (200, 400):
        items = [(k, text(20)) for k in range(n)]
        docs = [(k, text(60) + " " + items[k][1], "en") for k in range(n)]
        seen.append({})
        assert D.contaminated_pairs(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), work=Watched(spark)).count() == n
    assert all(seen[1][k] <= 2.2 * seen[0][k] for k in seen[0])


# --- op6


def lattice(word, table):
    """Sum over all segmentations, the plain way."""
    text = b" " + word
    alpha = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        alpha[j] = sum(alpha[i] * table.get(text[i:j], 0.0) for i in range(j))
    return alpha[-1]


def test_lattice_against_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bca", b" ab", b"cabab", "é".encode(), b"caba"]
    p = rng.random(len(pieces))
    p /= p.sum()
    v = Vocabulary(pieces, np.log(p))
    words_ = [bytes(rng.choice(list(b"abc\xc3\xa9"), int(rng.integers(1, 14))).tolist()) for _ in range(300)]
    got, use = v.marginals(np.frombuffer(b"".join(words_), np.uint8), np.array([len(w) for w in words_]), counts=np.ones(300), limit=64)
    table = dict(zip(pieces, p, strict=True))
    assert np.allclose(got, [math.log(lattice(w, table)) for w in words_])
    # expected uses cover every byte once, the marks too
    assert (use * [len(x) for x in pieces]).sum() == pytest.approx(sum(len(w) + 1 for w in words_))


def test_scores_against_plain_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{int(rng.zipf(1.4)) % 3000}" for _ in range(int(rng.integers(0, 120)))).upper() if k % 2 else " ".join(f"w{int(rng.zipf(1.4)) % 3000}" for _ in range(40)), "en") for k in range(300)]
    monkeypatch.setattr(M, "HEAD", 500)  # so that both ways of counting are used
    monkeypatch.setattr(M, "DOCS_PER_BUCKET", 16)
    out = {r.doc_id: r for r in M.score_texts(spark.createDataFrame(rows, SCHEMA), fold() == 1, rounds=1).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _, _ in rows}
    tokens = {k: [*words(t), None] for k, t, _ in rows}
    c = Counter(x for k in tokens if not held[k] for x in tokens[k])
    n, v = sum(c.values()), len(c)
    assert len(out) == 300
    for k, t in tokens.items():
        r = out[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)
    again = {r.doc_id: r.score for r in M.score_texts(spark.createDataFrame([(7, "W1 w2", "en"), (8, "w1", "en"), (9, "", "en"), (10, "w2 ", "en")], SCHEMA), F.lit(True)).collect()}
    assert again[7] == pytest.approx(again[8] + again[10] - again[9])


def test_lm_on_odd_inputs(spark):
    out = M.score_texts(odd(spark), fold() == 1).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[4].n_tokens == 30_001
    assert by[1].score == by[2].score
    nothing = M.score_texts(odd(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert M.score_texts(empty(spark), fold() == 1).count() == 0


def test_lm_score_against_all_segmentations(spark, tmp_path):
    """rounds=0 uses a unigram model's own scores unchanged: score is the plain lattice sum over the words and the end."""
    import sentencepiece

    rng = np.random.default_rng(3)
    rows = [(k, " ".join("".join(rng.choice(list("abc"), int(rng.integers(1, 7)))) for _ in range(int(rng.integers(0, 9)))), "en") for k in range(40)]
    pieces = [b" a", b"ab", b"abc", b"bca", b" ab", b"ca", *(bytes([b]) for b in range(256))]
    p = rng.random(len(pieces))
    p /= p.sum()

    class Model:
        """A unigram model with the pieces above, as the loader sees one."""

        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return len(pieces)

        def is_control(self, i):
            return False

        is_unknown = is_unused = is_control

        def is_byte(self, i):
            return len(pieces[i]) == 1

        def id_to_piece(self, i):
            return f"<0x{pieces[i][0]:02X}>" if self.is_byte(i) else pieces[i].decode().replace(" ", "\u2581")

        def get_score(self, i):
            return math.log(p[i])

    held = sentencepiece.SentencePieceProcessor
    sentencepiece.SentencePieceProcessor = Model
    try:
        own = Vocabulary.load("any")
        out = M.score_texts(spark.createDataFrame(rows, SCHEMA), F.lit(False), vocabulary="any", rounds=0).collect()
    finally:
        sentencepiece.SentencePieceProcessor = held
    # single bytes come as pieces of the loader's own, all at one score under the least
    assert np.exp(own.log_p).sum() == pytest.approx(1)
    ratio = np.exp(own.log_p[:6]) / p[:6]
    assert ratio == pytest.approx(np.full(6, ratio[0]))
    table = {x: w for x, w in zip([b" a", b"ab", b"abc", b"bca", b" ab", b"ca"], np.exp(own.log_p[:6]), strict=True)} | {bytes([b]): w for b, w in zip(range(256), np.exp(own.log_p[6:]), strict=True)}
    end = math.log10(1e-3)
    keep = 1 - 1e-3
    scaled = {x: w * keep for x, w in table.items()}
    assert {r.doc_id: r.score for r in out} == pytest.approx({k: end + sum(math.log10(lattice(w.encode(), scaled)) for w in t.split()) for k, t, _ in rows})


def test_lm_rows_grow_with_the_texts(spark, monkeypatch):
    """Twice the texts, chunks and packed rows give at most 2.2 times the rows that travel."""
    monkeypatch.setattr(M, "HEAD", 200)
    monkeypatch.setattr(M, "DOCS_PER_BUCKET", 4)
    rng = np.random.default_rng(8)
    seen = []

    class Watched(Workspace):
        def keep(self, df, name):
            out = super().keep(df, name)
            seen[-1][name] = seen[-1].get(name, 0) + out.count()
            return out

    for n in (400, 800):
        rows = [(k, " ".join(f"w{int(rng.zipf(1.3)) % 4000}" for _ in range(40)), "en") for k in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(n // 25)
        seen.append({})
        assert M.score_texts(docs, fold() == 1, rounds=0, work=Watched(spark)).count() == n
    assert seen[0]["requests"] >= 16 and seen[0]["words"] >= 64
    for name in ("words", "requests", "answers"):
        assert seen[1][name] <= 2.2 * seen[0][name], name


def test_lm_takes_a_text_of_one_huge_word(spark):
    rows = [(1, "ab" * 60_000, "en"), (2, "ab", "en")]
    out = {r.doc_id: r for r in M.score_texts(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()}
    assert out[1].n_tokens == 2 and out[1].n_known == 2 and out[1].score < out[2].score < 0


# --- op7


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(1200):
        bad = rng.random() < 0.2
        w = [f"w{rng.integers(400)}" for _ in range(60)]
        rows.append((k, " ".join(x.upper() + "!!" if bad and rng.random() < 0.5 else x for x in w), "en"))
        labels.append((k, int(not bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    out = C.score_quality(docs, table, fold() != 0).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    good, bad = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.98 and all(r.predicted == int(r.score >= 0.3) for r in out)
    # held-out labels don't matter
    flipped = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels], "doc_id long, quality int")
    assert {(r.doc_id, r.score) for r in C.score_quality(docs, flipped, fold() != 0).collect()} == {(r.doc_id, r.score) for r in out}


def test_classifier_on_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.score_quality(odd(spark), none, fold() != 0).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (5, 1), (5, 0)], "doc_id long, quality int")
    out = C.score_quality(odd(spark), some, fold() != 0).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert C.score_quality(empty(spark), some, fold() != 0).count() == 0


def plain_features(text):
    """bucket -> value, word by word with whole-number arithmetic."""
    m64 = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    def constant(k, seed):
        return mix((k + 1) * 0x9E3779B97F4A7C15 + seed & m64) | 1

    def word_hash(data, lower):
        power, total = 1, 0
        for byte in data:
            total += constant(byte + 32 if lower and 0x41 <= byte <= 0x5A else byte, 11) * power
            power = power * 0x5851F42D4C957F2D & m64
        return mix(total + len(data) & m64)

    def run(hashes, n):
        return [mix(sum(h * constant(k, 23) for k, h in enumerate(hashes[i : i + n])) & m64) for i in range(len(hashes) - n + 1)]

    def shape(data):
        own = [1 if 0x61 <= b < 0x7B or b >= 0x80 else 2 if 0x41 <= b < 0x5B else 3 if 0x30 <= b < 0x3A else b for b in data]
        return bytes(b for i, b in enumerate(own) if not i or b != own[i - 1])

    data = [w.encode() for w in re.findall("[^ \t-\r]+", text or "")]
    w = [word_hash(x, True) for x in data]
    s = [0x5A4E if i and w[i] == w[i - 1] else word_hash(shape(x), False) for i, x in enumerate(data)]
    found = Counter(g & C.BUCKETS - 1 for g in [*w, *(g ^ 0x11 for g in run(w, 2)), *(mix(x) ^ 0x21 for x in s), *(g ^ 0x22 for g in run(s, 2)), *(g ^ 0x23 for g in run(s, 3))])
    size = math.sqrt(sum(math.log1p(c) ** 2 for c in found.values()))
    return {b: math.log1p(c) / size for b, c in found.items()}


def test_features_and_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(12)
    parts = ["Alpha", "beta", "beta", "x1!", "ÉÀ", "\n", "\t", "42", "$$$", "Zz9"]
    texts = [" ".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(60)] + [None, "", "one", "A " * 40]
    rows = [(k % 3 > 0, b, v) for k, b, v in C.features(pa.array(texts, pa.string()))]
    assert [dict(zip(b.tolist(), v, strict=True)) for _, b, v in rows] == [pytest.approx(plain_features(t), abs=1e-12) for t in texts]

    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 1e-3
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(b):
        if abs(z.get(b, 0.0)) <= l1:
            return 0.0
        return -(z[b] - math.copysign(l1, z[b])) / ((beta + math.sqrt(n[b])) / alpha + l2)

    for _ in range(2):
        for label, bucket, value in rows:
            own = {b: weight(b) for b in bucket.tolist()}
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
            p = 1 / (1 + math.exp(-(bias + sum(own[b] * v for b, v in zip(bucket.tolist(), value, strict=True)))))
            for b, v in zip(bucket.tolist(), value, strict=True):
                g, old = (p - label) * v, n.get(b, 0.0)
                z[b] = z.get(b, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * own[b]
                n[b] = old + g * g
            g = p - label
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
    weights, bias = C.ftrl(rows)
    assert bias == pytest.approx(-bz / ((beta + math.sqrt(bn)) / alpha), abs=1e-9)
    assert {b: weights[b] for b in z} == pytest.approx({b: weight(b) for b in z}, abs=1e-9)
    assert np.count_nonzero(weights) == sum(weight(b) != 0 for b in z) > 20


def test_classifier_sample_is_bounded_and_counts_copies_once(spark):
    rows = [(k, f"text number {k} " * 20, "en") for k in range(2000)] + [(5, "text number 5 " * 20, "en")] * 1500
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), "text")
    known = spark.createDataFrame([(k, k % 2) for k in range(4000)], "id long, label int")
    everything = C.sample(docs, known, 10_000, 1 << 30, Workspace(spark)).collect()
    assert len(everything) == 2000
    some = C.sample(docs, known, 300, 1 << 30, Workspace(spark)).collect()
    assert 200 < len(some) < 400 and {tuple(r) for r in some} <= {tuple(r) for r in everything}
    small = C.sample(docs, known, 10_000, 30_000, Workspace(spark)).collect()
    assert 0 < sum(len(r.text) for r in small) < 45_000


# --- op9


def test_language_on_held_out_rows(spark):
    rng = np.random.default_rng(8)
    parts = {"aa": "the ing th er of".split(), "bb": "ung sch ein ä ü".split(), "cc": "ción que ado ñ los".split()}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(20)), lang if k % 10 else None) for k in range(600) for lang in [list(parts)[k % 3]]]
    out = G.predict_language(spark.createDataFrame(rows, SCHEMA), fold() != 0).collect()
    truth = {k: list(parts)[k % 3] for k in range(600)}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_on_odd_inputs(spark):
    out = {r.doc_id: r for r in G.predict_language(odd(spark), F.lit(True)).collect()}
    assert {out[k].lang_pred for k in (1, 2, 3)} == {"und"} and out[4].lang_pred == "fr"
    assert {r.lang_pred for r in G.predict_language(odd(spark), F.lit(False)).collect()} == {"und"}
    assert G.predict_language(empty(spark), fold() != 0).count() == 0
    one = spark.createDataFrame([(1, "12 34 !", "en"), (2, "Ωmega", "el")], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in G.predict_language(one, F.lit(True)).collect()} == {1: "und", 2: "el"}


def test_sample_is_bounded_and_fixed(spark):
    rows = [(k, f"word{k} text", "en" if k % 2 else "de") for k in range(3000)]
    held = spark.createDataFrame(rows, SCHEMA).selectExpr("lang", "text", "doc_id as key")
    a, b = G.train(held, max_rows=200), G.train(held, max_rows=200)
    assert a[0] == b[0] == ["de", "en"] and np.array_equal(a[1], b[1])
    assert hashlib.md5(a[1].tobytes()).hexdigest() != hashlib.md5(G.train(held, max_rows=5000)[1].tobytes()).hexdigest()


def plain_grams(text):
    """bucket -> count, character by character; None without a letter."""
    code, letters = [32], 0
    for c in (text or "").lower():
        if c.isalpha():
            code.append(ord(c))
            letters += 1
        elif code[-1] != 32:
            code.append(32)
    if code[-1] != 32:
        code.append(32)
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            h = n * 0x2545F491 & 0xFFFFFFFF
            for x in code[i : i + n]:
                h = (h ^ x) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            found[h & G.BUCKETS - 1] += 1
    return found if letters else None


@pytest.mark.parametrize("chars", [7, 64, 1 << 19])
def test_grams_against_plain_ones(monkeypatch, chars):
    monkeypatch.setattr(G, "CHARS", chars)
    monkeypatch.setattr(G, "LONG", 30)
    rng = np.random.default_rng(7)
    parts = ["a", "B", "é", "Ω", "  ", " ", ".", "12", "ß", "\n", "日", "😀", "ab", "İ"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 60)))) for _ in range(120)] + [None, "", "  ", "1 2", "x" * 500, " x" * 200]
    got = {}
    for rows, offsets, buckets, counts in G.counted(pa.array(texts, pa.string())):
        for k, a, b in zip(rows.tolist(), offsets[:-1], offsets[1:], strict=True):
            assert k not in got
            got[k] = dict(zip(buckets[a:b].tolist(), counts[a:b].tolist(), strict=True))
    assert got == {k: dict(g) for k, t in enumerate(texts) if (g := plain_grams(t))}


def test_language_against_plain_bayes(spark):
    rng = np.random.default_rng(18)
    rows = [(k, "".join(rng.choice(list("abcdé  ."), 40, p=w / w.sum())), f"l{k % 5}") for k in range(150) for w in [np.roll(np.arange(1, 9), k % 5).astype(float)]]
    rows += [(200, None, "l0"), (201, "42", "l1"), (202, "abc", None)]
    sums = {}
    for _, t, lang in rows:
        if lang and (g := plain_grams(t)):
            sums.setdefault(lang, Counter()).update(g)
    size = {x: sum(c.values()) + 0.5 * G.BUCKETS for x, c in sums.items()}
    out = {r.doc_id: r for r in G.predict_language(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect()}
    for k, t, _ in rows:
        g = plain_grams(t)
        if g is None:
            assert (out[k].lang_pred, out[k].score) == ("und", 0.0)
            continue
        log = {x: sum(n * math.log((sums[x][b] + 0.5) / size[x]) for b, n in g.items()) for x in sums}
        top = max(log.values())
        assert log[out[k].lang_pred] == pytest.approx(top, abs=1e-4)
        assert out[k].score == pytest.approx(1 / sum(math.exp((v - top) / math.sqrt(sum(g.values()))) for v in log.values()), abs=1e-4)


def test_any_number_of_languages_and_ties(spark):
    """600 languages take two blocks; a rare one is learned beside a frequent one; of equal languages the first by name wins."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26] + letters[k % 7]
    rows = [(k, f"{word(k)} " * 6, f"x{k:03d}") for k in range(600)] + [(1000 + k, f"{word(3)} " * 6, "x003") for k in range(2000)]
    rows += [(5000, "öö öö", "same1"), (5001, "öö öö", "same0"), (5002, "öö", None)]
    out = {r.doc_id: r for r in G.predict_language(spark.createDataFrame(rows, SCHEMA), F.lit(True), max_rows=700).collect()}
    assert len(out) == len(rows)
    assert np.mean([out[k].lang_pred == f"x{k:03d}" for k in range(600)]) > 0.99
    assert {out[k].lang_pred for k in (5000, 5001, 5002)} == {"same0"} and all(0 < r.score <= 1 for r in out.values())
