"""Secret scans over an incremental blob ledger; DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.
Only pairs of blob and rule version that the ledger lacks are scanned, one text
a blob; findings are joined back to all paths that hold the blob.  Copies of a
text are reduced to one in the map tasks, so a text crosses the network about
once; everything else that is shuffled is a digest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .work import Workspace


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression without empty matches; least: the fewest characters that `group` of a match needs to count."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


#: A bounded repeat stands for "drop shorter matches" where that can't move later matches.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<rule:int,start:bigint,end:bigint>"
#: Matches whose ends are summed in one run.
RUN = 256
#: Blobs of 32 bytes that are broadcast at most.
FEW_BLOBS = 10_000


def _lengths(rule: Rule, wanted: Column, text: Column) -> Column:
    """(gaps, hits, counts): lengths of the pieces between the leftmost matches without overlap, of the matches, and whether each match counts; null without a match."""
    pattern = F.lit(rule.pattern)
    sizes = lambda c: F.transform(c, lambda x: F.length(x))
    counts = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least) if rule.least else F.lit(None).cast("array<boolean>")
    found = F.struct(sizes(F.split(text, rule.pattern, -1)).alias("gaps"), sizes(F.regexp_extract_all(text, pattern, F.lit(0))).alias("hits"), counts.alias("counts"))
    return F.when(wanted & text.rlike(rule.pattern), found)


def _spans(index: int, found: Column, filtered: bool) -> Column:
    """Spans of a rule's matches in code points, end exclusive, from a column of _lengths.

    Ends are running sums.  An array that grows is copied at each step, so sums
    are taken over runs of RUN matches and the runs are joined.
    """
    none, runs = F.array().cast("array<bigint>"), F.array().cast("array<array<bigint>>")
    n = F.size(found["hits"])
    last = lambda c: F.try_element_at(c, F.lit(-1))

    def run(out: Column, start: Column) -> Column:
        step = lambda acc, i: F.concat(acc, F.array(F.coalesce(last(acc), last(last(out)), F.lit(0).cast("bigint")) + F.get(found["gaps"], i) + F.get(found["hits"], i)))
        return F.concat(out, F.array(F.aggregate(F.sequence(start, F.least(start + RUN, n) - 1), none, step)))

    ends = F.flatten(F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(RUN)), runs, run))
    spans = F.zip_with(ends, found["hits"], lambda e, h: F.struct(F.lit(index).alias("rule"), (e - h).alias("start"), e.alias("end")))
    if filtered:
        spans = F.filter(spans, lambda s, i: F.get(found["counts"], i))
    return F.when(found.isNotNull(), spans.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows) for versions(path, text).

    findings(path, blob, spans): one row for every row of versions; spans has
    (rule, start, end) of every match of every rule, sorted by start, then by the
    rule's place in `rules`.  ledger rows(blob, rule, version, spans): the pairs
    scanned by this call, also those without a match, to append to the ledger
    that the next call gets; a ledger has a pair at most once.  A changed rule
    has another version, so its old pairs are scanned again and the old
    findings are not used.

    Defined cases: a null text is empty; a null path is a path like others;
    repeated rows each give a row and are scanned once; a text may have any
    number of matches; no versions give no rows.  Other columns are ignored.
    """
    spark = versions.sparkSession
    work = work or Workspace(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = versions.select("path", text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = work.keep(held.select("path", "blob"), "paths")
    every = F.array(*(F.lit(k) for k in range(len(rules))))
    index = F.lit(None).cast("int")
    for k, rule in enumerate(rules):
        index = F.when((F.col("rule") == rule.name) & (F.col("version") == rule.version), k).otherwise(index)
    one = F.first("text").alias("text")
    if ledger is None:
        known = None
        texts = held.groupBy("blob").agg(one).withColumn("todo", every)
    else:
        known = ledger.withColumn("index", index).filter("index is not null").select("blob", "index", "spans")
        done = known.groupBy("blob").agg(F.collect_set("index").alias("done"))
        todo = F.array_except(every, F.coalesce("done", F.array().cast("array<int>")))
        unseen = work.keep(paths.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).filter("size(todo) > 0"), "unseen")
        if unseen.count() <= FEW_BLOBS:  # texts that are known stay where they are
            texts = held.join(F.broadcast(unseen.select("blob")), "blob", "left_semi").groupBy("blob").agg(one).join(unseen, "blob")
        else:
            texts = held.groupBy("blob").agg(one).join(unseen, "blob")
    lengths = [_lengths(rule, F.array_contains("todo", k), F.col("text")).alias(f"r{k}") for k, rule in enumerate(rules)]
    scanned = work.keep(texts.select("blob", "todo", *lengths), "scanned")
    scanned = scanned.select("blob", "todo", F.concat(*(_spans(k, F.col(f"r{k}"), rule.least > 0) for k, rule in enumerate(rules))).alias("spans"))

    none = F.array().cast(f"array<{SPAN}>")
    fresh = scanned.select("blob", "spans")
    if known is not None:
        fresh = fresh.union(known.select("blob", "spans")).filter("size(spans) > 0").groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # by start, then rule
    ordered = F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rule"].alias("rule"), s["end"].alias("end")))), lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    fresh = fresh.filter("size(spans) > 0").select("blob", ordered.alias("spans"))
    findings = paths.join(fresh, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))

    names, marks = F.array(*(F.lit(r.name) for r in rules)), F.array(*(F.lit(r.version) for r in rules))
    rows = scanned.select("blob", "spans", F.explode("todo").alias("index"))
    rows = rows.select("blob", F.get(names, F.col("index")).alias("rule"), F.get(marks, F.col("index")).alias("version"), F.filter("spans", lambda s: s["rule"] == F.col("index")).alias("spans"))
    return findings, rows


def scan_in_increments(versions: DataFrame, increments: int = 2, rules: tuple[Rule, ...] = RULES, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) of scan_versions over all of versions(path, text), an increment after the other.

    Paths are dealt to increments by a hash; each increment scans only the pairs
    of blob and rule version that the ledger of those before it lacks, and its
    own are written to the ledger before the next.  The rows are those of one
    call of scan_versions, in all cases that it defines.
    """
    work = work or Workspace(versions.sparkSession)
    findings = ledger = None
    for k in range(increments):
        part, rows = scan_versions(versions.filter(F.pmod(F.xxhash64("path"), F.lit(increments)) == k), ledger, rules, work)
        rows = work.keep(rows, "ledger")
        findings, ledger = (part, rows) if ledger is None else (findings.union(part), ledger.union(rows))
    return findings, ledger


def span_text(spans: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
