"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .mixing import MARGINS

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def shingles(table: str, key: str) -> str:
    """(key, g): distinct 5-word shingles; the whole sequence where there are fewer words."""
    return f"""SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN ['= ' || array_to_string(w, ' ')] ELSE [] END) AS g
  FROM (SELECT {key}, {WORDS.format(LOWER)} AS w FROM {table}))"""


NEAR_DEDUP = f"""WITH RECURSIVE s AS MATERIALIZED ({shingles('documents', 'doc_id')}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, walk.r FROM walk JOIN e ON e.a = walk.v),
m AS (SELECT v, min(r) AS component_id FROM walk GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

DECONTAMINATION = f"""WITH q AS MATERIALIZED ({shingles('benchmark', 'item_id')}), d AS MATERIALIZED ({shingles('documents', 'doc_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN q USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_common FROM c JOIN n USING (item_id) WHERE 5 * n_common >= 4 * n_item"""

LINE_DEDUP = """WITH p AS MATERIALIZED (SELECT doc_id, source AS h, text, md5(text) AS page FROM documents WHERE text IS NOT NULL),
t AS (SELECT h, count(DISTINCT page) AS total FROM p GROUP BY 1),
l AS MATERIALIZED (SELECT doc_id, h, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM p),
b AS (SELECT h, line FROM (SELECT h, line, count(DISTINCT page) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2) JOIN t USING (h) WHERE n >= 5 AND n > CAST(0.02 AS DOUBLE) * total),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS clean FROM l LEFT JOIN b ON b.h = l.h AND b.line = l.line GROUP BY 1)
SELECT doc_id, n_lines, n_dropped, md5(clean) AS text_md5 FROM k"""


def mixing(sweeps: int = 10, temper: float = 0.5, share: float = 0.5) -> str:
    """Raking as a chain of window sums."""
    marks = "length(regexp_replace(text, '[^|<>{}#*$%&_=\\[\\]]', '', 'g'))"
    topic = f"CASE WHEN {marks} * 50 > length(text) THEN 'markup' WHEN length(text) < 1000 THEN 'note' WHEN length(text) < 4000 THEN 'article' ELSE 'long' END"
    steps = [f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, len({WORDS.format('text')}) AS n_tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))"]
    steps.append("c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0)")
    for m in MARGINS:
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, power(s, {temper}) / sum(power(s, {temper})) OVER () AS target FROM (SELECT {m}, sum(tokens) AS s FROM c GROUP BY 1))")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w FROM c)")
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * target / sum(w) OVER (PARTITION BY {m}) AS w FROM w{k} JOIN t_{m} USING ({m}))")
            k += 1
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(w, tokens / ({share} * (SELECT sum(tokens) FROM c))) AS w FROM w{k})")
        k += 1
    steps.append(f"r AS (SELECT source, lang, topic, round(w, 8) AS weight, round(least(1.0, {share} * (SELECT sum(tokens) FROM c) * w / tokens), 9) AS p FROM w{k})")
    u = "CAST(('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    p = "CASE WHEN n_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, coalesce(weight, 0.0) AS weight, round({p}, 6) AS prob, {u} < {p} AS kept FROM d LEFT JOIN r USING (source, lang, topic)"


ORACLES = {"op1_minhash_near_dedup": NEAR_DEDUP, "op3_benchmark_decontamination": DECONTAMINATION, "op4_source_mixing": mixing(), "op5_line_dedup": LINE_DEDUP}
