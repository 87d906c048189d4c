"""The queries of this subpackage and their SQL, by name; ``__spark_entry__`` adds them to the library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op12
from .bpe import op7
from .codes import op11
from .fingerprints import op13
from .jaccard import op2
from .langid import op9
from .lines import op6
from .matroska import op5
from .mixing import LEVELS, WEIGHTS, op10
from .secrets import op4
from .substrings import op3
from .tokens_out import op8
from .vamana import op1



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: DuckDB SQL of the queries that SQL expresses.
WORDS_SQL = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

SUBSTRING_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i FROM d),
h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
rep AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM rep),
cut AS (SELECT r, list(i) AS cut FROM gone GROUP BY r),
kept AS (SELECT d.r, d.doc_id, len(w) AS n, coalesce(len(cut), 0) AS x,
  CASE WHEN cut IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(cut, i))) END AS k FROM d LEFT JOIN cut USING (r))
SELECT doc_id, n::BIGINT AS n_words, x::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

JACCARD_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM t),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * x >= 90 * (na + nb - x)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, min(r.b))::BIGINT AS component_id FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s)
"""


def _case(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if level in WEIGHTS else "1"


def _level_sql(i: int) -> str:
    """The shares of one level of the tree, as common table expressions n0..n2 over the level above."""
    names, up = ", ".join(LEVELS[: i + 1]), LEVELS[:i]
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    parent = f"JOIN n{i - 1} USING ({', '.join(up)})" if up else "CROSS JOIN (SELECT least(sum(tokens) * 3 // 5, sum(cap)) AS share FROM leaf)"
    budget = f"n{i - 1}.share" if up else "share"
    return f"""c{i} AS (SELECT {names}, sum(cap)::HUGEINT AS cap, ({_case(LEVELS[i])})::HUGEINT AS weight FROM leaf GROUP BY {names}),
b{i} AS (SELECT c{i}.*, ({budget})::HUGEINT AS budget FROM c{i} {parent}),
o{i} AS (SELECT *, budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw
  FROM b{i} WINDOW w AS ({part} ORDER BY cap::DOUBLE / weight::DOUBLE, {LEVELS[i]})),
f{i} AS (SELECT *, cap * lw <= weight * lb AS is_full FROM o{i}),
n{i} AS (SELECT {names}, CASE WHEN is_full THEN cap ELSE weight * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (w), 0))
  // greatest(coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (w), 0), 1) END AS share FROM f{i} WINDOW w AS ({part}))"""


MIX_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, len({WORDS_SQL})::BIGINT AS n_tokens FROM documents),
t AS (SELECT 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain, * FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS cap FROM t GROUP BY ALL),
{', '.join(_level_sql(i) for i in range(3))},
plan AS (SELECT leaf.*, share, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs FROM leaf JOIN n2 USING (domain, lang, source)),
k AS (SELECT t.*, epochs, share - epochs * tokens AS rest, md5('17:' || epochs || ':' || doc_id) AS place FROM t JOIN plan USING (domain, lang, source)),
c AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, domain, lang, source, n_tokens, 1::BIGINT AS n_rows, copies::BIGINT AS copies FROM c WHERE copies > 0
"""



def _round_sql(i: int) -> str:
    """Assignment i of the parts to the entries, and the entries that follow from it."""
    return f"""a{i} AS MATERIALIZED (SELECT q.r, p, any_value(q.x) AS x, min(struct_pack(d := list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c{i}.x[i]) * (q.x[i] - c{i}.x[i]))), e := e)) AS best
  FROM q JOIN c{i} USING (p) GROUP BY q.r, p),
m{i} AS (SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM a{i}) GROUP BY p, e, i),
n{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{i} GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.e, coalesce(n{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN n{i} ON c{i}.p = n{i}.p AND c{i}.e = n{i}.e)"""


CODES_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, ints[p * len(ints) // 16 + 1 : (p + 1) * len(ints) // 16] AS x FROM v, range(16) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM q WHERE r <= 64),
{_round_sql(0)},
{_round_sql(1)},
a2 AS MATERIALIZED (SELECT q.r, p, min(struct_pack(d := list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c2.x[i]) * (q.x[i] - c2.x[i]))), e := e)) AS best FROM q JOIN c2 USING (p) GROUP BY q.r, p),
k AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN k USING (r), b
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vamana_search": op1,
    "op2_ngram_jaccard": op2,
    "op3_substring_dedup": op3,
    "op4_secret_scan": op4,
    "op5_media_matroska": op5,
    "op6_line_dedup": op6,
    "op7_bpe_automaton": op7,
    "op8_token_parquet": op8,
    "op9_language_id": op9,
    "op10_source_mix": op10,
    "op11_hamerly_codes": op11,
    "op12_token_alignment": op12,
    "op13_minhash_fingerprints": op13,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op2_ngram_jaccard": JACCARD_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op10_source_mix": MIX_SQL, "op11_hamerly_codes": CODES_SQL}
