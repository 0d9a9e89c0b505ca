"""SQL of the corpus queries, for the small tables it is compared on."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOW)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS doc_id, y AS r FROM edge UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r),
comp AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r, w.doc_id)) AS component_id, w.doc_id <= coalesce(r, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM t WHERE len(h) >= 400)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS k FROM win) WHERE k > 1),
edge AS (SELECT doc_id, i, i - coalesce(max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS gap FROM hit),
run AS (SELECT doc_id, i, sum((gap > 0 OR i = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY doc_id, g),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS gone FROM span GROUP BY 1)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN a IS NULL THEN h ELSE substr(h, 1, 2 * a[1]) || array_to_string(list_transform(range(1, len(a) + 1), lambda k: substr(h, 2 * z[k] + 1, 2 * (coalesce(a[k + 1], len(h) // 2) - z[k]))), '') END)) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM late),
word AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def quality_rules(cutoffs: dict[str, list[float]], bands: tuple[int, ...], risk: float, delta: float) -> str:
    """Base columns, statistics, and the thresholds by exact binomial tails (logarithms of factorials)."""
    level = delta / (len(cutoffs) * len(bands))
    stratum = "CASE " + " ".join(f"WHEN n_words >= {b} THEN {k}" for k, b in reversed(list(enumerate(bands)))) + " END"
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS step, {c}::DOUBLE AS cut" for r, cs in cutoffs.items() for k, c in enumerate(cs))
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS x FROM good" for r in cutoffs)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}::DOUBLE) + (n - i) * ln(1 - {risk}::DOUBLE))))"
    above = " OR ".join(f"coalesce({r} > (SELECT min(cut) FROM chosen c WHERE c.stratum = stat.stratum AND c.rule = '{r}'), FALSE)" for r in cutoffs)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1) GROUP BY 1),
base AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
stat AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {stratum} AS stratum, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length FROM base),
good AS (SELECT * FROM stat WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
grid AS ({grid}), long AS ({long}),
tried AS (SELECT stratum, rule, step, cut, count(*) AS n, count(CASE WHEN x > cut THEN 1 END) AS k FROM long JOIN grid USING (rule) GROUP BY 1, 2, 3, 4),
passed AS (SELECT *, k <= n * {risk} AND {tail} <= {level!r} AS ok FROM tried),
chosen AS (SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS going FROM passed) WHERE going)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({above}) AS kept FROM stat
"""
