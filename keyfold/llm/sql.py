"""DuckDB SQL for the opN_ queries that SQL can express."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), k AS (
  SELECT norm, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN k USING (norm)
"""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), windows AS (
  SELECT r, i, words[i:i + 7] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY r
), c AS (
  SELECT w.r, doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.r = w.r
), f AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines) AS failed,
    CASE WHEN regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1) <> ''
      THEN lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) ELSE source END AS host
  FROM c
), hosts AS (
  SELECT host, count(*) AS n, sum(failed::INT) AS bad FROM f GROUP BY host
), fit AS (
  SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS mean, coalesce(var_samp(bad / n), 0) AS var, avg(1 / n) AS inv FROM hosts
), prior AS (
  SELECT mean, CASE WHEN var - mean * (1 - mean) * inv <= 0 THEN 1000.0
    ELSE least(1000.0, greatest(2.0, mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1)) END AS weight FROM fit
), verdicts AS (
  SELECT host, (bad + mean * weight) / (n + weight) AS rate, (bad + mean * weight) / (n + weight) > 0.5 AS blocked FROM hosts, prior
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND NOT blocked) AS kept, f.host, round(rate, 6) AS host_rate
FROM f JOIN verdicts ON f.host IS NOT DISTINCT FROM verdicts.host
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(r, o) AS (
  SELECT DISTINCT a, a FROM both_ways UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.o
), least AS (
  SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most, 3 * source_size / ((rank - 1) % 3 + 1) AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, rank, source_size, CASE WHEN level > ratio THEN most::DOUBLE ELSE max(CASE WHEN level <= ratio THEN level END) OVER () * weight END AS target FROM l
), q AS (
  SELECT d.*, rank, source_size, target, row_number() OVER () AS r, sum(size) OVER (PARTITION BY rank ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT r, rank, cum, size, e, (cum + e * source_size)::DOUBLE / target AS f FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0
), taken AS (
  SELECT r, run <= (SELECT sum(size) FROM d) AS taken
  FROM (SELECT *, sum(size) OVER (ORDER BY f, rank, cum, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
), n AS (
  SELECT r, count(*) AS copies FROM taken WHERE taken GROUP BY r
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken,
  CASE WHEN size > 0 THEN cum::DOUBLE / target END AS finish
FROM q LEFT JOIN n USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2, "op3_host_rules": OP3, "op4_forest_near_dedup": OP4, "op8_fair_mixing": OP8}
