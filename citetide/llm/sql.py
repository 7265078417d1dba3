"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

OP8 = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS tk, string_split(text, chr(10)) AS ls
  FROM documents),
lines AS (SELECT DISTINCT tk, line FROM (SELECT tk, unnest(ls) AS line FROM texts) WHERE trim(line, ' ') <> ''),
split AS (SELECT tk, line, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS w FROM lines),
leafed AS (SELECT tk, line, w, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM split),
leaves AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT tk) >= 10),
cand AS (SELECT * FROM leafed SEMI JOIN leaves USING (leaf)),
tokens AS (SELECT leaf, line, tk, unnest(w) AS token, unnest(range(len(w))) AS spot FROM cand),
fixed AS (SELECT leaf, spot, token FROM tokens WHERE token <> '<*>' GROUP BY ALL HAVING count(*) >= 10),
kinds AS (
  SELECT leaf, line, list(CASE WHEN f.token IS NULL THEN '<*>' ELSE token END ORDER BY spot) AS fields
  FROM (SELECT DISTINCT leaf, line, token, spot FROM tokens) t LEFT JOIN fixed f USING (leaf, spot, token)
  GROUP BY leaf, line HAVING 2 * count(f.token) >= count(*)),
recurring AS (SELECT leaf, fields FROM cand JOIN kinds USING (leaf, line) GROUP BY ALL HAVING count(DISTINCT tk) >= 10),
everywhere AS (
  SELECT line FROM kinds SEMI JOIN recurring USING (leaf, fields) UNION SELECT line FROM lines GROUP BY line HAVING count(*) >= 10),
keeper AS (SELECT line, min(tk) AS first FROM lines WHERE length(line) >= 40 GROUP BY line HAVING count(*) > 1),
gone AS (
  SELECT tk, line FROM lines SEMI JOIN everywhere USING (line)
  UNION SELECT tk, line FROM lines JOIN keeper USING (line) WHERE tk > first),
lost AS (SELECT tk, list(line) AS lost FROM gone GROUP BY tk),
kept AS (
  SELECT doc_id, text, ls, CASE WHEN lost IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(lost, x)) END AS k
  FROM texts LEFT JOIN lost USING (tk))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(k) = len(ls) THEN text ELSE coalesce(array_to_string(k, chr(10)), '') END AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(k), 0)::BIGINT AS n_dropped
FROM kept
"""

OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counts WHERE size > 1 AND f >= 30),
parts AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covers AS (
  SELECT x.lang, x.phrase FROM lowest x JOIN lowest y
  ON x.lang = y.lang AND y.size > x.size AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 80 * x.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covers USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _op13() -> str:
    """Six rounds of assigning and averaging, one pair of common tables each."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    best = f"SELECT rid, p, min({distance} * 16 + e) AS m FROM parts JOIN book{{}} USING (p) GROUP BY rid, p"
    rounds = []
    for i in range(6):
        rounds.append(f"""
near{i} AS (SELECT p, (m % 16)::BIGINT AS e, x FROM ({best.format(i)}) JOIN parts USING (rid, p)),
sums{i} AS (SELECT p, e, j, sum(x[j])::HUGEINT AS s, count(*) AS n FROM near{i}, (SELECT unnest(range(1, 9)) AS j) GROUP BY p, e, j),
means{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM sums{i} GROUP BY p, e),
book{i + 1} AS (SELECT p, e, coalesce(means{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN means{i} USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, (SELECT unnest(range(8)) AS p)),
book0 AS (
  SELECT p, e, x AS c FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (rid) WHERE e < 16),
{",".join(rounds)},
last AS ({best.format(6)}),
coded AS (
  SELECT rid, string_agg('0' || '0123456789abcdef'[(m % 16)::BIGINT + 1], '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM last GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(c[j]::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book6, (SELECT unnest(range(1, 9)) AS j)),
rows AS (SELECT vec_id, label, code, error FROM kept JOIN coded USING (rid))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, digest
"""


STATEMENTS: dict[str, str] = {"op8_log_template_lines": OP8, "op12_phrase_collocations": OP12, "op13_vector_codes": _op13()}
