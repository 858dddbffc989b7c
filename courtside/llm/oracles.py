"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LATIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, text: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words(_LATIN, _FOLD.format("text"))} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, w, least(10, len(w)) AS k FROM
      (SELECT item_id, {_words(_LATIN, _FOLD.format("text"))} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
places AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM
           (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins))),
hits AS (SELECT doc_id, i, k, item FROM places JOIN wins USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HOST = _FOLD.format("regexp_extract(url, '://([^/?#]*)', 1)")


def url_rules(rules: tuple) -> str:
    """Each address against each rule."""
    return f"""
WITH u AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, action) AS (VALUES {", ".join(map(str, rules))}),
best AS (SELECT host, path, rule_host || rule_path AS rule, action FROM (SELECT DISTINCT host, path FROM u)
         JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
         QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN best USING (host, path)
"""


EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_words(_WORD, "text")} AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
again AS (SELECT doc_id, i FROM wins QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM again)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS text FROM
         (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, len({_words(_WORD, "text")}) AS size, cast('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) AS draw FROM documents),
src AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
        FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source_size, source) AS place FROM src),
levels AS (SELECT place, weight, source_size, cast(sum(source_size) OVER () - (sum(3 * source_size) OVER (ORDER BY place) - 3 * source_size) AS DOUBLE)
           / cast(sum(weight) OVER (ORDER BY place DESC) AS DOUBLE) AS level FROM ranked),
final AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight < 3 * source_size),
aims AS (SELECT source, source_size, least(cast(3 * source_size AS DOUBLE), coalesce(level * weight, 0)) AS target FROM src, final),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aims),
placed AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
           coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN rest > 0 AND ahead + size / 2 <= rest THEN 1 ELSE 0 END) * size AS taken FROM placed
"""

#: All pairs that share a shingle, and every node reachable.
NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_WORD, _FOLD.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - 3) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * n_both >= 80 * (nx.n + ny.n - n_both)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN n USING (doc_id)
"""


def _centroids(k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid; a round is two tables: assignments, then centroids."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    tables = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS n, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        tables.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, min(struct_pack(far := {far}, n := c.n)) AS best FROM v, c{r} c GROUP BY vec_id, v.x)")
        if r < rounds:
            tables.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT n, list(part ORDER BY i) AS x FROM (SELECT best.n AS n, i,"
                f" (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS part FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY n) m USING (n))")
    return (f"WITH {', '.join(tables)} SELECT vec_id, cast(best.n AS INTEGER) AS cluster, cast(best.far AS BIGINT) AS distance,"
            " cast(sum(best.far) OVER (PARTITION BY best.n) AS BIGINT) AS cluster_inertia, cast(sum(best.far) OVER () AS BIGINT) AS inertia,"
            f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.n = best.n")


CENTROIDS = _centroids()

_FIELD = "coalesce(strlen(cast({0} AS VARCHAR)) || ':' || {0}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Level by level; the siblings of each leaf are looked up one by one, and its claim is folded step by step.
MANIFEST = f"""
WITH RECURSIVE bits(b, k, z) AS (SELECT b, 0, cast(b AS UBIGINT) FROM range(256) t(b) UNION ALL
  SELECT b, k + 1, xor(z >> 1, CASE WHEN z & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) FROM bits WHERE k < 8),
steps AS (SELECT b, z FROM bits WHERE k = 8),
crc(doc_id, i, h) AS (SELECT DISTINCT doc_id, 1, 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL
  SELECT doc_id, i + 1, xor(h >> 8, z) FROM crc JOIN steps ON b = xor(h, ascii(substr(cast(doc_id AS VARCHAR), i, 1))::UBIGINT) & 255 WHERE i <= length(cast(doc_id AS VARCHAR))),
sums AS (SELECT doc_id, xor(h, 4294967295::UBIGINT) AS crc FROM crc WHERE i = length(cast(doc_id AS VARCHAR)) + 1),
leaves AS MATERIALIZED (SELECT doc_id, lang, leaf, claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM
  (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claim FROM documents LEFT JOIN sums USING (doc_id))),
low(lang, level, pos, size, h) AS (SELECT lang, 0, pos, size, leaf FROM leaves UNION ALL
  SELECT lang, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY lang, level, pos // 2, size),
tops AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
high(level, pos, size, h) AS (SELECT 0, pos, size, h FROM tops UNION ALL
  SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY level, pos // 2, size),
sizes AS (SELECT DISTINCT lang, level, size, 0 AS part FROM low WHERE size > 1 UNION ALL SELECT DISTINCT t.lang, high.level, high.size, 1 FROM tops t, high WHERE high.size > 1),
ways AS (SELECT l.lang, l.pos, row_number() OVER (PARTITION BY l.lang, l.pos ORDER BY part, level) AS k, part, level, (CASE part WHEN 0 THEN l.pos ELSE t.pos END) >> level AS at
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN sizes s ON s.lang IS NOT DISTINCT FROM l.lang),
beside AS MATERIALIZED (SELECT w.lang, w.pos, w.k, w.at, coalesce(a.h, b.h) AS h FROM ways w
  LEFT JOIN low a ON w.part = 0 AND a.lang IS NOT DISTINCT FROM w.lang AND a.level = w.level AND a.pos = xor(w.at, 1)
  LEFT JOIN high b ON w.part = 1 AND b.level = w.level AND b.pos = xor(w.at, 1)),
fold(lang, pos, k, h) AS (SELECT lang, pos, 1, claim FROM leaves UNION ALL
  SELECT f.lang, f.pos, f.k + 1, sha256(CASE WHEN b.at % 2 = 1 THEN b.h || f.h ELSE f.h || coalesce(b.h, '') END)
  FROM fold f JOIN beside b ON b.lang IS NOT DISTINCT FROM f.lang AND b.pos = f.pos AND b.k = f.k),
last AS (SELECT lang, pos, arg_max(h, k) AS folded FROM fold GROUP BY lang, pos),
proofs AS (SELECT lang, pos, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof FROM beside GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, z.folded AS folded_root, z.folded = r.h AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN last z ON z.lang IS NOT DISTINCT FROM l.lang AND z.pos = l.pos
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos, (SELECT h FROM high WHERE size = 1) r
"""
