"""SQL over the given tables for the operators that SQL can express in reasonable time."""

from __future__ import annotations

from .license_scan import BASE, COVER, NOTICES, SLACK, templates
from .quality_rules import MAX_RATE, RULES, SPREADS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"


def license_sql() -> str:
    found = templates(BASE, NOTICES)
    grams = ", ".join(f"({i}, {b}, '{label}', {len(w) - 1}, {p}, '{w[p]} {w[p + 1]}')" for i, b, label, w in found for p in range(len(w) - 1))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
grams(tpl, is_base, label, n_grams, tpos, gram) AS (VALUES {grams}),
pairs AS (SELECT rid, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram, unnest(range(0, len(ws) - 1)) AS pos FROM docs WHERE len(ws) > 1),
diagonals AS (SELECT rid, tpl, is_base, label, n_grams, pos - tpos AS diagonal, bit_or(1::BIGINT << tpos) AS votes, min(pos) AS begins, max(pos) AS ends
  FROM pairs JOIN grams USING (gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN is_base OR diagonal - lag(diagonal) OVER w > {SLACK} OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS apart
  FROM diagonals WINDOW w AS (PARTITION BY rid, tpl ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY rid, tpl ORDER BY diagonal) AS span FROM marked),
spans AS (SELECT rid, tpl, is_base, label, n_grams, span, min(diagonal) AS diagonal, bit_count(bit_or(votes)) AS votes, max(ends) - min(begins) AS width FROM numbered GROUP BY ALL),
judged AS (SELECT *, is_base AND votes = n_grams AS whole, width <= 1.5 * n_grams AS fits FROM spans),
found AS (SELECT rid, count(*) FILTER (whole) AS n_base, min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word,
  list(DISTINCT label) FILTER (whole) AS base_labels, list(DISTINCT label) FILTER (whole OR (NOT is_base AND fits AND votes * 1.0 / n_grams >= {COVER})) AS labels,
  max(votes::DOUBLE / n_grams) FILTER (fits) AS score FROM judged GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(labels), ','), '') AS labels,
  round(coalesce(score, 0.0), 6) AS score
FROM docs LEFT JOIN found USING (rid)"""


def quality_sql() -> str:
    flags = ", ".join(f"({rule}) AS failed_{r}" for r, rule in RULES.items())
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS ls FROM documents),
tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS w FROM docs WHERE len(ws) > 2),
twice AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM tri) AS x WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY rid),
measured AS (SELECT doc_id, source, md5(t) AS digest, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (rid)),
failing AS (SELECT *, {flags} FROM measured),
texts AS (SELECT source, digest, {", ".join(f"max({r}::INT) AS {r}" for r in RULES)} FROM (SELECT source, digest, {", ".join(f"failed_{r} AS {r}" for r in RULES)} FROM failing) AS x GROUP BY ALL),
counted AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum({r})::DOUBLE AS {r}" for r in RULES)} FROM texts GROUP BY source),
hosts AS (UNPIVOT counted ON {", ".join(RULES)} INTO NAME rule VALUE f),
prior AS (SELECT rule, m, greatest(m * (1 - m) / greatest(v, 1e-9) - 1, 2.0) AS s FROM (SELECT rule, least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS m, var_pop(f / n) AS v FROM hosts GROUP BY rule) AS x),
fitted AS (SELECT source, f + m * s AS a, n - f + (1 - m) * s AS b FROM hosts JOIN prior USING (rule)),
verdicts AS (SELECT source, bool_or(a / (a + b) - {SPREADS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {MAX_RATE}) AS rejected FROM fitted GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_base AS base_failed, NOT failed_base AND NOT coalesce(rejected, FALSE) AS kept
FROM failing LEFT JOIN verdicts ON failing.source IS NOT DISTINCT FROM verdicts.source"""


def jaccard_sql() -> str:
    return rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS ws FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM docs),
tokens AS (SELECT rid, len(s) AS n, hash(x) AS x FROM (SELECT rid, s, unnest(s) AS x FROM sets) AS u),
links AS (SELECT a.rid AS a, b.rid AS b FROM tokens a JOIN tokens b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(doc_id) AS low FROM reach JOIN docs ON docs.rid = reach.b GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM sets LEFT JOIN least_id ON least_id.a = sets.rid"""


def jaccard_links_sql() -> str:
    """The groups of ``jaccard_sql`` with the smallest id of equal sets and the number of linked documents."""
    head, tail = jaccard_sql().split("SELECT doc_id, len(s)::BIGINT")
    return rf"""{head.rstrip()},
classes AS (SELECT rid, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM sets WHERE len(s) > 0),
counted AS (SELECT a AS rid, count(*) AS c FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(c, 0)::BIGINT AS n_links, len(s)::BIGINT{tail}
LEFT JOIN classes USING (rid) LEFT JOIN counted USING (rid)"""


def trie_sql(group: int = 5, modulus: int = 9) -> str:
    """Nodes as groups of equal lists of turn digests; subtree sums by joining every node with all its prefixes."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, z: xor(p >> 1, 3988292384 * (p & 1)))"
    codes = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {step}), 4294967295)"
    return f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS bytes,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL
), seqs AS (
  SELECT conv_id, list({{'k': digest, 'b': bytes}} ORDER BY turn NULLS FIRST, digest) AS own, CAST({crc} % {modulus} AS BIGINT) AS h FROM turns GROUP BY conv_id
), built AS (
  SELECT s.conv_id, list_concat(coalesce(list_slice(b.own, 1, s.h), []), list_slice(s.own, s.h + 1, len(s.own))) AS seq
  FROM seqs s LEFT JOIN seqs b ON b.conv_id = s.conv_id - s.conv_id % {group}
), rows AS (
  SELECT conv_id, CAST(d AS BIGINT) AS depth, list_transform(list_slice(seq, 1, d), lambda x: x.k) AS path, CASE WHEN d = 0 THEN 0 ELSE seq[d].b END AS bytes, d = len(seq) AS last
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM built)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM rows GROUP BY path, depth
), links AS (
  SELECT p.path, count(*) AS n_children FROM nodes c JOIN nodes p ON c.depth > 0 AND p.path = list_slice(c.path, 1, c.depth - 1) GROUP BY p.path
), flat AS (
  SELECT n.*, coalesce(l.n_children, 0) AS n_children FROM nodes n LEFT JOIN links l USING (path)
), up AS (
  SELECT list_slice(path, 1, d) AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS d FROM flat) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM flat f JOIN up u ON u.path = f.path LEFT JOIN nodes p ON f.depth > 0 AND p.path = list_slice(f.path, 1, f.depth - 1)
"""


def clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """Rounds as a chain of tables; distances by inner products of whole numbers, exact in double precision."""
    near = "min({'d': v.sq - 2 * list_inner_product(v.x, c.x) + c.sq, 'c': c.c})"
    out = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, x, list_inner_product(x, x) AS sq
  FROM (SELECT vec_id, list_transform(embedding, lambda a: floor({scale} * CAST(a AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda a: a IS NOT NULL AND isfinite(a))) = {dims})
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), x) - 1 AS c, x, sq FROM (SELECT * FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('{salt}' || vec_id), x LIMIT {k})
)"""
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.rid, {near} AS m FROM v, c{r} c GROUP BY v.rid)")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(g.x, c.x) AS x, list_inner_product(coalesce(g.x, c.x), coalesce(g.x, c.x)) AS sq FROM c{r} c LEFT JOIN (
    SELECT c, list(floor(s / n) ORDER BY j) AS x FROM (
      SELECT a.m.c AS c, j, sum(v.x[j]) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid), range(1, {dims + 1}) t(j) GROUP BY a.m.c, j) GROUP BY c) g ON g.c = c.c
)""")
    return "WITH " + ", ".join(out) + f"""
SELECT v.vec_id, CAST(a.m.c AS INTEGER) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.c = a.m.c
"""
