"""DuckDB SQL for the operators that SQL can express, computed the plain way.

Operator 7 counts shared shingles of all pairs and walks the links; it shares
nothing with the MinHash method. Operators 2 (trained character models), 3 and
9 (tokenizers), 5, 6 (trained models) and 8 (approximate) have no SQL; tests
compare them with brute force.
"""

from __future__ import annotations

from . import fingerprints, licenses, merkle, mixing, negatives, substrings
from .common import UPPER

LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

_TEMPLATES = ", ".join(
    f"({t}, '{label}', {str(base).lower()}, {size}, {place}, '{gram}')" for t, label, base, size, place, gram in licenses.templates()
)

LICENSES = f"""
WITH templates(template, label, base, size, place, gram) AS (VALUES {_TEMPLATES}),
texts AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text,
    regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS (
  SELECT doc_id, text, i, array_to_string(w[i + 1:i + k], ' ') AS gram
  FROM (SELECT doc_id, text, w, k, unnest(range(len(w) - k + 1)) AS i
        FROM texts, (SELECT unnest([{licenses.PHRASE_K}, {licenses.LICENSE_K}]) AS k))),
votes AS (
  SELECT doc_id, text, template, label, base, size, place, i, i - place AS diagonal,
    greatest({licenses.LEAST_SHIFT}, size // 5) AS step FROM grams JOIN templates USING (gram)),
phrases AS (
  SELECT doc_id, text, label, diagonal AS start, 1.0::DOUBLE AS cover FROM votes WHERE base
  GROUP BY doc_id, text, template, label, size, diagonal HAVING count(DISTINCT place) = size - {licenses.PHRASE_K - 1}),
-- the votes of a window of diagonals; every word of a license counts once, however many places hold it
windows AS (SELECT DISTINCT *, floor(diagonal / step) - unnest([0, 1]) AS win FROM votes WHERE NOT base),
covered AS (
  SELECT doc_id, text, template, label, size, win, count(DISTINCT word) / size AS cover
  FROM (SELECT *, unnest(range(place, place + {licenses.LICENSE_K})) AS word FROM windows)
  GROUP BY doc_id, text, template, label, size, win),
kept AS (
  SELECT doc_id, text, label, true AS base, start, cover FROM phrases
  UNION ALL SELECT doc_id, text, label, false, NULL, cover FROM covered WHERE cover >= {licenses.COVER})
SELECT t.doc_id, len(any_value(t.w))::BIGINT AS n_words,
  count(*) FILTER (WHERE base)::BIGINT AS n_base,
  (min(start) FILTER (WHERE base))::BIGINT AS first_word,
  (max(start) FILTER (WHERE base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(cover), 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN kept k ON t.doc_id IS NOT DISTINCT FROM k.doc_id AND t.text = k.text
GROUP BY t.doc_id, t.text
"""


def _entry(v: str, at: int) -> str:
    return f"(({v} >> {at}) & 1048575)"


_DIFFERENCES = ", ".join(f"((({_entry('a.v', at)} - {_entry('b.v', at)}) + 524288) & 1048575) - 524288 AS d{at}" for at in (0, 21, 42))

FINGERPRINTS = f"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS r, doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (
  SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS next_text,
    coalesce(lead(r) OVER (ORDER BY r), 1) AS next_r FROM docs),
texts AS (
  SELECT r, 0 AS kind, text FROM nexts
  UNION ALL SELECT r, 1, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) FROM nexts),
parts AS (
  SELECT r, kind, md5(unnest(string_split(regexp_replace(text, '([.!?] )', '\\1' || chr(10), 'g'), chr(10)))) AS h FROM texts),
words AS (
  SELECT r, kind, half, ('0x' || substr(h, 1 + 16 * half, 16))::UBIGINT AS w FROM parts, (SELECT unnest([0, 1]) AS half)),
vectors AS (
  SELECT r, kind, half * 21 + j AS place, sum((w >> j) & {fingerprints.ONES}::UBIGINT)::BIGINT & {fingerprints.KEEP} AS v
  FROM words, (SELECT unnest(range(21))::UBIGINT AS j) GROUP BY r, kind, half, j),
counts AS (SELECT r, kind, count(*)::BIGINT AS v FROM parts GROUP BY r, kind),
strings AS (
  SELECT r, kind, string_agg(lower(hex(v)), '.' ORDER BY place) AS fingerprint
  FROM (SELECT * FROM vectors UNION ALL SELECT r, kind, 42, v FROM counts) GROUP BY r, kind),
pairs AS (
  SELECT r, 1 AS what, r AS a, 0 AS ak, r AS b, 1 AS bk FROM nexts UNION ALL SELECT r, 2, r, 0, next_r, 0 FROM nexts),
differ AS (
  SELECT p.r, p.what, sum(d0 + d21 + d42)::DOUBLE AS s, sum(d0 * d0 + d21 * d21 + d42 * d42)::DOUBLE AS q, any_value(ca.v + cb.v) AS n
  FROM (SELECT p.r, p.what, p.a, p.ak, p.b, p.bk, {_DIFFERENCES}
        FROM pairs p JOIN vectors a ON a.r = p.a AND a.kind = p.ak JOIN vectors b ON b.r = p.b AND b.kind = p.bk AND b.place = a.place) p
  JOIN counts ca ON ca.r = p.a AND ca.kind = p.ak JOIN counts cb ON cb.r = p.b AND cb.kind = p.bk
  GROUP BY p.r, p.what),
near AS (SELECT r, what, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 4 * (126 * q - s * s) / (126.0::DOUBLE * 125) / n::DOUBLE)) AS likeness FROM differ)
SELECT x.doc_id, x.n::BIGINT AS n_chars, sha256(e.text) AS edited_sha256, f.fingerprint, g.fingerprint AS edited_fingerprint,
  n1.likeness AS near_edited, n2.likeness AS near_next
FROM nexts x JOIN texts e ON e.r = x.r AND e.kind = 1 JOIN strings f ON f.r = x.r AND f.kind = 0 JOIN strings g ON g.r = x.r AND g.kind = 1
JOIN near n1 ON n1.r = x.r AND n1.what = 1 JOIN near n2 ON n2.r = x.r AND n2.what = 2
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM texts),
sizes AS (SELECT t.doc_id, count(s.doc_id) AS n FROM texts t LEFT JOIN shingles s USING (doc_id) GROUP BY t.doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM texts UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('line:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS line FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, sum(source_size) OVER ()::DOUBLE AS total FROM sums),
weighed AS (SELECT *, ({list(mixing.WEIGHTS)})[(nth % {len(mixing.WEIGHTS)} + 1)::INT] AS weight, ({mixing.CAP} * source_size)::DOUBLE AS cap FROM named),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
fitting AS (SELECT arg_min(level, (cap / weight, nth)) AS level FROM levels WHERE level * weight <= cap),
goals AS (
  SELECT l.source, l.source_size, least(cap, coalesce(f.level * weight, cap)) AS target FROM levels l, fitting f),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.line, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (SELECT sum(greatest(0, least(size, round(target)::BIGINT - start - p * source_size))) FROM (SELECT unnest(range({mixing.CAP})) AS p))::BIGINT AS taken
FROM placed
"""

_W = substrings.WINDOW

SUBSTRINGS = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, md5(array_to_string(w[i + 1:i + {_W}], ' ')) AS h FROM (SELECT r, w, unnest(range(len(w) - {_W - 1})) AS i FROM texts)),
repeated AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
marked AS (
  SELECT w.r, w.i, word, max(p.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW) IS NULL AS keep
  FROM words w LEFT JOIN repeated p ON p.r = w.r AND p.i = w.i),
kept AS (
  SELECT r, count(*) FILTER (WHERE NOT keep) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE keep) AS text FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept k USING (r)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in merkle.FIELDS)
# crc32 bit by bit; doc_id in decimal is ASCII
_CRC = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, c:
  list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT)"""

MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({_LEAF}) AS leaf,
    CASE WHEN doc_id IS NULL THEN false ELSE xor({_CRC}, 4294967295) % 2 = 0 END AS tampered,
    sha256({_LEAF.replace("text", "replace(text, chr(10), '')")}) AS other FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows),
lower_tree(source, level, i, digest, n) AS (
  SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM numbered
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM lower_tree WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM lower_tree WHERE n = 1),
upper_tree(level, i, digest, n) AS (
  SELECT 0, s, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 2) // 3) FROM upper_tree WHERE n > 1 GROUP BY level, i // 3),
top AS (SELECT digest AS root, level AS height FROM upper_tree WHERE n = 1),
steps AS (
  SELECT l.r, t.level AS step,
    string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i < l.i // pow(3, t.level)::BIGINT) AS before,
    string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i > l.i // pow(3, t.level)::BIGINT) AS after
  FROM numbered l JOIN lower_tree t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1
    AND t.i // 3 = l.i // pow(3, t.level + 1)::BIGINT GROUP BY l.r, t.level
  UNION ALL
  SELECT l.r, s.height + t.level,
    string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i < s.s // pow(3, t.level)::BIGINT),
    string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i > s.s // pow(3, t.level)::BIGINT)
  FROM numbered l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN upper_tree t ON t.n > 1 AND t.i // 3 = s.s // pow(3, t.level + 1)::BIGINT GROUP BY l.r, s.height, t.level),
proofs AS (
  SELECT r, string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step) AS siblings, count(*) AS n FROM steps GROUP BY r),
folds(r, step, digest) AS (
  SELECT r, 0, CASE WHEN tampered THEN other ELSE leaf END FROM numbered
  UNION ALL
  SELECT f.r, f.step + 1, sha256(coalesce(before, '') || digest || coalesce(after, '')) FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM numbered l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN top
LEFT JOIN proofs p ON p.r = l.r JOIN folds f ON f.r = l.r AND f.step = coalesce(p.n, 0)
"""

NEGATIVES = f"""
WITH scaled AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT a, b, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {negatives.POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same
  AND 100 * n.score BETWEEN {negatives.LOW} * p.score AND {negatives.HIGH} * p.score
QUALIFY rank <= {negatives.NEGATIVES}
"""

ORACLE_SQL = {
    "op1_license_scan": LICENSES,
    "op4_multiset_fingerprint": FINGERPRINTS,
    "op7_tensored_minhash": NEAR_DUPLICATES,
    "op10_curriculum_mix": MIX,
    "op11_substring_dedup": SUBSTRINGS,
    "op12_merkle_manifest": MERKLE,
    "op13_kronecker_negatives": NEGATIVES,
}
