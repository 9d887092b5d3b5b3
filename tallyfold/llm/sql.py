"""Registered queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from .quality_rules import CLASS_LIMIT, CLASS_MIN_CHARS, COMMON_LIMIT, COMMON_MIN_WORDS, COMMON_WORDS, MIN_WORDS, MOST_REPEATED, N_COMMON, _forms

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Fixed value: the base32 alphabet.
OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
  array_to_string(list_transform(string_split(sha1(h), ''), lambda x: bin(16 + ('0x' || x)::INT)[2:]), '') AS bits FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1]), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""

OP8 = f"""
WITH sizes AS (
  SELECT doc_id, source, size, length(bin(size)) AS pref, md5('mix-1:' || key) AS h, key
  FROM (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS key FROM documents)),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source),
caps AS (SELECT *, ([5.0, 2.0, 1.0])[rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
chosen AS (SELECT *, (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE level <= ratio) AS l FROM levels),
targets AS (SELECT source, source_size, coalesce(least(cap, weight * l), cap) AS target FROM chosen),
classes AS (
  SELECT t.*, pref, n, 2.0::DOUBLE / pref AS ratio, 2.0::DOUBLE * n AS cap, pref::DOUBLE * n AS weight
  FROM (SELECT source AS s, pref, sum(size)::BIGINT AS n FROM sizes GROUP BY ALL) JOIN targets t ON s IS NOT DISTINCT FROM t.source),
steps AS (
  SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY ratio, pref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(sum(weight) OVER (PARTITION BY source ORDER BY ratio, pref ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM classes),
solved AS (SELECT *, arg_min(level, (ratio, pref)) FILTER (WHERE level <= ratio) OVER (PARTITION BY source) AS l FROM steps),
copies AS (SELECT *, CASE WHEN source_size > 0 THEN coalesce(least(2.0::DOUBLE, l * pref), 2.0::DOUBLE) ELSE 0 END AS c FROM solved),
plan AS (SELECT source, pref, source_size, target, floor(c)::INT AS certain, c - floor(c) AS rest, target - sum(floor(c) * n) OVER (PARTITION BY source) AS wanted FROM copies),
odds AS (SELECT *, (('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM sizes),
ranked AS (SELECT o.doc_id, o.key, o.size, p.source, p.source_size, p.target, p.certain, p.rest, p.wanted, CASE WHEN rest > 0 THEN (u / (1 - u)) / (rest / (1 - rest)) END AS q
  FROM odds o JOIN plan p ON o.source IS NOT DISTINCT FROM p.source AND o.pref = p.pref),
summed AS (SELECT *, coalesce(sum(CASE WHEN rest > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT doc_id, size, source_size, target, (size * (certain + CASE WHEN rest > 0 AND before + size / 2.0 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

def _op5() -> str:
    """Long form of the quality rules: one row per document and histogram place."""
    forms = ", ".join(f"('{lang}', {i}, '{form.decode()}')" for lang, words in COMMON_WORDS.items() for i, w in enumerate(words.split()) for form in _forms(w))
    # The character classes as patterns, in the order of CLASSES.
    patterns = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\x20\x09-\x0D", r".,;:?''\"()\-", r"!#$%&*+/<=>@\[\\\]^_`{|}~"]
    classes = ", ".join(f"length(regexp_replace(t, '[^{x}]', '', 'g'))" for x in patterns)

    def limit(pair: tuple[float, float], n: str) -> str:
        return f"{pair[0]} + {pair[1]}::DOUBLE / sqrt({n})"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
w8 AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(ws) - 6)) AS u(i)),
twice AS (SELECT doc_id, g FROM w8 GROUP BY 1, 2 HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM w8 JOIN twice USING (doc_id, g), range(8) r(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (
  SELECT doc_id, lang, ws, length(t)::BIGINT AS chars, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, [{classes}] AS cs
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base),
forms(lang, i, form) AS (VALUES {forms}),
found AS (SELECT doc_id, f.i, count(*) AS c FROM (SELECT doc_id, lang, unnest(ws) AS w FROM judged) x JOIN forms f ON f.lang = x.lang AND f.form = x.w GROUP BY 1, 2),
common AS (
  SELECT j.doc_id, j.lang, base_failed, i, n_words AS total, coalesce(f.c, 0) AS c FROM judged j CROSS JOIN range({N_COMMON}) r(i) LEFT JOIN found f USING (doc_id, i)
  UNION ALL SELECT j.doc_id, j.lang, base_failed, {N_COMMON}, n_words, n_words - coalesce((SELECT sum(c) FROM found f WHERE f.doc_id = j.doc_id), 0) FROM judged j),
class AS (
  SELECT doc_id, lang, base_failed, i, chars AS total, CASE WHEN i < 6 THEN cs[i + 1] ELSE chars - list_sum(cs) END AS c FROM judged CROSS JOIN range(7) r(i)),
both_kinds AS (SELECT 'class' AS kind, * FROM class UNION ALL SELECT 'common', * FROM common),
refs AS (SELECT kind, lang, i, avg(c / total::DOUBLE) AS q FROM both_kinds WHERE NOT base_failed GROUP BY 1, 2, 3),
parts AS (SELECT kind, doc_id, c / total::DOUBLE AS p, q FROM both_kinds b JOIN refs r USING (kind, i) WHERE b.lang IS NOT DISTINCT FROM r.lang),
js AS (SELECT kind, doc_id, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS x FROM parts GROUP BY 1, 2)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(chars >= {CLASS_MIN_CHARS} AND a.x > {limit(CLASS_LIMIT, "chars")}, false) OR coalesce(n_words >= {COMMON_MIN_WORDS} AND b.x > {limit(COMMON_LIMIT, "n_words")}, false)) AS kept,
  round(a.x, 6) AS class_distance, round(b.x, 6) AS common_distance
FROM judged j LEFT JOIN js a ON a.doc_id = j.doc_id AND a.kind = 'class' LEFT JOIN js b ON b.doc_id = j.doc_id AND b.kind = 'common'
"""


OP12 = """
WITH RECURSIVE f AS (
  SELECT doc_id, source, unnest([text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END]) AS t, unnest([0, 1]) AS edited, lang, n_chars
  FROM (SELECT *, {crc} AS crc FROM documents)),
h AS (SELECT doc_id, source, edited, sha256(concat({fields})) AS h FROM f),
leaves AS (
  SELECT a.doc_id, a.source, a.h AS leaf, b.h AS tampered, dense_rank() OVER (ORDER BY a.source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY a.source ORDER BY a.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY a.source) AS n
  FROM h a JOIN h b ON a.doc_id = b.doc_id WHERE a.edited = 0 AND b.edited = 1),
nodes AS (
  SELECT s, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT s, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY s, lvl, pos // 3, n),
subroots AS (SELECT s, lvl AS height, h FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, s AS pos, count(*) OVER () AS n, h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
path AS (
  SELECT doc_id, l.s, lvl AS k, (l.pos // (3::BIGINT ** lvl)::BIGINT) AS spot FROM leaves l JOIN (SELECT DISTINCT s, lvl FROM nodes WHERE n > 1) x ON x.s = l.s
  UNION ALL SELECT doc_id, NULL, 1000 + lvl, (l.s // (3::BIGINT ** lvl)::BIGINT) FROM leaves l, (SELECT DISTINCT lvl FROM tops WHERE n > 1)),
every AS (SELECT s, lvl AS k, pos, h FROM nodes UNION ALL SELECT NULL, 1000 + lvl, pos, h FROM tops),
steps AS (
  SELECT doc_id, p.k, row_number() OVER (PARTITION BY doc_id ORDER BY p.k) AS i,
    coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < spot), '') AS lefts, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > spot), '') AS rights
  FROM path p JOIN every e ON e.k = p.k AND e.s IS NOT DISTINCT FROM p.s AND e.pos // 3 = p.spot // 3 GROUP BY doc_id, p.k, spot),
folded AS (
  SELECT doc_id, 0::BIGINT AS i, tampered AS h FROM leaves
  UNION ALL SELECT f.doc_id, f.i + 1, sha256(lefts || h || rights) FROM folded f JOIN steps t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
last AS (SELECT doc_id, arg_max(h, i) AS folded_root FROM folded GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(lefts || rights, '' ORDER BY i) AS proof FROM steps GROUP BY doc_id)
SELECT l.doc_id, leaf, b.h AS subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM leaves l JOIN subroots b ON b.s = l.s JOIN (SELECT h FROM tops WHERE n = 1) r ON true JOIN last USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""

# CRC-32 in SQL: eight steps of the polynomial for each digit of a doc_id.
_DIGIT = "list_reduce(list_prepend(xor(c, ascii(d)::UBIGINT), list_transform(range(8), lambda i: i::UBIGINT)), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)), lambda c, d: " + _DIGIT.replace("ascii(d)::UBIGINT", "d") + "), 4294967295::UBIGINT)"
OP12 = OP12.format(crc=_CRC, fields=", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "t")))

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(units) AS n, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT for i in range(4)] AS hs FROM d),
y AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS p, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, array_to_string(units[1:p], '') AS a, array_to_string(units[p + 1:q], '') AS b, array_to_string(units[q + 1:], '') AS c FROM y),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output FROM z),
back AS (SELECT *, string_split(output, '<M>') AS m FROM o),
parts AS (SELECT *, m[1][4:] AS head, string_split(m[1][4:], CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS hs2 FROM back)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN hs2[1] || m[2] || hs2[2] ELSE hs2[2] || m[2] || hs2[1] END) AS restored_sha256
FROM parts
"""


ORACLE_SQL = {"op4_warc_bundles": OP4, "op5_quality_divergence": _op5(), "op8_pareto_mixing": OP8, "op9_setsketch_dedup": OP9, "op12_merkle_manifest": OP12, "op13_fill_in_middle": OP13}
