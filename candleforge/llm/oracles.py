"""DuckDB SQL of the training-data queries that SQL expresses."""

from __future__ import annotations

from candleforge.llm import quality

SPACE = r"[\x20\x09-\x0D]+"
#: Words of a text.
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> '')"

#: Letters A-Z only are lowered, as translate does.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{SPACE}'), lambda w: w <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
 c AS (SELECT any_value(s) AS s, min(doc_id) AS class, hash(list_sort(s)) AS h FROM s WHERE len(s) > 0 GROUP BY list_sort(s)), e AS (SELECT class, len(s) AS n, unnest(s) AS x FROM c),
 f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1), g AS (SELECT class, n, x FROM e SEMI JOIN f USING (x)),
 l AS (SELECT a.class AS a, b.class AS b FROM g a JOIN g b ON a.x = b.x AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT class AS node, class AS root FROM c UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node WHERE r.root < b.b),
 k AS (SELECT node, min(root) AS root FROM r GROUP BY 1), m AS (SELECT s.doc_id, k.root FROM s JOIN c ON list_sort(s.s) = list_sort(c.s) JOIN k ON k.node = c.class)
 SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept FROM s LEFT JOIN m ON m.doc_id = s.doc_id"""

#: Five hexadecimal digits are four letters.
_BASE32 = """array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || d[5 * k + 1:5 * k + 5] AS BIGINT) >> s) % 32 + 1]), '')), '')"""

OP5 = f"""SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
 FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)"""

_RATES = {
    "symbol_rate": "n_symbols / greatest(n_words, 1)", "capital_rate": "capitals / greatest(word_chars, 1)", "shout_rate": "shouts / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)", "word_length": "word_chars / greatest(n_words, 1)",
}


def _count(chars: str) -> str:
    return f"length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{chars}]', '', 'g'))"


def _fence(m: str) -> str:
    """Within the fences of the group that is large enough; sketches of up to SKETCH_K rows give exact quantiles."""
    level = lambda q: f"CASE WHEN n_own >= {quality.LEAST_ROWS} THEN {m}_{q}_own WHEN n_lang >= {quality.LEAST_ROWS} THEN {m}_{q}_lang ELSE {m}_{q}_every END"
    least, lower = quality.MEASURES[m]
    spread = f"greatest(({level('high')}) - ({level('low')}), {least})"
    return f"{m} <= ({level('high')}) + 3 * {spread}" + (f" AND {m} >= ({level('low')}) - 3 * {spread}" if lower else "")


_LEVELS = {"own": "lang, source", "lang": "lang", "every": ""}
_QUANTILES = {k: ", ".join([f"count(*) AS n_{k}", *[f"quantile_disc({m}, {q}) AS {m}_{n}_{k}" for m in _RATES for n, q in (("low", 0.25), ("high", 0.75))]]) for k in _LEVELS}

OP8 = f"""WITH a AS (SELECT doc_id, lang, source, text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS lines FROM documents),
 i AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM a WHERE len(w) > 5),
 t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM i) WHERE k > 1), u AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM t) GROUP BY 1),
 b AS (SELECT a.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST({_count("#*$%&|<>")} AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, {_count("A-Z")} AS capitals, {_count("!")} AS shouts, coalesce(n_repeat_words, 0) AS n_repeat_words FROM a LEFT JOIN u ON u.doc_id = a.doc_id),
 c AS (SELECT *, {", ".join(f"{x} AS {m}" for m, x in _RATES.items())}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
 o AS (SELECT lang, source, {_QUANTILES["own"]} FROM c GROUP BY 1, 2), l AS (SELECT lang, {_QUANTILES["lang"]} FROM c GROUP BY 1), e AS (SELECT {_QUANTILES["every"]} FROM c)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(_fence(m) for m in _RATES)} AS kept
 FROM c JOIN o ON c.lang IS NOT DISTINCT FROM o.lang AND c.source IS NOT DISTINCT FROM o.source JOIN l ON c.lang IS NOT DISTINCT FROM l.lang, e"""
