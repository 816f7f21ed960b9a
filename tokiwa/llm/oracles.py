"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from tokiwa.llm.divergence import COMMON_WORDS

OP9 = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS total, count(*)::DOUBLE AS sources FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE * (1.0::DOUBLE / sources) * total / size ELSE 0.0::DOUBLE END AS rate FROM sizes, totals
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate)) + 20
), drawn AS (
  SELECT d.doc_id, d.source, ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || md5(coalesce(d.text, '')) || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d
), numbered AS (
  SELECT w.doc_id, count(*) AS n FROM drawn w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.c <= w.u GROUP BY w.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, g.copy::INTEGER AS copy,
       md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || md5(coalesce(d.text, '')) || '|' || g.copy || '|order') AS shuffle_key
FROM documents d JOIN numbered n ON d.doc_id = n.doc_id, LATERAL (SELECT unnest(range(1, n.n + 1)) AS copy) g
"""

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def spans(kind: str, rank: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """Spans of a pattern: gaps and matches in turn, their lengths summed up."""
    return f"""{kind}_parts AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals FROM texts WHERE regexp_matches(t, '{pattern}')),
{kind}_rows AS (SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit, vals[i] AS val FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {kind}_parts)),
{kind} AS (SELECT doc_id, s::BIGINT AS s, {rank} AS r, (s + length(hit))::BIGINT AS e, '{kind}' AS k, hit AS v FROM (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS s FROM {kind}_rows) WHERE length(val) >= {least})"""


OP7 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{spans("assign", 0, ASSIGN, 2, 6)},
{spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)},
{spans("hex", 2, "[0-9a-f]{24,}", 0, 24)},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
{spans("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", 0, 20)},
suspects AS (
  SELECT *, row_number() OVER () AS c, CASE WHEN hexed THEN 16 ELSE 20 END AS w, CASE WHEN hexed THEN 3.0 WHEN plain THEN 3.6 ELSE 3.8 END AS bits FROM (
    SELECT *, regexp_full_match(v, '[0-9a-fA-F]+') AS hexed, regexp_full_match(v, '[0-9A-Za-z]+') AS plain FROM entropy) found
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, CASE WHEN hexed THEN '[a-fA-F]' ELSE '[A-Za-z]' END)
    AND NOT regexp_full_match(v, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')
    AND NOT regexp_full_match(v, '[A-Z]?[a-z]+([_/-][A-Z]?[a-z]+)*[_/-]?[0-9]{{1,4}}') AND replace(v, left(v, 1), '') <> ''
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = found.doc_id AND b.s < found.e AND found.s < b.e)),
windows AS (SELECT c, w, i, substr(v, i, w) AS win FROM (SELECT *, unnest(range(1, length(v) - w + 2)) AS i FROM suspects)),
counted AS (SELECT c, w, i, ch, count(*) AS n FROM (SELECT c, w, i, unnest(string_split(win, '')) AS ch FROM windows) GROUP BY ALL),
measured AS (SELECT c, max(h) AS most FROM (SELECT c, i, -sum((n / w) * log2(n / w)) AS h FROM counted GROUP BY c, i) GROUP BY c),
every AS (SELECT doc_id, s, r, e, k FROM base UNION ALL SELECT doc_id, s, r, e, k FROM suspects JOIN measured USING (c) WHERE round(most, 9) >= bits)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex,
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (k <> 'entropy') AS b, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS a FROM every GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""

COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON_WORDS))
COUNTS = {
    "lower": "[a-z]", "blank": r"[\x20\x09-\x0D]", "upper": "[A-Z]", "letter": r"[\p{L}\p{M}]", "digit": "[0-9]", "stop": r"""[.,;:!?''"()-]""", "symbol": r"[#*$%&|<>@^~_=+/\\{}\[\]`]",
}
NAMES = [*COUNTS, "rest"]
TERM = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"

OP5 = f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM texts))),
threes AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM threes WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS spot FROM twice) GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
repeated AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
peeled AS (SELECT doc_id, lang, length(t) AS n, length(t) - length(replace(replace(replace(replace(replace(replace(replace(replace(t, '#', ''), '*', ''), '$', ''), '%', ''), '&', ''), '|', ''), '<', ''), '>', '')) AS n_symbols,
  {", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS c_{n}" for n, p in COUNTS.items())} FROM texts),
chars AS (SELECT doc_id, lang, n, n_symbols, c_lower AS lower, c_blank AS blank, c_upper AS upper, c_letter - c_lower - c_upper AS letter, c_digit AS digit, c_stop AS stop, c_symbol AS symbol, n - c_blank - c_letter - c_digit - c_stop - c_symbol AS rest FROM peeled),
ref_chars AS (SELECT lang, sum(n) AS n, {", ".join(f"sum({n}) AS r_{n}" for n in NAMES)} FROM chars GROUP BY lang),
common AS (SELECT doc_id, lower(w) AS w, count(*) AS n FROM words WHERE lower(w) IN ({COMMON}) GROUP BY ALL),
lang_words AS (SELECT t.lang, sum(coalesce(n_words, 0)) AS n FROM texts t LEFT JOIN totals o ON t.doc_id = o.doc_id GROUP BY t.lang),
ref_words AS (SELECT t.lang, c.w, sum(c.n) / any_value(l.n) AS q FROM common c JOIN texts t ON c.doc_id = t.doc_id JOIN lang_words l ON t.lang IS NOT DISTINCT FROM l.lang GROUP BY t.lang, c.w),
ref_all AS (SELECT lang, sum(q) AS q FROM ref_words GROUP BY lang),
own AS (SELECT c.doc_id, sum(c.n / o.n_words) AS p, sum(r.q) AS q, sum({TERM.format(p="(c.n / o.n_words)", q="r.q")}) AS t
  FROM common c JOIN totals o ON c.doc_id = o.doc_id JOIN texts x ON c.doc_id = x.doc_id JOIN ref_words r ON r.w = c.w AND r.lang IS NOT DISTINCT FROM x.lang GROUP BY c.doc_id),
joined AS (SELECT h.doc_id, h.n, h.n_symbols, coalesce(o.n_words, 0) AS n_words, coalesce(o.word_chars, 0) AS word_chars, coalesce(v.n, 0) AS n_repeat_words, coalesce(d.n, 0) AS n_dup_lines,
    CASE WHEN h.n > 0 THEN sqrt(greatest(({" + ".join(TERM.format(p=f"(h.{n} / h.n)", q=f"(f.r_{n} / f.n)") for n in NAMES)}) / 2, 0)) END AS cd,
    coalesce(w.p, 0.0) AS p, coalesce(w.q, 0.0) AS q, coalesce(w.t, 0.0) AS tt, coalesce(a.q, 0.0) AS aq
  FROM chars h JOIN ref_chars f ON h.lang IS NOT DISTINCT FROM f.lang LEFT JOIN totals o ON h.doc_id = o.doc_id LEFT JOIN covered v ON h.doc_id = v.doc_id LEFT JOIN repeated d ON h.doc_id = d.doc_id
  LEFT JOIN own w ON h.doc_id = w.doc_id LEFT JOIN ref_all a ON h.lang IS NOT DISTINCT FROM a.lang),
judged AS (SELECT *, CASE WHEN n_words > 0 THEN sqrt(greatest((tt + aq - q + {TERM.format(p="(1 - p)", q="(1 - aq)")}) / 2, 0)) END AS wd, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM joined)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND (n < 200 OR round(cd, 9) <= 0.25) AND round(wd, 9) <= 0.28 + 1.2 * greatest(1 / sqrt(n_words) - 1 / sqrt(120), 0) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM judged
"""

ORACLES = {"op5_divergence": OP5, "op7_secrets": OP7, "op9_mixing": OP9}
