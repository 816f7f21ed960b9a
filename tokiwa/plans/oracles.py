"""DuckDB SQL for the queries of `tokiwa.plans.registry`, written apart from the engine's expressions."""

from __future__ import annotations

ASCII = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)


def count_class(body: str) -> str:
    return f"length(text) - length(regexp_replace(text, '[{body}]', '', 'g'))"


# Code point ranges of the character classes.
KATAKANA, HIRAGANA, KANJI = r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}", r"\x{3040}-\x{309F}", r"\x{3005}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{F900}-\x{FAFF}\x{2F00}-\x{2FDF}"
ALPHABET, DIGIT = r"A-Za-z\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}", r"0-9\x{FF10}-\x{FF19}"
SYMBOL = r"\x{3000}-\x{3004}\x{3006}-\x{303F}\x{FF00}-\x{FF0F}\x{20}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}"
EMOJI = r"\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1FAFF}\x{1FB00}-\x{1FBFF}\x{2300}-\x{23FF}\x{25AA}-\x{25AB}\x{25B6}-\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{27BF}\x{2934}-\x{2935}\x{2B50}-\x{2B55}\x{200D}\x{FE0E}-\x{FE0F}\x{20E3}\x{E0020}-\x{E007F}"
CLASSES = {"hiragana": HIRAGANA, "katakana": KATAKANA, "kanji": KANJI, "alphabet": ALPHABET, "digit": DIGIT, "symbol": SYMBOL, "emoji": EMOJI}
ANY = "".join(CLASSES.values())

# Patterns without look-around or possessive runs; where those would matter the texts are prepared first.
D, NUM = "[0-9０-９]", "(?:[.,][0-9]|[0-9０-９])+"
URL = r"[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]*[A-Za-z0-9_~:/?#\[\]@!$&(*+;=%-]"
EMAIL = r"[A-Za-z0-9_+-](?:[A-Za-z0-9._+-]*[A-Za-z0-9_+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+(?:[A-Za-z0-9.-]*[A-Za-z0-9])"
HASHTAG, MENTION = r"[#＃][A-Za-z0-9_\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FF5E}]+", r"@[A-Za-z0-9_]+(?:\.[A-Za-z0-9.-])?"
STORAGE, PERCENTAGE, NUMBER = NUM + "[KkMmGgTt]?[Bb]", NUM + "[%％]", f"{D}+(?:-{D}+)+"
VERSION, ASCIISEQ, BOUNDARY = rf"[vV]?{D}+(?:\.{D}+)+", r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+", r"[。！？!?\n・]"
ALL = "|".join([URL, EMAIL, HASHTAG, r"@\x{1}", STORAGE, PERCENTAGE, NUMBER, VERSION, ASCIISEQ, BOUNDARY])
RUN = "[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*"
# An address whose domain ends in a point or hyphen is none at all: its @ is hidden from the pattern.
PREPARED = r"regexp_replace(text, '@([A-Za-z0-9.-]*[.-])([^A-Za-z0-9.-]|$)', chr(1) || '\1\2', 'g')"


def rows_of(kind: str, source: str, column: str, key: str, where: str = "") -> str:
    return f"""
SELECT {key}, surface, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{kind}')) AS surface FROM (SELECT {key}, {PREPARED.replace("text", column) if kind == EMAIL else column} AS {column} FROM {source}))
{where} GROUP BY ALL"""


def token_cte(source: str, key: str, name: str = "tokens") -> str:
    """name(key, token_index, surface) of every row of source, by an own search for runs over the caps.

    Such a run is parted where the sum of its pieces' costs is least, in 32 bits, the earliest last cut of equals; inside it no other choice plays a part, as only nouns can stand there. Holds for texts without kana and kanji and with
    sentences under 32 KiB, as in the driver's tables.
    """
    return rf"""
{name}_t AS (SELECT {key}, {PREPARED} AS t FROM {source}),
{name}_parted AS (SELECT {key}, string_split_regex(t, '{ALL}') AS gaps, regexp_extract_all(t, '{ALL}') AS hits FROM {name}_t),
{name}_pieces AS (SELECT {key}, i, gaps[i] AS gap, hits[i] AS hit FROM (SELECT {key}, gaps, hits, unnest(range(1, len(gaps) + 1)) AS i FROM {name}_parted)),
{name}_runs AS (
  SELECT {key}, i, j, inner_hits[j] AS run FROM (SELECT {key}, i, inner_hits, unnest(range(1, len(inner_hits) + 1)) AS j FROM (SELECT {key}, i, regexp_extract_all(gap, '{RUN}') AS inner_hits FROM {name}_pieces))
), {name}_long AS (SELECT DISTINCT run FROM {name}_runs WHERE regexp_matches(run, '[A-Za-z]{{21}}|[A-Za-z0-9]{{25}}')),
{name}_spans AS (SELECT run, s, e, substr(run, s + 1, e - s) AS part FROM (SELECT run, s, unnest(range(s + 1, least(s + 24, length(run)) + 1)) AS e FROM (SELECT run, unnest(range(length(run))) AS s FROM {name}_long))),
{name}_edges AS (
  SELECT run, s, e, CASE WHEN e - s = 1 THEN 1.5::FLOAT WHEN e - s < 8 THEN 1.2::FLOAT ELSE 0.9::FLOAT END AS c FROM {name}_spans WHERE e - s <= 20 AND regexp_matches(part, '^[A-Za-z]+$')
  UNION ALL SELECT run, s, e, 0.8::FLOAT FROM {name}_spans WHERE regexp_matches(part, '^[0-9]+$')
  UNION ALL SELECT run, s, e, 0.8::FLOAT FROM {name}_spans WHERE e = least(s + 24, length(run)) AND regexp_matches(part, '[A-Za-z]') AND regexp_matches(part, '[0-9]')
), {name}_best AS (
  SELECT run, 0 AS p, [0::FLOAT] AS costs, [0::BIGINT] AS backs FROM {name}_long
  UNION ALL SELECT run, p + 1, list_append(costs, least.t), list_append(backs, least.s) FROM (
    SELECT b.run, b.p, any_value(b.costs) AS costs, any_value(b.backs) AS backs, min({{'t': (b.costs[e.s + 1] + e.c) + 0.001::FLOAT, 's': e.s::BIGINT}}) AS least
    FROM {name}_best b JOIN {name}_edges e ON e.run = b.run AND e.e = b.p + 1 GROUP BY b.run, b.p)
), {name}_cuts AS (
  SELECT run, backs, length(run) AS e, backs[length(run) + 1] AS s FROM {name}_best WHERE p = length(run)
  UNION ALL SELECT run, backs, s, backs[s + 1] FROM {name}_cuts WHERE s > 0
), {name}_found AS (
  SELECT {key}, i, j, 0 AS k, run AS surface FROM {name}_runs ANTI JOIN {name}_long USING (run)
  UNION ALL SELECT {key}, i, j, s, substr(r.run, s + 1, e - s) FROM {name}_runs r JOIN {name}_cuts c ON r.run = c.run
  UNION ALL SELECT {key}, i, 1000000, 0, hit FROM {name}_pieces WHERE hit IS NOT NULL AND NOT regexp_matches(hit, '^{BOUNDARY}$')
), {name} AS (
  SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i, j, k) - 1)::INTEGER AS token_index, surface FROM {name}_found
)"""


TOKENS = "WITH RECURSIVE " + token_cte("documents", "doc_id")
POSTINGS = "postings AS (SELECT surface AS tag, doc_id, count(*) AS tf FROM tokens WHERE length(surface) >= 2 GROUP BY ALL)"
ENTRIES = """entries(layer, entry_id, surface, pos, lemma) AS (VALUES
 (1,0,'the','DET','the'),(1,1,'of','PARTICLE','of'),(1,2,'and','CONJ','and'),(1,3,'que','CONJ','que'),(1,4,'der','DET','der'),(2,5,'thing','NOUN','thing'),
 (2,6,'tion','SUFFIX','tion'),(2,7,'over','ADV','over'),(2,8,'the','DET','the'),(3,9,'thethe','NOUN','thethe'),(3,10,'eau','NOUN','eau'),(3,11,'ción','SUFFIX','ción'),
 (3,12,'schen','NOUN','schen'),(3,13,'and','NOUN','and'),(3,14,'idiot','NOUN','idiot'),(3,15,'and','NOUN','and'))"""
ORACLES = {
    "normalize_width": f"""SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS folded_md5,
 regexp_matches(text, '[A-Za-z0-9０-９Ａ-Ｚａ-ｚｦ-ﾟヴゔ]') AS needs FROM documents""",
    "char_type_profile": f"SELECT doc_id, {', '.join(f'{count_class(b)} AS n_{n}' for n, b in CLASSES.items())}, length(regexp_replace(text, '[{ANY}]', '', 'g')) AS n_unknown FROM documents",
    "char_type_runs": f"SELECT doc_id, len(r)::INTEGER AS n_runs, list_max(list_transform(r, lambda x: length(x)))::INTEGER AS longest FROM (SELECT doc_id, regexp_extract_all(text, '{'|'.join(f'[{b}]+' for b in CLASSES.values())}|[^{ANY}]+') AS r FROM documents)",
    "char_type_totals": f"SELECT * FROM (SELECT unnest([{', '.join(repr(n.upper()) for n in CLASSES)}, 'UNKNOWN']) AS char_class, unnest([{', '.join(f'sum({count_class(b)})' for b in CLASSES.values())}, sum(length(regexp_replace(text, '[{ANY}]', '', 'g')))])::BIGINT AS n FROM documents) WHERE n > 0",
    "utf8_offsets": "SELECT doc_id, length(text)::INTEGER AS n_chars, octet_length(encode(text))::INTEGER AS n_bytes, true AS is_valid FROM documents",
    "pretoken_url": rows_of(URL, "pages", "html", "page_id"),
    "pretoken_email": rows_of(EMAIL, "documents", "text", "doc_id"),
    "pretoken_hashtag": rows_of(HASHTAG, "pages", "html", "page_id"),
    "pretoken_mention": rows_of(MENTION, "documents", "text", "doc_id", "WHERE NOT contains(surface, '.')"),
    "pretoken_storage": rows_of(STORAGE, "documents", "text", "doc_id"),
    "pretoken_percentage": rows_of(PERCENTAGE, "documents", "text", "doc_id"),
    "pretoken_number": rows_of(NUMBER, "documents", "text", "doc_id"),
    "pretoken_version": rows_of(VERSION, "documents", "text", "doc_id"),
    "pretoken_asciiseq": rows_of(ASCIISEQ, "documents", "text", "doc_id"),
    "pretoken_tiles": f"SELECT doc_id, length(text)::INTEGER AS n_chars, length(text)::INTEGER AS covered, (length(text) - length(regexp_replace(text, '{BOUNDARY}', '', 'g')))::INTEGER AS n_boundaries FROM documents",
    "sentence_boundaries": f"SELECT doc_id, (length(text) - length(regexp_replace(text, '{BOUNDARY}', '', 'g')))::INTEGER AS n_boundaries FROM documents",
    "latin_tokens": TOKENS + " SELECT doc_id, token_index, surface FROM tokens",
    "token_freq_topk": TOKENS + " SELECT surface, count(*) AS n FROM tokens GROUP BY surface ORDER BY n DESC, surface LIMIT 100",
    "tags_noun_min2_dedup": TOKENS + ", firsts AS (SELECT doc_id, surface AS tag, min(token_index) AS f FROM tokens WHERE length(surface) >= 2 GROUP BY ALL) SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY f)::INTEGER AS tag_rank FROM firsts",
    "tags_max_n": TOKENS + ", firsts AS (SELECT doc_id, surface AS tag, min(token_index) AS f FROM tokens WHERE length(surface) >= 2 GROUP BY ALL), ranked AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS r FROM firsts) SELECT doc_id, (r - 1)::INTEGER AS place, tag, 'NOUN' AS pos FROM ranked WHERE r <= 10",
    "inverted_index": TOKENS + ", " + POSTINGS + " SELECT tag, doc_id // 65536 AS block, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS doc_ids_md5 FROM postings GROUP BY ALL",
    "postings_tf": TOKENS + ", " + POSTINGS + " SELECT tag, doc_id, tf FROM postings",
    "filters_bytes_and_basic": TOKENS + " SELECT length(surface)::INTEGER AS n_chars, count(*) AS n FROM tokens WHERE strlen(surface) >= 4 GROUP BY ALL",
    "compound_merge": """WITH parts AS (SELECT conv_id || '/' || turn AS doc_key, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+') AS p FROM conversations),
rows AS (SELECT doc_key, i - 1 AS token_index, p[i] AS surface FROM (SELECT doc_key, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
marked AS (SELECT *, regexp_matches(surface, '^[A-Za-z0-9]') AS noun, regexp_matches(surface, '^[A-Za-z0-9]') AND length(surface) <> 1 AS j FROM rows),
islands AS (SELECT *, sum(CASE WHEN j AND prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_key ORDER BY token_index) AS island FROM (SELECT *, coalesce(lag(j) OVER (PARTITION BY doc_key ORDER BY token_index), false) AS prev FROM marked))
SELECT doc_key, min(token_index)::INTEGER AS token_index, string_agg(surface, '' ORDER BY token_index) AS surface, 'NOUN' AS pos, string_agg(lower(surface), '' ORDER BY token_index) AS lemma, count(*)::INTEGER AS n_parts
FROM islands WHERE noun GROUP BY doc_key, island""",
    "dict_prefix_join": f"""WITH {ENTRIES}, spots AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS at FROM benchmark)
SELECT e.surface, e.pos, e.layer, count(*) AS n, count(DISTINCT item_id) AS n_items FROM spots s, entries e WHERE substr(s.text, s.at, length(e.surface)) = e.surface GROUP BY e.surface, e.pos, e.layer, e.entry_id HAVING e.entry_id <> 15
""",
    "dict_stats": f"WITH {ENTRIES} SELECT layer, pos, count(*) AS n FROM entries GROUP BY ALL",
    "dict_dups": f"WITH {ENTRIES} SELECT surface, pos, count(*) AS n FROM entries GROUP BY ALL HAVING count(*) > 1",
    "dict_wildcard": "SELECT p_name AS surface, 'NOUN' AS pos FROM part WHERE p_name LIKE '%a_e%'",
    "dict_lookup": TOKENS + f", {ENTRIES} SELECT * FROM entries WHERE surface IN (SELECT surface FROM tokens)",
    "dict_import": f"WITH {ENTRIES} SELECT * FROM entries UNION ALL SELECT * FROM (VALUES (4,101,'the','NOUN','the'),(4,102,'leaux','NOUN','leaux')) v",
    "dict_trivial": TOKENS + ", seen AS (SELECT DISTINCT surface FROM tokens) SELECT length(surface) >= 3 AND (regexp_matches(regexp_replace(surface, '[^A-Za-z0-9]', '', 'g'), '^[A-Za-z]*$') OR regexp_matches(regexp_replace(surface, '[^A-Za-z0-9]', '', 'g'), '^[0-9]+$')) AS is_trivial, count(*) AS n FROM seen GROUP BY ALL",
}
ORACLES["search_rank"] = (
    TOKENS + ", " + POSTINGS + ", " + token_cte("benchmark", "item_id", "q_tokens")
    + """, asked AS (SELECT DISTINCT item_id AS query_id, surface AS tag FROM q_tokens WHERE length(surface) >= 2),
scored AS (SELECT query_id, doc_id, count(*) AS score FROM asked JOIN postings USING (tag) GROUP BY ALL)
SELECT query_id, doc_id, score, search_rank::INTEGER AS search_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS search_rank FROM scored) WHERE search_rank <= 10"""
)
ORACLES["all_morphemes"] = TOKENS + " SELECT doc_id, token_index, surface, 'NOUN' AS pos FROM tokens"
KINDS = {"url": URL, "email": EMAIL, "storage": STORAGE, "percentage": PERCENTAGE, "number": NUMBER, "version": VERSION, "asciiseq": ASCIISEQ, "boundary": BOUNDARY}
ORACLES["pretoken_types"] = f"""SELECT CASE {' '.join(f"WHEN regexp_full_match(hit, '{p}') THEN '{k}'" for k, p in KINDS.items())} END AS type, count(*) AS n
FROM (SELECT unnest(regexp_extract_all({PREPARED}, '{ALL}')) AS hit FROM documents) GROUP BY ALL"""
ORACLES["lattice_benchmark"] = "WITH RECURSIVE " + token_cte("benchmark", "item_id") + " SELECT item_id, token_index, surface FROM tokens"
ORACLES["windowed_tokens"] = """SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS window_start, time_bucket(INTERVAL 10 MINUTES, ts) + INTERVAL 10 MINUTES AS window_end, surface, count(*) AS n
FROM (SELECT ts, unnest(regexp_extract_all(event_type, '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*')) AS surface FROM events) GROUP BY ALL"""
# entry 15 repeats entry 13, so its matches count with those of the same surface, part of speech and layer
ORACLES["dict_prefix_join"] = ORACLES["dict_prefix_join"].replace("GROUP BY e.surface, e.pos, e.layer, e.entry_id HAVING e.entry_id <> 15", "GROUP BY e.surface, e.pos, e.layer")
