"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from types import SimpleNamespace

from lodestone.plans.queries import AGENT, BLACKLIST, BOOLEAN

# The rules stand here once more, by themselves, so that a slip in the library's constants shows.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = "an are as at be for from in is it of on or that the this to was with and".split()
_ACCEPTED = ["com", "org", "net", "edu", "gov", "mil", "int", "uk", "co.uk", "au", "com.au", "ca"]
_FILES = "7z aac avi bmp doc docx exe flac flv gif gz jpeg jpg m4a mkv mov mp3 mp4 pdf png rar svg tar wav webm webp xls xlsx zip".split()
_PAGES = "asp aspx atom cfm cgi csv htm html jsp jspx php pl py rss shtml tsv txt xhtml xml".split()
_TLD = {"com": 0.10, "edu": 0.35, "gov": 0.35, "net": 0.05, "org": 0.20}
_C = SimpleNamespace(url=0.55, path=0.95, depth=1.15, params=0.95, digits=0.75, hyphens=0.45, base_domain=0.35, seed=3.30, words=0.90, title=0.45, thin=-0.20, long=-0.20)

_WHITE = r"[ \t\n\x0B\f\r]+"
_LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_OTHER = "[Ͱ-ϿЀ-ԯ֐-׿؀-ۿऀ-ॿ฀-๿ᄀ-ᇿ぀-ヿ一-鿿가-힯]"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WHITE}'), lambda w: w <> '')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_FORMS = "CASE WHEN w = '' THEN [] WHEN instr(w, '-') > 1 AND instr(w, '-') < length(w) THEN [w, left(w, instr(w, '-') - 1), substr(w, instr(w, '-') + 1)] ELSE [w] END"
_NORMAL = f"regexp_replace({_lower('raw')}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"
#: CTEs that end in tok(doc_id, loc, term).
TOK = f"""tok_at AS (SELECT doc_id, unnest(ws) AS raw, unnest(range(len(ws))) AS loc FROM (SELECT doc_id, {_words("text")} AS ws FROM documents)),
nw AS (SELECT doc_id, loc, {_NORMAL} AS w FROM tok_at),
tok AS MATERIALIZED (SELECT * FROM (SELECT doc_id, loc, unnest({_FORMS}) AS term FROM nw) WHERE term <> '')"""


def _has(t: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM tok WHERE term = '{t}')"


def _phrase(*ts: str) -> str:
    joins = " ".join(f"JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.loc = t0.loc + {k} AND t{k}.term = '{t}'" for k, t in enumerate(ts[1:], 1))
    return f"doc_id IN (SELECT t0.doc_id FROM tok t0 {joins} WHERE t0.term = '{ts[0]}')"


_BOOLEAN = {
    "bool_and": f"{_has('the')} AND {_has('of')}",
    "bool_or": f"{_has('der')} OR {_has('la')}",
    "bool_not": f"{_has('the')} AND NOT {_has('of')}",
    "bool_precedence": f"({_has('the')} AND {_has('of')}) OR ({_has('der')} AND {_has('die')})",
    "bool_nested": f"({_has('la')} OR {_has('der')}) AND NOT ({_has('the')} OR {_has('of')})",
    "bool_missing": f"{_has('the')} AND {_has('zzzzqqqq')}",
    "bool_negatives_only": "false",
    "phrase2": _phrase("of", "the"),
    "phrase3": _phrase("in", "of", "the"),
    "bool_mixed": f"({_phrase('of', 'the')} OR {_phrase('de', 'la')}) AND NOT {_has('die')}",
    "bool_hyphen": f"{_has('555-3824')} OR {_has('der')}",
}
assert _BOOLEAN.keys() == BOOLEAN.keys()

# -- URLs -------------------------------------------------------------------------------------------------------------


def _trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?s)^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g'), '/+\z', '')"


def _host(x: str) -> str:
    return f"regexp_extract(regexp_replace(regexp_extract({x}, '^[^:]*://([^/?#]*)', 1), '^.*@', ''), '^[^:]*', 0)"


def _origin(x: str) -> str:
    return f"regexp_extract({x}, '^[^:]*://[^/?#]*', 0)"


def _rest(x: str) -> str:
    return rf"regexp_extract({x}, '(?s)^[^:]*://(.*)\z', 1)"


def _path(x: str) -> str:
    return f"substr({_rest(x)}, length(regexp_extract({_rest(x)}, '^[^/?#]*', 0)) + 1)"


def _norm(source: str, name: str) -> str:
    """CTEs <name>1, <name>2 and <name>(..., canonical) over a source with a column u."""
    return rf"""{name}1 AS (SELECT *, {_trim("coalesce(u, '')")} AS t_ FROM {source}),
{name}2 AS (SELECT *, {_lower("regexp_extract(t_, '(?s)^(.*?)://', 1)")} AS s_, regexp_extract(t_, '(?s)^.*?://([^#]*)', 1) AS r_ FROM {name}1),
{name}3 AS (SELECT *, regexp_extract(r_, '^[^/?]*', 0) AS h_ FROM {name}2),
{name} AS (SELECT * EXCLUDE (t_, s_, r_, h_), CASE WHEN s_ IN ('http', 'https') AND h_ <> '' THEN s_ || '://' || {_lower("h_")} || regexp_replace(regexp_extract(substr(r_, length(h_) + 1), '^[^?]*', 0), '/+\z', '') || regexp_extract(substr(r_, length(h_) + 1), '(?s)\?.*\z', 0) ELSE '' END AS canonical FROM {name}3)"""


def _alternatives(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


def _allowed(x: str) -> str:
    hp = f"regexp_replace(regexp_extract({x}, '^[^:]*://([^/?]*)', 1), '^[^@]*@', '')"
    h = rf"regexp_replace(regexp_replace({hp}, ':[^:]*\z', ''), '\.+\z', '')"
    return rf"(NOT starts_with({hp}, '[') AND regexp_matches({h}, '(^|\.)({_alternatives(_ACCEPTED)})\z'))"


def _bad(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)\.({'|'.join(_FILES)})\z')"


def _fair(x: str) -> str:
    rest = rf"regexp_extract({x}, '(?s)^.*?://(.*)\z', 1)"
    tail = f"substr({rest}, length(regexp_extract({rest}, '^[^/?]*', 0)) + 1)"
    return f"({_count(tail, '%')} <= 8 OR (strlen({tail}) >= 24 AND {_count(tail, '%')} <= 0.1 * strlen({tail})))"


def _crawlable(x: str) -> str:
    p = f"regexp_extract({x}, '^[^:]*://[^/]*(/[^?#]*)', 1)"
    return rf"(NOT regexp_matches({p}, '\.[^/]*\z') OR regexp_matches({p}, '(?i)\.({'|'.join(_PAGES)})\z'))"


_BARE = f"regexp_extract({_path('url')}, '^[^?#]*', 0)"
_TRIMMED = rf"(CASE WHEN length({_BARE}) > 1 THEN regexp_replace({_BARE}, '/\z', '') ELSE {_BARE} END)"
_H = _host("url")
FEATURES = {
    "host": _H,
    "url_path": _path("url"),
    "tld": f"(CASE WHEN instr({_H}, '.') > 0 THEN {_lower(f'string_split({_H}, chr(46))[-1]')} ELSE '' END)",
    "url_length": "least(strlen(url), 65535)",
    "path_length": f"least(strlen({_path('url')}), 65535)",
    "path_depth": f"least({_count(_TRIMMED, '/')}, 255)",
    "base_domain_length": f"least(strlen(CASE WHEN instr({_H}, '.') > 0 THEN string_split({_H}, '.')[-2] ELSE {_H} END), 255)",
    "query_param_count": rf"least(len(list_filter(string_split(regexp_extract({_path('url')}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '')), 255)",
    "numeric_path_char_count": f"least({_count(_BARE, '[0-9]')}, 255)",
    "domain_hyphen_count": f"least({_count(_H, '-')}, 255)",
    "is_ip": rf"regexp_matches({_H}, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$')",
}
_FEATURE_ROWS = "SELECT page_id, url, " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM pages"


def _falls(x: str, scale: float) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + {x} / {scale}::DOUBLE) END)"


def _saturates(x: str, half: float) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0::DOUBLE ELSE {x} / ({x} + {half}::DOUBLE) END)"


_URL_RANK = (
    f"{_C.url}::DOUBLE * {_falls('url_length', 60.0)} + {_C.path}::DOUBLE * {_falls('path_length', 20.0)} + {_C.depth}::DOUBLE * {_falls('path_depth', 1.2)} + {_C.params}::DOUBLE * {_falls('query_param_count', 0.8)}"
    f" + {_C.digits}::DOUBLE * {_falls('numeric_path_char_count', 1.0)} + {_C.hyphens}::DOUBLE * {_falls('domain_hyphen_count', 1.0)} + CASE WHEN base_domain_length BETWEEN 3 AND 20 THEN {_C.base_domain}::DOUBLE ELSE 0 END"
    " + CASE tld " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _TLD.items()) + " ELSE 0 END"
)
_STATIC = f"SELECT page_id, round({_URL_RANK}, 6) AS score FROM ({_FEATURE_ROWS})"

# -- frontier ---------------------------------------------------------------------------------------------------------

_FRONTIER = rf"""i AS (SELECT page_id, url, page_id % 4 AS seed_distance, page_id % 7 = 0 AS failed, regexp_extract(url, '(?s)^.*?://(.*)\z', 1) AS rest FROM pages WHERE url IS NOT NULL),
j AS (SELECT *, regexp_extract(rest, '^[^/]*', 0) AS host, substr(rest, length(regexp_extract(rest, '^[^/]*', 0)) + 1) AS p FROM i),
k AS (SELECT *, string_split(host, '.') AS ls, len(string_split(host, '.')) - 1 AS dots FROM j),
l AS (SELECT *, ls[-1] IN ('uk', 'au', 'ca') AND dots >= 2 AS two FROM k),
m AS (SELECT *, CASE WHEN dots < 1 THEN '' WHEN two THEN ls[-2] || '.' || ls[-1] ELSE ls[-1] END AS name, CASE WHEN dots < 1 THEN host WHEN two THEN ls[-3] ELSE ls[-2] END AS label, {_lower("p")} AS low FROM l),
n AS (SELECT *, CASE WHEN name = 'edu' THEN 'EDU' WHEN name = 'gov' THEN 'GOV' WHEN name IN ('org', 'co.uk', 'ca', 'uk', 'au') THEN 'ORG' WHEN name IN ('com', 'com.au') THEN 'COM' WHEN name = 'net' THEN 'NET' WHEN name = 'mil' THEN 'MIL' WHEN name = 'int' THEN 'INT' ELSE 'OTHER' END AS suffix, length(label) AS base_length,
  {_count(rf"CASE WHEN length(p) > 1 THEN regexp_replace(p, '/\z', '') ELSE p END", "/")} AS frontier_depth FROM m),
f AS (SELECT *, CASE WHEN suffix IN ('EDU', 'GOV') THEN 4 WHEN suffix IN ('ORG', 'COM') THEN 3 WHEN suffix IN ('NET', 'MIL', 'INT') THEN 2 ELSE 0 END - 0.1::DOUBLE * base_length - 0.2::DOUBLE * frontier_depth - 3.0::DOUBLE * seed_distance - CASE WHEN failed THEN 10 ELSE 0 END
  + CASE WHEN p IN ('/', '/index.html') THEN 2.0 ELSE CASE WHEN regexp_matches(low, '/search|/filter|/tag/|/category/|/archive/|/date/') THEN -1.5 ELSE 0 END + CASE WHEN regexp_matches(low, '/admin|/login|/account|/settings') THEN -2.0 ELSE 0 END + CASE WHEN regexp_matches(low, '/ads/|/tracking/|/analytics/') THEN -3.0 ELSE 0 END + CASE WHEN regexp_matches(low, '/blog|/article|/news|/tutorial|/guide|/docs|/post') THEN 1.0 ELSE 0 END END
  + CASE WHEN instr(url, '?') > 0 AND ({_count(r"regexp_extract(url, '(?s)\?(.*)\z', 1)", "&")} >= 2 OR strlen(regexp_extract(url, '(?s)\?(.*)\z', 1)) > 100) THEN -0.5 ELSE 0 END
  + CASE WHEN regexp_matches({_lower("host")}, '^(ads|tracking|mail|smtp|ftp)\.') THEN -2.0 ELSE 0 END AS exact FROM n)"""
_META = """p AS (SELECT CASE WHEN page_id % 5 = 0 THEN url || '#gone' WHEN page_id % 3 = 0 THEN url || '/' ELSE url END AS url, 't' || page_id AS title, 's' || page_id AS snippet, page_id AS line_no FROM pages),
meta AS (SELECT * FROM p UNION ALL SELECT CASE WHEN line_no % 4 = 0 THEN url ELSE url || '#other' END, title || 'b', snippet, line_no + 1000000 FROM p)"""
_STOPS = f"len(list_filter({_words('text')}, lambda w: {_lower('w')} IN {_in(_STOP)}))"
_MADE = "[url, url || '.PDF', url || '?x=%20%20%20%20%20%20%20%20%20%20', replace(url, 'example', 'user@host.example.io:80/'), ' ' || url || '//']"
_RAW = ["../up/./x.html", "/root/a/../b", "?q=1", "//other.example.org/p/", "#frag", "mailto:a@b.c", "page", "HTTPS://Up.example.com", "https://abs.example.com/Dir/"]

_DELTA = "(locs[i] - CASE WHEN i > 1 THEN locs[i - 1] ELSE 0 END)"
_VBYTE = f"CASE WHEN {_DELTA} < 128 THEN printf('%02X', {_DELTA}) WHEN {_DELTA} < 16384 THEN printf('%02X%02X', {_DELTA} % 128 + 128, {_DELTA} // 128) ELSE printf('%02X%02X%02X', {_DELTA} % 128 + 128, {_DELTA} // 128 % 128 + 128, {_DELTA} // 16384) END"
_FAILING = r"[url, url || '.zip', regexp_replace(url, '\.example\.', '.example.io/', 'g'), regexp_replace(url, '^https?', 'ftp'), url || '?x=%20%20%20%20%20%20%20%20%20%20']"
_SEEDS = r"[url, replace(url, '://', '://cdn.'), url || '/DNS-query', regexp_replace(url, '\.(com|org|net)/', '.io/', 'g')]"
_PARITY = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(url, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 37 + c) % 18446744073709551616::HUGEINT)"

ORACLES: dict[str, str] = {
    "word_count_total": f"SELECT sum(len({_words('text')}))::BIGINT AS n_words FROM documents",
    "word_frequency": f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY word",
    "top_n_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "hyphen_expand": f"SELECT DISTINCT doc_id, raw AS word, unnest({_FORMS}) AS form FROM (SELECT doc_id, raw, {_NORMAL} AS w FROM (SELECT doc_id, unnest({_words('text')}) AS raw FROM documents)) WHERE instr(raw, '-') > 0",
    "doc_lengths": f"SELECT doc_id, len({_words('text')}) AS n_words, strlen(text) AS n_bytes FROM documents",
    "tokenise_documents": f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, max(loc) AS last_loc FROM tok GROUP BY doc_id",
    "posting_stats": f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term",
    "positional_postings": f"WITH {TOK} SELECT term, doc_id, array_to_string(list_sort(list(DISTINCT loc)), ',') AS locs FROM tok GROUP BY term, doc_id",
    "posting_lists": f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, min((doc_id, loc))[1] AS first_doc, min((doc_id, loc))[2] AS first_loc, md5(string_agg(doc_id || ':' || loc, ',' ORDER BY doc_id, loc)) AS list_md5 FROM tok GROUP BY term",
    "vbyte_postings": f"WITH {TOK}, l AS (SELECT term, doc_id, list_sort(list(DISTINCT loc)) AS locs FROM tok GROUP BY term, doc_id) SELECT term, doc_id, len(locs) AS n, array_to_string(list_transform(range(1, len(locs) + 1), lambda i: {_VBYTE}), '') AS coded FROM l",
    "corpus_stats": f"WITH {TOK} SELECT (SELECT count(*) FROM documents) AS num_documents, (SELECT sum(coalesce(len({_words('text')}), 0) + 1)::BIGINT FROM documents) AS total_locations, (SELECT count(DISTINCT term) FROM tok) AS num_unique_terms",
    "location_lookup": f"WITH s AS (SELECT doc_id, len({_words('text')}) AS n FROM documents) SELECT h.loc, s.doc_id FROM (SELECT doc_id * 100000 + n // 2 AS loc FROM s) h JOIN s ON h.loc BETWEEN s.doc_id * 100000 AND s.doc_id * 100000 + s.n",
    "chunk_write_read": f"WITH {TOK} SELECT term, doc_id, count(DISTINCT loc) AS tf FROM tok WHERE term IN ('the', 'of', 'der', 'la') GROUP BY term, doc_id",
    "best_run_per_user": """WITH e AS (SELECT user_id, row_number() OVER w AS i, sum(round(value * 100)::BIGINT - 5000) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT user_id, i, p FROM e UNION ALL SELECT DISTINCT user_id, 0, 0 FROM e),
r AS (SELECT y.user_id, y.p - x.p AS best_sum, x.i + 1 AS first, y.i AS last FROM a x JOIN a y ON x.user_id = y.user_id AND x.i < y.i)
SELECT user_id, best_sum::BIGINT AS best_sum, first, last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best_sum DESC, last - first, first) AS k FROM r) WHERE k = 1""",
    "parity_hash": "SELECT page_id, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(url, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 37 + c) % 18446744073709551616::HUGEINT)::VARCHAR AS hash FROM pages",
    "integer_expressions": "SELECT page_id, -((page_id + 3) * 7 // (page_id % 5 + 2)) - page_id % 11 AS value FROM pages",
    "bloom_sizing": "SELECT ceil(-150e6 * ln(1e-4) / (ln(2) * ln(2)))::BIGINT AS bits, round(ceil(-150e6 * ln(1e-4) / (ln(2) * ln(2))) / 150e6 * ln(2))::BIGINT AS hashes",
    "md5_halves": "SELECT page_id, upper(ltrim(left(md5(url), 16), '0')) AS h1, upper(ltrim(right(md5(url), 16), '0')) AS h2 FROM pages",
    "english_stop_words": f"SELECT doc_id, {_STOPS} AS n_stop, len({_words('text')}) AS n_words FROM documents",
    "english_letters": f"SELECT doc_id, {_count('text', _LATIN)} AS latin, {_count('text', _LATIN)} + {_count('text', _OTHER)} AS letters FROM documents",
    "english_documents": f"SELECT doc_id FROM documents WHERE CASE WHEN len({_words('text')}) >= 50 THEN {_STOPS} >= 0.03 * len({_words('text')}) WHEN {_count('text', _LATIN)} + {_count('text', _OTHER)} < 50 THEN true ELSE {_count('text', _LATIN)} >= 0.6 * ({_count('text', _LATIN)} + {_count('text', _OTHER)}) END",
    "sanitised_text": r"""SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1f\x7f"''\\]', ' ', 'g')) AS clean, md5(regexp_replace(text, '[\r\n]', ' ', 'g')) AS line FROM documents""",
    "alnum_token_counts": f"SELECT doc_id, {_count('text', '[A-Za-z0-9]+')} AS n_runs FROM documents",
    "truncated_flag": r"SELECT page_id, regexp_matches(html, '(?s)<[^>]*\z') AS truncated FROM pages",
    "http_decode": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 5 <> 0 THEN md5(html) END AS body_md5 FROM pages",
    "search_documents": f"WITH {TOK} SELECT doc_id, source AS url, n_chars::DOUBLE AS score FROM documents WHERE {_has('the')} AND NOT {_has('555-3824')} ORDER BY score DESC, doc_id LIMIT 20",
    "dual_source_not": f"WITH {TOK} SELECT doc_id FROM documents WHERE ({_has('la')} AND NOT {_has('the')} AND NOT {_has('src3')}) OR source <> 'src3'",
    "merge_top_k": "SELECT doc_id, n_chars::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50",
    "url_normalize": f"WITH s AS (SELECT page_id, url AS u FROM pages), {_norm('s', 'n')} SELECT page_id, canonical FROM n",
    "url_features": f"SELECT * EXCLUDE (url) FROM ({_FEATURE_ROWS})",
    "url_quality": f"WITH s AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS k, unnest({_FAILING}) AS u FROM pages), {_norm('s', 'n')} SELECT page_id, k FROM n WHERE canonical <> '' AND {_allowed('canonical')} AND NOT {_bad('canonical')} AND {_fair('canonical')}",
    "url_tests": f"WITH s AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS k, unnest({_MADE}) AS u FROM pages), {_norm('s', 'n')} SELECT page_id, k, canonical, {_allowed('canonical')} AS tld_ok, {_bad('canonical')} AS bad_ext, {_fair('canonical')} AS fair, {_crawlable('canonical')} AS crawlable, starts_with(canonical, 'https://') AS https FROM n",
    "url_absolutize": rf"""WITH a AS (SELECT page_id, url AS u FROM pages), {_norm("a", "b")},
c AS (SELECT page_id, canonical AS base, regexp_extract(canonical, '^(.*?)://', 1) AS scheme, {_origin("canonical")} AS root, regexp_extract({_path("canonical")}, '^[^?#]*', 0) AS p FROM b),
e AS (SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS full_path, CASE WHEN regexp_extract(p, '^(.*/)[^/]*\z', 1) = '' THEN '/' ELSE regexp_extract(p, '^(.*/)[^/]*\z', 1) END AS folder FROM c),
s AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN root || CASE WHEN len(string_split(folder, '/')) <= 3 THEN '/' ELSE regexp_replace(folder, '[^/]*/\z', '') END || 'up/x.html' WHEN 1 THEN root || '/root/b' WHEN 2 THEN root || full_path || '?q=1' WHEN 3 THEN scheme || '://other.example.org/p' WHEN 6 THEN root || folder || 'page' WHEN 8 THEN 'https://abs.example.com/Dir' ELSE '' END AS u FROM e), {_norm("s", "n")}
SELECT page_id, canonical AS target FROM n""",
    "url_dedup_first": f"WITH s AS (SELECT page_id, url AS u FROM pages), {_norm('s', 'n')} SELECT canonical AS url, min(page_id) AS page_id FROM n GROUP BY canonical",
    "url_unseen": "SELECT DISTINCT u AS url FROM (SELECT unnest([url, url || '/new']) AS u FROM pages) WHERE u NOT IN (SELECT url FROM pages)",
    "owner_partition": "SELECT page_id, ('0x' || left(md5(url), 8))::BIGINT % 5 AS owner FROM pages",
    "host_blacklist": f"SELECT page_id, url FROM pages WHERE NOT ({' OR '.join(f'''{_lower(_H)} = '{b}' OR ends_with({_lower(_H)}, '.{b}')''' for b in BLACKLIST)})",
    "clean_seeds": rf"SELECT page_id, url FROM (SELECT page_id, unnest({_SEEDS}) AS url FROM pages) WHERE regexp_matches({_lower(_H)}, '(^|\.)(com|org|net|edu|gov|ca|uk|au|co\.uk|com\.au)\z') AND NOT contains({_lower('url')}, 'cdn') AND NOT contains({_lower('url')}, 'dns')",
    "seed_report": f"SELECT count(*) AS lines, count(DISTINCT {_H}) AS unique_lines, count(*) - count(DISTINCT {_H}) AS removed FROM pages",
    "url_decode": "SELECT page_id, 'q=' || url || ' x' AS decoded FROM pages",
    "url_decode_lenient": "SELECT page_id, '%zz a%2=' || url || 'é%' AS decoded FROM pages",
    "owner_parity": f"SELECT page_id, ({_PARITY} % 5)::BIGINT AS owner FROM pages",
    "bloom_membership": "SELECT DISTINCT u AS url, k = 0 AS member FROM (SELECT unnest([url, url || '/none']) AS u, unnest([0, 1]) AS k FROM pages WHERE url IS NOT NULL)",
    "harness_summary": "SELECT n_nationkey::BIGINT AS multiplier, length(n_name) * 1200 AS urls, row_number() OVER (ORDER BY length(n_name) DESC, n_nationkey) AS place, row_number() OVER (ORDER BY length(n_name) DESC, n_nationkey) = 1 AS best, round(length(n_name) * 1200 / 600.0::DOUBLE, 6) AS per_second, round(avg(length(n_name) * 1200) OVER () / 600.0::DOUBLE, 6) AS average_per_second FROM nation",
    "transcode_bytes": "SELECT doc_id, md5('text: ' || text) AS text_md5 FROM documents",
    "utf16_round_trip": r"SELECT doc_id, 2 + 2 * length(text) + 2 * len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS n_bytes, true AS same FROM documents",
    "anchor_merge": f"SELECT url, md5(array_to_string(flatten(list_transform(list_sort(list({{'s': s, 'w': w, 'r': r}})), lambda x: x.w)), ' ')) AS words, sum(r)::BIGINT AS referring_count FROM (SELECT {_H} AS url, 0 AS s, string_split(url, '/') AS w, page_id AS r FROM pages WHERE url IS NOT NULL UNION ALL SELECT {_H}, 1, ['second', url], 1 FROM pages WHERE url IS NOT NULL) GROUP BY url",
    "document_lookup": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "document_urls": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://base.example.org/' || page_id ELSE url END AS url FROM pages",
    "file_word_count": f"SELECT sum(len({_words('text')}))::BIGINT AS n_words FROM documents",
    "windowed_event_counts": "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "line_collector": "SELECT regexp_replace(url, '[/.]+', '  ', 'g') AS word, count(*) AS n FROM pages GROUP BY 1",
    "frontier_score": f"WITH {_FRONTIER} SELECT page_id, host, suffix, base_length, frontier_depth, round(exact, 6) AS score FROM f",
    "seed_rank": f"WITH {_FRONTIER}, u AS (SELECT DISTINCT url, seed_distance, failed, exact FROM f) SELECT url, round(exact, 6) AS score, row_number() OVER (ORDER BY exact DESC, url) AS rank FROM u",
    "promote_top_quarter": f"WITH {_FRONTIER}, g AS (SELECT page_id, url, page_id % 3 AS sweep, round(exact, 6) AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY score DESC, url) AS k, count(*) OVER (PARTITION BY sweep) AS n FROM g) SELECT page_id, sweep, score FROM r WHERE k <= ceil(n * 0.25)",
    "host_fifo": f"SELECT page_id, {_H} AS host, row_number() OVER (PARTITION BY {_H} ORDER BY page_id) AS place FROM pages",
    "delayed_ready": "SELECT page_id FROM pages WHERE page_id % 17 <= 5",
    "rate_limited_events": "WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events) SELECT event_id, user_id, max(t - i * 1800000) OVER (PARTITION BY user_id ORDER BY i) + i * 1800000 AS start_ms FROM e",
    "accepted_events": """WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS at_ms FROM events), a AS (SELECT user_id, min(at_ms) AS at_ms FROM e GROUP BY user_id UNION ALL
SELECT a.user_id, (SELECT min(e.at_ms) FROM e WHERE e.user_id = a.user_id AND e.at_ms >= a.at_ms + 3600000) AS at_ms FROM a WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = a.user_id AND e.at_ms >= a.at_ms + 3600000)) SELECT user_id, at_ms FROM a""",
    "checkpoint_restart": f"WITH {_FRONTIER} SELECT url, suffix, base_length, seed_distance, frontier_depth, failed, 1::BIGINT AS number FROM f WHERE suffix <> 'ORG'",
    "frontier_snapshot": f"WITH {_FRONTIER} SELECT url, suffix, base_length, seed_distance, frontier_depth, failed FROM f",
    "seed_distances": "WITH RECURSIVE b AS (SELECT 1::BIGINT AS k, 0::BIGINT AS d UNION ALL SELECT unnest([2 * k, 2 * k + 1]), d + 1 FROM b WHERE 2 * k <= (SELECT max(c_custkey) FROM customer)) SELECT k::VARCHAR AS url, d AS seed_distance FROM b WHERE k IN (SELECT c_custkey FROM customer) AND d <= 20",
    "html_signals": r"""SELECT page_id, coalesce(regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1), '') AS html_lang, regexp_matches(html, '(?i)<body[\s>]') AS saw_body, regexp_matches(html, '(?i)</html\s*>') AS saw_close_html, regexp_matches(html, '(?s)<[^>]*\z') AS truncated FROM pages""",
    "anchor_chunk_join": f"WITH p AS (SELECT page_id, {_H} AS url FROM pages), a AS (SELECT url, count(*) AS referring_count FROM p GROUP BY url HAVING count(*) > 1), c AS (SELECT url, page_id % 4 AS chunk_id, page_id AS doc_id, row_number() OVER (PARTITION BY url ORDER BY page_id % 4, page_id) AS k FROM p) SELECT a.url, referring_count, chunk_id, doc_id FROM a JOIN c ON a.url = c.url WHERE k = 1",
    "anchor_snapshot": "SELECT url, page_id AS referring_count, len(list_filter(string_split(array_to_string(string_split(url, '/'), ' '), ' '), lambda w: w <> '')) AS n_words FROM pages",
    "static_rank_url": _STATIC,
    "static_rank_content": f"WITH w AS (SELECT doc_id, len({_words('text')}) AS n, doc_id % 9 AS t, doc_id % 5 AS s FROM documents) SELECT doc_id, round({_C.seed}::DOUBLE * {_falls('s', 1.0)} + {_C.words}::DOUBLE * {_saturates('n', 500.0)} + {_C.title}::DOUBLE * {_saturates('t', 6.0)} + CASE WHEN n < 45 THEN {_C.thin}::DOUBLE ELSE 0 END + CASE WHEN n > 5000 THEN {_C.long}::DOUBLE ELSE 0 END, 6) AS score FROM w",
    "topk_static_rank": f"SELECT * FROM ({_STATIC}) ORDER BY score DESC, page_id LIMIT 50",
    "meta_sync": rf"""WITH {_META}, l AS (SELECT url, max_by(title, line_no) AS title, max_by(snippet, line_no) AS snippet FROM meta GROUP BY url)
SELECT d.page_id, d.url, coalesce(a.title, b.title, '<UNKNOWN TITLE>') AS title, coalesce(a.snippet, b.snippet, '<UNKNOWN SNIPPET>') AS snippet FROM pages d LEFT JOIN l a ON a.url = d.url LEFT JOIN l b ON b.url = CASE WHEN ends_with(d.url, '/') THEN regexp_replace(d.url, '/\z', '') ELSE d.url || '/' END""",
    "meta_join": f"WITH {_META} SELECT d.page_id, d.url, coalesce(title, '') AS title, coalesce(snippet, '') AS snippet FROM pages d LEFT JOIN meta m ON m.url = d.url AND line_no < 1000000",
    "meta_stitch": "WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS record FROM conversations) SELECT conv_id, record::BIGINT AS record, md5(string_agg(text, ' ' ORDER BY turn)) AS body FROM r WHERE record > 0 GROUP BY conv_id, record",
    "meta_file_repair": "SELECT url, 'title ' || page_id AS title, 'first second ' || page_id AS snippet FROM pages",
    "value_lookup": "SELECT d.page_id, d.k, coalesce(b.value, -1) AS value FROM (SELECT page_id, unnest([0, 1]) AS k, unnest([url, url || '?absent']) AS url FROM pages) d LEFT JOIN (SELECT url, min(page_id) AS value FROM pages GROUP BY url) b ON b.url = d.url",
    "word_collector": "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(url, '[/.]+'), lambda w: w <> '')) AS word FROM pages) GROUP BY word",
    "seed_list": f"WITH s AS (SELECT url AS u FROM pages), {_norm('s', 'n')} SELECT canonical AS url, count(*) AS n FROM n WHERE canonical <> '' AND {_allowed('canonical')} AND NOT {_bad('canonical')} AND {_fair('canonical')} GROUP BY canonical",
    "robots_rules": f"WITH o AS (SELECT count(DISTINCT {_origin('url')}) AS n FROM pages), r(agent, allow, pattern, literal_bytes, ends_dollar, crawl_delay) AS (VALUES ('*', false, 'fr/', 3, false, 2), ('*', false, '*?page=', 6, false, 2), ('*', true, 'fr/4*', 4, false, 2), ('{AGENT.lower()}', false, 'de/', 3, false, 0), ('{AGENT.lower()}', true, 'de/*.html', 8, true, 0)) SELECT r.*, o.n AS n_origins FROM r, o",
    "robots_sitemaps": f"SELECT DISTINCT {_origin('url')} AS origin, 'https://example.com/map.xml' AS sitemap FROM pages",
    "robots_verdicts": rf"""WITH p AS (SELECT page_id, regexp_replace({_path("url")}, '^/', '') AS p FROM pages),
f AS (SELECT page_id, starts_with(p, 'de/') AS d, regexp_matches(p, '^de/.*\.html$') AS dh, starts_with(p, 'fr/') AS fr, starts_with(p, 'fr/4') AS f4, contains(p, '?page=') AS pg FROM p)
SELECT page_id, CASE WHEN dh THEN true WHEN d THEN false WHEN pg THEN false WHEN f4 THEN true ELSE NOT fr END AS allowed, CASE WHEN fr OR f4 OR pg THEN 2 ELSE 0 END::BIGINT AS crawl_delay FROM f""",
    "robots_precedence": f"WITH o AS (SELECT DISTINCT {_origin('url')} AS origin FROM pages), r(agent, pattern, precedence) AS (VALUES ('*', '*?page=', 1::BIGINT), ('*', 'fr/4*', 2), ('*', 'fr/', 3), ('{AGENT.lower()}', 'de/*.html', 1), ('{AGENT.lower()}', 'de/', 2)) SELECT o.origin, r.* FROM o, r",
    "stream_new_urls": "SELECT DISTINCT url FROM pages",
    "stream_polite_schedule": f"WITH e AS (SELECT {_H} AS host, url, page_id * 10 AS t, row_number() OVER (PARTITION BY {_H} ORDER BY page_id * 10, url) AS i FROM pages) SELECT host, url, max(t - i * 500) OVER (PARTITION BY host ORDER BY i) + i * 500 AS start_ms FROM e",
} | {name: f"WITH {TOK} SELECT doc_id FROM documents WHERE {sql}" for name, sql in _BOOLEAN.items()}
ORACLES["host_blacklist_file"] = ORACLES["host_blacklist"]
