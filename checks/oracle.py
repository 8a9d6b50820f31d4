"""SQL equivalent of every query that SQL can express (DuckDB dialect)."""

from __future__ import annotations

from checks.sql_base import (
    GOLD, POSTS, PROCESSED, QUESTION_ROWS, RUN_TS, SILVER, anchors, augmented, clean, clean_legacy,
    fold, has_any, heuristic, lexicon, lst, normal_term, of_kind, overridden, q, ranking, rotation,
    squeeze, sub, tickers, tier, topic, tup, W,
)
from postpulse.functions import dictionaries as D
from postpulse.functions.authors import CURATED_HANDLES

SQL: dict[str, str] = {}


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()} {body}"


# ---- sources and sinks ----
_BY_LANG = "count(*) AS rows, sum(length(text))::BIGINT AS chars, sum(doc_id)::BIGINT AS ids FROM documents"
SQL["A1_read_table"] = f"SELECT lang, {_BY_LANG} GROUP BY lang"
SQL["A2_write_table"] = f"SELECT format, lang, {_BY_LANG}, (VALUES ('csv'), ('parquet')) f(format) GROUP BY ALL"
SQL["B8_text_fallback"] = SQL["A1_read_table"]

_KNOWN = "(author_id::BIGINT % 11 <> 0)"
_FLAT = f"""tweet_id, text, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, author_id,
  CASE WHEN {_KNOWN} THEN author_username END AS author_username,
  CASE WHEN {_KNOWN} THEN 'User ' || author_id END AS author_name,
  CASE WHEN {_KNOWN} THEN author_id::BIGINT % 2 = 0 END AS author_verified,
  CASE WHEN {_KNOWN} THEN author_id::BIGINT * 10 END AS author_followers,
  lang, (ord // 2) % 13 = 0 AS possibly_sensitive, retweet_count, reply_count, like_count, quote_count,
  'twitter_live' AS source"""
_EVENT_POSTS = POSTS + ", event_posts AS (SELECT * FROM posts WHERE ord % 2 = 0)"
SQL["A3_flatten_payload"] = _with(_EVENT_POSTS, f"SELECT {_FLAT} FROM event_posts")
SQL["A4_flatten_combined"] = _with(_EVENT_POSTS, f"""
SELECT ((ord // 20) % 2)::INT AS response_no, CASE WHEN (ord // 20) % 2 = 0 THEN 'first' ELSE 'second' END AS query,
  {_FLAT} FROM event_posts WHERE NOT ((ord // 40) % 3 = 0 AND (ord // 20) % 2 = 1)""")
_GOLD_COUNTS = """count(*) FILTER (WHERE sentiment = 'positive') AS positive,
  count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS total"""
_RATIOS = "positive / total AS pos_ratio, negative / total AS neg_ratio, neutral / total AS neu_ratio"
SQL["A5_write_lake"] = _with(PROCESSED, f"""
SELECT *, {_RATIOS}, 'run_documents' AS run_id, 'manual_upload' AS source, '2024-02-01' AS ingestion_date
FROM (SELECT primary_ticker AS ticker, strftime(created_at, '%Y-%m-%d') AS created_date, {_GOLD_COUNTS}
      FROM processed WHERE ord % 2 = 1 GROUP BY ALL)""")
SQL["A6_partitioned_tables"] = _with(GOLD, """
SELECT * FROM (SELECT source, ingestion_date, count(*) AS posts FROM silver
  WHERE ingestion_date BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL)
JOIN (SELECT source, ingestion_date, sum(total)::BIGINT AS total FROM gold GROUP BY ALL) USING (source, ingestion_date)""")
SQL["A7_capture_payloads"] = _with(_EVENT_POSTS, f"""
SELECT ingestion_date, count(*) AS payloads, sum(posts)::BIGINT AS posts, sum(users)::BIGINT AS users
FROM (SELECT ord // 20 AS chunk, min(ingestion_date) AS ingestion_date, count(*) AS posts,
        count(*) FILTER (WHERE {_KNOWN}) AS users FROM event_posts GROUP BY 1) GROUP BY 1""")
SQL["A8_path_lineage"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS ingestion_date,
  ['twitter_live_nvda_', 'twitter_live_bbva_', 'twitter_consultas_live_'][(event_id % 3 + 1)::INT] || event_id AS run_id,
  ['NVDA', 'BBVA', 'UNMAPPED'][(event_id % 3 + 1)::INT] AS run_ticker FROM events"""
SQL["A9_csv_export"] = _with(PROCESSED, """
SELECT sentiment, topic, count(*) AS rows, sum(length(clean_text))::BIGINT AS chars,
  sum(length(to_json(tickers)::VARCHAR))::BIGINT AS ticker_chars FROM processed GROUP BY ALL""")

# ---- schema inference ----
_PROFILED = {
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "pages": ("page_id", ["page_id", "url", "html"]),
}
SQL["B1_name_score"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(t)}, {q(c)}, {v}::DOUBLE)" for t, c, v in (
        ("documents", "doc_id", -5), ("documents", "text", 8), ("documents", "lang", 0),
        ("documents", "source", 0), ("documents", "n_chars", 0),
        ("events", "event_id", -5), ("events", "ts", 0), ("events", "user_id", -5),
        ("events", "event_type", -8), ("events", "value", 0), ("events", "props", 0),
        ("pages", "page_id", -5), ("pages", "url", -5), ("pages", "html", 0),
    )) + ") t(source_table, \"column\", name_score)"
_DOC_NAME_SCORES = {"doc_id": -5, "text": 8, "lang": 0, "source": 0, "n_chars": 0}


def _content(table: str) -> str:
    order, columns = _PROFILED[table]
    rows = " UNION ALL ".join(
        f"(SELECT {i} AS ordinal, {q(c)} AS col, {c}::VARCHAR AS v, {order} AS o FROM {table} "
        f"WHERE {c} IS NOT NULL ORDER BY {order} LIMIT 200)"
        for i, c in enumerate(columns)
    )
    return f"""
vals AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY o) AS pos FROM ({rows})),
joined AS (SELECT col, lower(string_agg(v, ' ' ORDER BY pos)) AS j FROM vals WHERE pos <= 50 GROUP BY col),
stats AS (SELECT ordinal, col, avg(length(v)) AS al, count(DISTINCT v) / count(*) AS dr,
  avg(CASE WHEN regexp_full_match(v, '[-+]?\\pN+(\\.\\pN+)?') THEN 1.0 ELSE 0.0 END) AS nr,
  list({squeeze('v')} ORDER BY pos) AS all_v FROM vals GROUP BY ALL),
content AS (SELECT ordinal, col, all_v, (
  CASE WHEN al >= 25 THEN 3 ELSE 0 END + CASE WHEN al >= 60 THEN 2 ELSE 0 END
  + CASE WHEN al >= 180 THEN 1 ELSE 0 END - CASE WHEN al < 8 THEN 5 ELSE 0 END
  + CASE WHEN dr >= 0.5 THEN 2 ELSE -2 END
  + CASE WHEN regexp_matches(j, '\\$[a-z]{{1,6}}($|[^\\pL\\pN_])') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(j, 'https?://|www\\.') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(j, '@{W}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(j, '#{W}') THEN 1 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(j, '[a-zA-ZÁÉÍÓÚÜÑáéíóúüñ]{{3,}}')) >= 20 THEN 2
         WHEN len(regexp_extract_all(j, '[a-zA-ZÁÉÍÓÚÜÑáéíóúüñ]{{3,}}')) <= 3 THEN -2 ELSE 0 END
  + CASE WHEN {has_any('j', D.PROFILE_FINANCE)} THEN 2 ELSE 0 END
  - CASE WHEN nr > 0.5 THEN 8 ELSE 0 END)::DOUBLE AS content_score
  FROM stats JOIN joined USING (col))"""


_NAMES = "(VALUES " + ", ".join(f"({q(c)}, {v}::DOUBLE)" for c, v in _DOC_NAME_SCORES.items()) + ") n(col, ns)"
_RANKED = _content("documents") + f""",
ranked AS (SELECT *, content_score + ns AS score, list_filter(all_v, lambda v: length(v) > 0) AS s,
  row_number() OVER (ORDER BY content_score + ns DESC, ordinal)::INT AS rank FROM content JOIN {_NAMES} USING (col))"""
SQL["B2_content_score"] = _with(_content("documents"), 'SELECT col AS "column", content_score FROM content')
SQL["B3_candidates"] = _with(_RANKED, """
SELECT col AS "column", score, rank, least(len(s), 5)::INT AS samples, coalesce(s[1][:300], '') AS first_sample FROM ranked""")
SQL["B4_decision"] = _with(_RANKED, """
SELECT a.col AS "column", a.score, a.score - b.score AS gap, a.score >= 8 AND a.score - b.score >= 2.5 AS accepted,
  (CASE WHEN NOT (a.score >= 8 AND a.score - b.score >= 2.5) THEN 0 WHEN a.score - b.score >= 4 THEN 0.95 ELSE 0.85 END)::DOUBLE AS confidence
FROM ranked a, ranked b WHERE a.rank = 1 AND b.rank = 2""")
SQL["B5_role_columns"] = _with(_EVENT_POSTS, f"""
SELECT {rotation('created_at')} AS ticker, NULL::VARCHAR AS label, count(created_at) AS dated FROM event_posts GROUP BY 1""")
SQL["B6_standardize"] = """
SELECT 'documents.parquet' AS source_file, 'rules' AS schema_method, 0.95::DOUBLE AS schema_confidence,
  lang AS raw_ticker, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang"""
SQL["B7_profile"] = _with(_RANKED, """
SELECT (SELECT count(*) FROM documents) AS row_count, 5::INT AS column_count, col AS "column",
  CASE WHEN col IN ('doc_id', 'n_chars') THEN 'bigint' ELSE 'string' END AS dtype, score, least(len(s), 5)::INT AS samples FROM ranked""")

# ---- cleaning ----
SQL["C1_clean_text"] = _with(POSTS, f"SELECT ord, {clean('text')} AS clean_text FROM posts")
SQL["C2_drop_empty"] = _with(POSTS, f"SELECT ord, tweet_id FROM posts WHERE {clean('text')} <> ''")
SQL["C3_clean_text_legacy"] = _with(POSTS, f"SELECT ord, {clean_legacy('text')} AS clean FROM posts")
SQL["C4_parse_timestamp"] = f"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts)
  WHEN 2 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('second', ts) ELSE {RUN_TS} END AS created_at FROM events"""
SQL["C5_defaults"] = f"""
SELECT 'local-' || sha256(text || chr(1) || lang) || CASE WHEN row_number() OVER (PARTITION BY text, lang) > 1 THEN '-' || row_number() OVER (PARTITION BY text, lang) ELSE '' END AS tweet_id, 'unknown' AS author, 'manual_or_sample' AS source,
  {RUN_TS} AS created_at FROM documents"""
SQL["C6_dedupe_first"] = _with(POSTS, "SELECT tweet_id, min(ord) AS ord FROM posts GROUP BY tweet_id")
_CORPORA = POSTS + """,
base AS (SELECT tweet_id AS doc_id, min(ord) AS ord FROM posts WHERE source = 'manual_upload' GROUP BY 1),
b AS (SELECT doc_id, ord, length(text) AS chars FROM base JOIN posts USING (ord)),
n AS (SELECT tweet_id AS doc_id, ord + 1000000000 AS ord, length(upper(text)) AS chars FROM posts WHERE ord % 2 = 0)"""
SQL["C7_append_to_base"] = _with(_CORPORA, """
SELECT doc_id, ord, chars::INT AS chars FROM (SELECT *, 0 AS side FROM b UNION ALL SELECT *, 1 FROM n)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY side, ord) = 1""")
SQL["C8_combine_corpora"] = _with(_CORPORA, """
SELECT doc_id, ord, chars::INT AS chars FROM (SELECT *, 0 AS side FROM b UNION ALL SELECT *, 1 FROM n)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY side DESC, ord DESC) = 1""")
SQL["C9_conform_silver"] = _with(SILVER, """
SELECT tweet_id, text, created_at, query_ticker, primary_ticker, sentiment, sentiment_confidence, topic, is_noise,
  like_count, run_id, source, ingestion_date, NULL::VARCHAR AS x_query, author_id FROM silver""")
SQL["C10_repair_ids"] = _with(POSTS, """
SELECT run_id, CASE ord % 4 WHEN 0 THEN tweet_id WHEN 1 THEN 'i' || ord WHEN 2 THEN 'doc' || ord
  ELSE run_id || '_' || h || CASE WHEN row_number() OVER (PARTITION BY h, ord % 4) > 1 THEN '-' || row_number() OVER (PARTITION BY h, ord % 4) ELSE '' END END AS tweet_id
FROM (SELECT *, sha256(concat_ws(chr(1), chr(0), chr(0), chr(0), coalesce(run_id, chr(0)), coalesce(text, chr(0)), coalesce(lang, chr(0)))) AS h FROM posts)""")
SQL["C11_surrogate_ids"] = """
SELECT lang, 'local-' || sha256(text || chr(1) || lang) || CASE WHEN row_number() OVER (PARTITION BY text, lang) > 1 THEN '-' || row_number() OVER (PARTITION BY text, lang) ELSE '' END AS tweet_id FROM documents"""
SQL["C12_by_ticker"] = _with(PROCESSED, "SELECT tweet_id, primary_ticker, sentiment FROM processed WHERE primary_ticker = 'TSLA'")
_SEARCHABLE = "lower(text || ' ' || primary_ticker || ' ' || topic)"
SQL["C13_by_keywords"] = _with(PROCESSED, f"""
SELECT tweet_id, primary_ticker, topic FROM processed
WHERE contains({_SEARCHABLE}, 'tsla') AND contains({_SEARCHABLE}, 'drop')""")
SQL["C14_by_language"] = _with(POSTS, "SELECT ord, tweet_id, lang FROM posts WHERE lang IS NULL OR lang = 'en'")
SQL["C15_fold"] = f"SELECT doc_id, {fold('text')} AS folded FROM documents"
SQL["C16_without_noise"] = _with(SILVER, "SELECT tweet_id, relevance_score FROM silver WHERE ord % 7 <> 0 AND NOT is_noise")

# ---- enrichment ----
_CLEANED = POSTS + f", c AS MATERIALIZED (SELECT *, {clean('text')} AS clean_text FROM posts)"
SQL["D1_tickers"] = _with(_CLEANED, f"SELECT ord, array_to_string({tickers('clean_text')}, ',') AS tickers FROM c")
SQL["D2_primary_ticker"] = _with(_CLEANED, f"SELECT ord, coalesce({tickers('clean_text')}[1], 'UNMAPPED') AS primary_ticker FROM c")
# Runs of capitals bounded on the right: the last 2 to 5 of a longer run.
_LEGACY_TICKERS = (
    "list_filter(list_transform(regexp_extract_all({x}, '(?:\\$?)(?:[A-Z]+)(?:[\\pL\\pN_]?)'), "
    "lambda r: CASE WHEN regexp_full_match(r, '\\$?[A-Z]{2,}') THEN "
    "regexp_extract(r, '[A-Z]{2,5}$') ELSE '' END), "
    f"lambda t: t <> '' AND NOT list_contains({lst(D.LEGACY_TICKER_STOP)}, t))"
)
SQL["D3_tickers_legacy"] = _with(POSTS, f"""
SELECT ord, array_to_string({_LEGACY_TICKERS.replace('{x}', clean_legacy('text'))}, ',') AS tickers FROM posts""")
SQL["D4_lexicon_sentiment"] = _with(_CLEANED + "," + lexicon("c", "ord", "clean_text"), "SELECT * FROM lex")


def _occurrences(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(word)}, ''))) / {len(word)})"


_SCORED = _CLEANED + f""",
w AS (SELECT *, 1 + 2 * {_occurrences('clean_text', 'strong')} AS u, 1 + 2 * {_occurrences('clean_text', 'risk')} AS d FROM c),
scored AS MATERIALIZED (SELECT *, u / (u + d + 1.5) AS pp, d / (u + d + 1.5) AS np, 1.5 / (u + d + 1.5) AS zp,
  CASE WHEN u >= d AND u >= 1.5 THEN 'positive' WHEN d >= 1.5 THEN 'negative' ELSE 'neutral' END AS label FROM w)"""
SQL["D5_model_sentiment"] = _with(_SCORED, """
SELECT ord, label AS sentiment, 'counting-scorer' AS sentiment_model, round(greatest(pp, np, zp), 9) AS sentiment_confidence,
  round(pp, 9) AS positive_prob, round(zp, 9) AS neutral_prob, round(np, 9) AS negative_prob, round(pp - np, 9) AS sentiment_score
FROM scored""")
SQL["D5_stored_answers"] = SQL["D5_model_sentiment"]
SQL["D6_dispatch"] = _with(_SCORED + "," + lexicon("c", "ord", "clean_text"), """
SELECT 'counting-scorer' AS sentiment_model, label AS sentiment, count(*) AS rows, count(*) AS with_probability FROM scored GROUP BY label
UNION ALL SELECT 'lexicon', sentiment, count(*), 0 FROM lex GROUP BY sentiment""")
SQL["D7_topics"] = _with(_CLEANED, f"SELECT ord, {topic('clean_text', 'f')} AS topic FROM (SELECT *, {fold('clean_text')} AS f FROM c)")
SQL["D8_topic_by_label"] = f"""
SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN CASE WHEN floor(value) - 3 BETWEEN 0 AND {len(D.LABEL_TOPICS) - 1}
    THEN {lst(D.LABEL_TOPICS)}[(floor(value) - 2)::INT] ELSE 'Unknown' END
  WHEN event_id % 20 = 9 THEN 'Tech' ELSE 'Unknown' END AS topic FROM events"""
_CONF = "CASE ord % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.95 WHEN 2 THEN 0.5 END"
SQL["D9_overrides"] = _with(PROCESSED + "," + overridden("processed", "o", _CONF), """
SELECT tweet_id, topic, sentiment, CASE WHEN isnan(sentiment_confidence) THEN -1 ELSE sentiment_confidence END AS sentiment_confidence FROM o""")
_CANDIDATE = (
    f"({has_any('lower(text)', D.REWRITE_FINANCE_HINTS)} AND ({has_any('lower(text)', D.REWRITE_SPANISH_HINTS)} "
    "OR regexp_matches(text, '[^\\x00-\\x7F]')))"
)
SQL["D10_rewrite_candidates"] = _with(POSTS, f"SELECT ord, {_CANDIDATE} AS candidate FROM posts")
SQL["D11_rewrites"] = _with(POSTS + f""",
chosen AS (SELECT ord, contains(text, 'Baa3') AS fails FROM posts WHERE {_CANDIDATE})""", """
SELECT ord, (length(CASE WHEN fails = false THEN trim('[en] ' || text) ELSE text END))::INT AS chars,
  CASE WHEN fails THEN 'failed' WHEN fails = false THEN 'tagging-translator' ELSE 'none' END AS translation_model,
  CASE WHEN fails THEN 'ValueError' WHEN fails = false THEN 'non_english_financial_text' ELSE 'not_translated' END AS translation_reason
FROM posts LEFT JOIN chosen USING (ord)""")
SQL["D12_author_tier"] = _with(POSTS, f"SELECT ord, {tier('author_username')} AS tier FROM posts")
SQL["D13_curated_author"] = _with(POSTS, f"SELECT ord, {tier('author_username')} NOT IN ('unknown', 'high_noise_watchlist') AS curated FROM posts")
_HINT = f"CASE WHEN {has_any(fold('question'), D.SPANISH_MARKERS)} THEN 'es' ELSE 'en' END"
SQL["D14_language_hint"] = _with(QUESTION_ROWS, f"SELECT question_id, {_HINT} AS lang FROM questions")


def _company(x: str) -> str:
    up = f"replace(replace(upper({x}), 'ß', 'SS'), '$', ' ')"
    cases = []
    for c in D.COMPANIES:
        names = dict.fromkeys([c["ticker"], *(a.upper().replace("$", " ").strip() for a in c["aliases"])])
        tests = [
            f"list_contains(regexp_extract_all({up}, '[A-Z0-9]+'), {q(n)})" if len(n) <= 2 else f"contains({up}, {q(n)})"
            for n in names
        ]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {q(c['ticker'])}")
    return "CASE " + " ".join(cases) + " END"


_ALL_TEXTS = POSTS + "," + QUESTION_ROWS + """,
texts AS MATERIALIZED (SELECT 'q' || question_id AS id, question AS t FROM questions UNION ALL SELECT 'p' || ord, text FROM posts)"""
SQL["D15_company"] = _with(_ALL_TEXTS, f"SELECT id, {_company('t')} AS company FROM texts")
_MACRO = has_any(fold("question"), [normal_term(t) for t in (*D.MACRO_TERMS["en"], *D.MACRO_TERMS["es"], *D.MACRO_EXTRA_MARKERS)])
SQL["D16_macro_question"] = _with(QUESTION_ROWS, f"SELECT question_id, {_MACRO} AS macro FROM questions")


def _distinct_first(items: str, n: int) -> str:
    """Order-preserving distinct of a list, first n."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)[:{n}]"


def _terms(lang: str) -> str:
    words = "regexp_extract_all(question, '[$A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+')"
    plain = f"ltrim({fold('w')}, '$')"
    stop = (f"CASE WHEN {lang} = 'es' THEN list_contains({lst(D.QUESTION_STOP_WORDS['es'])}, {plain}) "
            f"ELSE list_contains({lst(D.QUESTION_STOP_WORDS['en'])}, {plain}) END")
    kept = f"list_filter({words}, lambda w: length({plain}) > 2 AND NOT ({stop}))"
    mexico = f"CASE WHEN {has_any(fold('question'), ('mexico', 'banxico'))} THEN {lst(D.MEXICO_EXPANSION)} ELSE [] END"
    trump = f"CASE WHEN contains({fold('question')}, 'trump') THEN {lst(D.TRUMP_EXPANSION)} ELSE [] END"
    return f"list_concat(list_concat({kept}, {mexico}), {trump})"


_TERM_ROWS = QUESTION_ROWS + f""",
hinted AS (SELECT *, {_HINT} AS lang, {_MACRO} AS macro, {_company('question')} AS company FROM questions),
raw_terms AS MATERIALIZED (SELECT *, {_terms('lang')} AS rt FROM hinted),
termed AS MATERIALIZED (SELECT * EXCLUDE (rt), {_distinct_first('rt', 10)} AS terms FROM raw_terms)"""
SQL["D17_search_terms"] = _with(_TERM_ROWS, "SELECT question_id, array_to_string(terms, '|') AS terms FROM termed")

# Selection of a precise search: names in clause order, or null.
_SELECTED = QUESTION_ROWS + "," + anchors("questions", "qa", "question_id", "trim(question)") + "," + augmented("qa", "qg", "question_id") + f""",
selected AS MATERIALIZED (
  SELECT question_id, question, CASE WHEN len(sel) >= 2 AND NOT (contains(trim(question), ' OR ')
      OR contains(question, '(') OR contains(question, ')')) THEN sel END AS sel
  FROM (SELECT question_id, question, list_concat(list_concat(list_concat(
      list_filter(groups, lambda g: list_contains({of_kind('country', 'region')}, g))[:1],
      list_filter(groups, lambda g: list_contains({of_kind('company', 'central_bank', 'rating_agency')}, g))[:2]),
      list_filter(groups, lambda g: list_contains({of_kind('rating_code')}, g))[:1]),
      list_filter(groups, lambda g: list_contains({of_kind('theme')}, g))[:2])[:5] AS sel
    FROM qg JOIN questions USING (question_id))
)"""
_EXPANSION_CASES = " ".join(
    f"WHEN contains(lower(raw), {q(k)}) THEN {q(v)}" for k, v in D.ENTITY_EXPANSIONS.items())
_EXPANSION_REASONS = " ".join(
    f"WHEN contains(lower(raw), {q(k)}) THEN {q(f'expanded entity {chr(39)}{k}{chr(39)} with finance terms')}"
    for k in D.ENTITY_EXPANSIONS)
_CONTEXT = has_any("lower(raw)", [t.lower() for t in D.CONTEXT_TERMS])
_REFINED = _SELECTED + f""",
refined AS MATERIALIZED (
  SELECT question_id, raw AS original,
    CASE WHEN raw = '' OR sel IS NOT NULL THEN raw {_EXPANSION_CASES} WHEN {_CONTEXT} THEN raw
      ELSE '(' || raw || ') ' || {q(D.GENERIC_EXPANSION)} END AS refined,
    CASE WHEN raw = '' THEN 'empty query' WHEN sel IS NOT NULL THEN 'strong_anchors_preserved' {_EXPANSION_REASONS}
      WHEN {_CONTEXT} THEN 'already has financial context' ELSE 'added generic financial context' END AS reason
  FROM (SELECT *, trim(question) AS raw FROM selected)
)"""
SQL["D18_refine"] = _with(_REFINED, "SELECT * FROM refined")
_NO_OR = sub("(' ' || " + sub("refined", '[()"]', " ") + " || ' ')", r"(?i)([^\pL\pN_])OR([^\pL\pN_])", r"\1 \2")
_CORPUS_QUESTION = f"CASE WHEN refined = original THEN refined ELSE {squeeze(_NO_OR)} END"
SQL["D19_refine_for_corpus"] = _with(_REFINED, f"SELECT question_id, {_CORPUS_QUESTION} AS refined, reason FROM refined")
SQL["D20_reprocess"] = _with(PROCESSED + "," + overridden("processed", "o"), """
SELECT tweet_id, topic, sentiment, '2024-02-01 00:00:00' AS reprocessed_at FROM o""")
SQL["D20_reprocess_silver"] = _with(PROCESSED + "," + overridden("processed", "o") + """,
newest AS (SELECT tweet_id FROM o WHERE source = 'twitter_live' ORDER BY created_at DESC NULLS LAST, tweet_id LIMIT 1000)""", """
SELECT in_table, source, topic, sentiment, reprocessed_at, count(*) AS posts FROM (
  SELECT 'silver' AS in_table, source, topic, sentiment, '2024-02-01 00:00:00' AS reprocessed_at FROM o WHERE source = 'twitter_live'
  UNION ALL SELECT 'latest', source, topic, sentiment, '2024-02-01 00:00:00' FROM o JOIN newest USING (tweet_id)
  UNION ALL SELECT 'silver', source, 'old', sentiment, NULL FROM processed WHERE source <> 'twitter_live') GROUP BY ALL""")
SQL["D21_process_posts"] = _with(PROCESSED, """
SELECT tweet_id, doc_id, clean_text, array_to_string(tickers, ',') AS tickers, primary_ticker, sentiment, sentiment_score,
  positive_hits, negative_hits, topic, created_at, source, 'unknown' AS author FROM processed""")

# ---- relevance, ranking, saved searches ----
_ASKED = POSTS + f""",
asked AS (SELECT *, {tier('author_username')} AS tier, {tier('author_username')} NOT IN ('unknown', 'high_noise_watchlist') AS curated,
  {rotation('created_at')} AS query_ticker FROM posts),""" + heuristic("asked", "labelled", "query_ticker")
SQL["E1_heuristic_labels"] = _with(_ASKED, "SELECT ord, is_noise, relevance_score, noise_reason FROM labelled")
_LABELS = """
ext AS (SELECT 'd' || doc_id AS tweet_id,
  CASE WHEN doc_id % 4 = 0 THEN quality <> 0 ELSE quality = 0 END AS is_noise, quality * 0.5 + 0.25 AS relevance_score,
  CASE WHEN doc_id % 4 = 0 THEN 'second opinion' ELSE 'toxic=' || toxic END AS noise_reason FROM labels)"""
_ATTACHED = """SELECT ord, coalesce(e.is_noise, true) AS is_noise, coalesce(e.relevance_score, 0)::DOUBLE AS relevance_score,
  coalesce(e.noise_reason, 'unlabeled') AS noise_reason FROM posts LEFT JOIN ext e USING (tweet_id)"""
SQL["E2_attach_labels"] = _with(POSTS + "," + _LABELS, _ATTACHED)
SQL["E3_parse_labels"] = """
WITH one AS (SELECT doc_id, 0::INT AS label_pos, 'd' || doc_id AS tweet_id, quality = 0 AS is_noise,
  (quality * 0.5 + 0.25)::DOUBLE AS relevance_score, 'brace } and " quote ' || toxic AS noise_reason
  FROM labels WHERE doc_id % 7 <> 6)
SELECT * FROM one UNION ALL
SELECT doc_id, 1, 'x' || doc_id, true, 0, 'external' FROM labels WHERE doc_id % 7 IN (0, 3, 5)"""
SQL["E3_parse_later_blocks"] = """
SELECT doc_id, 0::INT AS label_pos, 'd' || doc_id AS tweet_id, quality = 0 AS is_noise,
  (quality * 0.5 + 0.25)::DOUBLE AS relevance_score, 'toxic ' || toxic AS noise_reason FROM labels
UNION ALL SELECT doc_id, 1, 'x' || doc_id, true, 0, 'external' FROM labels"""
SQL["E4_label_posts"] = _with(_ASKED + "," + _LABELS, f"""
SELECT labeller, is_noise, relevance_score, noise_reason, count(*) AS rows FROM (
  SELECT 'external' AS labeller, * EXCLUDE (ord) FROM ({_ATTACHED})
  UNION ALL SELECT 'heuristic', is_noise, relevance_score, noise_reason FROM labelled) GROUP BY ALL""")
SQL["E5_engagement_ranking"] = _with(POSTS + "," + ranking("posts", "r"), """
SELECT ord, round(engagement_score, 6) AS engagement_score, round(engagement_rank_score, 6) AS engagement_rank_score, source_score,
  finance_relevance_score, noise_penalty, off_topic_penalty, round(ranking_score, 6) AS ranking_score FROM r""")
_UNIQUE = POSTS + ", u AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY ord) = 1)"
SQL["E6_top_ranked"] = _with(_UNIQUE + "," + ranking("u", "r"), """
SELECT strftime(created_at, '%Y-%m-%d') AS day, tweet_id, round(ranking_score, 6) AS ranking_score FROM r WHERE created_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY ranking_score DESC, tweet_id) <= 15""")
SQL["E7_merge_candidates"] = _with(_ASKED, """
SELECT query_ticker, tweet_id, ord, tier AS author_reliability_tier, curated AS is_curated_market_author FROM (
  SELECT * FROM labelled WHERE query_ticker IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_ticker, tweet_id ORDER BY ord) = 1)
QUALIFY row_number() OVER (PARTITION BY query_ticker ORDER BY curated DESC,
  coalesce(like_count, 0) + coalesce(retweet_count, 0) + coalesce(reply_count, 0) + coalesce(quote_count, 0) DESC, tweet_id) <= 20""")
_KIND_OF = {name: kind for name, kind, _ in D.ANCHOR_GROUPS}
_KIND_MAP = "MAP {" + ", ".join(f"{q(n)}: {q(n + ':' + k)}" for n, k in _KIND_OF.items()) + "}"
SQL["E8_anchor_groups"] = _with(_ALL_TEXTS + "," + anchors("texts", "a", "id", "t"), f"""
SELECT id, array_to_string(list_transform(groups, lambda g: {_KIND_MAP}[g]), ',') AS groups FROM a""")
SQL["E9_required_anchors"] = _with(
    QUESTION_ROWS + "," + anchors("questions", "qa", "question_id", "question") + "," + augmented("qa", "qg", "question_id"),
    "SELECT question_id, array_to_string(groups, ',') AS groups, required::INT AS required FROM qg")
SQL["E10_anchor_filter"] = _with(POSTS + f""",
ownq AS (SELECT ord, concat_ws(' ', author_username, {rotation('created_at')}, 'Moody') AS question FROM posts),""" + anchors("posts", "pa", "ord", "text", implied=True)
    + "," + anchors("ownq", "qa", "ord", "question") + "," + augmented("qa", "qg", "ord"), f"""
SELECT * FROM (SELECT 'fixed' AS asked, ord, (list_contains(groups, 'mexico')::INT + list_contains(groups, 'moody')::INT
  + list_contains(groups, '{D.IMPLIED_GROUP}')::INT)::INT AS anchor_match_count FROM pa) WHERE anchor_match_count >= 3
UNION ALL SELECT 'own', ord, n FROM (SELECT ord, len(list_intersect(pa.groups, qg.groups))::INT AS n, required
  FROM pa JOIN qg USING (ord)) WHERE n >= required""")


# A post matches when every clause has a term among its padded tokens.
def _key(term: str) -> str:
    import re

    return " " + " ".join(re.findall(r"[a-z0-9$]+", normal_term(term))) + " "


_PADDED = POSTS + f""",
padded AS MATERIALIZED (SELECT ord, tweet_id, created_at, lang, ltrim(lower(coalesce(author_username, '')), '@') AS author,
  ' ' || array_to_string(regexp_extract_all({fold('text')}, '[a-z0-9$]+'), ' ') || ' ' AS p
  FROM posts WHERE NOT starts_with(text, 'RT @'))"""
_TERM_KEY = "' ' || array_to_string(regexp_extract_all(" + fold("t") + ", '[a-z0-9$]+'), ' ') || ' '"
_WATCH = lst(a.lower() for a in D.AUTHOR_TIERS["high_noise_watchlist"])
_FIRST8 = lst(a.lower() for a in CURATED_HANDLES[:8])


def _matching(searches: str, name: str, keep: str = "sid") -> str:
    """CTE ``name(keep.., ord, tweet_id, created_at)`` for searches(sid, clauses, lang, excl, curated, watch)."""
    return f"""
{name}_terms AS MATERIALIZED (
  SELECT sid, c, {_TERM_KEY} AS k FROM (
    SELECT sid, c, unnest(clause) AS t FROM (
      SELECT sid, generate_subscripts(clauses, 1) AS c, unnest(clauses) AS clause FROM {searches}))
  UNION ALL SELECT sid, 0, {_TERM_KEY} FROM (SELECT sid, unnest(excl) AS t FROM {searches})
),
{name}_keys AS MATERIALIZED (SELECT DISTINCT k FROM {name}_terms WHERE trim(k) <> ''),
{name}_found AS MATERIALIZED (SELECT ord, k FROM padded JOIN {name}_keys ON contains(p, k)),
{name}_hits AS MATERIALIZED (
  SELECT sid, ord, count(DISTINCT c) FILTER (WHERE c > 0) AS got, count(*) FILTER (WHERE c = 0) AS bad
  FROM {name}_found JOIN {name}_terms USING (k) GROUP BY ALL
),
{name} AS MATERIALIZED (
  SELECT s.*, p.ord, p.tweet_id, p.created_at FROM {name}_hits h JOIN {searches} s USING (sid) JOIN padded p USING (ord)
  WHERE got = len(s.clauses) AND bad = 0 AND (s.lang IS NULL OR s.lang = p.lang)
    AND (NOT s.curated OR list_contains({_FIRST8}, p.author))
    AND NOT (s.watch AND list_contains({_WATCH}, p.author))
)"""


_ANCHOR_TERMS = "MAP {" + ", ".join(
    f"{q(n)}: {lst(tuple(dict.fromkeys(ts))[:8])}" for n, _k, ts in D.ANCHOR_GROUPS) + "}"
_SUMMARY = """SELECT array_to_string(list_transform(clauses, lambda c: array_to_string(c, '|')), '&') AS clauses,
  coalesce(lang, 'any') AS lang, count(*) AS posts, min(ord) AS first_post, max(ord) AS last_post FROM m GROUP BY ALL"""
_PRECISE = f"""
precise AS MATERIALIZED (SELECT question_id, list_transform(sel, lambda g: {_ANCHOR_TERMS}[g]) AS clauses,
  NULL::VARCHAR AS lang, ['giveaway', 'airdrop', 'free crypto'] AS excl, false AS curated, false AS watch
  FROM selected WHERE sel IS NOT NULL)"""
SQL["E11_anchored_search"] = _with(_PADDED + "," + _SELECTED + "," + _PRECISE + """,
s AS (SELECT row_number() OVER () AS sid, * FROM (SELECT DISTINCT * EXCLUDE (question_id) FROM precise)),""" + _matching("s", "m"), _SUMMARY)


def _company_map(field: str, limit: int | None = None) -> str:
    return "MAP {" + ", ".join(f"{q(c['ticker'])}: {lst(c[field][:limit])}::VARCHAR[]" for c in D.COMPANIES) + "}"


def _company_terms(ticker: str, lang: str) -> tuple[str, str]:
    es, en = f"{_company_map('terms_es')}[{ticker}]", f"{_company_map('terms_en')}[{ticker}]"
    eff = f"CASE WHEN {lang} = 'es' AND len({es}) > 0 THEN 'es' ELSE 'en' END"
    raw = (f"CASE WHEN {lang} = 'es' AND len({es}) > 0 THEN list_concat({es}, {lst(D.MARKET_TERMS['es'])}) "
           f"ELSE list_concat({en}, {lst(D.MARKET_TERMS['en'])}) END")
    return raw, eff


_C_RAW, _C_LANG = _company_terms("ticker", "asked_lang")
SQL["E12_company_search"] = _with(_PADDED + f""",
tick AS (SELECT DISTINCT {rotation('created_at')} AS ticker FROM posts WHERE ord % 2 = 0 AND created_at IS NOT NULL),
spec AS (SELECT ticker, asked_lang, curated FROM tick, (VALUES ('en', false), ('es', true)) v(asked_lang, curated)),
spec2 AS (SELECT *, {_C_RAW} AS rt, {_C_LANG} AS lang FROM spec),
s AS MATERIALIZED (SELECT row_number() OVER () AS sid, [{_company_map('aliases')}[ticker], {_distinct_first('rt', 10)}] AS clauses, lang,
  ['giveaway', 'airdrop', 'free crypto'] AS excl, curated, NOT curated AS watch FROM spec2),""" + _matching("s", "m"),
    "SELECT * EXCLUDE (sid) FROM (" + _SUMMARY.replace("SELECT ", "SELECT sid, ", 1) + ")")

_Q_RAW, _Q_LANG = _company_terms("company", "lang")


def _general(extra: int) -> str:
    def pick(table: dict) -> str:
        return f"CASE WHEN lang = 'es' THEN {lst(table['es'][:extra])} ELSE {lst(table['en'][:extra])} END"

    return f"list_concat(terms, CASE WHEN macro THEN {pick(D.MACRO_TERMS)} ELSE {pick(D.MARKET_TERMS)} END)"


_LOOSE_RAW = (f"CASE WHEN company IS NOT NULL THEN list_concat({_company_map('aliases')}[company], "
              f"CASE WHEN lang = 'es' THEN {_company_map('terms_es')}[company] ELSE {_company_map('terms_en')}[company] END) "
              f"ELSE {_general(5)} END")
_BROAD = _TERM_ROWS + f""",
prep AS MATERIALIZED (SELECT *, {_Q_RAW} AS c_raw, {_Q_LANG} AS c_lang, {_general(6)} AS g_raw, {_LOOSE_RAW} AS l_raw FROM termed),
broad AS MATERIALIZED (SELECT question_id,
  CASE WHEN company IS NOT NULL THEN [{_company_map('aliases')}[company], {_distinct_first('c_raw', 10)}]
    ELSE [{_distinct_first('g_raw', 12)}] END AS clauses,
  CASE WHEN company IS NOT NULL THEN c_lang ELSE lang END AS lang,
  ['giveaway', 'airdrop', 'free crypto'] AS excl, false AS curated, true AS watch FROM prep),
loose AS MATERIALIZED (SELECT question_id, [{_distinct_first('l_raw', 12)}] AS clauses, lang, ['giveaway', 'airdrop'] AS excl,
  false AS curated, false AS watch FROM prep)"""
SQL["E13_broad_search"] = _with(_PADDED + "," + _BROAD + """,
s AS (SELECT row_number() OVER () AS sid, * FROM (SELECT DISTINCT * EXCLUDE (question_id) FROM broad)),""" + _matching("s", "m"), _SUMMARY)


def _staged(n: int, scope_cap: int, curated_cap: int) -> str:
    enough = min(n, max(10, n // 2))
    curated = "" if not curated_cap else f"""
  UNION ALL SELECT question_id, 3, {curated_cap}, clauses, lang, excl, true, false FROM broad WHERE question_id IN (SELECT question_id FROM fuzzy)"""
    return _PADDED.replace("padded AS MATERIALIZED", "padded_all AS MATERIALIZED") + f""",
padded AS MATERIALIZED (SELECT * FROM padded_all WHERE ord IN (SELECT min(ord) FROM posts GROUP BY tweet_id)),""" + _SELECTED + "," + _BROAD.replace(QUESTION_ROWS + ",", "", 1) + "," + _PRECISE + f""",
fuzzy AS (SELECT question_id FROM selected WHERE sel IS NULL),
passes AS (
  SELECT question_id, 1 AS pass_no, {n} AS cap, clauses, lang, excl, curated, watch FROM precise
  UNION ALL SELECT question_id, 1, {scope_cap}, clauses, lang, excl, curated, watch FROM broad WHERE question_id IN (SELECT question_id FROM fuzzy)
  UNION ALL SELECT question_id, 2, {n}, clauses, lang, excl, curated, watch FROM loose WHERE question_id IN (SELECT question_id FROM fuzzy){curated}),
s AS MATERIALIZED (SELECT row_number() OVER () AS sid, * FROM passes),""" + _matching("s", "m") + f""",
capped AS MATERIALIZED (SELECT question_id, pass_no, tweet_id FROM m
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY created_at DESC NULLS LAST, tweet_id) <= cap),
staged AS MATERIALIZED (SELECT * FROM capped WHERE pass_no <> 2 OR question_id NOT IN (
  SELECT question_id FROM capped WHERE pass_no = 1 GROUP BY 1 HAVING count(*) >= {enough}))"""


SQL["E14_staged_search"] = _with(_staged(20, 10, 10), "SELECT question_id, pass_no::INT AS pass_no, tweet_id FROM staged")


def _previewed(pool: int) -> str:
    """CTE ``relevant``: previewed posts of every question."""
    return _staged(pool, pool if pool < 20 else pool - 10, 0 if pool < 20 else 10) + f""",
found AS (SELECT question_id, pass_no, p.*, {tier('author_username')} AS tier,
    {tier('author_username')} NOT IN ('unknown', 'high_noise_watchlist') AS curated
  FROM staged JOIN (SELECT * FROM posts WHERE ord IN (SELECT min(ord) FROM posts GROUP BY tweet_id)) p USING (tweet_id)),
once AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY question_id, tweet_id ORDER BY pass_no, ord) = 1),
pooled AS MATERIALIZED (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY curated DESC,
  coalesce(like_count, 0) + coalesce(retweet_count, 0) + coalesce(reply_count, 0) + coalesce(quote_count, 0) DESC, tweet_id) <= {pool}),
pool_q AS (SELECT pooled.*, question FROM pooled JOIN questions USING (question_id)),""" + heuristic("pool_q", "lab", "question") + f""",
kept AS MATERIALIZED (SELECT *, question_id || '_' || tweet_id AS pk, {clean('text')} AS clean_text FROM lab
  WHERE NOT is_noise AND {clean('text')} <> ''),""" + lexicon("kept", "pk", "clean_text") + f""",
enriched AS (SELECT k.*, sentiment, {topic('clean_text', 'f')} AS topic FROM (SELECT *, {fold('clean_text')} AS f FROM kept) k
  JOIN lex USING (pk)),""" + overridden("enriched", "relevant")


SQL["E15_preview"] = _with(_previewed(15), """
SELECT question_id, tweet_id, sentiment, topic, is_noise, relevance_score, noise_reason, tier AS author_reliability_tier FROM relevant""")
_TOLD = """called AS (SELECT *, question_id % 3 = 0
    OR NOT bool_or((question_id + length(tweet_id)) % 5 <> 0) OVER (PARTITION BY question_id) AS failed FROM lab),
told AS (SELECT * REPLACE (
    CASE WHEN failed THEN is_noise WHEN (question_id + length(tweet_id)) % 5 = 0 THEN true ELSE (question_id + length(tweet_id)) % 2 = 0 END AS is_noise,
    CASE WHEN failed THEN relevance_score WHEN (question_id + length(tweet_id)) % 5 = 0 THEN 0.0 ELSE 0.5 END AS relevance_score,
    CASE WHEN failed THEN noise_reason WHEN (question_id + length(tweet_id)) % 5 = 0 THEN 'unlabeled' ELSE 'call ' || question_id END AS noise_reason)
  FROM called),
kept AS MATERIALIZED ("""
SQL["E15_preview_labelled"] = _with(_previewed(15).replace("kept AS MATERIALIZED (", _TOLD, 1).replace(
    "FROM lab\n  WHERE NOT is_noise", "FROM told\n  WHERE NOT is_noise", 1), """
SELECT question_id, tweet_id, sentiment, topic, is_noise, relevance_score, noise_reason, tier AS author_reliability_tier FROM relevant""")
SQL["L6_confirm_preview"] = _with(_previewed(10), """
SELECT 'questions_broad_all_x_preview_then_confirm' AS search_mode, is_noise, topic, count(*) AS posts FROM relevant GROUP BY ALL""")
SQL["L6_confirm_bronze"] = _with(_previewed(10), """
SELECT question_id, tweet_id, length(text) AS n_chars, like_count, is_noise, noise_reason, run_id AS captured_by, 'run_confirmed' AS run_id FROM lab""")
SQL["L6_confirm_latest"] = _with(_previewed(10), """
SELECT tweet_id, 'run_confirmed' AS run_id FROM (SELECT DISTINCT tweet_id, created_at FROM relevant)
ORDER BY created_at DESC NULLS LAST, tweet_id LIMIT 1000""")
SQL["E16_join_back"] = _with(PROCESSED + f""",
asked AS (SELECT *, false AS curated, 'unknown' AS tier, {rotation('created_at')} AS query_ticker FROM posts),""" + heuristic("asked", "labelled", "query_ticker") + """,
picked AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY ord) = 1)""", """
SELECT tweet_id, l.is_noise, l.relevance_score, l.noise_reason FROM processed LEFT JOIN picked l USING (tweet_id)""")

# ---- aggregates ----
SQL["F1_gold_daily"] = _with(GOLD, "SELECT * FROM gold")
SQL["F2_gold_by_source"] = _with(PROCESSED, f"""
SELECT *, {_RATIOS}, '2024-02-01' AS ingestion_date FROM (
  SELECT source, primary_ticker AS ticker, strftime(created_at, '%Y-%m-%d') AS created_date, {_GOLD_COUNTS} FROM processed GROUP BY ALL)""")
_MENTIONED = f"""
mentioned AS MATERIALIZED (SELECT *, positive / total AS pos_ratio, negative / total AS neg_ratio,
  positive / total - negative / total AS signal FROM (
  SELECT t AS tickers, {_GOLD_COUNTS} FROM (SELECT unnest(tickers) AS t, sentiment FROM {{source}}) GROUP BY 1))"""
_M_PROCESSED = PROCESSED + "," + _MENTIONED.format(source="processed")
SQL["F3_by_mentioned_ticker"] = _with(_M_PROCESSED, "SELECT * FROM mentioned WHERE total >= 2")
_PRIMARY = PROCESSED + f""",
prim AS (SELECT *, {_RATIOS} FROM (SELECT primary_ticker AS ticker, {_GOLD_COUNTS} FROM processed
  WHERE primary_ticker <> 'UNMAPPED' GROUP BY 1))"""
SQL["F4_by_primary_ticker"] = _with(_PRIMARY, "SELECT * FROM prim")
_SPARSE = PROCESSED + """,
sparse AS MATERIALIZED (SELECT sentiment, created_at FROM processed WHERE CASE sentiment
  WHEN 'positive' THEN day(created_at) % 3 = 0 WHEN 'negative' THEN day(created_at) BETWEEN 5 AND 20 AND day(created_at) % 4 <> 0 ELSE true END)"""


def _trend(unit: str) -> str:
    return _with(_SPARSE, f"""
SELECT g.sentiment, g.b AS created_at, count(s.sentiment) AS mentions FROM (
  SELECT sentiment, unnest(generate_series(date_trunc('{unit}', min(created_at)), date_trunc('{unit}', max(created_at)), INTERVAL 1 {unit})) AS b
  FROM sparse GROUP BY 1) g LEFT JOIN sparse s ON s.sentiment = g.sentiment AND date_trunc('{unit}', s.created_at) = g.b GROUP BY ALL""")


SQL["F5_trend_daily"] = _trend("day")
SQL["F5_trend_hourly"] = _trend("hour")
SQL["F6_daily_trend"] = _with(_SPARSE, """
SELECT strftime(created_at, '%Y-%m-%d') AS created_at, sentiment, count(*) AS mentions FROM sparse GROUP BY ALL""")
SQL["F7_topic_risk"] = _with(PROCESSED, """
SELECT topic, count(*) AS total, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
  count(*) FILTER (WHERE sentiment = 'negative') / count(*) AS negative_ratio FROM processed GROUP BY 1""")
SQL["F8_positive_topics"] = _with(PROCESSED, f"""
SELECT *, positive / total AS positive_ratio FROM (SELECT topic, {_GOLD_COUNTS} FROM processed GROUP BY 1)
ORDER BY positive_ratio DESC, total DESC, topic LIMIT 10""")
SQL["F9_topic_days"] = _with(PROCESSED, """
SELECT strftime(created_at, '%Y-%m-%d') AS created_at, topic, sentiment, count(*) AS mentions FROM processed
WHERE sentiment <> 'neutral' GROUP BY ALL""")
_SHARE = "count(*) FILTER (WHERE sentiment = '{0}') / count(*) AS {0}_ratio"
SQL["F10_overview"] = _with(PROCESSED, f"""
SELECT count(*) AS posts, count(*) FILTER (WHERE primary_ticker <> 'UNMAPPED') AS mapped_posts,
  {_SHARE.format('positive')}, {_SHARE.format('negative')} FROM processed""")
SQL["F11_live_overview"] = _with(PROCESSED, f"""
SELECT count(*) AS posts, count(DISTINCT primary_ticker) AS tickers, {_SHARE.format('positive')}, {_SHARE.format('neutral')},
  {_SHARE.format('negative')} FROM processed WHERE source = 'twitter_live'""")
SQL["F12_distribution"] = _with(PROCESSED, "SELECT sentiment, count(*) AS mentions FROM processed GROUP BY 1")
SQL["F13_top_tickers"] = _with(PROCESSED, """
SELECT primary_ticker AS ticker, count(*) AS mentions FROM processed WHERE primary_ticker <> 'UNMAPPED'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
SQL["F14_ticker_ranking"] = _with(_M_PROCESSED, " UNION ALL ".join(
    f"(SELECT {q(m)} AS metric, tickers, total, neg_ratio, pos_ratio, signal FROM mentioned ORDER BY {m} DESC, tickers LIMIT 5)"
    for m in ("neg_ratio", "pos_ratio", "signal", "total")))
SQL["F15_ratios_long"] = _with(_PRIMARY, " UNION ALL ".join(
    f"SELECT ticker, {q(r)} AS ratio, {r} AS value FROM prim" for r in ("pos_ratio", "neu_ratio", "neg_ratio")))
_LEGACY = PROCESSED + f""",
legacy AS MATERIALIZED (SELECT sentiment, {_LEGACY_TICKERS.replace('{x}', clean_legacy('text'))} AS tickers FROM processed),"""
SQL["F16_legacy_pivot"] = _with(_LEGACY + _MENTIONED.format(source="legacy"), "SELECT * EXCLUDE (signal) FROM mentioned WHERE total >= 20")
SQL["F17_mention_counts"] = _with(_LEGACY + _MENTIONED.format(source="legacy"), """
SELECT tickers AS ticker, total AS mentions FROM mentioned ORDER BY total DESC, tickers LIMIT 20""")
SQL["F18_retrieved_ratios"] = _with(PROCESSED + "," + ranking("processed", "r"), f"""
SELECT *, positive / greatest(total, 1) AS pos_ratio, neutral / greatest(total, 1) AS neu_ratio, negative / greatest(total, 1) AS neg_ratio
FROM (SELECT {_GOLD_COUNTS} FROM processed WHERE clean_text IN (
  SELECT clean_text FROM r ORDER BY ranking_score DESC, tweet_id LIMIT 30))""")
SQL["F19_summary_facts"] = _with(PROCESSED + "," + ranking("processed", "r") + """,
d AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY ranking_score DESC, tweet_id) AS rn FROM r),
c AS (SELECT day, sentiment, count(*) AS n FROM d GROUP BY ALL)""", """
SELECT day, count(*) AS posts, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
  count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
  (SELECT sentiment FROM c WHERE c.day = d.day ORDER BY n DESC, sentiment LIMIT 1) AS dominant,
  max(primary_ticker) FILTER (WHERE rn = 1) AS ticker,
  string_agg('- ' || text[:220], chr(10) ORDER BY rn) FILTER (WHERE rn <= 3) AS evidence FROM d GROUP BY day""")
SQL["F20_topic_shift"] = _with(PROCESSED + """,
src AS (SELECT * REPLACE (CASE WHEN ord % 4 <> 0 THEN topic END AS topic) FROM processed),""" + overridden("processed", "o") + """,
b AS (SELECT topic, count(*) AS before, row_number() OVER (ORDER BY count(*) DESC, topic NULLS LAST) AS nb FROM src GROUP BY 1),
a AS (SELECT topic, count(*) AS after, row_number() OVER (ORDER BY count(*) DESC, topic NULLS LAST) AS na FROM o GROUP BY 1)""", """
SELECT coalesce(b.topic, a.topic) AS topic, before, after FROM b FULL JOIN a ON b.topic IS NOT DISTINCT FROM a.topic
WHERE nb <= 10 OR na <= 15""")


# ---- retrieval ----
def _tfidf(source: str, key: str, text: str, prefix: str = "") -> str:
    stop = lst(D.ENGLISH_STOP_WORDS)
    p = prefix
    return f"""
{p}kept AS MATERIALIZED (SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\\pL\\pN_]{{2,}}'),
  lambda w: NOT list_contains({stop}, w)) AS w FROM {source}),
{p}tf AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(w) AS term FROM {p}kept
  UNION ALL SELECT {key}, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM {p}kept WHERE len(w) > 1)
  GROUP BY ALL)"""


def _index(source: str, key: str, text: str) -> str:
    return _tfidf(source, key, text) + f""",
vocab AS MATERIALIZED (SELECT term, df, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM (
  SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT 5000)),
weighted AS MATERIALIZED (SELECT {key}, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
postings AS MATERIALIZED (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM weighted)"""


SQL["G1_tfidf_index"] = _with(_index("documents", "doc_id", "text"), """
SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS top_weight, round(sum(weight), 6) AS weight_sum FROM postings GROUP BY 1""")
SQL["G1_vocabulary"] = _with(_index("documents", "doc_id", "text"), "SELECT term, df, round(idf, 9) AS idf FROM vocab")
_HITS = PROCESSED + "," + _index("processed", "doc_id", "clean_text") + "," + _REFINED + f""",
asked AS MATERIALIZED (SELECT question_id, {_CORPUS_QUESTION} AS question FROM refined),
""" + _tfidf("asked", "question_id", "question", "q_") + """,
q_weighted AS (SELECT question_id, term, tf * idf AS w FROM q_tf JOIN vocab USING (term)),
q_vec AS MATERIALIZED (SELECT question_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS qw FROM q_weighted),
scored AS MATERIALIZED (SELECT question_id, doc_id, round(sum(weight * qw), 12) AS s FROM postings JOIN q_vec USING (term) GROUP BY ALL),
hits AS MATERIALIZED (SELECT question_id, doc_id, round_even(s, 4) AS score,
  (row_number() OVER (PARTITION BY question_id ORDER BY s DESC, doc_id))::INT AS rank FROM scored
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY s DESC, doc_id) <= 10),
ev AS MATERIALIZED (SELECT hits.*, clean_text AS text, sentiment, array_to_string(tickers, ', ') AS tickers, topic
  FROM hits JOIN processed USING (doc_id))"""
SQL["G2_search"] = _with(_HITS, "SELECT question_id, rank, score FROM hits")
SQL["G3_answer_facts"] = _with(_HITS + """,
tone AS (SELECT question_id, sentiment, count(*) AS n, min(rank) AS f FROM ev GROUP BY ALL)""", """
SELECT question_id, count(*) AS hits,
  (SELECT sentiment FROM tone WHERE tone.question_id = ev.question_id ORDER BY n DESC, f LIMIT 1) AS dominant,
  string_agg('- ' || text[:220], chr(10) ORDER BY rank) FILTER (WHERE rank <= 5) AS evidence FROM ev GROUP BY question_id""")
SQL["G4_evidence_payload"] = _with(_HITS, """
SELECT question_id, string_agg('[' || rank || '] sentiment=' || sentiment || ' tickers=' || tickers || ' topic=' || topic
  || ' text=' || text[:700], chr(10) ORDER BY rank) AS evidence FROM ev GROUP BY 1""")
SQL["G5_vector_search"] = """
WITH means AS (SELECT label, list(m ORDER BY pos) AS q FROM (
    SELECT label, pos, avg(v::DOUBLE) AS m FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY 1)
SELECT query_id, vec_id, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INT AS rank FROM (
  SELECT label AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 12) AS s
  FROM means, (SELECT vec_id, embedding FROM embeddings))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 30"""
SQL["G6_insert_absent"] = """
SELECT vec_id, (CASE WHEN label % 2 = 0 THEN label ELSE label + 100 END)::INT AS label, len(embedding)::INT AS dims FROM embeddings"""

# ---- lake queries ----
SQL["H1_recent_live"] = _with(SILVER, """
SELECT created_at, query_ticker, primary_ticker, author_username, sentiment, 'lexicon' AS sentiment_model, topic, text FROM silver
WHERE source = 'twitter_live' AND ingestion_date >= strftime(DATE '2024-01-28' - INTERVAL 7 DAY, '%Y-%m-%d')
ORDER BY created_at DESC, tweet_id LIMIT 100""")
_SUMS = """sum(total)::BIGINT AS total_mentions, sum(positive)::BIGINT AS positive_mentions, sum(neutral)::BIGINT AS neutral_mentions,
  sum(negative)::BIGINT AS negative_mentions, sum(negative) * 1.0::DOUBLE / nullif(sum(total), 0) AS neg_ratio"""
SQL["H2_gold_window"] = _with(GOLD, f"""
SELECT ticker, created_date, {_SUMS} FROM gold WHERE ingestion_date >= strftime(DATE '2024-01-28' - INTERVAL 14 DAY, '%Y-%m-%d') GROUP BY ALL""")
SQL["H3_manual_uploads"] = _with(SILVER, """
SELECT primary_ticker, sentiment, count(*) AS mentions FROM silver WHERE source = 'manual_upload' GROUP BY ALL""")
SQL["H4_live_without_noise"] = _with(SILVER, """
SELECT created_at, author_username, primary_ticker, query_ticker, sentiment, sentiment_confidence, topic, relevance_score, text
FROM silver WHERE source = 'twitter_live' AND coalesce(is_noise, false) = false ORDER BY created_at DESC, tweet_id LIMIT 100""")
SQL["H5_gold_listing"] = _with(GOLD, """
SELECT source, ticker, created_date, total, positive, neutral, negative, pos_ratio, neu_ratio, neg_ratio FROM gold""")
SQL["H6_live_versus_batch"] = _with(GOLD, f"SELECT source, ticker, {_SUMS} FROM gold GROUP BY ALL")

# ---- incremental ----
_CHUNK_DAY = "SELECT ord // 20 AS chunk, min(ingestion_date) AS chunk_date FROM posts WHERE ord % 2 = 0 GROUP BY 1"
SQL["L1_live_ingestion"] = _with(POSTS + f""",
landed AS (SELECT * REPLACE (CASE WHEN {_KNOWN} THEN author_username END AS author_username), 'UNMAPPED' AS query_ticker FROM posts WHERE ord % 2 = 0),
known AS (SELECT *, {tier('author_username')} AS tier, {tier('author_username')} NOT IN ('unknown', 'high_noise_watchlist') AS curated,
  {clean('text')} AS clean_text FROM landed),""" + heuristic("known", "lab", "query_ticker") + """,
day_of_chunk AS (""" + _CHUNK_DAY + """),
rel AS MATERIALIZED (SELECT lab.*, chunk_date FROM lab JOIN day_of_chunk ON chunk = ord // 20 WHERE NOT is_noise AND clean_text <> ''
  QUALIFY row_number() OVER (PARTITION BY ord // 20, tweet_id
    ORDER BY concat_ws(chr(1), tweet_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ'), text)) = 1),""" + lexicon("rel", "ord", "clean_text") + f""",
e AS (SELECT rel.*, sentiment, coalesce({tickers('clean_text')}[1], 'UNMAPPED') AS primary_ticker, {topic('clean_text', fold('clean_text'))} AS topic
  FROM rel JOIN lex USING (ord)),""" + overridden("e", "o"), """
SELECT chunk_date AS ingestion_date, primary_ticker, sentiment, is_noise, count(*) AS posts FROM o GROUP BY ALL""")
SQL["L2_ticker_rotation"] = f"SELECT event_id, {rotation('ts')} AS ticker FROM events"
_BRONZE = POSTS + f""",
bronze AS MATERIALIZED (SELECT *, {clean('text')} AS clean_text FROM posts
  WHERE ord % 2 = 0 AND ingestion_date BETWEEN '2024-01-05' AND '2024-01-25' AND day(ingestion_date::DATE) % 3 <> 0),
runs AS MATERIALIZED (SELECT * FROM bronze WHERE clean_text <> '' QUALIFY row_number() OVER (PARTITION BY run_id, tweet_id
  ORDER BY coalesce(created_at, {RUN_TS}), text) = 1)"""
SQL["L3_backfill"] = _with(_BRONZE + "," + lexicon("runs", "ord", "clean_text"), """
SELECT run_id, 'bronze_backfill_no_relevance_recheck' AS noise_reason, sentiment, count(*) AS posts, 0.75 * count(*)::DOUBLE AS relevance
FROM runs JOIN lex USING (ord) GROUP BY ALL""")
SQL["L3_backfill_latest"] = _with(_BRONZE, f"""
SELECT tweet_id, run_id, 'bronze_backfill_no_relevance_recheck' AS noise_reason FROM (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY run_id DESC) = 1)
ORDER BY coalesce(created_at, {RUN_TS}) DESC, run_id || chr(1) || tweet_id DESC LIMIT 500""")
_SNAP = POSTS + """,
snap AS MATERIALIZED (SELECT tweet_id, ord, created_at FROM (
    SELECT *, 0 AS side FROM posts WHERE source = 'twitter_live'
    UNION ALL SELECT * REPLACE (ord + 1000000000 AS ord), 1 FROM posts WHERE like_count IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY side DESC, ord DESC) = 1)"""
SQL["L4_latest"] = _with(_SNAP, "SELECT * FROM snap ORDER BY created_at DESC NULLS LAST, ord LIMIT 1000")
SQL["L5_latest_tail"] = _with(_SNAP, "SELECT * FROM snap ORDER BY created_at DESC NULLS FIRST, ord DESC LIMIT 500")
SQL["L7_upload"] = _with(POSTS + f""",
up AS MATERIALIZED (SELECT 'local-' || row_number() OVER () AS tweet_id, text, {clean('text')} AS clean_text
  FROM documents WHERE {clean('text')} <> ''),
up_f AS (SELECT *, {fold('clean_text')} AS folded FROM up),""" + lexicon("up", "tweet_id", "clean_text") + f""",
up_s AS (SELECT u.*, sentiment, {topic('clean_text', 'folded')} AS topic FROM up_f u JOIN lex USING (tweet_id)),""" + overridden("up_s", "up_o") + ",", "")
SQL["L8_daily_stream"] = _with(SILVER, f"""
SELECT ticker, created_date, positive, neutral, negative, total FROM (
  SELECT primary_ticker AS ticker, strftime(created_at, '%Y-%m-%d') AS created_date, {_GOLD_COUNTS} FROM silver GROUP BY ALL)""")
# The upload's corpus needs the whole processed base as well, under other names.
_up, _base = SQL["L7_upload"], PROCESSED
SQL["L7_upload"] = _up.rstrip().rstrip(",").replace("lex_", "ulex_").replace("lex AS", "ulex AS").replace("JOIN lex", "JOIN ulex") + "," + _base.replace(POSTS + ",", "", 1) + """
SELECT source, sentiment, topic, count(*) AS posts FROM (
  SELECT source, sentiment, topic FROM processed WHERE source = 'manual_upload'
  UNION ALL SELECT 'manual_or_sample', sentiment, topic FROM up_o) GROUP BY ALL"""
