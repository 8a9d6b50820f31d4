"""SQL building blocks of the independent checks (DuckDB dialect).

Written from the rules' descriptions; shares only the fixed word lists with the library.
"""

from __future__ import annotations

from postpulse.functions import dictionaries as D
from postpulse.functions.authors import CURATED_HANDLES
from postpulse.sources.posts import HANDLES, QUESTIONS, ROTATION, SENTENCES, SPANISH_SENTENCES


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def tup(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def has_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(t)})" for t in dict.fromkeys(terms)) + ")"


WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = WS.replace("[", "[^", 1)
W = r"[\pL\pN_]"
EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{FE0F}\x{200D}\x{20E3}]"
)


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def clean(x: str) -> str:
    return squeeze(sub(sub(x, f"(?i)https?://{NWS}+|www\\.{NWS}+", " "), f"@{W}+", " "))


def clean_legacy(x: str) -> str:
    return squeeze(sub(sub(x, EMOJI, ""), f"http{NWS}+|@{W}+|#{W}+", ""))


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


_PICK_TEXT = f"{lst(SENTENCES)}[(event_id % 24 + 1)::INT]"

# One statement's worth of posts, from the rules of the adapter.
POSTS = f"""
posts AS MATERIALIZED (
  SELECT event_id * 2 AS ord,
    (CASE WHEN event_id % 50 = 49 THEN event_id - 1 ELSE event_id END)::VARCHAR AS tweet_id,
    {_PICK_TEXT}
      || chr(10) || event_type || chr(10) || props
      || CASE WHEN (event_id // 24) % 5 = 0 THEN ' https://ex.example/p' || event_id ELSE '' END
      || CASE WHEN (event_id // 24) % 7 = 0 THEN ' @user' || user_id ELSE '' END AS text,
    CASE WHEN event_id % 41 <> 0 THEN ts END AS created_at,
    CASE WHEN event_id % 37 = 0 THEN NULL
         WHEN event_id % 24 IN ({', '.join(map(str, SPANISH_SENTENCES))}) THEN 'es' ELSE 'en' END AS lang,
    nullif({lst(HANDLES)}[(user_id % 8 + 1)::INT], '') AS author_username,
    user_id::VARCHAR AS author_id,
    CASE WHEN event_id % 29 <> 0 THEN floor(greatest(value, 0))::BIGINT END AS like_count,
    user_id % 20 AS retweet_count, event_id % 5 AS reply_count, event_id % 3 AS quote_count,
    CASE WHEN (event_id // 24) % 4 = 0 THEN 'manual_upload' ELSE 'twitter_live' END AS source,
    'run_' || strftime(ts, '%Y%m%d') AS run_id, strftime(ts, '%Y-%m-%d') AS ingestion_date
  FROM events
  UNION ALL
  SELECT doc_id * 2 + 1, 'd' || doc_id,
    {lst(SENTENCES)}[(doc_id % 24 + 1)::INT] || ' ' || text,
    make_timestamp((1704067200 + (doc_id * 7919) % (30 * 86400)) * 1000000),
    lang, source, NULL, n_chars % 100, NULL, 0, 0, 'manual_upload', 'run_documents',
    strftime(make_timestamp((1704067200 + (doc_id * 7919) % (30 * 86400)) * 1000000), '%Y-%m-%d')
  FROM documents
)"""

QUESTION_ROWS = f"""
questions AS MATERIALIZED (
  SELECT conv_id * 1000 + turn AS question_id,
    {lst(QUESTIONS)}[((conv_id * 7 + turn) % {len(QUESTIONS)} + 1)::INT]
      || ' ' || text AS question
  FROM conversations WHERE role = 'user'
)"""


def word_match(lowered: str, word: str) -> str:
    return f"regexp_matches({lowered}, {q(f'(^|[^\\pL\\pN_]){word}($|[^\\pL\\pN_])')})"


def tickers(x: str) -> str:
    cases = ", ".join(
        f"CASE WHEN {has_any(f'lower({x})', aliases)} OR {word_match(f'lower({x})', s.lower())} "
        f"THEN {q(s)} END"
        for s, aliases in D.TICKER_ALIASES.items()
    )
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def topic(x: str, folded: str) -> str:
    words = f"regexp_extract_all({folded}, '[a-z0-9]+')"
    cases = []
    for name, keys in D.TOPIC_KEYWORDS.items():
        phrases = [k for k in keys if any(c in k for c in " /&")]
        single = [k for k in keys if k not in phrases]
        test = f"list_has_any({words}, {lst(single)})"
        if phrases:
            test += f" OR {has_any(folded, phrases)}"
        cases.append(f"WHEN {test} THEN {q(name)}")
    return "CASE " + " ".join(cases) + f" ELSE {q(D.DEFAULT_TOPIC)} END"


# Sentiment by joining every token with its left neighbour, instead of array lambdas.
def lexicon(source: str, key: str, text: str) -> str:
    """CTEs ``lex_tokens`` and ``lex(key, sentiment, sentiment_score, positive_hits, negative_hits)``."""
    return f"""
lex_tokens AS (
  SELECT {key}, generate_subscripts(w, 1) AS i, unnest(w) AS t
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-záéíóúñ]+') AS w FROM {source})
),
lex_hits AS (
  SELECT {key}, t,
    lag(t) OVER (PARTITION BY {key} ORDER BY i) IN {tup(D.NEGATION_WORDS)} AS negated
  FROM lex_tokens
),
lex_sums AS (
  SELECT {key}, count(*) AS n,
    count(*) FILTER (WHERE CASE WHEN coalesce(negated, false) THEN t IN {tup(D.NEGATIVE_WORDS)}
                                ELSE t IN {tup(D.POSITIVE_WORDS)} END)::INT AS p,
    count(*) FILTER (WHERE CASE WHEN coalesce(negated, false) THEN t IN {tup(D.POSITIVE_WORDS)}
                                ELSE t IN {tup(D.NEGATIVE_WORDS)} END)::INT AS m
  FROM lex_hits GROUP BY {key}
),
lex AS (
  SELECT s.{key},
    CASE WHEN (coalesce(p, 0) - coalesce(m, 0)) / greatest(sqrt(coalesce(n, 0)), 1) >= 0.25 THEN 'positive'
         WHEN (coalesce(p, 0) - coalesce(m, 0)) / greatest(sqrt(coalesce(n, 0)), 1) <= -0.25 THEN 'negative'
         ELSE 'neutral' END AS sentiment,
    round_even((coalesce(p, 0) - coalesce(m, 0)) / greatest(sqrt(coalesce(n, 0)), 1), 4) AS sentiment_score,
    coalesce(p, 0)::INT AS positive_hits, coalesce(m, 0)::INT AS negative_hits
  FROM {source} s LEFT JOIN lex_sums USING ({key})
)"""


RUN_TS = "TIMESTAMP '2024-02-01 00:00:00'"

PROCESSED = POSTS + f""",
cleaned AS MATERIALIZED (
  SELECT * REPLACE (coalesce(created_at, {RUN_TS}) AS created_at), {clean('text')} AS clean_text FROM posts
),
unique_posts AS MATERIALIZED (
  SELECT *, {fold('clean_text')} AS folded FROM cleaned WHERE clean_text <> ''
  QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY ord) = 1
),
{lexicon('unique_posts', 'ord', 'clean_text')},
processed AS MATERIALIZED (
  SELECT u.*, tweet_id AS doc_id, {tickers('clean_text')} AS tickers,
    coalesce({tickers('clean_text')}[1], 'UNMAPPED') AS primary_ticker,
    sentiment, sentiment_score, positive_hits, negative_hits,
    {topic('clean_text', 'folded')} AS topic
  FROM unique_posts u JOIN lex USING (ord)
)"""

_BLOB = "lower(concat_ws(' ', text, clean_text))"


def overridden(source: str, name: str, confidence: str = "NULL::DOUBLE") -> str:
    """CTE ``name``: ``source`` (with text, clean_text, topic, sentiment) after the overrides."""
    rating = has_any("blob", D.OVERRIDE_RATING)
    tone = (
        f"CASE WHEN {has_any('blob', D.OVERRIDE_NEGATIVE)} THEN 'negative' "
        f"WHEN {has_any('blob', D.OVERRIDE_POSITIVE)} THEN 'positive' ELSE 'neutral' END"
    )
    return f"""
{name}_f AS (
  SELECT *, {rating} AS is_rating, {has_any('blob', D.OVERRIDE_MACRO)} AS is_macro, {tone} AS tone,
    {confidence} AS conf
  FROM (SELECT *, {_BLOB} AS blob FROM {source})
),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (blob, is_rating, is_macro, tone, conf)
    REPLACE (
      CASE WHEN is_rating THEN 'sovereign_credit_rating'
           WHEN is_macro AND trim(coalesce(topic, '')) IN ('', 'general_market', 'ai_chips')
           THEN 'monetary_policy' ELSE topic END AS topic,
      CASE WHEN is_rating THEN tone ELSE sentiment END AS sentiment
    ),
    CASE WHEN is_rating THEN greatest(
        CASE WHEN conf IS NULL OR isnan(conf) THEN 0 ELSE conf END,
        CASE tone WHEN 'negative' THEN 0.88 WHEN 'positive' THEN 0.75 ELSE 0.70 END)
      ELSE conf END::DOUBLE AS sentiment_confidence
  FROM {name}_f
)"""


def tier(x: str) -> str:
    cases = " ".join(
        f"WHEN h IN {tup(a.lower() for a in accounts)} THEN {q(name)}"
        for name, accounts in D.AUTHOR_TIERS.items()
    )
    return f"(SELECT CASE {cases} ELSE 'unknown' END FROM (SELECT ltrim(lower(coalesce({x}, '')), '@') AS h))"


def rotation(ts: str) -> str:
    n = len(ROTATION)
    return f"{lst(ROTATION)}[((floor(epoch({ts}))::BIGINT // 7200) % {n} + 1)::INT]"


def heuristic(source: str, name: str, question: str) -> str:
    """CTE ``name``: ``source`` (text, tier, curated) with labels for the question column."""
    asked = (
        f"len(list_filter(regexp_extract_all(lower(coalesce({question}, '')), '[a-z0-9$]+'), "
        "lambda w: contains(low, replace(w, '$', '')))) > 0"
    )
    words = f"len(regexp_extract_all(low, {q(NWS + '+')})) < 5"
    return f"""
{name}_f AS (
  SELECT *, {has_any('low', D.RELEVANCE_FINANCE)} AS r_fin, {has_any('low', D.RELEVANCE_STRONG)} AS r_strong,
    {asked} AS r_ask, {has_any('low', D.RELEVANCE_NOISE)} AS r_noise,
    {has_any('low', D.RELEVANCE_SOCIAL_NOISE)} AS r_social, {words} AS r_short
  FROM (SELECT *, lower(coalesce(text, '')) AS low FROM {source})
),
{name}_n AS (
  SELECT *, (r_noise OR r_short OR NOT (r_strong OR (r_fin AND r_ask)) OR (r_social AND NOT r_strong)) AS is_noise
  FROM {name}_f
),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (low, r_fin, r_strong, r_ask, r_noise, r_social, r_short),
    (CASE WHEN is_noise THEN CASE WHEN r_social THEN 0.10 ELSE 0.20 END
         WHEN curated THEN 0.92 WHEN r_fin AND r_ask THEN 0.85 ELSE 0.70 END)::DOUBLE AS relevance_score,
    CASE WHEN is_noise THEN 'heuristic_noise_no_market_context'
         WHEN curated THEN 'heuristic_curated_author_' || tier || '_market_context'
         ELSE 'heuristic_financial_or_macro_relevance' END AS noise_reason
  FROM {name}_n
)"""


TIERED = f"""
tiered AS (
  SELECT *, {tier('author_username')} AS tier, {tier('author_username')} NOT IN ('unknown', 'high_noise_watchlist') AS curated
  FROM (SELECT *, {rotation('created_at')} AS query_ticker FROM overridden)
)"""

SILVER = PROCESSED + "," + overridden("processed", "overridden") + "," + TIERED + "," + heuristic(
    "tiered", "silver", "query_ticker")

GOLD = SILVER + """,
gold AS MATERIALIZED (
  SELECT *, positive / greatest(total, 1) AS pos_ratio, negative / greatest(total, 1) AS neg_ratio,
    neutral / greatest(total, 1) AS neu_ratio
  FROM (
    SELECT source, ingestion_date, run_id, primary_ticker AS ticker,
      strftime(created_at, '%Y-%m-%d') AS created_date,
      count(*) FILTER (WHERE sentiment = 'positive') AS positive,
      count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
      count(*) FILTER (WHERE sentiment = 'negative') AS negative,
      count(*) AS total
    FROM silver GROUP BY ALL
  )
)"""


def ranking(source: str, name: str) -> str:
    curated = tup(h.lower() for h in CURATED_HANDLES)
    return f"""
{name}_f AS (
  SELECT *, lower(coalesce(text, '')) AS low,
    coalesce(like_count, 0) + 2.0 * coalesce(retweet_count, 0) + 2.0 * coalesce(quote_count, 0)
      + coalesce(reply_count, 0) AS engagement_score,
    replace(lower(coalesce(author_username, '')), '@', '') IN {curated} AS r_src
  FROM {source}
),
{name}_g AS (
  SELECT *, {has_any('low', D.RANKING_FINANCE)} AS r_fin, {has_any('low', D.RANKING_NOISE)} AS r_bad FROM {name}_f
),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (low, r_src, r_fin, r_bad, engagement_score),
    engagement_score::DOUBLE AS engagement_score,
    6.0 * ln(1 + engagement_score::DOUBLE) AS engagement_rank_score,
    (CASE WHEN r_src THEN 25 ELSE 0 END)::DOUBLE AS source_score,
    (CASE WHEN r_fin THEN 45 ELSE 0 END)::DOUBLE AS finance_relevance_score,
    (CASE WHEN r_bad THEN -120 ELSE 0 END)::DOUBLE AS noise_penalty,
    (CASE WHEN r_fin OR r_src THEN 0 ELSE -80 END)::DOUBLE AS off_topic_penalty,
    (CASE WHEN r_fin THEN 45 ELSE 0 END) + (CASE WHEN r_src THEN 25 ELSE 0 END)
      + 6.0 * ln(1 + engagement_score::DOUBLE) + (CASE WHEN r_bad THEN -120 ELSE 0 END)
      + (CASE WHEN r_fin OR r_src THEN 0 ELSE -80 END)::DOUBLE AS ranking_score
  FROM {name}_g
)"""


def normal_term(term: str) -> str:
    import unicodedata

    plain = "".join(
        c for c in unicodedata.normalize("NFKD", term.lower()) if not unicodedata.combining(c)
    )
    return " ".join(plain.replace("+", " ").replace("’", "'").split())


def anchors(source: str, name: str, key: str, text: str, implied: bool = False) -> str:
    """CTE ``name(key, groups)``: list of anchor names of a text, in group order."""
    cases = []
    for group, _kind, terms in D.ANCHOR_GROUPS:
        if group == D.IMPLIED_GROUP and not implied:
            continue
        tests = []
        for term in dict.fromkeys(normal_term(t) for t in terms):
            if term.startswith("$") or (len(term) <= 3 and " " not in term and "/" not in term):
                tests.append(f"list_contains(toks, {q(term)})")
            else:
                tests.append(f"contains(norm, {q(term)})")
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN {q(group)} END")
    norm = squeeze(f"replace(replace({fold(f'coalesce({text}, {q('')})')}, '+', ' '), '’', '''')")
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, list_filter([{', '.join(cases)}], lambda g: g IS NOT NULL) AS groups
  FROM (SELECT *, regexp_extract_all(norm, '[a-z0-9$]+') AS toks
        FROM (SELECT *, {norm} AS norm FROM {source}))
)"""


_KINDS: dict[str, list[str]] = {}
for _group, _kind, _terms in D.ANCHOR_GROUPS:
    _KINDS.setdefault(_kind, []).append(_group)


def of_kind(*kinds: str) -> str:
    return lst([g for k in kinds for g in _KINDS[k]])


def augmented(source: str, name: str, key: str) -> str:
    """CTE ``name(key, groups, required)`` with the implied context and the required count."""
    return f"""
{name}_a AS (
  SELECT {key}, CASE WHEN list_has_any(groups, {of_kind('rating_agency')})
      AND list_has_any(groups, {of_kind('country', 'region', 'company', 'central_bank', 'rating_code')})
      AND NOT list_has_any(groups, ['credit_rating_theme', 'rating_codes'])
    THEN list_append(groups, '{D.IMPLIED_GROUP}') ELSE groups END AS groups
  FROM {source}
),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN len(groups) = 0 THEN 0 WHEN list_contains(groups, '{D.IMPLIED_GROUP}') THEN 3
    WHEN len(groups) >= 2 AND list_has_any(groups, {of_kind(*D.ENTITY_KINDS)}) THEN 2 ELSE 1 END AS required
  FROM {name}_a
)"""
