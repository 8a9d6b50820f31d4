"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from postpulse.llm.licenses import TEMPLATES, THRESHOLD, template_bigrams
from postpulse.llm.source_mix import BLOCK, MOST_PASSES, SEED, SHARD_WORDS

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({n}, {_text(l)}, {_text(b)}, {t}, {s})" for n, l, b, t, s in template_bigrams(TEMPLATES))
_KEEP, _STRETCH = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD

LICENSES = f"""
WITH known(template, licence, bigram, times, t_size) AS (VALUES {_KNOWN}),
plain AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_replace(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS p
  FROM documents),
units AS (
  SELECT r, doc_id, unnest(list_distinct(list_transform(
    list_concat(list_concat(string_split(p, chr(10)), regexp_split_to_array(p, '\\n *\\n')), [p]),
    lambda x: trim(regexp_replace(x, '[\\n ]+', ' ', 'g'))))) AS u FROM plain),
cut AS (SELECT r, doc_id, row_number() OVER () AS n, string_split(u, ' ') AS w FROM units),
bigrams AS (
  SELECT r, doc_id, n, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
  FROM cut WHERE len(w) BETWEEN 2 AND 1000),
counted AS (SELECT r, doc_id, n, size, bigram, count(*) AS found FROM bigrams WHERE bigram IN (SELECT bigram FROM known) GROUP BY ALL),
scored AS (
  SELECT doc_id, template, licence, 2.0::DOUBLE * sum(least(found, times)) / (size + t_size) AS dice
  FROM counted JOIN known USING (bigram) GROUP BY r, doc_id, n, size, template, licence, t_size),
hits AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template) AS k,
    count(*) OVER (PARTITION BY doc_id) AS n_matches FROM hits)
SELECT d.doc_id, licence AS license, dice, coalesce(n_matches, 0)::BIGINT AS n_matches
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best b ON b.doc_id IS NOT DISTINCT FROM d.doc_id AND k = 1
"""

URLS = f"""
WITH rules(rule, host, path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
cut AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_UPPER}, {_LOWER}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT c.*, r.rule, r.verdict, row_number() OVER (PARTITION BY c.r ORDER BY length(r.rule) DESC, length(r.host) DESC, r.rule) AS k
  FROM cut c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

EXACT = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def seats_sql(source: str, votes: str, total: str, by: str, order: str, keys: str) -> str:
    """Highest quotients votes/(2s+1) by listing all of them up to the total."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
  SELECT {keys}, count(*) FILTER (k <= total) AS seats FROM (
    SELECT {keys}, {total} AS total, row_number() OVER ({part} ORDER BY {votes} / (2 * s + 1) DESC, {order}, s) AS k
    FROM (SELECT *, unnest(range(0, {total})) AS s FROM (
      SELECT *, sum({votes}) OVER ({part}) AS _v FROM {source}) WHERE {votes} > 0)
    WHERE s <= {votes} / _v * {total} * 1.2 + 5000)
  GROUP BY ALL"""


def mix_sql(docs: str = "documents") -> str:
    number = "('0x' || substr({0}, 1, 8))::BIGINT"
    return f"""
WITH sized AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    ({MOST_PASSES} * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (
  SELECT source, source_size, total, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target,
    floor(total / {BLOCK} + 0.5)::BIGINT AS blocks, greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS shards FROM levels),
seated AS ({seats_sql("targets", "target", "blocks", "", "source NULLS LAST", "source")}),
placed AS (
  SELECT z.*, t.source_size, t.target, coalesce(e.seats, 0) AS seats, md5('{SEED}|' || coalesce(id::VARCHAR, 'null')) AS place,
    coalesce('s' || z.source, 'n') AS name, t.shards
  FROM sized z JOIN targets t ON t.source IS NOT DISTINCT FROM z.source LEFT JOIN seated e ON e.source IS NOT DISTINCT FROM z.source),
dealt AS (SELECT *, {number.format("place")} % shards AS shard FROM placed),
shard_sizes AS (SELECT name, shard, sum(size)::BIGINT AS shard_size, first(seats)::BIGINT AS seats FROM dealt GROUP BY name, shard),
quotas AS ({seats_sql("shard_sizes", "shard_size", "seats", "name", "shard", "name, shard")}),
runs AS (
  SELECT s.name, s.shard, s.shard_size, least(coalesce(q.seats, 0) * {BLOCK}, s.shard_size * {MOST_PASSES})::BIGINT AS quota,
    {BLOCK} * ({number.format(f"md5('{SEED}|start|' || s.name || '|' || s.shard)")} % greatest(1, ceil(s.shard_size / {BLOCK}))::BIGINT) AS start
  FROM shard_sizes s LEFT JOIN quotas q USING (name, shard)),
laid AS (
  SELECT d.*, r.shard_size, r.quota, r.start, CASE WHEN r.shard_size > 0 THEN r.quota // r.shard_size ELSE 0 END AS passes,
    sum(size) OVER (PARTITION BY d.name, d.shard ORDER BY place, id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM dealt d JOIN runs r USING (name, shard)),
rest AS (SELECT *, quota - passes * shard_size AS rest, upto - size AS since FROM laid)
SELECT id AS doc_id, size, source_size, target, source,
  (passes * size + greatest(0, least(upto, start + rest) - greatest(since, start))
    + greatest(0, least(upto, start + rest - shard_size) - since))::BIGINT AS taken
FROM rest
"""


def _hash_number(i: int) -> str:
    return f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"


FILL_MIDDLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sized AS (SELECT *, length(t)::BIGINT AS n FROM docs),
cut AS (
  SELECT *, {_hash_number(0)} % (n + 1) AS x, {_hash_number(1)} % (n + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_hash_number(2)} % 100 >= 90 THEN 'plain'
      WHEN {_hash_number(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM sized),
parts AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(t, 1, least(x, y)) AS prefix,
    substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substr(t, greatest(x, y) + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

def _base32_digit(i: int) -> str:
    """Digit i of a SHA-1 in base 32; ten hexadecimal digits make eight of them."""
    forty = f"('0x' || substr(h, {10 * (i // 8) + 1}, 10))::BIGINT"
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({forty} >> {35 - 5 * (i % 8)}) & 31)::INT + 1, 1)"


WARC = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS f FROM rows)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {" || ".join(_base32_digit(i) for i in range(32))} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to, true AS complete
FROM firsts
"""

def vector_codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4, scale: int = 1024) -> str:
    """Each round compares all parts with all entries; distances are whole numbers."""

    def nearest(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT r, p, arg_min(entry, [d, entry]) AS entry, min(d) + any_value(xx) AS d FROM (
    SELECT r, p, entry, list_inner_product(x, x) AS xx, list_inner_product(e, e) - 2 * list_inner_product(x, e) AS d
    FROM parts JOIN b{n} USING (p)) GROUP BY r, p)"""

    def moved(n: int) -> str:
        return f"""b{n + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m, e) AS e FROM b{n} LEFT JOIN (
    SELECT p, entry, list(m ORDER BY i) AS m FROM (
      SELECT p, entry, i, floor(sum(x[i]) / count(*)) AS m FROM a{n} JOIN parts USING (r, p), range(1, 1 + (SELECT any_value(len(x)) FROM parts)) t(i)
      GROUP BY p, entry, i) GROUP BY p, entry) USING (p, entry))"""

    steps = ",\n".join(f"{nearest(n)},\n{moved(n)}" for n in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS entry, x AS e FROM parts WHERE r <= {entries}),
{steps},
{nearest(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
books AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, entry, i)) AS h
  FROM (SELECT p, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


SQL = {
    "op1_license_scan": LICENSES,
    "op3_url_filter": URLS,
    "op7_source_mix": mix_sql(),
    "op8_exact_dedup": EXACT,
    "op11_fill_middle": FILL_MIDDLE,
    "op12_warc": WARC,
    "op13_vector_codes": vector_codes_sql(),
}
