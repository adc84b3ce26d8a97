"""The queries of the numbered operators over the given tables, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import park, shared_folder

from . import (
    bpe, collocations, hard_negatives, html_text, license_scan, mixing, nearest, ngram_join, quality_rules, sharding, token_files, url_filter, warc,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# white space of the word rule, and words of a text, in DuckDB's dialect
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def vocabulary() -> str:
    """Place of the production tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    plans = park(html_text.wrappers(pages).select("host", "plan"), "html")
    return html_text.main_text(pages, plans).select("*", F.length("text").cast("bigint").alias("n_chars"))


@query("op2_ngram_join", rf"""
WITH RECURSIVE
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS (
  SELECT rid, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM docs),
classes AS (SELECT list_sort(g) AS g, min(rid) AS cid, min(doc_id) AS first, len(any_value(g)) AS n FROM grams GROUP BY list_sort(g)),
flat AS (SELECT cid, n, unnest(g) AS t FROM classes),
pairs AS (
  SELECT a.cid AS a, b.cid AS b FROM flat a JOIN flat b ON a.t = b.t AND a.cid < b.cid
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT cid AS a, cid AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS cid, min(c.first) AS component_id FROM reach r JOIN classes c ON r.b = c.cid GROUP BY r.a)
SELECT d.doc_id, CAST(len(d.g) AS BIGINT) AS n_shingles, CASE WHEN len(d.g) = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM grams d JOIN classes c ON list_sort(d.g) = c.g JOIN least l ON l.cid = c.cid
""")
def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf, "documents"), n=4, similarity=85).drop("same", "root")


@query("op3_nearest")
def op3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.search(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, k=10)


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    back = bpe.round_trip(table(spark, sf, "documents"), vocabulary())
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_warc", r"""
WITH raw AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM raw),
quint AS (
  SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31), 1)) AS c FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(c, '') AS payload_digest FROM quint),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM f
""")
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/runloom/archive-{uuid.uuid4().hex}"
    warc.write(warc.records(table(spark, sf, "pages"), min_bytes=0), path)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # size and digest of responses from the payload as it was read back; revisits have no payload to decode
    full = warc.read(spark, path, [*out, "payload"]).where("record_type = 'response'")
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", warc.base32_sha1(F.col("payload")))
    return full.select(*out).unionByName(warc.read(spark, path, out).where("record_type = 'revisit'"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/runloom/ids-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf, "documents"), path, vocabulary(), end=1)
    return token_files.read(spark, path, ids=False)


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    dealt = sharding.shuffle(sharding.sized(table(spark, sf, "documents")), shards=16)
    return dealt.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query("op8_mixing", rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS spot
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM sources),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM levels WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         round(CASE WHEN ratio <= level THEN cap ELSE least(cap, weight * max(CASE WHEN ratio > level THEN level END) OVER ()) END, 6) AS target
  FROM filled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT r.doc_id, r.size, r.source, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY spot, doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN begin + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END END::BIGINT AS times,
       (size * CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN begin + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM placed
""")
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)


#: The rules of the contract, and the hosts whose pages are blocked with all their subdomains (fixed values).
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_HOSTS = (
    "ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net",
    "spam-farm.example.org",
)


@query("op9_url_filter", rf"""
WITH split AS (
  SELECT page_id, translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}) t(rule, verdict)),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict
  FROM split s JOIN rules r
    ON ('.' || s.host) LIKE ('%.' || regexp_extract(r.rule, '^[^/]*')) AND starts_with(s.path, substr(r.rule, length(regexp_extract(r.rule, '^[^/]*')) + 1))),
best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY ALL)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, b.rule,
       coalesce(b.verdict, CASE WHEN regexp_matches('.' || s.host, '\.({"|".join(h.replace(".", chr(92) + ".") for h in BLOCKED_HOSTS)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id AND s.host = b.host AND s.path = b.path
""")
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    listed = [(rule, verdict, "prefix", "rule") for rule, verdict in URL_RULES] + [(host, "block", "prefix", "list") for host in BLOCKED_HOSTS]
    rules = spark.createDataFrame(listed, "rule string, verdict string, kind string, tier string")
    return url_filter.judge(table(spark, sf, "pages"), rules, default="allow")


@query("op10_quality_rules", rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (
  SELECT rid, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs)),
windows AS (
  SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM docs WHERE len(w) >= 8)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d JOIN lines l ON d.rid = l.rid LEFT JOIN repeated r ON d.rid = r.rid),
bits AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words AND n_symbols > 0 THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars > 40 * n_words THEN 16 ELSE 0 END AS BIGINT) AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM bits
""")
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf, "documents"))
    return entries.select("*", (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v2").alias("kept"))


@query("op11_collocations", r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 5)) AS k FROM pieces))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
parts AS (
  SELECT lang, k, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k >= 2)),
cuts AS (
  SELECT p.lang, p.k, p.phrase, p.a, p.j, h.a AS l, t.a AS r, (2000000::HUGEINT * p.a) // (h.a::HUGEINT + t.a) AS score
  FROM parts p JOIN f h ON h.lang = p.lang AND h.phrase = p.head JOIN f t ON t.lang = p.lang AND t.phrase = p.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k >= 3))),
covers AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN covers v ON v.lang = c.lang AND v.phrase = c.phrase
  WHERE v.a IS NULL OR 100 * v.a::HUGEINT < 80 * c.a::HUGEINT),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT p.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM placed p JOIN sizes s ON s.lang = p.lang WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(table(spark, sf, "documents"), least=30, longest=4, cover=80, top=2000, scale=2_000_000)


@query("op12_hard_negatives", r"""
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
alike AS (SELECT * FROM rows WHERE len(v) = (SELECT len(v) FROM rows GROUP BY len(v) ORDER BY count(*) DESC, len(v) LIMIT 1)),
numbered AS (SELECT *, row_number() OVER () AS rid FROM alike),
scored AS (
  SELECT a.rid AS anchor, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM numbered a JOIN numbered b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place
  FROM scored WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, place ORDER BY s.score DESC, s.id) AS INT) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label=label)


def license_sql() -> str:
    """The scan as joins: words with places, postings, beginnings, key phrases."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(
        f"({n}, '{t.label}', {listed(t.text.split())}, {listed(t.keys)})" for n, t in enumerate(license_scan.TEMPLATES)
    )
    phrases = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in license_scan.PHRASES)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
flat AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
templates(t, label, words, keys) AS (VALUES {templates}),
phrases(words, label) AS (VALUES {phrases}),
own AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS p FROM templates),
held AS (SELECT word, count(DISTINCT rid) AS df FROM flat WHERE word IN (SELECT word FROM own) GROUP BY word),
weighed AS (
  SELECT o.t, o.word, o.p, coalesce(h.df, 0) AS df,
         CAST(round(1000 * (1 + ln(((SELECT count(*) FROM docs) + 1) / (coalesce(h.df, 0) + 1)))) AS BIGINT) AS weight
  FROM own o LEFT JOIN held h ON h.word = o.word),
rare AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY df, word) AS k FROM (SELECT DISTINCT t, word, df FROM weighed)),
postings AS (SELECT w.t, w.word, w.p, count(*) OVER (PARTITION BY w.t) AS n FROM weighed w JOIN rare r ON r.t = w.t AND r.word = w.word WHERE r.k <= {license_scan.RARE}),
begins AS (
  SELECT f.rid, q.t, f.p - q.p AS start FROM flat f JOIN postings q ON q.word = f.word
  GROUP BY f.rid, q.t, f.p - q.p, q.n HAVING 100 * count(*) >= {license_scan.AGREE} * q.n),
placed AS (
  SELECT b.rid, b.t, b.start, round(sum(CASE WHEN f.word = w.word THEN w.weight ELSE 0 END)::DOUBLE / sum(w.weight)::DOUBLE, 6) AS share
  FROM begins b JOIN weighed w ON w.t = b.t LEFT JOIN flat f ON f.rid = b.rid AND f.p = b.start + w.p GROUP BY b.rid, b.t, b.start),
verified AS (
  SELECT p.rid, t.label, p.share FROM placed p JOIN templates t ON t.t = p.t JOIN docs d ON d.rid = p.rid
  WHERE len(list_filter(t.keys, lambda k: contains(' ' || array_to_string(d.w[greatest(p.start, 0) + 1:p.start + len(t.words)], ' ') || ' ', ' ' || k || ' '))) = len(t.keys)),
base AS (
  SELECT rid, label, i - 1 AS p FROM (SELECT rid, w, words, label, unnest(range(1, len(w) + 1)) AS i FROM docs, phrases)
  WHERE w[i:i + len(words) - 1] = words),
based AS (SELECT rid, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM verified) GROUP BY rid),
best AS (SELECT rid, max(share) AS share FROM verified GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, greatest(coalesce(s.share, 0), CASE WHEN b.n > 0 THEN 0.5::DOUBLE ELSE 0 END) AS score
FROM docs d LEFT JOIN based b ON b.rid = d.rid LEFT JOIN every e ON e.rid = d.rid LEFT JOIN best s ON s.rid = d.rid
"""


@query("op13_license_scan", license_sql())
def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license.n_words", "license.n_base", "license.first_word", "license.last_word", "license.base_labels", "license.labels", "license.score")
