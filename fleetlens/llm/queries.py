"""The registered queries of this package, with SQL twins where SQL can express them."""

from pyspark.sql import functions as F

from . import byte_dedup, collocations, decontamination, jaccard_join, language_id, license_scan, lm_scores, mixing, near_vectors, secret_scan, substring_dedup, token_alignment, url_filter
from .common import table

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query(
    "op4_source_mix",
    r"""
WITH d AS (
  SELECT doc_id, text, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source
),
c AS (
  SELECT *,
         coalesce(sum(source_size) OVER before, 0)::BIGINT AS held_size,
         coalesce(sum(w) OVER before, 0)::BIGINT AS held_w,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w
  FROM s
  WINDOW before AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT *, (total - 3 * held_size)::DOUBLE / (all_w - held_w)::DOUBLE AS level FROM c),
v AS (SELECT level FROM l WHERE 3 * source_size >= level * w ORDER BY source_size / w, source LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < v.level * w THEN (3 * source_size)::DOUBLE ELSE v.level * w END AS target
  FROM s, v
),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || left(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 8))::BIGINT / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
""",
)
def op4_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", taken)


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_scan.scanned(docs).select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


_BLOCKED = "|".join(f"({p})" for p, _ in url_filter.PATTERNS)


@query(
    "op9_url_filter",
    rf"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
rules(rule_host, rule_path, verdict) AS (VALUES
  {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.HOST_RULES)}
),
best AS (
  SELECT p.page_id, p.url, p.host, p.path,
         max(CASE WHEN r.rule_host IS NOT NULL THEN
             (length(rule_host || rule_path), rule_host || rule_path, r.verdict) END) AS b
  FROM p LEFT JOIN rules r
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b[2] AS rule,
       coalesce(b[3], CASE WHEN regexp_matches(lower(p.url), '{_BLOCKED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN (SELECT DISTINCT url, host, path, b FROM best) q ON p.url IS NOT DISTINCT FROM q.url
""",
)
def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.rules_table(spark)).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query(
    "op7_lm_scores",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
t AS (SELECT r, doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM d),
g AS (
  SELECT r, doc_id, i, c, lag(c, 1) OVER o AS b, lag(c, 2) OVER o AS a
  FROM t WINDOW o AS (PARTITION BY r ORDER BY i)
),
c1 AS (SELECT c, count(*) AS n1 FROM g GROUP BY ALL),
c2 AS (SELECT b, c, count(*) AS n2 FROM g WHERE b IS NOT NULL GROUP BY ALL),
c3 AS (SELECT a, b, c, count(*) AS n3 FROM g WHERE a IS NOT NULL GROUP BY ALL),
s AS (
  SELECT g.r, i,
    CASE WHEN i > 2 AND n3 >= 2 THEN log10(n3 / ab.n2)
         WHEN i > 1 AND bc.n2 >= 2 THEN log10(bc.n2 / b1.n1) + CASE WHEN i > 2 THEN log10(0.4) ELSE 0 END
         ELSE log10(w1.n1 / (SELECT count(*) FROM t)) + CASE WHEN i > 2 THEN 2 WHEN i > 1 THEN 1 ELSE 0 END * log10(0.4)
    END AS x,
    CASE WHEN i > 2 THEN n3 >= 2 WHEN i > 1 THEN bc.n2 >= 2 ELSE true END AS longest
  FROM g JOIN c1 w1 ON w1.c = g.c LEFT JOIN c1 b1 ON b1.c = g.b
  LEFT JOIN c2 bc ON bc.b = g.b AND bc.c = g.c
  LEFT JOIN c2 ab ON ab.b = g.a AND ab.c = g.b
  LEFT JOIN c3 ON c3.a = g.a AND c3.b = g.b AND c3.c = g.c
),
e AS (SELECT r, count(*) AS n, sum(x) AS x, count(*) FILTER (longest) AS l FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(x, 0), 6) AS log10_sum, round(x / n, 6) AS log10_mean,
       coalesce(l, 0)::BIGINT AS n_longest, coalesce(n - l, 0)::BIGINT AS n_backed_off
FROM d LEFT JOIN e ON d.r = e.r
""",
)
def op7_lm_scores(spark, sf_dir):
    scores = lm_scores.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log10_sum", "log10_mean")})


@query("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op5_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
v AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS x
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
m AS (SELECT x, min(doc_id) AS least FROM v GROUP BY x),
c AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM v JOIN m USING (x) WHERE least < doc_id
),
k AS (
  SELECT d.r, t.i, t.c FROM d, LATERAL (SELECT unnest(w) AS c, generate_subscripts(w, 1) AS i) t
  WHERE (d.r, t.i) NOT IN (SELECT (r, i) FROM c)
),
j AS (SELECT r, string_agg(c, ' ' ORDER BY i) AS kept, count(*) AS n FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON d.r = j.r
""",
)
def op5_substring_dedup(spark, sf_dir):
    kept = substring_dedup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identified(docs).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))


@query("op1_near_vectors")
def op1_near_vectors(spark, sf_dir):
    return near_vectors.linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    files = license_scan.as_files(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return license_scan.scanned(files).drop("text", "source")


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    rows = token_alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


@query(
    "op11_suffix_dedup",
    r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS r FROM documents
),
v AS (
  SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS x
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)
),
m AS (SELECT x FROM v GROUP BY x HAVING count(*) > 1),
p AS (SELECT r, i FROM v JOIN m USING (x)),
e AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p),
s AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT r, i, sum(CASE WHEN before >= i - 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM e)
  GROUP BY r, k
),
g AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS low FROM s),
k AS (
  SELECT d.r, any_value(d.h) AS h, count(g.a) AS n_spans, coalesce(sum(g.b - g.a), 0) AS n_removed,
         coalesce(string_agg(substr(d.h, 2 * g.low + 1, 2 * (g.a - g.low)), '' ORDER BY g.a), '')
           || substr(any_value(d.h), 2 * coalesce(max(g.b), 0) + 1) AS kept
  FROM d LEFT JOIN g ON d.r = g.r GROUP BY d.r
)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k ON d.r = k.r
""",
)
def op11_suffix_dedup(spark, sf_dir):
    kept = byte_dedup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op12_collocations",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
),
s AS (
  SELECT k.lang, k.phrase, k.a, k, h.f AS l, t.f AS r, n.n, (1000 * k.a * n.n) // (h.f * t.f) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = head JOIN f t ON t.lang = k.lang AND t.phrase = tail
  JOIN n ON n.lang = k.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT b.* FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND 100 * c.a >= 100 * b.a AND len(c.w) > len(string_split(b.phrase, ' '))
      AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
  )
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
WHERE rank <= 2000
""",
)
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
