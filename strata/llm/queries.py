"""Registered queries of the operators: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


@register("op1_decontamination", sql=r"""
WITH it AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM it WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT pos.doc_id, pos.k, pos.i, win.item_id FROM pos JOIN win USING (g, k)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op8_url_filters", sql=r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN host = '' AND path = '' THEN 'block'
    WHEN contains('.' || host, '.casino') OR contains('.' || host, '.adult.') OR contains('.' || host, '.ads.')
      OR contains('.' || host, '.tracker.') OR starts_with(path, '/login') OR contains(path, '/wp-admin/')
      OR contains(path, '/cart/') OR path LIKE '%.exe' OR path LIKE '%.zip' OR path LIKE '%.jpg'
      OR path LIKE '%.png' THEN 'block' ELSE 'allow' END AS verdict
FROM r
""")
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.url_filter import UrlRule, filter_urls

    rules = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"),
             UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"),
             UrlRule("block", "com", "/de/"))
    return filter_urls(table(spark, sf_dir, "pages"), rules)


@register("op9_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels, learn=~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.pii import mask_pii

    key = os.environ.get("STRATA_PII_KEY", "demonstration key, set your own").encode()
    return mask_pii(table(spark, sf_dir, "documents"), key)


@register("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs))


@register("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.pieces import encode, load_vocabulary

    docs = table(spark, sf_dir, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    back = encode(docs.withColumn("text_sha256", sha), load_vocabulary(), carry=("text_sha256",), decoded="decoded")
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.xxhash64("ids").alias("ids_hash"), "text_sha256",
                       (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.lm import score_lm

    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    out = score_lm(table(spark, sf_dir, "documents"), learn=remainder != 2, delete=remainder == 3)
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


@register("op7_ngram_jaccard")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op12_fill_in_middle", sql=r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, coalesce(array_to_string(w[1:least(a, b)], ''), '') AS pre,
         coalesce(array_to_string(w[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
         coalesce(array_to_string(w[greatest(a, b) + 1:], ''), '') AS suf
  FROM k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.fim import fill_in_middle, restore

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op11_merkle_manifest", sql=r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1),
              lambda i: [ord(s[i]), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                             ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS crc
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
w AS (
  SELECT doc_id, lang, crc, n_chars,
         coalesce(strlen(s) || ':' || s, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS d,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
              THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS seen
  FROM w),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaf),
up AS (
  SELECT lang, 0 AS lv, i, n, d FROM pos
  UNION ALL
  SELECT lang, lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY lang, lv, i // 2),
sub AS (
  SELECT lang, d, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lv, i, n, d FROM sub
  UNION ALL
  SELECT lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY lv, i // 2),
walk AS (
  SELECT pos.doc_id, pos.lang, pos.d AS leaf, pos.i, 0 AS lv, pos.n, false AS high, coalesce(seen, pos.d) AS f,
         '' AS proof
  FROM pos
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, CASE WHEN w.n = 1 THEN sub.i ELSE w.i // 2 END,
         CASE WHEN w.n = 1 THEN 0 ELSE w.lv + 1 END, CASE WHEN w.n = 1 THEN sub.n ELSE (w.n + 1) // 2 END,
         w.high OR w.n = 1,
         CASE WHEN w.n = 1 THEN w.f WHEN w.i % 2 = 1 THEN sha256(coalesce(b.d, t.d, '') || w.f)
              ELSE sha256(w.f || coalesce(b.d, t.d, '')) END,
         CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || coalesce(b.d, t.d, '') END
  FROM walk w
  LEFT JOIN (SELECT * FROM up) b ON NOT w.high AND b.lang IS NOT DISTINCT FROM w.lang AND b.lv = w.lv AND b.i = xor(w.i, 1)
    AND w.n > 1
  LEFT JOIN top t ON w.high AND t.lv = w.lv AND t.i = xor(w.i, 1)
  JOIN sub ON sub.lang IS NOT DISTINCT FROM w.lang
  WHERE NOT (w.high AND w.n = 1))
SELECT walk.doc_id, leaf, sub.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root,
       f = r.d AS verified
FROM walk JOIN sub ON sub.lang IS NOT DISTINCT FROM walk.lang
JOIN (SELECT d FROM top WHERE n = 1) r ON walk.high AND walk.n = 1
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.merkle import merkle_manifest, proof_digest

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    longer = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    out = merkle_manifest(table(spark, sf_dir, "documents"), observed={"n_chars": longer})
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                      "folded_root", "verified")


@register("op13_substring_dedup", sql=r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word ANTI JOIN cov ON cov.doc_id = word.doc_id AND cov.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.windows import remove_repeated_windows

    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
