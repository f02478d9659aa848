"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, idfiles, language, merkle, minhash, packing, pieces, pii, quality_crf, rules, shards, substrings, whitening

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM tri),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
                 + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
                 + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                 + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END
                 + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed,
       failed & 3 <> 0 AS base_failed, failed & 15 = 0 AS kept
FROM b
"""


@query("op7_quality_rules", RULES_SQL)
def op7_quality_rules(spark, sf_dir):
    rows = rules.ledger(documents(spark, sf_dir))
    return rows.select("*", (~rules.passes(rules.BASE)).alias("base_failed"),
                       rules.passes(rules.POLICIES["v1"]).alias("kept"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(pieces)


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(language.remainder("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    return language.predict(docs, model).withColumn("held_out", held_out)


@query("op1_balanced_shards")
def op1_balanced_shards(spark, sf_dir):
    return shards.shard_documents(documents(spark, sf_dir))


@query("op10_pii_spans")
def op10_pii_spans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return pii.report(docs, pii.train(docs))


@query("op2_nearest_vectors")
def op2_nearest_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.nearest(table, table.where("vec_id % 20 = 0"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(language.remainder("doc_id", 5) == 0, F.lit(False))
    model = quality_crf.train(docs, labels.where(~held_out))
    return quality_crf.score(docs, model).withColumn("held_out", held_out)


@query("op9_sentence_pieces")
def op9_sentence_pieces(spark, sf_dir):
    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) > 1)
  UNION ALL SELECT doc_id, words[1] FROM w WHERE len(words) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT * FROM s JOIN n USING (doc_id)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sn a JOIN sn b USING (shingle)
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.y, r.c FROM r JOIN links ON links.x = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op4_near_duplicates", NEAR_SQL)
def op4_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), size=2)


PASSAGES_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE first < doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) x
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op3_substring_dedup", PASSAGES_SQL)
def op3_substring_dedup(spark, sf_dir):
    return substrings.report(documents(spark, sf_dir))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS slot, text,
         concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id, coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'),
                coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
             lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT doc_id, source, slot, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(after) || ':' || after, '-')) AS changed
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS after FROM d)),
t AS (
  SELECT source, 0 AS lvl, slot, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT source, lvl + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), any_value((n + 2) // 3)
  FROM t WHERE n > 1 GROUP BY source, lvl, slot // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, slot, h, n FROM s
  UNION ALL
  SELECT lvl + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), any_value((n + 2) // 3)
  FROM u WHERE n > 1 GROUP BY lvl, slot // 3),
p AS (
  SELECT doc_id, string_agg(h, '' ORDER BY lvl, slot) AS proof FROM (
    SELECT l.doc_id, t.lvl, t.slot, t.h FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1
      AND t.slot // 3 = l.slot // CAST(3 ** (t.lvl + 1) AS BIGINT) AND t.slot <> l.slot // CAST(3 ** t.lvl AS BIGINT)
    UNION ALL
    SELECT l.doc_id, u.lvl + 100, u.slot, u.h FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN u ON u.n > 1
      AND u.slot // 3 = s.slot // CAST(3 ** (u.lvl + 1) AS BIGINT) AND u.slot <> s.slot // CAST(3 ** u.lvl AS BIGINT))
  GROUP BY doc_id),
f AS (
  SELECT doc_id, source, 0 AS lvl, slot, changed AS h FROM l
  UNION ALL
  SELECT f.doc_id, any_value(f.source), f.lvl + 1, f.slot // 3,
         sha256(string_agg(CASE WHEN t.slot = f.slot THEN f.h ELSE t.h END, '' ORDER BY t.slot))
  FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.slot // 3 = f.slot // 3 AND t.n > 1
  GROUP BY f.doc_id, f.lvl, f.slot),
v AS (
  SELECT doc_id, 0 AS lvl, s.slot, f.h FROM (SELECT doc_id, source, arg_max(h, lvl) AS h FROM f GROUP BY doc_id, source) f
  JOIN s ON s.source IS NOT DISTINCT FROM f.source
  UNION ALL
  SELECT v.doc_id, v.lvl + 1, v.slot // 3, sha256(string_agg(CASE WHEN u.slot = v.slot THEN v.h ELSE u.h END, '' ORDER BY u.slot))
  FROM v JOIN u ON u.lvl = v.lvl AND u.slot // 3 = v.slot // 3 AND u.n > 1 GROUP BY v.doc_id, v.lvl, v.slot),
folded AS (SELECT doc_id, arg_max(h, lvl) AS folded_root FROM v GROUP BY doc_id)
SELECT l.doc_id, leaf, s.h AS subroot, r.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN folded USING (doc_id) LEFT JOIN p USING (doc_id)
JOIN (SELECT h FROM u WHERE n = 1) r ON true
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(documents(spark, sf_dir), tampered=merkle.without_line_breaks())


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op11_token_files")
def op11_token_files(spark, sf_dir):
    return idfiles.stored(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
