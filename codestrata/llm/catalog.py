"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog.base import Registry
from ..session import read_table
from . import (bpe, decontaminate, jaccard_join, lexical_search, periodic_runs, ppm, quality_model, quality_rules, sharding,
               substrings, token_counts, toxicity, warc)
from .common import crc_mod

R = Registry()

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """Place of the public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@R.query("op1_jaccard_join")
def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.join_documents(read_table(spark, sf_dir, "documents"), width=4, percent=85)


@R.query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_mod("doc_id", 5) != 0)
    return toxicity.score_documents(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@R.query("op3_bpe_encoding")
def op3_bpe_encoding(spark, sf_dir):
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary())


@R.query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    got = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "distance")


@R.query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return token_counts.count_pieces(read_table(spark, sf_dir, "documents"), vocabulary())


@R.query("op6_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM w, unnest(generate_series(1, len(words) - 12)) AS t(i)),
low AS (SELECT win, min(doc_id) AS least FROM win GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM win JOIN low USING (win), unnest(generate_series(0, 12)) AS t(k) WHERE least < doc_id),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at) AS kept, count(*) AS n FROM pos p
         LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at WHERE g.at IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""")
def op6_substring_dedup(spark, sf_dir):
    return substrings.digests(read_table(spark, sf_dir, "documents"))


@R.query("op7_ppm_scoring")
def op7_ppm_scoring(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    scored = ppm.score_documents(docs, crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@R.query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@R.query("op9_extendible_sharding", f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
           CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT d.*, k AS depth, h >> (60 - k) AS prefix FROM d, unnest(generate_series(0, 24)) AS t(k)),
sums AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM lv GROUP BY ALL),
best AS (SELECT lv.*, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY lv.depth) AS rn
         FROM lv JOIN sums USING (depth, prefix) WHERE shard_bytes <= {sharding.LIMIT})
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, prefix, CAST(shard_bytes AS BIGINT) AS shard_bytes, true AS fits
FROM best WHERE rn = 1""")
def op9_extendible_sharding(spark, sf_dir):
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


@R.query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels, crc_mod("doc_id", 4) != 2)
    return quality_model.score_documents(docs, model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@R.query("op11_salvage_warc", f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, CASE WHEN payload_bytes >= {warc.SHARED_FROM} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM h""")
def op11_salvage_warc(spark, sf_dir):
    return warc.page_rows(warc.round_trip(read_table(spark, sf_dir, "pages")))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS_OF = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"


@R.query("op12_lexical_search", f"""
WITH t AS (SELECT doc_id, {_TERMS_OF} AS term FROM documents), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, {_TERMS_OF} AS term FROM benchmark),
score AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                 * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
          FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= {lexical_search.BEST}""")
def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@R.query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_planted_periods(read_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))
