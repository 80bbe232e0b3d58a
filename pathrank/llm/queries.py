"""The queries of this subpackage: each applies an operator to a whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.llm.common import table


def op8_log_structured_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.window_index import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.labelled import remainder
    from pathrank.llm.quality import THRESHOLD, fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder(4) != 2))
    return score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pathrank.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op1_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked", "links", "links_before", "links_after")


def op2_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.labelled import remainder
    from pathrank.llm.toxicity import THRESHOLD, fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(3) != 1))
    return score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op3_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.suffix_repeats import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.spotsigs import edited, fingerprint, likeness

    found = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def op5_rare_word_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_union("base_labels", "found_labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.decontaminate import digest, find

    return digest(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.simhash import groups

    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.main_text import judged

    return judged(table(spark, sf_dir, "pages"))


def op13_run_length_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathrank.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_balanced_label_propagation": op1_balanced_label_propagation,
    "op2_multiple_instance_toxicity": op2_multiple_instance_toxicity,
    "op3_maximal_repeats": op3_maximal_repeats,
    "op4_spot_signatures": op4_spot_signatures,
    "op5_rare_word_licenses": op5_rare_word_licenses,
    "op6_fm_index_decontamination": op6_fm_index_decontamination,
    "op7_golay_simhash": op7_golay_simhash,
    "op8_log_structured_windows": op8_log_structured_windows,
    "op9_random_indexing_quality": op9_random_indexing_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_filter_transducer": op11_filter_transducer,
    "op12_host_suffix_array": op12_host_suffix_array,
    "op13_run_length_divergence": op13_run_length_divergence,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op6_fm_index_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::varchar AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_log_structured_windows": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (g) WHERE doc_id > first),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT doc_id, count(r.k) AS n_removed, string_agg(word, ' ' ORDER BY e.k) FILTER (r.k IS NULL) AS kept FROM e LEFT JOIN r USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op11_filter_transducer": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
x(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.a || q.a || r.a || s.a || t.a AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
g AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (SELECT filter_order, step, c.*, substr(filter_order, step, 1) AS letter, contains(fails, substr(filter_order, step, 1)) AS fails_own, translate(fails, substr(filter_order, 1, step - 1), '') <> fails AS gone FROM g, c),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND fails_own THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_own THEN bad ELSE 0 END) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM r""",
    "op13_run_length_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
s AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN s USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM k),
l AS (SELECT lang, term, sum(n) AS n FROM k GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 50)
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM r""",
}
