"""The registered queries of this subpackage: thin bindings of the operators to the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import SHARE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS g FROM w WHERE len(ws) >= 50),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS m FROM h) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM d, (SELECT unnest(range(0, 50)) AS o)),
k AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference_format import conversations, format_preferences, mismatched_pairs

    rows = format_preferences(mismatched_pairs(conversations(table(spark, sf_dir, "conversations"))))
    masks = [F.expr(f"array_join(transform({c}, m -> concat(m.start, '-', m.end)), ',')").alias(c) for c in ("chosen_mask", "rejected_mask")]
    return rows.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", *masks, "degenerate")


OP3_SQL = """
WITH t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS n FROM t),
e AS (SELECT conv_id, turns[1:n] AS c, turns[n] AS reply FROM l WHERE n IS NOT NULL),
x AS (SELECT conv_id, c, coalesce(lead(reply) OVER (ORDER BY conv_id), first(reply) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM e),
y AS (SELECT conv_id, c, list_append(c[1:len(c) - 1], other) AS r, len(c) - 1 + CASE WHEN c[len(c)] IS NOT DISTINCT FROM other THEN 1 ELSE 0 END AS n FROM x),
z AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM y)
SELECT conv_id, CAST(n AS BIGINT) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  CASE WHEN len(c) = 0 THEN '' ELSE '14-' || (length(c[1].text) + 22) END AS chosen_mask,
  CASE WHEN len(r) = 0 THEN '' ELSE '14-' || (length(r[1].text) + 22) END AS rejected_mask,
  len(c) = 0 OR len(r) = 0 AS degenerate FROM z
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import cut
    from .training_order import in_training_order, shard_folder, write_shards

    pieces = in_training_order(table(spark, sf_dir, "documents"), word_tokenizer(), key=20240607)
    return cut(write_shards(pieces, shard_folder(spark), word_tokenizer()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = fit(docs.filter(remainder != 2))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import fit, predict

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    net = fit(docs, table(spark, sf_dir, "labels").filter(remainder != 0))
    return predict(docs, net).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .outlier_rules import judge

    rows = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset_fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    rows = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), share=SHARE)
    return rows.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def _op8_sql(rounds: int = 10, share: float = SHARE, powers: tuple[float, ...] = (0.7, 0.8, 0.9), seed: str = "mix") -> str:
    """The same raking, one common table expression for each step."""
    margins = ("source", "lang", "topic")
    steps, last = [], "r0"
    for i in range(rounds):
        for m in margins:
            steps.append(f"r{i}{m} AS (SELECT c.source, c.lang, c.topic, c.tokens, c.w * t.t * (SELECT sum(tokens) FROM cells) / sum(c.w) OVER (PARTITION BY c.{m}) AS w FROM {last} c JOIN t_{m} t ON c.{m} IS NOT DISTINCT FROM t.{m})")
            last = f"r{i}{m}"
    targets = [f"t_{m} AS (SELECT {m}, pow(sum(tokens), {p}) / (SELECT sum(p) FROM (SELECT pow(sum(tokens), {p}) AS p FROM cells GROUP BY {m})) AS t FROM cells GROUP BY {m})" for m, p in zip(margins, powers, strict=True)]
    return rf"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
n AS (SELECT doc_id, source, lang, tokens, tokens / (1 + length(text) - length(replace(text, chr(10), ''))) AS per, CASE WHEN per < 8 THEN 'list' WHEN per < 40 THEN 'prose' ELSE 'block' END AS topic FROM d),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM n GROUP BY 1, 2, 3 HAVING sum(tokens) > 0), {", ".join(targets)},
r0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells), {", ".join(steps)},
g AS (SELECT *, w / tokens AS weight, (SELECT sum(tokens) FROM cells) AS whole FROM {last}),
o AS (SELECT *, (whole * {share} - whole + sum(tokens) OVER onward) / sum(w) OVER onward AS own FROM g WINDOW onward AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT source, lang, topic, weight, round(least(1.0, weight * (SELECT max(own) FROM o)), 9) AS probability FROM o),
j AS (SELECT n.doc_id, n.source, n.lang, n.topic, n.tokens, coalesce(weight, 1) AS weight, coalesce(probability, 1) AS probability FROM n LEFT JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.lang IS NOT DISTINCT FROM f.lang AND n.topic = f.topic)
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability FROM j
WHERE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < probability
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT g.lang, coalesce(sum(total), 0) AS n, count(total) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + l.v) AS HUGEINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS HUGEINT) AS q
  FROM t JOIN l ON l.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import fit, whiten

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(rows, fit(rows))


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metric_join import range_join

    return range_join(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_preference_format": op3_preference_format,
    "op4_ngram_join": op4_ngram_join,
    "op5_training_order": op5_training_order,
    "op6_multiset_fingerprint": op6_multiset_fingerprint,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_metric_join": op13_metric_join,
}
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op3_preference_format": OP3_SQL, "op8_mixing": _op8_sql(), "op11_source_divergence": OP11_SQL}
