"""Further library queries bound to the driver's tables: word lookup, previews, marks, merges and document structure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import display_key, lookup_word
from ..operators import documents, library, store
from ..sources import blocks
from .registry import query, table


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS seq FROM conversations)
SELECT conv_id, turn, 'G' || (strlen(word) % 7) AS strong, min(seq) AS seq FROM w WHERE list_contains(string_split_regex(lower(word), '[^\\p{L}\\p{N}]'), 'the') GROUP BY 1, 2, 3""")
def strongs_for_word(spark, d):
    verses = table(spark, d, "conversations").select("conv_id", "turn", "text")
    words = verses.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "word")).withColumn("size", F.octet_length("word"))
    before = Window.partitionBy("conv_id", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    links = words.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int")).withColumn("ref_end", F.col("start") + F.col("size"))
    links = links.select("conv_id", "turn", (F.col("at") + 1).cast("long").alias("seq"), "start", "ref_end", F.concat(F.lit("G"), (F.col("size") % 7).cast("string")).alias("strong"))
    return library.strongs_for_word(links, verses, ["conv_id", "turn"], F.lit("The")).select("conv_id", "turn", "strong", "seq")


@query("SELECT turn AS verse, turn BETWEEN 2 AND 3 AS marked FROM conversations WHERE conv_id = 5 AND turn >= 1 ORDER BY turn")
def passage_preview(spark, d):
    rows = table(spark, d, "conversations").withColumnRenamed("turn", "verse")
    return library.preview(rows, {"conv_id": 5}, 2, 3).select("verse", "marked")


@query("SELECT p_brand AS book, p_partkey AS chapter, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 8 AS row_no FROM part")
def selector_rows(spark, d):
    spine = table(spark, d, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("chapter"))
    return library.selector_rows(spine, 8).select("book", "chapter", F.col("row").cast("long").alias("row_no"))


@query("SELECT conv_id, turn, role, b.book FROM (SELECT conv_id, turn, role, conv_id % 50 AS chapter, length(text) % 20 AS verse FROM conversations) n JOIN (SELECT doc_id % 50 AS chapter, n_chars % 20 AS verse, max(doc_id) AS book FROM documents GROUP BY 1, 2) b USING (chapter, verse)")
def located_notes(spark, d):
    notes = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") % 50).alias("chapter"), (F.length("text") % 20).cast("long").alias("verse"))
    verses = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("chapter"), (F.col("n_chars") % 20).alias("verse"), F.col("doc_id").alias("book"))
    return library.last_place(notes, verses).select("conv_id", "turn", "role", "book")


@query("""SELECT conv_id, role, max(turn) AS verse_end, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""")
def commentary_merge(spark, d):
    rows = table(spark, d, "conversations").select(F.col("role").alias("code"), F.lit(0).alias("book"), F.col("conv_id").alias("chapter"), F.lit(0).alias("verse_start"), F.col("turn").alias("verse_end"), F.col("turn").alias("pos"), F.lit(None).cast("string").alias("heading"), "text")
    return store.merged_entries(rows).select(F.col("chapter").alias("conv_id"), F.col("code").alias("role"), "verse_end", "text")


@query("SELECT p_partkey, CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 'G' || p_partkey ELSE k END AS display FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS k FROM part)")
def display_keys(spark, d):
    key = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    return table(spark, d, "part").select("p_partkey", display_key(key, F.col("p_partkey")).alias("display"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS seq FROM documents)
SELECT doc_id, seq, nullif(regexp_replace(word, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'), '') AS word FROM w""")
def lookup_words(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    return words.select("doc_id", (F.col("at") + 1).cast("long").alias("seq"), lookup_word(F.col("word")).alias("word"))


@query("""WITH k AS (SELECT user_id AS key, max(event_type) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS key, min(event_type) AS value FROM events WHERE user_id % 3 = 0 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM k WHERE key NOT IN (SELECT key FROM n)""")
def kv_upsert(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "key")
    old = e.filter("key % 2 = 0").groupBy("key").agg(F.max("event_type").alias("value"))
    return store.set_keys(old, e.filter("key % 3 = 0").groupBy("key").agg(F.min("event_type").alias("value")))


@query("""WITH v AS (SELECT l_orderkey % 5 AS doc_id, l_orderkey AS chapter, l_linenumber AS verse, bool_or(l_discount > 0.00) AS paragraph FROM lineitem GROUP BY 1, 2, 3),
i AS (SELECT *, lag(verse) OVER (PARTITION BY doc_id, chapter ORDER BY verse) IS NOT NULL AS inner_one FROM v), r AS (SELECT doc_id, count(*) FILTER (WHERE inner_one) AS n, count(*) FILTER (WHERE inner_one AND paragraph) AS f FROM i GROUP BY 1)
SELECT doc_id, count(*) FILTER (WHERE paragraph AND NOT (n >= 20 AND f * 10 >= n * 9)) AS flagged FROM v JOIN r USING (doc_id) GROUP BY 1""")
def paragraph_flags(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("doc_id"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("verse")).agg(F.bool_or(F.col("l_discount") > 0).alias("paragraph"))
    return documents.settled_paragraphs(rows).groupBy("doc_id").agg(F.count_if("paragraph").alias("flagged"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), w AS (SELECT doc_id, pos // 5 AS page, unnest(string_split(t, ' ')) AS w, unnest(range(0, len(string_split(t, ' ')))) AS i FROM s),
f AS (SELECT doc_id, page, i % 7 * 100 + length(w) AS x, 6 * length(w) AS width FROM w), b AS (SELECT DISTINCT doc_id, page, unnest(generate_series(x // 4, (x + width) // 4)) AS b FROM f),
g AS (SELECT doc_id, page, b, lead(b) OVER (PARTITION BY doc_id, page ORDER BY b) AS n FROM b) SELECT doc_id, page, CAST((arg_max(b, (n - b, -b)) + 1) * 4 AS DOUBLE) AS gutter_from, CAST(arg_max(n, (n - b, -b)) * 4 AS DOUBLE) AS gutter_to FROM g WHERE n > b + 1 GROUP BY 1, 2""")
def page_gutters(spark, d):
    """The widest gap of every page of five lines, whose words stand in seven columns."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).select("doc_id", F.expr("bigint(pos div 5)").alias("page"), F.posexplode(F.split("t", " ")).alias("i", "w"))
    return documents.gutter(words.select("doc_id", "page", F.expr("double(i % 7 * 100 + length(w))").alias("x"), F.expr("double(6 * length(w))").alias("width")))


@query()
def block_histogram(spark, d):
    return blocks.pages(table(spark, d, "pages")).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(make_date(2024, month(o_orderdate), day(o_orderdate)) + 1, '%Y-%m-%d') AS next_day FROM orders")
def devotional_walk(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(day.cast("string").alias("day"), F.date_add(F.make_date(F.lit(2024), F.month(day), F.day(day)), 1).cast("string").alias("next_day")).distinct()
