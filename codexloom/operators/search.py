"""Lexical search: Okapi BM25 over folded tokens, and ranked dictionary search.

A query touches only its own terms, so the texts are folded and cut into words once, and only words that can have a query
term as their token are looked at further. What comes out, a row of counts per document, goes to a table of its own, from which
both the corpus statistics (count, average length, document frequencies; one row) and the scores are read. Nothing is
exploded or shuffled by term. The index tables are there for inspection and for many queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical, fold, forms, tokens, words
from ..session import cut

K1, B = 1.5, 0.75
#: Repeated keys up to which they are broadcast.
MOST_REPEATED = 100_000


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens, len of all rows, empty texts too."""
    return docs.select(F.col(key), tokens(F.col(text)).alias("tokens")).withColumn("len", F.size("tokens").cast("long"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, len: a token for each word."""
    return docs.select(F.col(key), F.size(words(F.col(text))).cast("long").alias("len"))


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Terms are counted inside each row; only rows that share a key go on to a shuffle."""
    counted = lambda rows: rows.select(F.col(key), F.explode(_counts(tokens(F.col(text)))).alias("_c")).select(key, "_c.term", "_c.tf")
    repeated = cut(docs.groupBy(F.col(key).alias("_k")).count().filter("count > 1").select("_k"))
    n = repeated.count()
    if not n:
        return counted(docs)
    again = docs[key].eqNullSafe(repeated["_k"])
    few = F.broadcast(repeated) if n <= MOST_REPEATED else repeated
    shared = counted(docs.join(few, again, "left_semi")).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return counted(docs.join(few, again, "left_anti")).unionByName(shared)


def _counts(terms: Column) -> Column:
    """Each different term of an array and how often it is there: terms in order lie in runs."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda p: F.transform(p, lambda x, j: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(p, j + 1), F.size(s)) - x).cast("long").alias("tf")))
        return F.when(F.size(s) > 0, F.get(F.transform(F.array(starts), run), F.lit(0)))

    return F.get(F.transform(F.array(F.sort_array(terms)), runs), F.lit(0))


def _distinct(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(words(text)), canonical))


def document_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct terms are found inside each row, so only (term, 1) is shuffled, combined on the map side."""
    return docs.select(F.explode(_distinct(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def index_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One pass: each document's first row carries its length, and documents without terms have the null term."""
    read = docs.select(F.transform(F.array(words(F.col(text))), lambda w: F.struct(F.size(w).cast("long").alias("len"), F.array_distinct(F.transform(F.array_distinct(w), canonical)).alias("terms"))).alias("_d"))
    rows = read.select(F.explode("_d").alias("d")).select("d.len", F.posexplode_outer("d.terms").alias("pos", "term"))
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    terms = rows.groupBy("term").agg(F.count("*").alias("n"), F.count_if(head).alias("docs"), F.sum(F.when(head, F.col("len")).otherwise(0)).alias("len"))
    known = F.col("term").isNotNull()
    total = F.coalesce(F.sum("docs"), F.lit(0))
    return terms.agg(total.alias("n_docs"), F.coalesce(F.try_divide(F.sum("len"), total), F.lit(0.0)).alias("avg_len"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_postings"), F.count("term").alias("n_terms"))


def query_terms(docs: DataFrame, query: str) -> list[str]:
    """The query's tokens, with multiplicity, folded by the same expression as the documents."""
    row = docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("q")).first()
    return list(row["q"])


def scores(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key and score of every row; terms count as often as the query has them, in the query's order."""
    terms = query_terms(docs, query)
    distinct = list(dict.fromkeys(terms))
    wanted = sorted({w for t in distinct for w in forms(t)}) or [""]
    known = lambda w: F.struct(F.size(w).cast("long").alias("len"), F.transform(F.filter(w, lambda x: x.isin(*wanted)), canonical).alias("hits"))
    read = docs.select(F.col(key), F.explode(F.transform(F.array(words(F.col(text))), known)).alias("_d"))
    count = lambda t: F.size(F.filter("_d.hits", lambda x: x == F.lit(t))).cast("double")
    base = cut(read.select(key, F.col("_d.len").alias("len"), *[count(t).alias(f"tf{i}") for i, t in enumerate(distinct)]))
    stats = base.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(distinct))])
    mean = F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0)

    def weight(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))).otherwise(0.0)

    total = F.lit(0.0)
    for t in terms:
        total = total + weight(distinct.index(t))
    return base.crossJoin(F.broadcast(stats)).select(key, total.alias("score"))  # stats is one row


def top_hits(docs: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """The k best positive scores; ties in key order. Scores are rounded to 6 digits before they are ranked."""
    ranked = scores(docs, key, text, query).withColumn("score", F.round("score", 6)).filter("score > 0")
    return ranked.orderBy(F.desc("score"), F.asc(key)).limit(k)


def dictionary_search(entries: DataFrame, query: str, limit: int, strip_g: bool = False) -> DataFrame:
    """Ranked search of (sort, key, headword, pron, text): rank 0 for a match of headword, pronunciation or key, rank 1
    where the text has all the query's tokens, by how many of its tokens match; then by sort."""
    needle = query.strip()
    if strip_g:
        needle = needle.lstrip("gG")
    needle = needle.lower()
    terms = list(dict.fromkeys(query_terms(entries, needle)))
    low = F.lit(needle)
    direct = F.contains(F.lower("headword"), low) | F.contains(F.lower(F.coalesce("pron", F.lit(""))), low) | (F.ltrim(F.col("key"), F.lit("0")) == F.ltrim(low, F.lit("0")))
    rows = entries.withColumn("_tokens", tokens(F.col("text")))
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    matches = F.size(F.filter("_tokens", lambda t: F.array_contains(wanted, t)))
    every = F.forall(wanted, lambda t: F.array_contains("_tokens", t)) & F.lit(bool(terms))
    ranked = rows.withColumn("rank", F.when(direct, 0).when(every, 1)).filter(F.col("rank").isNotNull() & F.lit(bool(needle)))
    ranked = ranked.withColumn("matches", F.when(F.col("rank") == 1, matches).otherwise(0).cast("long"))
    return ranked.orderBy("rank", F.desc("matches"), "sort").limit(limit).drop("_tokens")


__all__ = ["dictionary_search", "document_frequencies", "fold", "index_stats", "lengths", "scores", "term_frequencies", "tokenized", "top_hits"]
