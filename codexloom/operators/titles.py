"""Book names inside titles, by one join of all short word sequences with the table of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import book_key
from ..session import cut

# Endings that a name may carry, in order.
SUFFIXES = ("brief", "briefes", "-Brief", "evangelium", "buch")
#: Names up to which their table is broadcast; a larger one is joined by a shuffle.
MOST_NAMES = 100_000


def name_table(spark, names: dict[str, int]) -> DataFrame:
    """key, book from normalised names."""
    return spark.createDataFrame(list(names.items()), "key string, book int")


def book_in_title(titles: DataFrame, key: list[str], text: str, names: DataFrame) -> DataFrame:
    """``titles`` with ``book``: the leftmost, and there the longest, of all sequences of one to three words that is a name, with or without
    an ending; null where none is. Words are letters, digits and dots. ``key`` tells titles apart; null texts have no words.
    """
    words = titles.select(*key, F.expr(rf"filter(split({text}, '[^\\p{{L}}\\p{{N}}.]+'), w -> w <> '')").alias("_w")).filter("size(_w) > 0")
    grams = words.select(*key, "_w", F.explode(F.expr("sequence(0, size(_w) - 1)")).alias("_i")).select(*key, "_i", F.explode(F.expr("transform(sequence(1, least(3, size(_w) - _i)), n -> struct(n, array_join(slice(_w, _i + 1, n), ' ') as t))")).alias("_g"))
    cut_off = ", ".join(f"if(endswith(_g.t, '{s}'), regexp_replace(left(_g.t, length(_g.t) - {len(s)}), '-+$', ''), null)" for s in SUFFIXES)
    forms = grams.select(*key, "_i", "_g.n", F.posexplode(F.expr(f"array(_g.t, {cut_off})")).alias("_f", "_t")).filter("_t is not null").withColumn("_key", book_key(F.col("_t")))
    names = names.select(F.col("key").alias("_key"), "book")
    names = F.broadcast(names) if names.count() <= MOST_NAMES else cut(names)
    found = forms.join(names, "_key").groupBy(*key).agg(F.min_by("book", F.struct("_i", -F.col("n"), "_f")).alias("book"))
    return titles.join(found, key, "left")
