"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells (source, language, topic). Raking scales the cells' token totals to each of the three
marginals in turn; a window sum per marginal is one such step, over the table of cells, whose size is the number
of different cells. A cell's factor is its raked total over its own; a document is drawn with a probability that
follows its cell's factor. The draw is a hash of doc_id and the seed, so it repeats.

With a share, the probability is least(1, c * factor), c such that the expected tokens are that share of all tokens in
cells. A cell whose factor is 1 / c or more keeps each of its documents once, none twice; what it falls short of its
raked total goes to the other cells in proportion to theirs, so the raked proportions hold exactly among those.
Raking goes on until a round changes no cell by more than 1e-6 of its value (``rake``).
Without a share the largest factor gives 1: all cells keep the raked proportions, but the rarest cell decides how
much is kept, and nothing bounds that from below.

Defined results: null source, lang or topic is a value like any other; null text has no tokens, and a cell without
tokens gets factor 1; rows that share a doc_id are drawn together; null doc_id draws as the empty id; an empty table
gives an empty result; other columns pass through unless they carry the name of a result, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MARGINS = ("source", "lang", "topic")
#: The part of all tokens that op8_mixing and the pipeline draw.
SHARE = 0.5


def text_form(text: str = "text") -> Column:
    """A topic by layout: words a line, of ``list`` (under 8), ``prose`` (under 40) or ``block``."""
    per_line = "_tokens / (1 + length(coalesce({0}, '')) - length(replace(coalesce({0}, ''), '\\n', '')))".format(text)
    return F.expr(f"case when {per_line} < 8 then 'list' when {per_line} < 40 then 'prose' else 'block' end")


def tokens_of(text: str = "text") -> Column:
    return F.expr(f"cast(size(filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')) as long)")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """The default target of a marginal: each value's tokens to a power below 1, which lifts small values."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, powers: dict[str, float], rounds: int = 10, every: int = 5, settled: float = 1e-6, most: int = 100) -> DataFrame:
    """Adds ``raked`` to cells (source, lang, topic, tokens > 0). Targets are shares in proportion to tokens^power.

    At least ``rounds`` rounds, then ``every`` more at a time until the last one has changed no cell by more than
    ``settled`` of its value. Empty cells can make targets that contradict each other and never settle: after ``most``
    rounds the cells stand as they are, with the totals of the last marginal exact.
    """
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    df = cells.withColumn("_whole", whole.cast("double")).withColumn("raked", F.col("tokens").cast("double"))
    for m in MARGINS:
        own = Window.partitionBy(m)
        df = df.withColumn(f"_sum_{m}", F.sum("tokens").over(own)).withColumn(f"_w_{m}", F.pow(F.col(f"_sum_{m}").cast("double"), F.lit(powers[m])) / F.count("*").over(own))
        df = df.withColumn(f"_t_{m}", F.pow(F.col(f"_sum_{m}").cast("double"), F.lit(powers[m])) / F.sum(f"_w_{m}").over(Window.partitionBy(F.lit(0))))
    df = cut(df.drop(*[f"_sum_{m}" for m in MARGINS], *[f"_w_{m}" for m in MARGINS]))
    done = 0
    while done < most:
        for _ in range(every):
            df = df.withColumn("_before", F.col("raked"))
            for m in MARGINS:
                df = df.withColumn("raked", F.col("raked") * F.col(f"_t_{m}") * F.col("_whole") / F.sum("raked").over(Window.partitionBy(m)))
        df, done = cut(df), done + every
        if done >= rounds and (df.agg(F.max(F.abs(F.col("raked") / F.col("_before") - 1))).first()[0] or 0) <= settled:
            break
    return df.drop("_whole", "_before", *[f"_t_{m}" for m in MARGINS])


def probabilities(cells: DataFrame, share: float | None = None) -> DataFrame:
    """Adds ``weight``, a cell's factor, and ``probability`` to raked cells. share: of all tokens, above 0, at most 1."""
    if share is not None and not 0 < share <= 1:
        raise ValueError(f"share {share} is not above 0 and at most 1")
    df, everything = cells.withColumn("weight", F.col("raked") / F.col("tokens")), Window.partitionBy(F.lit(0))
    if share is None:
        return df.withColumn("probability", F.round(F.col("weight") / F.max("weight").over(everything), 9))
    # c if this cell and those of smaller factor are drawn and the others kept whole; the set that holds gives the largest c
    onward = everything.orderBy(F.desc("weight"), *MARGINS).rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("tokens").over(everything)
    own = (whole * float(share) - whole + F.sum("tokens").over(onward)) / F.sum("raked").over(onward)
    c = F.max("_c").over(everything)
    return df.withColumn("_c", own).withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * c), 9)).drop("_c")


def mix(docs: DataFrame, powers: dict[str, float] | None = None, topic: Column | None = None, seed: str = "mix", rounds: int = 10, share: float | None = None) -> DataFrame:
    """The drawn rows of ``docs`` with tokens, topic, weight (the cell's factor) and probability."""
    powers = powers or {"source": 0.7, "lang": 0.8, "topic": 0.9}
    named = docs.drop("tokens", "topic", "weight", "probability").withColumn("_tokens", tokens_of())
    named = named.withColumn("topic", topic if topic is not None else text_form()).withColumnRenamed("_tokens", "tokens")
    cells = named.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    raked = probabilities(rake(cut(cells), powers, rounds), share)
    factors = raked.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "probability")
    on = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    joined = named.join(factors, on[0] & on[1] & on[2], "left").drop(*[f"_{m}" for m in MARGINS])
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    joined = joined.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0))})
    return joined.filter(draw < F.col("probability"))
