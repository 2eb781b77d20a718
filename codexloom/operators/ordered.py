"""State along an order, for keys of any length.

A key's rows are cut into chunks by position. What a chunk leaves behind is one row, these are carried from chunk to chunk, and
each chunk then goes on from what it is given; so a key that holds a third of all rows spans as many tasks as it has chunks.
Rows are dealt once, by (key, chunk); rows with a null key belong to no key and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK = 4096
#: Chunks that ``states`` folds, and rows of one: a fold writes a character a row.
FOLD = 512
#: Keys of more than one chunk up to which they are broadcast.
MOST_SPANNING = 100_000


def carried(rows: DataFrame, key: list[str], order: list[str], chunk: Column, lag: dict[str, Column] | None = None, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """Adds what the rows before each row leave behind: the row before's value, the last value that is not null, the sum.

    ``order`` is unique within a key and ``chunk`` never falls along it. Without rows before, lag and last are null, sums 0.
    """
    lag, last, total = lag or {}, last or {}, total or {}
    dealt = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).withColumn("_chunk", chunk)
    spanning = cut(dealt.groupBy(*key).agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_b"), F.count_if(F.col("_chunk").isNull()).alias("_odd")).filter("_a < _b or _odd > 0").select(*key))
    n_spanning = spanning.count()
    own = {**{f"_g_{n}": F.struct(c.alias("v")) for n, c in lag.items()}, **{f"_l_{n}": c for n, c in last.items()}, **{f"_t_{n}": F.coalesce(c, F.lit(0)) for n, c in total.items()}}
    dealt = dealt.withColumns(own)
    # Where each key is one chunk, its rows need nothing from others.
    w = Window.partitionBy(*key, *(["_chunk"] if n_spanning else [])).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"_in{n}": F.lag(n).over(w) if n.startswith("_g_") else F.last(n, ignorenulls=True).over(before) if n.startswith("_l_") else F.sum(n).over(before) for n in own}
    both = dealt.withColumns(inside)
    if n_spanning:
        # Only keys of several chunks leave anything to a chunk.
        few = F.broadcast(spanning) if n_spanning <= MOST_SPANNING else spanning
        seen = dealt.join(few, key, "left_semi").withColumns(inside | {"_end": F.lead(F.lit(True)).over(w).isNull()})
        left = {n: F.col(n) if n.startswith("_g_") else F.coalesce(n, f"_in{n}") if n.startswith("_l_") else F.col(n) + F.coalesce(f"_in{n}", F.lit(0)) for n in own}
        ends = seen.filter("_end").select(*key, "_chunk", *(c.alias(n) for n, c in left.items()))
        onward = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        given = ends.select(*key, "_chunk", *((F.sum(n) if n.startswith("_t_") else F.last(n, ignorenulls=True)).over(onward).alias(f"_of{n}") for n in own))
        both = both.join(given, [*key, "_chunk"], "left")
    came = lambda n: F.coalesce(f"_in{n}", f"_of{n}") if n_spanning else F.col(f"_in{n}")
    out = {n: came(f"_g_{n}")["v"] for n in lag} | {n: came(f"_l_{n}") for n in last}
    out |= {n: sum((F.coalesce(f"_of_t_{n}", F.lit(0)) for _ in range(min(1, n_spanning))), F.coalesce(f"_in_t_{n}", F.lit(0))) for n in total}
    return both.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def states(rows: DataFrame, key: list[str], pos: str, code: Column, out: str, start: int = 0, size: int = FOLD) -> DataFrame:
    """Adds the state of a finite automaton before each row.

    ``code`` says where a row leads from each state: its i-th character is the next state's digit if the state is i. A chunk's
    codes compose to one code, these to one for ``size`` chunks, and so on down again with the state that each is given. ``pos``
    is an integer that is unique within a key and lies about evenly.
    """
    found = moves(rows.select(*key, pos, code.alias("_code")), key, pos, "_code", out, start, size)
    return rows.join(found.drop("_code"), [*key, pos])


def moves(rows: DataFrame, key: list[str], pos: str, code: str, out: str, start: int = 0, size: int = FOLD) -> DataFrame:
    """``states`` of rows that have nothing but key, ``pos`` and the column ``code``: the lists that carry the codes give the rows back."""
    dealt = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).select(*key, pos, F.col(code).alias("_code"), F.expr(f"{pos} div {size}").alias("_chunk"))
    packed = cut(_packed(dealt, [*key, "_chunk"], pos)).withColumn("_far", F.expr(f"_chunk div {size}"))
    wide = _packed(packed.withColumn("_code", _composed("_codes")), [*key, "_far"], "_chunk")
    top = _packed(wide.withColumn("_code", _composed("_codes")), key, "_far").withColumn("_given", F.lit(str(start)))
    wide = wide.join(_spread(top, key, "_far"), [*key, "_far"])
    packed = packed.drop("_far").join(_spread(wide, key, "_chunk"), [*key, "_chunk"])
    return _spread(packed, key, pos, True).withColumnRenamed("_given", out).withColumn(out, F.col(out).cast("int")).withColumnRenamed("_code", code)


def _packed(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    both = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_code").alias("c"))))
    return rows.groupBy(*key).agg(both.alias("_all")).select(*key, F.col("_all.p").alias("_places"), F.col("_all.c").alias("_codes"))


def _composed(codes: str) -> Column:
    """The code of a list of codes, one after the other."""
    return F.expr(f"aggregate(slice({codes}, 2, size({codes})), get({codes}, 0), (s, c) -> translate(s, '0123456789', rpad(c, 10, '0')))")


def _spread(rows: DataFrame, key: list[str], pos: str, coded: bool = False) -> DataFrame:
    """key, place and the state before it (and the code there), from lists of codes and the state that each list is given."""
    passed = "aggregate(_codes, _given, (s, c) -> concat(s, substring(c, int(right(s, 1)) + 1, 1)))"
    codes = ["_codes"] if coded else []
    each = rows.select(*key, "_places", *codes, F.expr(passed).alias("_s")).select(*key, F.posexplode("_places").alias("_i", pos), *codes, "_s")
    return each.select(*key, pos, *(F.expr("get(_codes, _i)").alias("_code") for _ in codes), F.expr("substring(_s, _i + 1, 1)").alias("_given"))


def chain(rows: DataFrame, key: list[str], pos: str, following: str) -> DataFrame:
    """The rows (key, pos) that are reached from each key's first row by going from ``pos`` to ``following`` again and again.

    Pointers double: after k rounds every row knows its successor 2^k steps on and rows up to there are marked, so the rounds are
    the logarithm of the longest chain. ``following`` is greater than ``pos``, or null at a chain's end.
    """
    jumps = cut(rows.select(*key, F.col(pos).alias("_p"), F.col(following).alias("_f")))
    marked = cut(jumps.groupBy(*key).agg(F.min("_p").alias("_p")))
    jumps = jumps.filter("_f is not null")
    while True:
        found = cut(marked.join(jumps, [*key, "_p"]).select(*key, F.col("_f").alias("_p")))
        if found.isEmpty():
            return marked.withColumnRenamed("_p", pos)
        marked = marked.unionByName(found)
        jumps = cut(jumps.join(jumps.select(*key, F.col("_p").alias("_f"), F.col("_f").alias("_g")), [*key, "_f"]).select(*key, "_p", F.col("_g").alias("_f")))
