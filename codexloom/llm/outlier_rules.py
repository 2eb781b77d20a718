"""Quality rules with robust multivariate outliers, in column expressions only.

Base statistics of a text give a vector of four transformed values, on a grid of ``GRID`` steps per ``FLOORS``. For each
(language, source), and for each language, a minimum-covariance-determinant estimate is found: concentration steps
re-estimate mean and covariance from the nearest half of the rows (``SHARE``), from several starts (medians and quartile
ranges, and small random subsets): two for each start, then more for the best two, for as long as the determinant falls by a
hundredth. The estimate of least determinant wins, and
rows inside its 97.5 % ellipse give the final one. A row's squared Mahalanobis distance is taken under its own group's
mean and a covariance that is the group's and the language's in proportion to n and ``PRIOR`` rows, so that a group of any
size has one. A row is rejected where the distance exceeds ``cutoff``.

Since vectors are on a grid, all steps run over the table of different vectors and their counts, which grows with the
grid and the groups, not with the rows. Nearest vectors are found by binned distances (64 bins per doubling; the bin that
the share falls in counts by the part that is still wanted), so no group is ever sorted or collected. Covariances get a
floor on the diagonal, since rare statistics are zero in most rows. Estimates are broadcast while there are at most
``MOST_GROUPS``, and joined by a shuffle beyond that.

Defined results: null text has no words and fails the base rules; null lang or source is a group of its own; repeated
rows count each; an empty table gives an empty result; other columns pass through ``judge`` untouched, whatever their
names, unless they carry the name of a result, which replaces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARE, INLIER, P, PRIOR = 0.5, 0.975, 4, 50
#: Least standard deviation that a transformed value is taken to have; bin width of the start's medians is a quarter.
FLOORS, GRID = (0.30, 0.45, 0.50, 0.05), 16
#: Random starts besides the one of medians, the vectors of each (expected), and the fall of a log determinant that counts.
STARTS, SUBSET, FALL = 4, 8, 0.01
BINS = 64
MOST_GROUPS = 200_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*STATS, "base_failed", "distance", "kept")


def _chi2(x: float, dof: int) -> float:
    """Distribution function for 4 or 6 degrees of freedom."""
    y = x / 2
    return 1 - math.exp(-y) * (1 + y + (y * y / 2 if dof == 6 else 0))


def _quantile(share: float) -> float:
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, P) < share else (low, mid)
    return low


def _consistency(share: float) -> float:
    return share / _chi2(_quantile(share), P + 2)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts to the rows of ``docs``."""
    space = r"[\\x20\\x09-\\x0D]+"
    t = f"coalesce(`{text}`, '')"
    words = f"filter(split({t}, '{space}'), w -> w != '')"
    # A one-element array binds a name: its element is evaluated once, however often the inner expression uses it.
    grams = "transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)))"
    repeated = f"""if(size(w) < 5, 0, get(transform(array({grams}), g -> if(size(array_distinct(g)) = size(g), 0,
        get(transform(array(array_sort(transform(g, (h, i) -> struct(h as h, i as i)))), p ->
            get(transform(array(sort_array(transform(filter(p, (x, j) -> x.h <=> get(p, j - 1).h or x.h <=> get(p, j + 1).h), x -> x.i))), f ->
                aggregate(transform(f, (x, j) -> least(5, coalesce(get(f, j + 1) - x, 5))), 0, (a, x) -> a + x)), 0)), 0))), 0))"""
    marks = t
    for c in "#*$%&|<>":
        marks = f"replace({marks}, '{c}', '')"
    lines = f"filter(split({t}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    found = f"""get(transform(array({words}), w -> struct(cast(size(w) as long) as n_words, cast(length(array_join(w, '')) as long) as word_chars,
        cast({repeated} as long) as n_repeat_words)), 0)"""
    dup = f"get(transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) as long)), 0)"
    out = docs.select(*[c for c in docs.columns if c not in (*STATS, "_w")], F.expr(found).alias("_w"), F.expr(f"cast(octet_length({t}) - octet_length({marks}) as long)").alias("n_symbols"), F.expr(dup).alias("n_dup_lines"))
    return out.select(*[c for c in out.columns if c not in ("_w", "n_symbols", "n_dup_lines")], "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")


def _bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a Generate node, so that later expressions refer to their values, not to their formulas."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("_b", F.explode(F.array(made))).select("*", "_b.*").drop("_b")


def _inverse_factor(c: dict[tuple[int, int], Column], df: DataFrame) -> DataFrame:
    """Columns w<i><j>: the inverse of the covariance's lower Cholesky factor l<i><j>."""
    for j in range(P):
        rest = {i: c[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)) for i in range(j, P)}
        top = F.sqrt(F.greatest(rest[j], F.lit(1e-12)))
        df = _bound(df, {f"l{i}{j}": top if i == j else rest[i] / top for i in range(j, P)})
    for i in range(P):
        sums = {j: F.lit(1.0 if i == j else 0.0) - sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) for j in range(i + 1)}
        df = _bound(df, {f"w{i}{j}": sums[j] / F.col(f"l{i}{i}") for j in range(i + 1)})
    return df


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + z * z
    return total


_MOMENTS = ["n", *(f"s{j}" for j in range(P)), *(f"q{i}{j}" for i in range(P) for j in range(i + 1))]
_COVARIANCE = [f"c{i}{j}" for i in range(P) for j in range(i + 1)]
_MEAN = [f"m{j}" for j in range(P)]
_WHO = ["_key", "_start"]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted sums of grid vectors (x0.., weight w)."""
    x = lambda *at: math.prod((F.col(f"x{j}") for j in at), start=F.col("w"))
    sums = [F.sum("w").alias("n"), *[F.sum(x(j)).alias(f"s{j}") for j in range(P)], *[F.sum(x(i, j)).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]]
    return rows.groupBy(*keys).agg(*sums)


def _estimate(sums: DataFrame, scale: float, keys: list[str]) -> DataFrame:
    """Mean, covariance, inverse Cholesky factor and log determinant from sums."""
    df = _bound(sums, {f"m{j}": F.col(f"s{j}") / F.col("n") for j in range(P)})
    c = {}
    for i in range(P):
        for j in range(i + 1):
            spread = (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
            c[f"c{i}{j}"] = spread + F.lit(FLOORS[i] ** 2) if i == j else spread
    return _factored(_bound(df, c), [*keys, "_size", *_MEAN])


def _factored(df: DataFrame, keep: list[str]) -> DataFrame:
    """From c<i><j>: these, w<i><j> and logdet."""
    df = _inverse_factor({(i, j): F.col(f"c{i}{j}") for i in range(P) for j in range(i + 1)}, df)
    logdet = sum((-2 * F.log(F.col(f"w{j}{j}")) for j in range(P)), F.lit(0.0))
    return df.select(*keep, *_COVARIANCE, *(f"w{i}{j}" for i in range(P) for j in range(i + 1)), logdet.alias("logdet"))


def few(df: DataFrame) -> DataFrame:
    """A table of estimates, cut off from its lineage, broadcast if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_GROUPS else df


def _starts(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """First estimates: of medians and quartile ranges (start 0), and of small subsets of different vectors."""
    long = cells.select("_key", "w", F.expr("stack(4, " + ", ".join(f"{j}, cast(floor(x{j} / {FLOORS[j] / 4}) as long)" for j in range(P)) + ") as (_j, _bin)"))
    counts = long.groupBy("_key", "_j", "_bin").agg(F.sum("w").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_key", "_j").orderBy("_bin"))).join(sizes, "_key")
    at = lambda j, share: F.min(F.when((F.col("_j") == j) & (F.col("_upto") >= share * F.col("_size")), F.col("_bin") + 0.5)) * (FLOORS[j] / 4)
    q = counts.groupBy("_key", "_size").agg(*[at(j, s).alias(f"r{j}_{int(s * 100)}") for j in range(P) for s in (0.25, 0.5, 0.75)])
    zero = F.lit(0.0)
    scale = [F.greatest((F.col(f"r{j}_75") - F.col(f"r{j}_25")) / 1.349, F.lit(FLOORS[j])) for j in range(P)]
    medians = q.select("_key", F.lit(0).alias("_start"), "_size", *[F.col(f"r{j}_50").alias(f"m{j}") for j in range(P)], *[(scale[i] * scale[i] if i == j else zero).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
    drawn = cells.join(sizes, "_key").withColumn("_start", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    chance = F.expr(f"pmod(xxhash64(_key, x0, x1, x2, x3, _start), 1000003) / 1000003D < {SUBSET}D / _cells")
    subsets = _moments(drawn.filter(chance).withColumn("w", F.lit(1.0)), ["_key", "_start", "_size"])
    return _factored(medians, [*_WHO, "_size", *_MEAN]).unionByName(_estimate(subsets, 1.0, _WHO))


def _concentrated(cells: DataFrame, estimate: DataFrame) -> DataFrame:
    """One C-step of every start: mean and covariance of each key's nearest ``SHARE`` of rows."""
    near = cells.join(estimate.select(*_WHO, "_size", *_MEAN, *(f"w{i}{j}" for i in range(P) for j in range(i + 1))), "_key")
    bins = _moments(near.withColumn("_bin", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BINS)), [*_WHO, "_size", "_bin"])
    upto = F.sum("n").over(Window.partitionBy(*_WHO).orderBy("_bin"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(SHARE) * F.col("_size") - (upto - F.col("n"))) / F.col("n")))
    sums = bins.withColumn("_part", part).groupBy(*_WHO, "_size").agg(*[F.sum(F.col(c) * F.col("_part")).alias(c) for c in _MOMENTS])
    return _estimate(sums, _consistency(SHARE), _WHO)


def estimates(cells: DataFrame) -> DataFrame:
    """From _key, x0..x3 (on the grid) and w (rows): each key's robust mean, covariance and size."""
    sizes = few(cells.groupBy("_key").agg(F.sum("w").alias("_size"), F.count("*").alias("_cells")))
    tried = _concentrated(cells, few(_concentrated(cells, few(_starts(cells, sizes)))))
    best = F.row_number().over(Window.partitionBy("_key").orderBy("logdet", "_start"))
    falling, done = few(tried.withColumn("_best", best).filter("_best <= 2").drop("_best")), None
    while True:
        new = _concentrated(cells, falling)
        old = falling.select(*[F.col(c).alias(f"_old_{c}") if c not in _WHO else c for c in falling.columns])
        both = cut(new.join(old, _WHO))
        fell = F.col("logdet") < F.col("_old_logdet") - FALL
        settled = both.filter(~fell).select(*_WHO, *[F.col(f"_old_{c}").alias(c) for c in falling.columns if c not in _WHO])
        done = settled if done is None else done.unionByName(settled)
        falling = few(both.filter(fell).select(*falling.columns))
        if falling.isEmpty():
            break
    names = ["_start", "_size", *_MEAN, *(f"w{i}{j}" for i in range(P) for j in range(i + 1))]
    best = few(done.groupBy("_key").agg(F.min_by(F.struct(*names), F.struct("logdet", "_start")).alias("_e")).select("_key", "_e.*"))
    inside = cells.join(best, "_key").filter(_distance() <= _quantile(INLIER))
    return _estimate(_moments(inside, ["_key", "_size"]), _consistency(INLIER), ["_key"]).select("_key", "_size", *_MEAN, *_COVARIANCE)


def scales(found: DataFrame) -> DataFrame:
    """Each group's mean, and inverse factor of its own covariance with the language's by ``PRIOR`` rows. Keys are (level, lang, source)."""
    own = found.filter("_key.level = 1")
    language = few(found.filter("_key.level = 2").select(F.col("_key.lang").alias("_lang"), *[F.col(c).alias(f"_l{c}") for c in _COVARIANCE]))
    both = own.join(language, F.col("_key.lang").eqNullSafe(F.col("_lang")))
    both = _bound(both.select("_key", "_size", *_MEAN, *[((F.col("_size") * F.col(c) + PRIOR * F.col(f"_l{c}")) / (F.col("_size") + PRIOR)).alias(f"_{c}") for c in _COVARIANCE]), {c: F.col(f"_{c}") for c in _COVARIANCE})
    return _factored(both, ["_key", *_MEAN])


def judge(docs: DataFrame, text: str = "text", cutoff: float = 30.0) -> DataFrame:
    """All columns of ``docs`` but its text, with the base statistics, base_failed, distance (squared) and kept."""
    passing = [c for c in docs.columns if c not in (*RESULTS, text)]
    held = F.struct(*[F.col(c) for c in passing]) if passing else F.lit(None).cast("struct<none: int>")
    base = statistics(docs.select(held.alias("_row"), F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), text), text).drop(text)
    base = cut(base.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")))
    good = base.filter("not base_failed")
    usual = few(good.groupBy("_lang").agg((F.sum("word_chars") / F.sum("n_words")).alias("_usual")).select(F.col("_lang").alias("_l"), "_usual"))
    # Short texts are drawn towards the language's usual word length, by 20 words of it.
    x = ("(word_chars + 20 * _usual) / (n_words + 20)", "ln(1 + 100 * n_symbols / (n_words + 20))", "ln(1D + n_dup_lines)", "n_repeat_words / (n_words + 20)")
    on_grid = [F.round(F.expr(e) / (FLOORS[j] / GRID)) * (FLOORS[j] / GRID) for j, e in enumerate(x)]
    ready = base.join(usual, F.col("_lang").eqNullSafe(F.col("_l")), "left").withColumns({f"x{j}": e for j, e in enumerate(on_grid)})
    key = lambda level, source: F.struct(F.lit(level).alias("level"), F.col("_lang").alias("lang"), source.alias("source"))
    values = [f"x{j}" for j in range(P)]
    one = cut(ready.filter("not base_failed").groupBy(key(1, F.col("_source")).alias("_key"), *values).agg(F.count("*").cast("double").alias("w")))
    two = one.groupBy(F.struct(F.lit(2).alias("level"), F.col("_key.lang").alias("lang"), F.lit(None).cast("string").alias("source")).alias("_key"), *values).agg(F.sum("w").alias("w"))
    found = few(scales(cut(estimates(cut(one.unionByName(two))))))
    out = ready.join(found, F.col("_lang").eqNullSafe(F.col("_key.lang")) & F.col("_source").eqNullSafe(F.col("_key.source")), "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in passing], *STATS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
