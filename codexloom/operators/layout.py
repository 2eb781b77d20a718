"""Line breaking and column planning as per-row and per-group dataflows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import CHUNK, carried, chain

# Fixed values of the cost model.
TOLERANCE, LINE_PENALTY, ADJACENT, DOUBLE_HYPHEN, BAD = 200.0, 10.0, 10_000.0, 10_000.0, 10_000.0
NO_BREAK, MUST_BREAK, ENDLESS = 10_000, -10_000, 1 << 40

BOX, GLUE, PENALTY = 0, 1, 2
#: kind, width, stretch, shrink, penalty, flagged
Item = tuple[int, int, int, int, int, bool]


def box(width: int) -> Item:
    return BOX, width, 0, 0, 0, False


def glue(width: int, stretch: int, shrink: int) -> Item:
    return GLUE, width, stretch, shrink, 0, False


def penalty(value: int, width: int = 0, flagged: bool = False) -> Item:
    return PENALTY, width, 0, 0, value, flagged


def paragraph(items: list[Item]) -> list[Item]:
    """Closed by glue that fills the last line and a break that must be taken."""
    return [*items, penalty(NO_BREAK), glue(0, ENDLESS, 0), penalty(MUST_BREAK)]


def _pass(a: np.ndarray, width: int, tolerance: float, spare: int, overfull_too: bool) -> tuple[list[int], list[float], float] | None:
    """Least total demerits over all break sequences: a table of partial solutions, extended to one break at a time.

    A partial solution is (first item of its next line, fitness, flagged, total, ratio, its predecessor, its break); all live
    ones are rated against a break in one vector step.
    """
    kind, w, y, z, pen, flag = a.T
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (np.where(kind == PENALTY, 0, w), y, z)]
    n = len(a)
    content = (kind == BOX) | ((kind == PENALTY) & (pen == MUST_BREAK))
    after = np.full(n + 1, n)
    for i in range(n - 1, -1, -1):
        after[i] = i if content[i] else after[i + 1]
    legal = ((kind == GLUE) & np.concatenate(([False], kind[:-1] == BOX))) | ((kind == PENALTY) & (pen < NO_BREAK))
    start, fit, flagged, total, ratio, prev, at = [0], [1], [0], [0.0], [0.0], [-1], [-1]
    live = np.array([0])
    final: list[int] = []
    for b in np.flatnonzero(legal):
        forced, cost = pen[b] == MUST_BREAK, float(pen[b])
        s = np.array(start)[live]
        slack = (width - (sums[0][b] - sums[0][s] + (w[b] if kind[b] == PENALTY else 0))).astype(float)
        stretch, shrink = (sums[1][b] - sums[1][s] + spare).astype(float), (sums[2][b] - sums[2][s]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(slack > 0, np.where(stretch > 0, slack / stretch, np.inf), np.where(slack < 0, np.where(shrink > 0, slack / shrink, -np.inf), 0.0))
            over = r < -1
            bad = np.where(over, BAD + BAD * -slack / max(width, 1), np.minimum(100 * np.abs(r) ** 3, BAD))
        able = (~over | overfull_too) & ((bad <= tolerance) | forced)
        fitness = np.where(r < -0.5, 0, np.where(r <= 0.5, 1, np.where(r <= 1, 2, 3)))
        d = (LINE_PENALTY + bad) ** 2 + (0.0 if forced else np.sign(cost) * cost**2)
        d = d + DOUBLE_HYPHEN * (np.array(flagged)[live] * flag[b]) + ADJACENT * (np.abs(fitness - np.array(fit)[live]) > 1)
        d = d + np.array(total)[live]
        new = []
        for f in range(4):
            of = np.flatnonzero(able & (fitness == f))
            if len(of):
                best = of[np.argmin(d[of])]
                new.append(len(start))
                for column, value in zip((start, fit, flagged, total, ratio, prev, at), (int(after[b + 1]), f, int(flag[b]), float(d[best]), float(r[best]), int(live[best]), int(b)), strict=True):
                    column.append(value)
        if b == n - 1:
            final = new
        live = np.concatenate((live[~over & (not forced)], [] if b == n - 1 else new)).astype(int)
        if not len(live) and not final:
            return None
    if not final:
        return None
    best = min(final, key=lambda i: total[i])
    breaks, ratios, demerits = [], [], total[best]
    while best > 0:
        breaks.append(at[best])
        ratios.append(ratio[best])
        best = prev[best]
    return breaks[::-1], ratios[::-1], demerits


def break_lines(items: list[Item], width: int) -> tuple[list[int], list[float], float]:
    """Break positions, glue ratios and total demerits; raises ValueError for a paragraph that is not closed.

    Tried with the tolerance, then with spare stretch of an eighth of the line, then with overfull lines, then with all.
    """
    if not items or items[-1][0] != PENALTY or items[-1][4] != MUST_BREAK:
        raise ValueError("the paragraph must end with a break that must be taken")
    a = np.array(items, dtype=np.int64)
    for tolerance, spare, over in ((TOLERANCE, 0, False), (TOLERANCE, width // 8, False), (BAD, width // 8, True), (np.inf, width // 8, True)):
        if out := _pass(a, width, tolerance, spare, over):
            return out
    raise ValueError("no feasible breaks")


#: Words of one vectorised step of ``_word_breaks``; a longer text is a step of its own.
STEP_WORDS = 1 << 16


def _words(own: np.ndarray) -> list[Item]:
    items: list[Item] = []
    for i, x in enumerate(own):
        items += [glue(400, 200, 100)] * (i > 0) + [box(int(x) * 100)]
    return paragraph(items)


def _word_breaks(words: np.ndarray, first: np.ndarray, widths: np.ndarray, tolerance: float, spares: np.ndarray) -> list[list[int] | None]:
    """``_pass`` without overfull lines for texts of words alone; text t has the words from ``first[t]`` to ``first[t + 1]``.

    How good a line is depends on its first and last word only, so all lines of all texts that may be set are rated in one
    vector step, and the least total is sought among these few. Sums are made in ``_pass``'s order, so they are the same to the bit.
    """
    n, count = len(words), np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    w = words.astype(np.int64) * 100
    natural, least = (np.concatenate(([0], np.cumsum(w + g))) for g in (400, 300))
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    # Lines that start before ``low`` are overfull at this word, and at all later ones.
    low = np.maximum(np.searchsorted(least, least[1:] - 300 - widths[text], "left"), first[text])
    end = np.arange(n)
    size = np.maximum(end + 1 - low, 0)
    b = np.repeat(end, size)
    s = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[b]
    slack = (widths[text[b]] - (natural[b + 1] - natural[s] - 400)).astype(float)
    gaps = b - s
    stretch, shrink = (200 * gaps + np.where(last[b], ENDLESS, 0) + spares[text[b]]).astype(float), (100 * gaps).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(slack > 0, np.where(stretch > 0, slack / stretch, np.inf), np.where(slack < 0, np.where(shrink > 0, slack / shrink, -np.inf), 0.0))
        bad = np.minimum(100 * np.abs(r) ** 3, BAD)
    able = np.flatnonzero((bad <= tolerance) | last[b])
    fitness = np.where(r < -0.5, 0, np.where(r <= 0.5, 1, np.where(r <= 1, 2, 3)))[able].tolist()
    base = ((LINE_PENALTY + bad) ** 2 + 0.0)[able].tolist()
    s, b = s[able], b[able]
    bounds = np.searchsorted(b, first)
    s, b, out = s.tolist(), b.tolist(), []
    for t in range(len(count)):
        # Partial solutions by the first word of their next line: fitness, total, the solution before, the break.
        at, done = int(first[t]), int(first[t + 1]) - 1
        known: dict[int, list[tuple]] = {at: [(1, 0.0, None, -1)]}
        i, stop = int(bounds[t]), int(bounds[t + 1])
        while i < stop:
            here, best = b[i], [None] * 4
            while i < stop and b[i] == here:
                f, d0 = fitness[i], base[i]
                for node in known.get(s[i], ()):
                    d = d0 + (ADJACENT if abs(f - node[0]) > 1 else 0.0) + node[1]
                    if best[f] is None or d < best[f][1]:
                        best[f] = (f, d, node, 2 * (here - at) + 1)
                i += 1
            if any(best):
                known[here + 1] = [x for x in best if x]
        final = min(known.get(done + 1, ()), key=lambda x: x[1], default=None)
        if final is None:
            out.append(None)
            continue
        breaks, node = [2 * (done - at) + 3], final[2]
        while node[2] is not None:
            breaks.append(node[3])
            node = node[2]
        out.append(breaks[::-1])
    return out


def break_words(texts: list[np.ndarray], widths: np.ndarray) -> list[list[int]]:
    """Line breaks of each text's words as ``break_lines`` finds them; texts that need overfull lines or have no words are left to it."""
    out: list[list[int] | None] = [None] * len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    rest = np.flatnonzero(size)
    for spare in (False, True):
        step = np.cumsum(size[rest]) // STEP_WORDS
        for own in np.split(rest, np.flatnonzero(np.diff(step)) + 1):
            if len(own):
                first = np.concatenate(([0], np.cumsum(size[own])))
                for i, found in zip(own, _word_breaks(np.concatenate([texts[i] for i in own]), first, widths[own], TOLERANCE, widths[own] // 8 * spare), strict=True):
                    out[i] = found
        rest = np.array([i for i in rest if out[i] is None], np.int64)
    return [found if found is not None else break_lines(_words(own), int(width))[0] for found, own, width in zip(out, texts, widths, strict=True)]


def break_words_udf():
    """Line breaks (item positions) of words of the given widths, set with spaces of 4 plus 2 minus 1 units, 100 to a unit."""

    @F.pandas_udf("array<int>")
    def run(widths: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series(break_words([np.asarray(x, np.int64) for x in widths], width.to_numpy(np.int64) * 100), dtype=object)

    return run


def block_starts(blocks: DataFrame, group: list[str], order: str, lines: str) -> DataFrame:
    """The first line of each block when blocks are laid end to end."""
    w = Window.partitionBy(*group).orderBy(order)
    return blocks.withColumn("first_line", (F.sum(lines).over(w) - F.col(lines)).cast("long"))


def column_of(starts: DataFrame, per_column: int) -> DataFrame:
    """Column number and place in it of each block's first line, with columns of one size."""
    return starts.withColumn("column", F.expr(f"first_line div {per_column}")).withColumn("place", F.expr(f"first_line % {per_column}"))


def plan_columns(kinds: list[int], per_column: int) -> list[int]:
    """First lines of the columns over a line stream of kinds 0 content, 1 heading, 2 blank.

    Blank lines at a column's head are skipped, and a heading (with blanks after it) that would close a column moves on.
    """
    starts, at, n = [], 0, len(kinds)
    while at < n:
        while at < n and kinds[at] == 2:
            at += 1
        if at == n:
            break
        starts.append(at)
        end = min(at + per_column, n)
        if end < n:
            back = end
            while back > at and kinds[back - 1] in (1, 2):
                back -= 1
            if back > at and 1 in kinds[back:end]:
                end = back + kinds[back:end].index(1)
        at = end
    return starts


def _lines(lines: DataFrame, key: list[str], per_column: int, kept: int, size: int) -> DataFrame:
    """Lines with the content before them, the last heading up to them, the end of a column that starts there."""
    chunk = F.expr(f"pos div {size}")
    content, heading = (F.col("kind") == 0).cast("long"), F.col("kind") == 1
    rows = carried(lines.select(*key, F.col("pos").cast("long").alias("pos"), F.coalesce("kind", F.lit(0)).alias("kind")), key, ["pos"], chunk, lag={"_was": F.col("kind")}, total={"content": content})
    opens = heading & (F.coalesce("_was", F.lit(0)) != 1)
    rows = cut(rows.withColumns({"_opens": opens, "_content": content}))
    # From the far end: where the heading that begins here ends, and how much content lies before that.
    back = rows.select(*key, (-F.col("pos")).alias("_back"), F.when(~heading, F.struct("pos", "content")).alias("_v"), F.when(F.col("_opens"), F.col("pos")).alias("_g"))
    back = carried(back, key, ["_back"], F.expr(f"-((-_back) div {size})"), last={"_end": F.col("_v"), "_first": F.col("_g")})
    rows = rows.join(back.select(*key, (-F.col("_back")).alias("pos"), F.col("_end.content").alias("_end"), "_first"), [*key, "pos"])
    whole = rows.groupBy(*key).agg(F.max("pos").alias("_last"), F.sum("_content").alias("_all"))
    rows = rows.join(whole, key).withColumn("_end", F.coalesce("_end", "_all"))
    # Headings with too little content between them move on together.
    heads = rows.filter("_opens").select(*key, "pos", "content", "_end")
    heads = carried(heads, key, ["pos"], chunk, lag={"_p": F.col("_end")})
    heads = heads.withColumn("_new", F.when(F.coalesce(F.col("content") - F.col("_p") >= kept, F.lit(True)), F.col("pos")))
    heads = carried(heads, key, ["pos"], chunk, last={"_i": F.col("_new")}).select(*key, "pos", F.coalesce("_new", "_i").alias("_island"))
    rows = cut(rows.join(heads, [*key, "pos"], "left"))
    # A column looks at the lines that it would take, so each chunk also gets the first lines of the next one.
    dealt = rows.withColumn("_chunk", F.explode(F.expr(f"if(pos % {size} < {per_column} and pos >= {size}, array(pos div {size}, pos div {size} - 1), array(pos div {size}))")))
    if size < per_column:
        dealt = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.expr(f"(pos - {per_column}) div {size}")), F.expr(f"pos div {size}"))))
    w = Window.partitionBy(*key, "_chunk").orderBy("pos")
    ahead = w.rowsBetween(1, max(1, per_column - 1))
    heads_ahead = F.collect_list(F.when(F.col("_opens"), F.struct("pos", "_end", "_island"))).over(ahead) if per_column > 1 else F.array().cast("array<struct<pos:bigint,_end:bigint,_island:bigint>>")
    seen = dealt.withColumns({"_ahead": heads_ahead, "_until": F.lead("content", per_column).over(w)}).filter(f"_chunk = pos div {size}")
    until = F.coalesce("_until", "_all")
    bad = F.get(F.filter("_ahead", lambda x: x["_end"] > until - kept), F.lit(0))
    return seen.withColumn("_bad", bad).withColumn("end", F.when(F.col("_bad").isNotNull(), F.greatest("_first", F.col("_bad._island"))).otherwise(F.least(F.col("pos") + per_column, F.col("_last") + 1)))


def columns(lines: DataFrame, key: list[str], per_column: int, kept: int = 2, origins: DataFrame | None = None, settle: bool = True, behind: int = 20, size: int = CHUNK) -> DataFrame:
    """The first lines (key, start) of columns over lines (key, pos from 0 without gaps, kind: 0 content, 1 heading, 2 blank).

    A column takes ``per_column`` lines, but none that would leave a heading at its foot with fewer than ``kept`` content lines
    below. Where a column that starts at a line ends is known for every line by itself; which lines do start one, pointers that double
    find out (``ordered.chain``). From an origin (key, origin) on columns go forward, and backward full ones from there to the first
    line. An origin that settles moves up by at most half a column, to where the headings behind it are orphans least, the nearest of
    ``behind`` columns counting more than all that are farther. Origins at or beyond the ends count as none. At least one content line is kept.
    """
    rows = cut(_lines(lines, key, per_column, max(1, kept), size))
    ends = rows.select(*key, "pos", F.when(F.col("end") <= F.col("_last"), F.col("end")).alias("_next"), "_last")
    if origins is None:
        return chain(ends, key, "pos", "_next").select(*key, F.col("pos").alias("start"))
    placed = origins.join(rows.groupBy(*key).agg(F.max("_last").alias("_last")), key).filter("origin > 0 and origin <= _last").select(*key, F.col("origin").cast("long").alias("origin"))
    if settle:
        placed = _settled(placed, rows, key, per_column, max(1, kept), behind, size)
    placed = cut(placed)
    forward = ends.join(placed, key, "left").filter("pos >= coalesce(origin, 0)")
    back = placed.select(*key, F.explode(F.expr(f"transform(sequence(1, ceil(origin / {per_column})), k -> greatest(0, origin - k * {per_column}))")).alias("start"))
    return chain(forward, key, "pos", "_next").select(*key, F.col("pos").alias("start")).unionByName(back.select(*key, F.col("start").cast("long")))


def _settled(placed: DataFrame, rows: DataFrame, key: list[str], per_column: int, kept: int, behind: int, size: int) -> DataFrame:
    """Origins after their move: every shift's columns look up the last heading before their end."""
    chunk = F.expr(f"pos div {size}")
    heads = carried(rows.select(*key, "pos", "kind", "content", "_content", "_opens"), key, ["pos"], chunk, last={"_g": F.when(F.col("_opens"), F.col("pos")), "_h": F.when(F.col("kind") == 1, F.struct("pos", "content"))})
    heads = heads.select(*key, F.col("pos").alias("_foot"), (F.col("content") + F.col("_content")).alias("_upto"), F.when(F.col("_opens"), F.col("pos")).otherwise(F.col("_g")).alias("_g"), F.when(F.col("kind") == 1, F.struct("pos", "content")).otherwise(F.col("_h")).alias("_h"))
    tries = placed.withColumn("_shift", F.explode(F.expr(f"sequence(0, {per_column // 2})"))).filter("_shift = 0 or origin > _shift")
    feet = tries.withColumn("_k", F.explode(F.expr(f"sequence(1, {behind})"))).withColumn("_e", F.expr(f"origin - _shift - (_k - 1) * {per_column}")).filter("_e > 0")
    feet = feet.withColumns({"_s": F.greatest(F.lit(0), F.col("_e") - per_column), "_foot": F.col("_e") - 1}).join(heads, [*key, "_foot"])
    orphan = (F.col("_h.pos") > F.col("_s")) & (F.col("_upto") - F.col("_h.content") < kept) & (F.col("_g") > F.col("_s"))
    cost = feet.groupBy(*key, "origin", "_shift").agg(F.sum(F.when(F.coalesce(orphan, F.lit(False)), F.expr(f"shiftleft(1L, {behind} - _k)")).otherwise(0)).alias("_cost"))
    return cost.groupBy(*key, "origin").agg(F.min(F.struct("_cost", "_shift")).alias("_b")).select(*key, (F.col("origin") - F.col("_b._shift")).alias("origin"))
