"""Document structure over the given texts: measured lines made from documents, their blocks, tables and verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import references as refs
from ..operators import blocks, footnotes, hits, intervals, layout, lines, titles, verses
from .registry import query, table

# Every sentence of a document is a line; its measures come from its length and place, so that each rule has cases.
LINES = r"""
s AS (SELECT doc_id, unnest(string_split_regex(text, '\. |\n')) AS t, unnest(range(0, len(string_split_regex(text, '\. |\n')))) AS pos FROM documents),
m AS (SELECT doc_id, pos, length(t) AS n, CASE WHEN length(t) % 9 = 0 THEN '• ' || t WHEN length(t) % 9 = 1 THEN (pos % 4 + 1) || '. ' || t WHEN length(t) % 10 = 3 THEN t || '-' WHEN length(t) % 10 = 4 THEN t || ':' ELSE t END AS t FROM s),
g AS (SELECT doc_id, pos, n, t, pos // 40 AS page, 12.0 * (pos % 40) + CASE WHEN (pos + n) % 4 = 0 THEN 6 ELSE 0 END AS top, 50.0 + [0, 0, 0, 0, 7, 12, 45][n % 7 + 1] + CASE WHEN n % 8 = 5 THEN 100 ELSE 0 END AS "left",
  CASE WHEN n > 40 THEN 350.0 ELSE 150.0 + 4 * n END AS "right", 10.0 + CASE WHEN n % 23 = 0 THEN 4 WHEN n % 29 = 0 THEN 0.625 ELSE 0 END AS size, n % 11 = 0 AS bold, n % 13 = 0 AS italic, n % 6 = 2 AND strpos(t, ', ') > 0 AS split FROM m),
lines AS (SELECT *, CASE WHEN split THEN [{'left': "left", 'text': t[:strpos(t, ', ') - 1]}, {'left': "left" + 100, 'text': t[strpos(t, ', ') + 2:]}] ELSE [{'left': "left", 'text': t}] END AS cells FROM g)"""


def measured_lines(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("pos", "t"))
    n = F.length("t")
    t = F.when(n % 9 == 0, F.concat(F.lit("• "), "t")).when(n % 9 == 1, F.concat((F.col("pos") % 4 + 1).cast("string"), F.lit(". "), "t")).when(n % 10 == 3, F.concat("t", F.lit("-"))).when(n % 10 == 4, F.concat("t", F.lit(":"))).otherwise(F.col("t"))
    rows = s.select("doc_id", F.col("pos").cast("long").alias("pos"), n.alias("n"), t.alias("t"))
    left = F.expr("50D + get(array(0, 0, 0, 0, 7, 12, 45), n % 7) + if(n % 8 = 5, 100, 0)")
    rows = rows.select(
        "doc_id", "pos", "n", "t", F.expr("int(pos div 40)").alias("page"), F.expr("12D * (pos % 40) + if((pos + n) % 4 = 0, 6, 0)").alias("top"), left.alias("left"), F.expr("if(n > 40, 350D, 150D + 4 * n)").alias("right"),
        F.expr("10D + case when n % 23 = 0 then 4 when n % 29 = 0 then 0.625D else 0 end").alias("size"), F.expr("n % 11 = 0").alias("bold"), F.expr("n % 13 = 0").alias("italic"), F.expr("if(n % 6 = 2, instr(t, ', '), 0)").alias("_at"),
    )
    two = "array(struct(left, substring(t, 1, _at - 1) as text), struct(left + 100 as left, substring(t, _at + 2) as text))"
    return rows.withColumn("cells", F.expr(f"if(_at > 0, {two}, array(struct(left, t as text)))")).drop("n", "t", "_at")


PROFILE = r"""
z AS (SELECT doc_id, CAST(round(size * 10) AS INTEGER) AS s, sum(length(array_to_string(list_transform(cells, lambda c: c.text), chr(9)))) AS n FROM lines GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER w AS i, first(s) OVER w AS tops, first(n) OVER w AS most FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, s DESC)),
b AS (SELECT doc_id, coalesce(arg_min(s, i) FILTER (s > tops AND n * 10 >= most * 4), min(tops)) / 10.0 AS body_size FROM y GROUP BY 1),
o AS (SELECT l.doc_id, round("left") AS lft, "right" AS rgt, CASE WHEN lag(page) OVER w = page THEN top - lag(top) OVER w END AS p, body_size FROM lines l JOIN b ON b.doc_id = l.doc_id WHERE abs(size - body_size) < 0.3 WINDOW w AS (PARTITION BY l.doc_id ORDER BY pos)),
c AS (SELECT doc_id, lft, count(*) AS n FROM o GROUP BY 1, 2),
q AS (SELECT doc_id, list_sort(list(rgt)) AS r, list_sort(list(p) FILTER (p > 0.8 * body_size AND p < 2 * body_size)) AS p FROM o GROUP BY 1),
prof AS (SELECT b.doc_id, body_size, coalesce(q.p[len(q.p) // 2 + 1], body_size * 1.3) AS body_pitch, k.lft AS body_left, q.r[len(q.r) * 9 // 10 + 1] AS body_right FROM b JOIN q ON q.doc_id = b.doc_id JOIN (SELECT doc_id, arg_max(lft, (n, -lft)) AS lft FROM c GROUP BY 1) k ON k.doc_id = b.doc_id)"""

# The reading of one line after another, as two recursions: what a line is, then what a paragraph line does.
KINDS = r"""
a AS (SELECT l.*, array_to_string(list_transform(cells, lambda c: c.text), ' ') AS text, len(cells) AS k, body_size, body_pitch, body_left, body_right, body_right - 0.25 * (body_right - body_left) AS edge FROM lines l JOIN prof p ON p.doc_id = l.doc_id),
e AS (SELECT *, lag(struct_pack(page, "right" := "right", top, bold, size, text)) OVER w AS prev, last_value(CASE WHEN k >= 2 THEN list_transform(cells[2:], lambda c: c."left") END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cols FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, CASE WHEN prev.page = page THEN top - prev.top WHEN prev.page < page AND prev."right" >= edge THEN body_pitch ELSE CAST('inf' AS DOUBLE) END AS gap FROM e),
v AS (SELECT *, gap > 1.45 * body_pitch AS far, "right" - "left" < 0.85 * (body_right - body_left) AS short, size > body_size + 0.4 AS larger, regexp_full_match(trim(text), '[0-9]*') AS digits FROM f),
u AS (SELECT *, (larger AND (short OR digits)) OR (size > 1.3 * body_size AND NOT digits) AS heading, bold AND short AND NOT digits AND k = 1 AS soft,
  k = 1 AND gap < 1.45 * body_pitch AND coalesce(len(list_filter(cols, lambda c: abs(c - "left") < 6)) > 0, false) AS joins,
  k >= 2 AND "right" >= body_right - body_size AND abs(size - body_size) < 0.3 AND len(list_filter(cells, lambda c: len(list_filter(string_split_regex(c.text, '\s+'), lambda x: x <> '')) > 4)) = 0 AS spread FROM v),
st AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, 'S' AS st FROM prof UNION ALL SELECT u.doc_id, u.pos, CASE WHEN spread AND st = 'P' THEN 'P' WHEN k >= 2 THEN CASE WHEN st IN ('T', 'F') THEN 'T' ELSE 'F' END WHEN joins AND st IN ('T', 'F') THEN 'T' WHEN heading THEN 'H' WHEN soft AND st NOT IN ('P', 'F') THEN 'H' ELSE 'P' END
  FROM st JOIN u ON u.doc_id = st.doc_id AND u.pos = st.pos + 1),
kn AS (SELECT u.*, CASE WHEN st.st = 'F' AND lead(st.st) OVER w IS NOT DISTINCT FROM 'T' THEN 'T' WHEN st.st = 'F' THEN 'L' ELSE st.st END AS kind FROM u JOIN st ON st.doc_id = u.doc_id AND st.pos = u.pos WINDOW w AS (PARTITION BY u.doc_id ORDER BY u.pos)),
kw AS (SELECT *, kind = 'L' AS lone, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) IN ('P', 'L'), false) AS open, kind <> 'L' AND regexp_matches(text, '^\s*(?:[0-9]{1,2}(?:[.)][ \x{A0}]|\.\t).|(?:[•–\-·▪■◦] |[•–]\x{A0}).|[a-z][.)][ \x{A0}])') AS mark, kind <> 'L' AND "left" > body_left + 0.6 * body_size AS ind,
  coalesce(prev."right" < edge, false) AS after_short, coalesce((prev.bold <> bold AND NOT italic) OR abs(prev.size - size) > 0.4, false) AS restyled, coalesce(regexp_matches(rtrim(prev.text), '(\x{AD}|.-)$'), false) AND kind <> 'L' AS hyphen,
  coalesce(regexp_matches(rtrim(prev.text), ':$'), false) AS colon, bold AND regexp_matches(text, '^\s*[0-9]{1,3}\s') AS scr FROM kn),
kx AS (SELECT *, CASE WHEN mark THEN TRY_CAST(regexp_extract(text, '^\s*([0-9]{1,2})', 1) AS INTEGER) END AS num, far OR after_short OR ind OR colon AS evid FROM kw),
fo AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, 0 AS step, CAST(NULL AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS margin, false AS quote, 0 AS lst, 0 AS items FROM prof UNION ALL
  SELECT doc_id, pos, step, CASE WHEN step = -1 THEN NULL WHEN step = 0 THEN first ELSE "left" END, CASE WHEN step = -1 THEN NULL WHEN step <> 0 OR "left" > first + 0.5 THEN "left" ELSE margin END, CASE WHEN step = -1 THEN false WHEN step = 0 THEN quote ELSE step = 2 END,
    CASE WHEN step = -1 OR lone THEN 0 WHEN step = 4 THEN CASE WHEN num IS NULL THEN 1 ELSE 2 END WHEN step IN (1, 2) THEN 0 ELSE lst END, CASE WHEN step = 4 THEN 1 WHEN step = 3 THEN items + 1 ELSE items END
  FROM (SELECT *, CASE WHEN kind NOT IN ('P', 'L') THEN -1 WHEN NOT (first IS NULL OR lone OR (NOT hyphen AND (far OR restyled OR after_short OR item OR (ind AND lst = 0 AND NOT quote AND "left" < body_left + 3 * body_size AND "left" > margin + 0.6 * body_size)))) THEN 0
      WHEN item AND ((lst = 2 AND coalesce(num = items + 1, false)) OR (lst = 1 AND num IS NULL)) THEN 3 WHEN item THEN 4 WHEN ind AND lst = 0 AND "left" > body_left + 3 * body_size AND NOT scr THEN 2 WHEN lst > 0 AND ind THEN 5 ELSE 1 END AS step
    FROM (SELECT k.*, fo.first, fo.margin, fo.quote, fo.lst, fo.items, k.mark AND (fo.first IS NULL OR k.evid OR (fo.lst > 0 AND abs(k."left" - fo.first) < 1 AND k."left" < fo.margin) OR (fo.lst = 2 AND coalesce(k.num = fo.items + 1, false))) AS item FROM fo JOIN kx k ON k.doc_id = fo.doc_id AND k.pos = fo.pos + 1) x) y)"""

BLOCKS = r"""
bl AS (SELECT k.*, f.step, last_value(CASE WHEN f.step > 0 THEN k.pos END IGNORE NULLS) OVER w AS block, CASE WHEN f.step IN (3, 4, 5) THEN last_value(CASE WHEN f.step = 4 THEN k.pos END IGNORE NULLS) OVER w END AS list FROM kx k JOIN fo f ON f.doc_id = k.doc_id AND f.pos = k.pos WHERE f.step >= 0 WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.pos)),
bt AS (SELECT *, CASE WHEN step IN (3, 4) THEN regexp_replace(text, '^\s*(?:[0-9]{1,2}(?:[.)][ \x{A0}]|\.\t)|(?:[•–\-·▪■◦] |[•–]\x{A0})|[a-z][.)][ \x{A0}])', '') ELSE text END AS tx FROM bl),
bp AS (SELECT *, lead(tx) OVER (PARTITION BY doc_id, block ORDER BY pos) AS nxt FROM bt),
bj AS (SELECT *, CASE WHEN nxt IS NULL THEN rtrim(tx) WHEN regexp_matches(rtrim(tx), '\x{AD}$') THEN regexp_replace(rtrim(tx), '\x{AD}$', '') WHEN regexp_matches(rtrim(tx), '.-$') AND regexp_matches(nxt, '^\p{Ll}') THEN regexp_replace(rtrim(tx), ' *-$', '') WHEN regexp_matches(rtrim(tx), '.-$') THEN rtrim(tx) ELSE rtrim(tx) || ' ' END AS piece FROM bp),
pa AS (SELECT doc_id, block AS pos, CASE WHEN arg_min(step, pos) IN (3, 4) THEN 'item' ELSE 'paragraph' END AS kind, CASE WHEN arg_min(scr, pos) THEN 'scripture' WHEN arg_min(step, pos) = 2 THEN 'quote' ELSE 'body' END AS style, arg_min(list, pos) AS list, count(*) AS n_lines, trim(regexp_replace(string_agg(piece, '' ORDER BY pos), '\s+', ' ', 'g')) AS text, arg_min("right" < edge, pos) AS is_short FROM bj GROUP BY doc_id, block),
hd AS (SELECT doc_id, pos, text, CAST(round(size * 10) AS INTEGER) AS s FROM kx WHERE kind = 'H'),
hl AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(s) OVER w = s THEN 0 ELSE 1 END AS new, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY s DESC), 6) AS level FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hg AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM hl),
al AS (SELECT doc_id, pos, kind, style, CAST(NULL AS BIGINT) AS level, list, n_lines, text, list IS NULL AND style = 'body' AND n_lines = 1 AND is_short AS single FROM pa WHERE text <> '' UNION ALL
  SELECT doc_id, min(pos), 'heading', NULL, min(level), NULL, count(*), trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '\s+', ' ', 'g')), false FROM hg GROUP BY doc_id, h UNION ALL
  SELECT doc_id, pos, 'table', NULL, NULL, NULL, NULL, NULL, false FROM (SELECT doc_id, pos, kind, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM kx) WHERE kind = 'T' AND before IS DISTINCT FROM 'T')
SELECT doc_id, pos, kind, CASE WHEN single AND (coalesce(lag(single) OVER w, false) OR coalesce(lead(single) OVER w, false)) THEN 'poetry' ELSE style END AS style, level, list, n_lines, text FROM al WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""


@query(f"WITH {LINES.lstrip()}, {PROFILE.lstrip()} SELECT doc_id, CAST(body_size AS DOUBLE) AS body_size, CAST(body_pitch AS DOUBLE) AS body_pitch, CAST(body_left AS DOUBLE) AS body_left, CAST(body_right AS DOUBLE) AS body_right FROM prof")
def document_measures(spark, d):
    """Body size, pitch and edges of every document's lines."""
    return blocks.measures(measured_lines(spark, d))


@query(f"WITH RECURSIVE {LINES.lstrip()}, {PROFILE.lstrip()}, {KINDS.lstrip()}, {BLOCKS.lstrip()}")
def document_blocks(spark, d):
    """Headings, paragraphs, items and tables of every document's lines."""
    rows = measured_lines(spark, d)
    found = blocks.blocks(rows, blocks.measures(rows))
    return found.select("doc_id", "pos", "kind", "style", F.col("level").cast("long").alias("level"), "list", "n_lines", "text")


# Every line of a document is a heading that opens a chapter, a title, or a paragraph with verse numbers at its commas.
PARTS = r"""
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
p AS (SELECT doc_id, pos, t, unnest(string_split(t, ', ')) AS x, unnest(range(0, len(string_split(t, ', ')))) AS part FROM s),
r AS (SELECT doc_id, pos, part, CASE WHEN pos % 5 = 0 THEN 'start' WHEN length(t) % 7 = 3 THEN 'title' ELSE 'text' END AS kind, length(t) % 4 AS chapter, CASE WHEN part > 0 THEN nullif(length(x) % 6, 0) END AS number, trim(CASE WHEN part = 0 AND length(t) % 3 = 1 THEN (length(t) % 5) || ' ' || x ELSE x END) AS text
  FROM p WHERE part = 0 OR NOT (pos % 5 = 0 OR length(t) % 7 = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS i FROM r WHERE kind <> 'text' OR number IS NOT NULL OR text <> ''),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS first, 0::BIGINT AS chapter, 0::BIGINT AS verse, false AS held, false AS ended, 0::BIGINT AS n, 0::BIGINT AS grp, NULL::BIGINT AS begun, ''::VARCHAR AS act, false AS flag, false AS opens, ''::VARCHAR AS text, NULL::VARCHAR AS kind, NULL::BIGINT AS pos FROM o
  UNION ALL SELECT doc_id, i, CASE WHEN kind = 'start' THEN own ELSE first END, CASE WHEN kind = 'start' THEN own WHEN rolls THEN chapter + 1 ELSE chapter END, CASE WHEN kind = 'start' THEN 0 WHEN num IS NOT NULL THEN num ELSE verse END, CASE WHEN kind = 'start' OR num IS NOT NULL THEN false WHEN act = 'wait' THEN true ELSE held END,
    CASE WHEN act = 'wait' THEN regexp_matches(text, '[.!?:;«»"]\s*$') ELSE ended END, n + CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END, grp + CASE WHEN act = 'wait' AND NOT (held AND (verse = 0 OR NOT ended OR regexp_matches(text, '^\p{Ll}'))) THEN 1 ELSE 0 END, CASE WHEN act <> '' THEN pos ELSE begun END, act, num IS NOT NULL AND begun IS DISTINCT FROM pos, opens, text, kind, pos
  FROM (SELECT *, num IS NOT NULL AND ((verse > 0 AND num = 1) OR (verse >= 2 AND num < verse AND num <= 3 AND held)) AS rolls, num IS NOT NULL AND num >= 2 AND held AND (verse = 0 OR (verse >= 2 AND num < verse AND num <= 3)) AS opens,
      CASE WHEN kind <> 'text' OR first IS NULL OR first = 0 THEN '' WHEN num IS NOT NULL THEN 'number' ELSE 'wait' END AS act
    FROM (SELECT o.doc_id, o.i, o.pos, o.kind, o.chapter AS own, f.first, f.chapter, f.verse, f.held, f.ended, f.n, f.grp, f.begun,
        CASE WHEN o.kind <> 'text' OR coalesce(f.first, 0) = 0 THEN NULL WHEN o.number IS NOT NULL THEN o.number WHEN f.verse = 0 AND regexp_matches(o.text, '^[0-9]{1,3} ') THEN greatest(1, CASE WHEN CAST(regexp_extract(o.text, '^[0-9]+') AS BIGINT) = f.first THEN 1 ELSE CAST(regexp_extract(o.text, '^[0-9]+') AS BIGINT) END) END AS num,
        CASE WHEN o.kind = 'text' AND o.number IS NULL AND f.verse = 0 AND coalesce(f.first, 0) > 0 AND regexp_matches(o.text, '^[0-9]{1,3} ') THEN ltrim(regexp_replace(o.text, '^[0-9]+', '')) ELSE o.text END AS text
      FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1) a) b),
v AS (SELECT doc_id, 2 * n + 1 AS ordinal, chapter, verse, flag AS paragraph, grp, opens, i FROM f WHERE act = 'number'),
h AS (SELECT doc_id, ordinal, chapter, verse, paragraph FROM v UNION ALL SELECT doc_id, ordinal - 1, chapter, 1, true FROM v WHERE opens),
w AS (SELECT f.doc_id, CASE WHEN f.act = 'number' THEN 2 * f.n + 1 ELSE coalesce(v.ordinal - 1, 2 * f.n + 1) END AS ordinal, f.i, trim(regexp_replace(f.text, '\s+', ' ', 'g')) AS text FROM f LEFT JOIN v ON f.act = 'wait' AND v.opens AND v.doc_id = f.doc_id AND v.grp = f.grp WHERE f.act IN ('wait', 'number')),
t AS (SELECT doc_id, ordinal, string_agg(text, ' ' ORDER BY i) AS text FROM w WHERE text <> '' GROUP BY 1, 2)"""


def verse_parts(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    kind = F.expr("case when pos % 5 = 0 then 'start' when length(t) % 7 = 3 then 'title' else 'text' end")
    p = s.withColumn("kind", kind).select("*", F.posexplode(F.split("t", ", ")).alias("part", "x")).filter("part = 0 or kind = 'text'")
    text = F.expr("if(part = 0 and length(t) % 3 = 1, concat(length(t) % 5, ' ', x), x)")
    start = lambda c: F.when(F.col("kind") == "start", c)
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), "part", "kind", start(F.lit(1)).alias("book"), start(F.expr("int(length(t) % 4)")).alias("chapter"), F.expr("if(part > 0, nullif(int(length(x) % 6), 0), null)").alias("number"), text.alias("text"))


@query(f"WITH RECURSIVE {PARTS.lstrip()} SELECT h.doc_id, h.ordinal, h.chapter, h.verse, h.paragraph, coalesce(t.text, '') AS text FROM h LEFT JOIN t ON t.doc_id = h.doc_id AND t.ordinal = h.ordinal")
def verse_rows(spark, d):
    """Numbered verses of every document's lines."""
    rows, _ = verses.verses(verse_parts(spark, d))
    return rows.select("doc_id", "ordinal", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), "paragraph", "text")


@query(f"""WITH RECURSIVE {PARTS.lstrip()}, e AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM f WHERE i > 0),
m AS (SELECT e.doc_id, e.i, e.text, min(x.i) AS ni FROM e JOIN e x ON x.doc_id = e.doc_id AND x.c = e.c AND x.act = 'number' AND x.i > e.i WHERE e.kind = 'title' GROUP BY ALL),
k AS (SELECT m.*, v.ordinal - CASE WHEN v.opens THEN 1 ELSE 0 END AS ordinal FROM m JOIN v ON v.doc_id = m.doc_id AND v.i = m.ni)
SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY i) AS seq, text FROM k""")
def verse_titles(spark, d):
    """The titles among every document's lines, by the verse that they stand before."""
    _, titles = verses.verses(verse_parts(spark, d))
    return titles.withColumn("seq", F.col("seq").cast("long"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS kind, 1 + length(text) // 60 AS n, CASE WHEN role = 'user' THEN 1 + length(text) // 200 ELSE 2 + length(text) // 60 END AS k FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, n, i) - 1 AS pos, CASE WHEN kind = 0 AND i = k - 1 THEN 2 ELSE kind END AS kind FROM (SELECT *, unnest(range(0, k)) AS i FROM s)),
g AS (SELECT *, kind = 1 AND lag(kind) OVER w IS DISTINCT FROM 1 AS opens, coalesce(sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, max(pos) OVER (PARTITION BY conv_id) + 1 AS total, first_value(CASE WHEN kind <> 1 THEN pos END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
h AS (SELECT conv_id, pos AS g, coalesce(nx, total) AS g_end FROM g WHERE opens),
p AS (SELECT conv_id, pos, c FROM g UNION ALL SELECT conv_id, max(total), sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) FROM g GROUP BY conv_id),
hc AS (SELECT h.*, p.c AS c_end FROM h JOIN p ON p.conv_id = h.conv_id AND p.pos = h.g_end),
e AS (SELECT g.conv_id, g.pos, least(g.pos + 12, g.total) AS e, false AS done FROM g UNION ALL
  SELECT e.conv_id, e.pos, coalesce(b.g, e.e), b.g IS NULL FROM e LEFT JOIN LATERAL (SELECT min(hc.g) AS g FROM hc, p WHERE hc.conv_id = e.conv_id AND hc.g > e.pos AND hc.g < e.e AND p.conv_id = e.conv_id AND p.pos = e.e AND p.c - hc.c_end < 2) b ON true WHERE NOT e.done),
n AS (SELECT conv_id, pos, min(e) AS e FROM e GROUP BY 1, 2),
c AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS start FROM l UNION ALL SELECT c.conv_id, n.e FROM c JOIN n ON n.conv_id = c.conv_id AND n.pos = c.start JOIN (SELECT conv_id, max(pos) AS m FROM l GROUP BY 1) t ON t.conv_id = c.conv_id WHERE n.e <= t.m)
SELECT conv_id, start FROM c""")
def column_starts(spark, d):
    """Columns of twelve lines over every conversation: a question is a heading, an answer content with a blank line after it."""
    rows = table(spark, d, "conversations").filter("conv_id is not null").selectExpr("conv_id", "turn", "int(role = 'user') as kind", "length(text) as n").fillna({"n": 0, "kind": 0})
    rows = rows.selectExpr("conv_id", "turn", "kind", "1 + n div 60 as m", "if(kind = 1, 1 + n div 200, 2 + n div 60) as k")
    before = F.sum("k").over(Window.partitionBy("conv_id").orderBy("turn", "kind", "m").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_at", F.coalesce(before, F.lit(0))).select("conv_id", "_at", "kind", "k", F.expr("explode(sequence(0, k - 1)) as i"))
    rows = rows.selectExpr("conv_id", "_at + i as pos", "if(kind = 0 and i = k - 1, 2, kind) as kind")
    return layout.columns(rows, ["conv_id"], 12)


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split_regex(text, '\. |\n')) AS t, unnest(range(0, len(string_split_regex(text, '\. |\n')))) AS pos FROM documents),
l AS (SELECT doc_id, pos, pos // 8 AS page, 90.0 * (pos % 8) AS top, CASE WHEN pos % 8 >= 4 AND length(t) % 3 > 0 THEN 8.0 ELSE 10.0 END AS size, length(t) % 11 = 0 AS bold, CASE WHEN length(t) % 5 = 0 THEN (pos % 30) || ' ' || t WHEN length(t) % 5 = 1 THEN 'a ' || t WHEN length(t) % 5 = 2 THEN t || '-' ELSE t END AS text FROM s),
k AS (SELECT *, size < 8.8 AS small, CASE WHEN regexp_matches(text, '^[a-z] ') THEN text[1] ELSE nullif(regexp_extract(text, '^([0-9]{1,3})\.?[ \x{A0}]', 1), '') END AS lab FROM l),
r AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS page, CAST(NULL AS BIGINT) AS seen, false AS block, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS lab, '' AS text FROM k GROUP BY doc_id
  UNION ALL SELECT doc_id, pos, page, CASE WHEN inside THEN page ELSE seen END, inside, n + CASE WHEN inside AND lab IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN inside THEN lab END, text
  FROM (SELECT k.doc_id, k.pos, k.page, k.lab, k.text, r.seen, r.n, (r.block AND r.page = k.page AND k.small) OR (k.small AND top > 400 AND NOT bold AND (k.lab IS NOT NULL OR coalesce(r.seen + 1 = k.page, false))) AS inside FROM r JOIN k ON k.doc_id = r.doc_id AND k.pos = r.pos + 1) a),
o AS (SELECT *, rtrim(CASE WHEN lab IS NULL THEN text ELSE regexp_replace(text[length(lab) + 1:], '^[. \x{A0}]+', '') END) AS t FROM r WHERE block),
p AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, n ORDER BY pos) AS nx FROM o)
SELECT doc_id, n AS note, min(page) AS page, max(lab) AS label, trim(regexp_replace(string_agg(CASE WHEN nx IS NULL THEN t WHEN regexp_matches(t, '\x{AD}$') THEN regexp_replace(t, '\x{AD}$', '') WHEN regexp_matches(t, '.-$') AND regexp_matches(nx, '^\p{Ll}') THEN regexp_replace(t, ' *-$', '') ELSE t || ' ' END, '' ORDER BY pos), '\s+', ' ', 'g')) AS text FROM p GROUP BY doc_id, n""")
def document_notes(spark, d):
    """Footnotes of every document, eight lines to a page, over page turns."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("pos", "t")).withColumn("n", F.length("t"))
    text = F.expr("case when n % 5 = 0 then concat(pos % 30, ' ', t) when n % 5 = 1 then concat('a ', t) when n % 5 = 2 then concat(t, '-') else t end")
    rows = s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.expr("pos div 8").alias("page"), F.expr("90D * (pos % 8)").alias("top"), F.expr("if(pos % 8 >= 4 and n % 3 > 0, 8D, 10D)").alias("size"), F.expr("n % 11 = 0").alias("bold"), text.alias("text"))
    profile = table(spark, d, "documents").select("doc_id").distinct().withColumn("body_size", F.lit(10.0))
    return footnotes.notes(footnotes.split(rows, profile))


# Every part of a turn between commas is a fragment: ten sentences a page, whose parts stand a little off their baselines; every ninth is a raised mark.
FRAGMENTS = r"""
d AS (SELECT conv_id * 1000 + turn AS doc_id, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1),
s AS (SELECT doc_id, unnest(string_split_regex(text, '\. |\n')) AS t, unnest(range(0, len(string_split_regex(text, '\. |\n')))) AS pos FROM d),
w AS (SELECT doc_id, pos, unnest(string_split(t, ', ')) AS w, unnest(range(0, len(string_split(t, ', ')))) AS i FROM s),
n AS (SELECT *, length(w) AS n, CAST(coalesce(sum(length(w)) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars FROM w),
f AS (SELECT doc_id, pos // 10 AS page, 50 + 8.0 * chars + 4 * i + CASE WHEN n % 7 = 6 THEN 20 ELSE 0 END AS x, (1000 + 1400 * (pos % 10) + (n * 7 + i * 3) % 25 * 10 - CASE WHEN i % 9 = 4 THEN 400 ELSE 0 END) / 100 AS y, 0.0 AS rise, 8.0 * n + CASE WHEN i % 5 = 3 THEN 3 ELSE 0 END AS width, CASE WHEN i % 9 = 4 THEN 6.0 ELSE 10.0 END AS size, n % 5 = 0 AS bold, n % 6 = 0 AS italic, CASE WHEN i % 9 = 4 THEN CAST(n % 10 AS VARCHAR) ELSE w END AS text FROM n)"""


@query(rf"""WITH RECURSIVE {FRAGMENTS.lstrip()},
q AS (SELECT *, CAST(round(100 * (y + rise)) AS BIGINT) AS q, row_number() OVER (PARTITION BY doc_id, page ORDER BY CAST(round(100 * (y + rise)) AS BIGINT), x, text, width, size, bold, italic) AS rn FROM f WHERE text <> ''),
a AS (SELECT doc_id, page, min(q) AS a FROM q GROUP BY 1, 2 UNION ALL SELECT doc_id, page, nx FROM (SELECT a.doc_id, a.page, min(q.q) AS nx FROM a JOIN q ON q.doc_id = a.doc_id AND q.page = a.page AND q.q > a.a + 150 GROUP BY 1, 2) z),
g AS (SELECT q.*, max(a.a) AS g FROM q JOIN a ON a.doc_id = q.doc_id AND a.page = q.page AND a.a <= q.q GROUP BY ALL),
h AS (SELECT doc_id, page, g, bool_and(regexp_matches(regexp_replace(trim(text), '[,.;:)]+$', ''), '^([0-9*)]+|[a-z])$')) AS marks, max(size) AS size FROM g GROUP BY 1, 2, 3),
hb AS (SELECT *, coalesce(marks AND size < 0.8 * lead(size) OVER w AND lead(g) OVER w - g < 70 * lead(size) OVER w, false) AS joins FROM h WINDOW w AS (PARTITION BY doc_id, page ORDER BY g)),
ht AS (SELECT x.doc_id, x.page, x.g, min(y.g) AS line FROM hb x JOIN hb y ON y.doc_id = x.doc_id AND y.page = x.page AND y.g >= x.g AND NOT y.joins GROUP BY 1, 2, 3),
r AS (SELECT g.* EXCLUDE (rise), rise + (line - g.g) / 100 AS rise, line FROM g JOIN ht ON ht.doc_id = g.doc_id AND ht.page = g.page AND ht.g = g.g),
st AS (SELECT doc_id, page, line, max(size) AS any_size, arg_max(s, (n, s)) AS s FROM (SELECT doc_id, page, line, max(size) AS size, CAST(round(size * 10) AS INTEGER) AS s, sum(CASE WHEN abs(rise) <= 0.5 THEN length(text) ELSE 0 END) AS n FROM r GROUP BY doc_id, page, line, CAST(round(size * 10) AS INTEGER), bold, italic) GROUP BY 1, 2, 3),
k AS (SELECT r.*, s / 10.0 AS ls, lead(x) OVER w AS nx, lead(text) OVER w AS nt FROM r JOIN st ON st.doc_id = r.doc_id AND st.page = r.page AND st.line = r.line WINDOW w AS (PARTITION BY r.doc_id, r.page, r.line ORDER BY x, rn)),
c AS (SELECT * EXCLUDE (width), CASE WHEN nx > x AND x + width > nx + 0.05 THEN nx - x ELSE width END AS width FROM k),
l AS (SELECT *, CASE WHEN trim(text) <> '' AND nx - x - width > 0 THEN nx - x - width END AS letter, lag(x + width) OVER w AS e FROM c WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x, rn)),
m AS (SELECT doc_id, page, line, list_sort(list(letter) FILTER (letter IS NOT NULL)) AS gaps, count(*) AS m, min(ls) AS ls FROM l GROUP BY 1, 2, 3),
t AS (SELECT doc_id, page, line, CASE WHEN len(gaps) >= 8 AND 2 * len(gaps) >= m AND gaps[len(gaps) // 2 + 1] < 0.25 * ls THEN gaps[len(gaps) // 2 + 1] ELSE 0 END AS tr FROM m),
b AS (SELECT l.*, tr, e IS NOT NULL AND NOT (regexp_matches(trim(text), '^[!-/:-@\[-`{{-~–»«’]+$') AND NOT regexp_matches(trim(text), '^[(»„\[]')) AS plain, x - e AS gap FROM l JOIN t ON t.doc_id = l.doc_id AND t.page = l.page AND t.line = l.line),
z AS (SELECT doc_id, page, line, max(x + width) AS rgt, string_agg(CASE WHEN plain AND gap > 0.625 * ls THEN chr(9) WHEN plain AND gap > 0.15 * ls + tr THEN ' ' ELSE '' END || text, '' ORDER BY x, rn) AS text,
  array_to_string(list(CASE WHEN (rise > 0.5 OR (size < 0.8 * ls AND q < line - 50)) AND regexp_matches(trim(text), '^([0-9]+|[a-z])[,.;:)]*$') THEN regexp_extract(trim(text), '^([0-9]+|[a-z])', 1) END ORDER BY x, rn), ',') AS marks, min(ls) AS size FROM b GROUP BY 1, 2, 3)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) - 1 AS line, CAST(line / 100 AS DOUBLE) AS top, CAST(size AS DOUBLE) AS size, text, coalesce(marks, '') AS marks FROM z""")
def page_lines(spark, d):
    """Lines of every turn's parts, placed on pages."""
    turns = table(spark, d, "conversations").filter("conv_id is not null and turn is not null").groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")).agg(F.min("text").alias("text"))
    s = turns.select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("pos", "t"))
    w = s.select("doc_id", "pos", F.posexplode(F.split("t", ", ")).alias("i", "w")).withColumn("n", F.length("w"))
    w = w.withColumn("chars", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fragments = w.selectExpr(
        "doc_id", "pos div 10 as page", "50D + 8 * chars + 4 * i + if(n % 7 = 6, 20, 0) as x", "(1000 + 1400 * (pos % 10) + (n * 7 + i * 3) % 25 * 10 - if(i % 9 = 4, 400, 0)) / 100D as y", "0D as rise",
        "8D * n + if(i % 5 = 3, 3, 0) as width", "if(i % 9 = 4, 6D, 10D) as size", "n % 5 = 0 as bold", "n % 6 = 0 as italic", "if(i % 9 = 4, string(n % 10), w) as text",
    )
    found = lines.lines(fragments)
    return found.select("doc_id", "page", F.col("line").cast("long").alias("line"), "top", "size", "text", F.array_join("marks", ",").alias("marks"))


# Every line of a document is a run of characters; links of 30, 40 or 50 characters begin at every fiftieth, some of them touching.
RUNS = r"""
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
r AS (SELECT doc_id, pos AS run, start, start + n AS "end" FROM (SELECT doc_id, pos, length(t) AS n, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)),
k AS (SELECT doc_id, i AS link, 50 * i + doc_id % 7 AS start, 50 * i + doc_id % 7 + 30 + i % 3 * 10 AS "end" FROM (SELECT doc_id, unnest(range(0, 1 + length(text) // 50)) AS i FROM documents))"""


def runs(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("run", "t")).withColumn("n", F.length("t"))
    before = Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))
    return rows.select("doc_id", F.col("run").cast("long").alias("run"), start.alias("start"), (start + F.col("n")).alias("end"))


def links(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.expr("explode(sequence(0L, length(text) div 50)) as link"))
    return rows.selectExpr("doc_id", "link", "50 * link + doc_id % 7 as start", "50 * link + doc_id % 7 + 30 + link % 3 * 10 as end")


@query(rf"""WITH {RUNS.lstrip()}, b AS (SELECT DISTINCT doc_id, unnest([start, "end"]) AS p FROM (SELECT doc_id, start, "end" FROM r WHERE start < "end" UNION ALL SELECT doc_id, start, "end" FROM k)),
g AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM b)
SELECT g.doc_id, r.run, g.p AS start, g.nx AS "end", k.link FROM g JOIN r ON r.doc_id = g.doc_id AND r.start <= g.p AND g.p < r."end" LEFT JOIN k ON k.doc_id = g.doc_id AND k.start <= g.p AND g.p < k."end" WHERE g.nx IS NOT NULL""")
def linked_pieces(spark, d):
    """Every line of a document cut at the bounds of its links."""
    return intervals.pieces(runs(spark, d), links(spark, d), ["doc_id"], "run", "link")


@query(rf"""WITH {RUNS.lstrip()} SELECT r.doc_id, r.run, min(k.link) AS link FROM r LEFT JOIN k ON k.doc_id = r.doc_id AND k.start < r."end" AND k."end" > r.start GROUP BY 1, 2""")
def first_links(spark, d):
    """The first link that every line of a document has a part in."""
    return intervals.first_overlap(runs(spark, d), links(spark, d), ["doc_id"], "link").select("doc_id", "run", "link")


@query(r"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, CASE WHEN length(text) % 3 > 0 THEN length(text) % 11 END AS name, role = 'user' AS mark FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT * FROM m WHERE NOT mark), n AS (SELECT m.conv_id, m.i, (SELECT min(b.i) FROM b WHERE b.conv_id = m.conv_id AND b.name = m.name) AS body FROM m WHERE mark),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS r FROM n WHERE body IS NULL),
f AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS r FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = b.conv_id AND n.body = b.i))
SELECT n.conv_id, n.i, coalesce(n.body, f.i) AS body FROM n LEFT JOIN l ON l.conv_id = n.conv_id AND l.i = n.i LEFT JOIN f ON f.conv_id = l.conv_id AND f.r = l.r""")
def note_bodies(spark, d):
    """Questions of every conversation as marks, answers as bodies: paired by name, the rest by order."""
    rows = table(spark, d, "conversations").filter("conv_id is not null")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    rows = rows.select("conv_id", i.cast("long").alias("i"), F.expr("if(length(text) % 3 > 0, length(text) % 11, null)").alias("name"), (F.col("role") == "user").alias("mark"))
    return intervals.paired(rows.filter("mark").drop("mark"), rows.filter("not mark").drop("mark"), ["conv_id"], "i", "name").select("conv_id", "i", "body")


@query("""WITH m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS mark, pos, length(t) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) s),
k AS (SELECT doc_id, mark, 7.0 * (n % 60) AS lft, 15.0 * pos AS top, 2.0 + n % 40 AS width, 6.0 AS height FROM m), p AS (SELECT doc_id, pos AS place, 11.0 * (n % 50) AS x, 20.0 * pos + n % 13 AS y FROM m),
h AS (SELECT p.doc_id, p.place, arg_min(mark, (abs(x - lft - width / 2) + abs(y - top - height / 2), mark)) AS mark FROM p JOIN k ON k.doc_id = p.doc_id AND x BETWEEN lft - greatest(22, 1.5 * width) AND lft + width + greatest(22, 1.5 * width) AND y BETWEEN top - 22 AND top + height + 22 GROUP BY 1, 2)
SELECT p.doc_id, p.place, h.mark FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.place = p.place""")
def nearest_marks(spark, d):
    """The mark next to a place in every line of a document, each line having one mark."""
    lines_of = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("t").alias("n"))
    marks = lines_of.selectExpr("doc_id", "pos + 1 as mark", "7D * (n % 60) as left", "15D * pos as top", "2D + n % 40 as width", "6D as height")
    places = lines_of.selectExpr("doc_id", "pos as at", "11D * (n % 50) as x", "20D * pos + n % 13 as y")
    return hits.nearest_marks(places, marks, ["doc_id"]).select("doc_id", F.col("at").alias("place"), "mark")


_NAMES = refs.built_in().at


@query(rf"""WITH b AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r[2]}')" for i, r in enumerate(refs.ROWS))}) t(k, name)), names AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {i})" for n, i in _NAMES.items())}) t(key, book)),
t AS (SELECT page_id, coalesce(regexp_extract(html, '<title[^>]*>([^<]*)', 1), '') || ' ' || name || ['', 'brief', 'evangelium', 'xyz', '-Brief'][page_id % 5 + 1] || ' Auslegung' AS title FROM pages JOIN b ON k = page_id % 66),
w AS (SELECT page_id, list_filter(string_split_regex(title, '[^\p{{L}}\p{{N}}.]+'), lambda x: x <> '') AS w FROM t), i AS (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT page_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest([1, 2, 3]) AS n FROM i) x WHERE i + n - 1 <= len(w)),
f AS (SELECT page_id, i, n, 0 AS f, t FROM g UNION ALL SELECT page_id, i, n, s.f, regexp_replace(t[:length(t) - length(s.s)], '-+$', '') FROM g JOIN (VALUES (1, 'brief'), (2, 'briefes'), (3, '-Brief'), (4, 'evangelium'), (5, 'buch')) s(f, s) ON suffix(t, s.s)),
r AS (SELECT page_id, arg_min(book, (i, -n, f)) AS book FROM f JOIN names ON key = replace(replace(replace(replace(regexp_replace(lower(t), '[. \t]', '', 'g'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') GROUP BY 1)
SELECT t.page_id, t.title, r.book FROM t LEFT JOIN r ON r.page_id = t.page_id""")
def title_books(spark, d):
    """The book that every page's title names, a German name being put behind it."""
    books = spark.createDataFrame([(i, r[2]) for i, r in enumerate(refs.ROWS)], "_k int, name string")
    title = F.concat(F.coalesce(F.regexp_extract("html", "<title[^>]*>([^<]*)", 1), F.lit("")), F.lit(" "), "name", F.expr("get(array('', 'brief', 'evangelium', 'xyz', '-Brief'), int(page_id % 5))"), F.lit(" Auslegung"))
    rows = table(spark, d, "pages").join(F.broadcast(books), F.col("page_id") % 66 == F.col("_k")).select("page_id", title.alias("title"))
    return titles.book_in_title(rows, ["page_id"], "title", titles.name_table(spark, _NAMES))
