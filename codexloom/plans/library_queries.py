"""The library's queries bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ALIASES, marker_label, xml_escape
from ..operators import intervals, layout, library, replication, search
from .registry import query, table

SEARCH = "the thing and nicht Erde est que the"

_ALIAS = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " END"
_STRIP = "regexp_replace({0}, '^(.{{4,}}?)(ern|em|en|er|es|e|n|t)$', '\\1')"
_TOKEN = f"coalesce({_ALIAS.format('w')}, {_ALIAS.format(_STRIP.format('w'))}, {_STRIP.format('w')})"


def _tokens_sql(rows: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    fold = f"lower(regexp_replace(strip_accents(coalesce({text}, '')), '[^\\x00-\\x7F]', '', 'g'))"
    return f"""words AS (SELECT {key}, unnest(string_split_regex({fold}, '[^a-z0-9]+')) AS w FROM {rows}),
tok AS (SELECT {key}, {_TOKEN} AS term FROM words WHERE w <> '')"""


_LENGTHS = "len AS (SELECT d.doc_id, coalesce(n, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) USING (doc_id))"
_QUERY = f"""q0 AS (SELECT unnest(string_split(lower('{SEARCH}'), ' ')) AS w), q AS (SELECT {_TOKEN} AS term FROM q0)"""
SCORES_SQL = f"""WITH {_tokens_sql()}, {_LENGTHS}, {_QUERY},
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len) FROM len) AS avg),
scored AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), s GROUP BY 1)
SELECT doc_id, score FROM scored WHERE score > 0"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(SCORES_SQL + " ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return search.top_hits(_docs(spark, d), "doc_id", "text", SEARCH, 10)


@query(SCORES_SQL)
def bm25_scores(spark, d):
    return search.scores(_docs(spark, d), "doc_id", "text", SEARCH).select("doc_id", F.round("score", 6).alias("score")).filter("score > 0")


@query(f"WITH {_tokens_sql()}, {_LENGTHS} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT round(avg(len), 6) FROM len) AS avg_len, (SELECT count(DISTINCT (doc_id, term)) FROM tok) AS n_postings, (SELECT count(DISTINCT term) FROM tok) AS n_terms")
def bm25_index_stats(spark, d):
    return search.index_stats(_docs(spark, d), "doc_id", "text").select("n_docs", F.round("avg_len", 6).alias("avg_len"), "n_postings", "n_terms")


@query(f"WITH {_tokens_sql()} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2")
def doc_term_freq(spark, d):
    return search.term_frequencies(_docs(spark, d), "doc_id", "text")


@query(f"WITH {_tokens_sql()} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1")
def doc_freq(spark, d):
    return search.document_frequencies(_docs(spark, d), "doc_id", "text")


@query(f"WITH {_tokens_sql()}, {_LENGTHS} SELECT doc_id, CAST(len AS BIGINT) AS len FROM len")
def doc_lengths(spark, d):
    return search.lengths(_docs(spark, d), "doc_id", "text")


# Dictionary

_ENTRY = "e AS (SELECT p_partkey AS sort, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS key, p_name AS headword, p_brand AS pron, p_type AS text FROM part)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("sort"), F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("key"), F.col("p_name").alias("headword"), F.col("p_brand").alias("pron"), F.col("p_type").alias("text"), F.col("p_brand").alias("module"))


@query(f"WITH {_ENTRY} SELECT sort, key, headword, CAST(0 AS BIGINT) AS matches FROM e WHERE contains(lower(headword), 'red') OR contains(lower(pron), 'red') OR ltrim(key, '0') = 'red' ORDER BY sort LIMIT 40")
def dict_search(spark, d):
    return search.dictionary_search(_entries(spark, d), "Red", 40).select("sort", "key", "headword", "matches")


@query(f"WITH {_ENTRY} SELECT sort, key, headword, CAST(1 AS BIGINT) AS matches FROM e WHERE lower(text) = 'economy' ORDER BY sort LIMIT 40")
def dict_search_body(spark, d):
    return search.dictionary_search(_entries(spark, d), "gEconomy ", 40, strip_g=True).select("sort", "key", "headword", "matches")


@query("SELECT p_partkey AS sort, p_brand AS module, (SELECT max(b.p_partkey) FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey < a.p_partkey) AS prev, (SELECT min(b.p_partkey) FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey > a.p_partkey) AS next FROM part a")
def dict_neighbors(spark, d):
    return library.neighbours(_entries(spark, d).select("module", "sort"), ["module"], "sort")


@query("SELECT conv_id, turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS prev, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn) AS next FROM conversations a")
def section_neighbors(spark, d):
    return library.neighbours(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query(f"WITH {_ENTRY} SELECT sort, key, headword FROM e WHERE sort BETWEEN 20 AND 60 ORDER BY sort")
def dict_range(spark, d):
    return _entries(spark, d).filter(F.col("sort").between(20, 60)).orderBy("sort").select("sort", "key", "headword")


@query("SELECT o_orderkey, CAST((month(o_orderdate) * 100 + day(o_orderdate)) * 10 AS BIGINT) AS sort FROM orders WHERE (month(o_orderdate) * 100 + day(o_orderdate)) * 10 BETWEEN 3140 AND 3149")
def devotional_day(spark, d):
    sort = ((F.month("o_orderdate") * 100 + F.day("o_orderdate")) * 10).cast("long")
    return table(spark, d, "orders").select("o_orderkey", sort.alias("sort")).filter(F.col("sort").between(3140, 3149))


# Concordance and inventory


@query("SELECT l_orderkey AS verse, l_linenumber AS seq, o_orderpriority AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 42 ORDER BY verse, seq, text LIMIT 500")
def concordance(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("verse"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("strong"))
    verses = table(spark, d, "orders").select(F.col("o_orderkey").alias("verse"), F.col("o_orderpriority").alias("text"))
    return library.concordance(links, verses, ["verse"], "strong", 42, ["verse", "seq", "text"], 500).select("verse", "seq", "text")


def _modules(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("code"), "doc_id", "text")
    tagged = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("code")
    return docs, docs.select("code").distinct(), tagged


@query("SELECT min(source) AS code FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def first_tagged_module(spark, d):
    _, modules, tagged = _modules(spark, d)
    return library.first_tagged(modules, tagged)


@query("""WITH o AS (SELECT * FROM (VALUES ('src1', 'First'), ('src7', 'Seventh'), ('nowhere', 'None')) t(code, title)),
m AS (SELECT source AS code, count(*) AS n_verses, count(*) FILTER (WHERE contains(text, chr(10))) AS n_notes FROM documents GROUP BY 1)
SELECT m.code, coalesce(o.title, 'Module ' || m.code) AS title, n_verses, n_notes, m.code IN (SELECT source FROM documents SEMI JOIN labels USING (doc_id)) AS strongs FROM m LEFT JOIN o ON m.code = o.code""")
def module_inventory(spark, d):
    docs, modules, tagged = _modules(spark, d)
    titles = spark.createDataFrame([("src1", "First"), ("src7", "Seventh"), ("nowhere", "None")], "code string, title string")
    named = modules.withColumn("title", F.concat(F.lit("Module "), "code"))
    children = {"verses": docs.select("code"), "notes": docs.filter(F.contains("text", F.lit("\n"))).select("code")}
    return library.inventory(named, titles, children, tagged).select("code", "title", "n_verses", "n_notes", "strongs")


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS text_length, max(turn) AS last_verse FROM conversations GROUP BY 1")
def contents_spine(spark, d):
    return library.contents(table(spark, d, "conversations"), ["conv_id"], "turn")


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def chapter_rows(spark, d):
    return library.chapter_rows(table(spark, d, "conversations"), {"conv_id": 7}, ["turn"]).select("turn", "role", "text")


@query("SELECT turn, text FROM conversations WHERE conv_id = 7 AND role = 'assistant' ORDER BY turn")
def notes_rows(spark, d):
    return library.chapter_rows(table(spark, d, "conversations"), {"conv_id": 7, "role": "assistant"}, ["turn"]).select("turn", "text")


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn")
def all_rows(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text").orderBy("conv_id", "turn")


@query("SELECT count(*) AS verse_count FROM conversations")
def verse_count(spark, d):
    return table(spark, d, "conversations").agg(F.count("*").alias("verse_count"))


@query("""SELECT 'labels' AS child, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) UNION ALL
SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""")
def orphaned_rows(spark, d):
    parents = table(spark, d, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    return library.orphans({"labels": (table(spark, d, "labels").select(F.col("doc_id").alias("child_id")), "child_id"), "lineitem": (table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")}, parents, "doc_id")


@query("""WITH i AS (SELECT quality AS module, toxic * 2 + doc_id % 7 * 3 AS idx, max(doc_id) AS width, max(toxic) AS height FROM labels GROUP BY 1, 2),
s AS (SELECT module, unnest(generate_series(0, max(idx))) AS idx FROM i GROUP BY module)
SELECT module, idx, coalesce(width, 0) AS width, CAST(coalesce(height, 0) AS BIGINT) AS height FROM s LEFT JOIN i USING (module, idx)""")
def image_gap_fill(spark, d):
    images = table(spark, d, "labels").select(F.col("quality").alias("module"), F.expr("toxic * 2 + doc_id % 7 * 3").alias("idx"), F.col("doc_id").alias("width"), F.col("toxic").cast("long").alias("height"))
    return library.image_sizes(images, "module").withColumn("idx", F.col("idx").cast("long"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k AS seq, CASE WHEN k >= 26 THEN chr(CAST(96 + k // 26 AS INT)) ELSE '' END || chr(CAST(97 + k % 26 AS INT)) AS label FROM n""")
def note_labels(spark, d):
    rows = library.numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", "seq", marker_label(F.col("seq")).alias("label"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS BIGINT) AS seq FROM conversations")
def seq_numbering(spark, d):
    return library.numbered(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], ["turn"])


@query("SELECT l_orderkey, string_agg(l_shipmode, ' ' ORDER BY pos) AS text, arg_min(l_returnflag, pos) AS flag FROM (SELECT l_orderkey, l_linestatus AS l_shipmode, l_returnflag, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS pos FROM lineitem) GROUP BY 1")
def concatenate_duplicates(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("text"), F.col("l_returnflag").alias("flag"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("pos"))
    return library.concatenated(rows, ["l_orderkey"], "pos", "text", ("flag",))


@query("SELECT l_orderkey, arg_max(l_partkey, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS l_partkey, arg_max(l_returnflag, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS flag FROM lineitem GROUP BY 1")
def last_wins(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("flag"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("pos"))
    return library.last_wins(rows, ["l_orderkey"], "pos").select("l_orderkey", "l_partkey", "flag")


# Replicated state

_OPS = "ops AS (SELECT event_type || '/' || user_id AS key, props AS value, epoch_us(ts) // 1000 AS millis, event_id AS counter, 'd' || user_id % 4 AS device FROM events)"
_FOLD = "SELECT key, arg_max(value, (millis, counter, device)) AS value, max((millis, counter, device)) AS s FROM {0} GROUP BY key"
_STATE = f"state AS (SELECT key, value, s[1] AS millis, s[2] AS counter, s[3] AS device FROM ({_FOLD.format('(SELECT * FROM ops WHERE counter % 2 = 0)')}))"


def ops_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), F.col("event_id").alias("counter"), F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("device"))


def _state(spark, d):
    ops = ops_of(spark, d)
    return replication.merged(ops.filter("counter % 2 = 0")), ops.filter("counter % 2 = 1")


@query(f"WITH {_OPS} SELECT key, value, s[1] AS millis, s[2] AS counter, s[3] AS device FROM ({_FOLD.format('ops')})")
def lww_fold(spark, d):
    return replication.merged(ops_of(spark, d))


@query(f"WITH {_OPS} SELECT key, value, s[1] AS millis, s[2] AS counter, s[3] AS device FROM ({_FOLD.format('ops')})")
def lww_apply(spark, d):
    return replication.applied(*_state(spark, d))


@query(f"WITH {_OPS}, {_STATE}, new AS (SELECT key, value, s FROM ({_FOLD.format('(SELECT * FROM ops WHERE counter % 2 = 1)')})) SELECT new.key, new.value FROM new LEFT JOIN state USING (key) WHERE state.key IS NULL OR s > (state.millis, state.counter, state.device)")
def changed_keys(spark, d):
    return replication.changes(*_state(spark, d)).select("key", "value")


@query(f"WITH {_OPS} SELECT key, value, s[1] AS millis, s[2] AS counter FROM ({_FOLD.format(chr(40) + 'SELECT * FROM ops WHERE device = ' + chr(39) + 'd1' + chr(39) + chr(41))}) ORDER BY millis, counter")
def log_compact(spark, d):
    return replication.compacted(ops_of(spark, d), "d1").select("key", "value", "millis", "counter")


@query(f"""WITH {_OPS}, full_state AS (SELECT key, value, s[1] AS millis, s[2] AS counter, s[3] AS device FROM ({_FOLD.format('ops')})),
log AS (SELECT key, max((millis, counter)) AS s FROM ops WHERE device = 'd2' AND counter % 3 <> 0 GROUP BY 1)
SELECT f.key, f.value FROM full_state f LEFT JOIN log USING (key) WHERE f.device = 'd2' AND (log.key IS NULL OR (f.millis, f.counter) > s)""")
def self_heal(spark, d):
    ops = ops_of(spark, d)
    return replication.healing(replication.merged(ops), ops.filter("counter % 3 <> 0"), "d2").select("key", "value")


@query(f"WITH {_OPS}, k AS (SELECT DISTINCT key FROM ops) SELECT key FROM k WHERE starts_with(key, 'click/') ORDER BY key")
def keys_prefix(spark, d):
    return library.prefix_scan(ops_of(spark, d).select("key").distinct(), "click/")


@query(f"WITH {_OPS} SELECT key, '{{\"k\":\"' || key || '\",\"v\":' || arg_max(value, (millis, counter, device)) || '}}' AS line FROM ops WHERE starts_with(key, 'view/') GROUP BY key ORDER BY key")
def label_export(spark, d):
    rows = replication.live(library.prefix_scan(replication.merged(ops_of(spark, d).filter(F.startswith("key", F.lit("view/")))), "view/"))
    return rows.select("key", F.concat(F.lit('{"k":"'), "key", F.lit('","v":'), "value", F.lit("}")).alias("line"))


@query("""WITH e AS (SELECT user_id, event_id AS seq, epoch_us(ts) // 60000000000 AS now FROM events), h AS (SELECT user_id, seq, max(now) OVER (PARTITION BY user_id ORDER BY seq) AS millis FROM e)
SELECT user_id, seq, millis, CAST(row_number() OVER (PARTITION BY user_id, millis ORDER BY seq) - 1 AS BIGINT) AS counter FROM h""")
def hlc_ticks(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.expr("unix_millis(cast(ts as timestamp)) div 60000000").alias("now"))
    return replication.clock_ticks(e, "user_id", "now").select("user_id", "seq", "millis", "counter")


# Intervals

_TURNS = "iv AS (SELECT conv_id, turn, role, turn AS a, turn + length(text) % 4 AS b FROM conversations)"


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("a"), (F.col("turn") + F.length("text") % 4).alias("b"))


@query(f"WITH {_TURNS} SELECT x.conv_id, x.turn AS comment, y.turn AS mark FROM iv x JOIN iv y ON x.conv_id = y.conv_id AND x.role = 'assistant' AND y.role = 'user' AND x.a <= y.b AND y.a <= x.b")
def comment_overlap(spark, d):
    t = _turns(spark, d)
    left = t.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("comment"), F.col("a").alias("la"), F.col("b").alias("lb"))
    right = t.filter("role = 'user'").select("conv_id", F.col("turn").alias("mark"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    return intervals.overlap_join(left, right, ["conv_id"], "la", "lb", "ra", "rb", 4).select("conv_id", "comment", "mark")


@query("SELECT turn, text FROM conversations WHERE conv_id BETWEEN 3 AND 6 AND NOT (conv_id = 3 AND turn < 1) AND NOT (conv_id = 6 AND turn > 1)")
def footnote_range(spark, d):
    rows = table(spark, d, "conversations").filter(F.col("conv_id").between(3, 6))
    return rows.filter("not (conv_id = 3 and turn < 1) and not (conv_id = 6 and turn > 1)").select("turn", "text")


@query(f"""WITH {_TURNS}, o AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY conv_id ORDER BY a, b, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR row_number() OVER (PARTITION BY conv_id ORDER BY a, b, turn) = 1 THEN 1 ELSE 0 END AS n FROM iv WHERE role = 'user'),
g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY a, b, turn) AS i FROM o) SELECT conv_id, min(a) AS a, max(b) AS b, count(*) AS n_merged FROM g GROUP BY conv_id, i""")
def interval_span_merge(spark, d):
    return intervals.merged_spans(_turns(spark, d).filter("role = 'user'"), ["conv_id"], "a", "b")


@query("""SELECT e.event_id, min(p.event_id) AS note FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id >= e.event_id WHERE e.event_type = 'click' GROUP BY 1""")
def asof_note_binding(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    notes = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("note"))
    return intervals.next_at_or_after(e.filter("event_type = 'click'"), notes, ["user_id"], "event_id", "at", "note").select("event_id", "note")


@query("""WITH r AS (SELECT user_id, event_id, value < 20 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM r WHERE f)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= 2""")
def poetry_runs(spark, d):
    return intervals.runs(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value < 20", 2)


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, pos, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(strlen(t) AS BIGINT) AS bytes FROM p""")
def paragraph_offsets(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    size = F.octet_length("t").cast("long")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.sum(size + 1).over(w), F.lit(0)).alias("start"), size.alias("bytes"))


# Layout, plans, documents


@query("SELECT conv_id, turn, CAST(sum(1 + length(text) // 60) OVER (PARTITION BY conv_id ORDER BY turn) - (1 + length(text) // 60) AS BIGINT) AS first_line, CAST((sum(1 + length(text) // 60) OVER (PARTITION BY conv_id ORDER BY turn) - (1 + length(text) // 60)) // 12 AS BIGINT) AS column_no FROM conversations")
def column_plan(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr("1 + length(text) div 60").alias("lines"))
    return layout.column_of(layout.block_starts(rows, ["conv_id"], "turn", "lines"), 12).select("conv_id", "turn", "first_line", F.col("column").alias("column_no"))


@query("SELECT o_orderkey, CAST(least(dayofyear(o_orderdate), 365) AS BIGINT) AS plan_day, CAST(dayofyear(make_date(2024, month(o_orderdate), day(o_orderdate))) AS BIGINT) AS leap_day FROM orders")
def plan_day(spark, d):
    leap = F.dayofyear(F.make_date(F.lit(2024), F.month("o_orderdate"), F.day("o_orderdate")))
    return table(spark, d, "orders").select("o_orderkey", F.least(F.dayofyear("o_orderdate"), F.lit(365)).cast("long").alias("plan_day"), leap.cast("long").alias("leap_day"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT line, n FROM c""")
def furniture(spark, d):
    lines = _docs(spark, d).select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter("trim(line) <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n")).filter("n >= 3")


@query("""WITH a AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1), b AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)) GROUP BY 1)
SELECT w, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS invented FROM a FULL JOIN b USING (w) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def extraction_diff(spark, d):
    count = lambda rows, n: rows.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias(n))
    bench = table(spark, d, "benchmark")
    other = table(spark, d, "documents").join(bench.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    both = count(bench, "a").join(count(other, "b"), "w", "full").na.fill(0, ["a", "b"]).filter("a <> b")
    return both.select("w", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("invented"))


_FEATURES = {"n_headings": "<h[1-6][ >]", "n_paragraphs": "<p[ >]", "n_items": "<li[ >]", "n_tables": "<table[ >]", "n_images": "<img[ >]"}
_FEATURE_SQL = ", ".join(f"CAST(len(regexp_extract_all(html, '{p}')) AS BIGINT) AS {n}" for n, p in _FEATURES.items())


@query(f"SELECT page_id, {_FEATURE_SQL} FROM pages")
def doc_features(spark, d):
    return table(spark, d, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).cast("long").alias(n) for n, p in _FEATURES.items()])


@query(f"WITH f AS (SELECT page_id, {_FEATURE_SQL} FROM pages) SELECT page_id, CASE WHEN n_items >= 50 AND n_headings >= 2 AND 2 * n_items >= n_paragraphs THEN 'bible' WHEN n_headings >= 10 OR (n_headings * 100 >= 15 * n_paragraphs AND n_headings >= 3) THEN 'commentary' ELSE 'book' END AS kind FROM f")
def detect_kind(spark, d):
    kind = F.expr("case when n_items >= 50 and n_headings >= 2 and 2 * n_items >= n_paragraphs then 'bible' when n_headings >= 10 or (n_headings * 100 >= 15 * n_paragraphs and n_headings >= 3) then 'commentary' else 'book' end")
    return doc_features(spark, d).select("page_id", kind.alias("kind"))


@query("SELECT source, lang AS subject FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r, lead(count(*), 1, 0) OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS second FROM documents GROUP BY 1, 2) WHERE r = 1 AND n >= 20 AND n >= 2 * second")
def subject_mode(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n"), "lang")
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n", 1, 0).over(w))
    return ranked.filter("r = 1 and n >= 20 and n >= 2 * second").select("source", F.col("lang").alias("subject"))


@query("""WITH s AS (SELECT p_brand, list_sort(list(p_size)) AS v FROM part GROUP BY 1) SELECT p_brand, v[CAST(floor(len(v) * 9 / 10) AS BIGINT) + 1] AS p90, v[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS median, v[CAST(floor(len(v) / 10) AS BIGINT) + 1] AS p10 FROM s""")
def profile_quantiles(spark, d):
    """Integer-index quantiles, from counts of distinct values rather than from a sorted list of a group's rows."""
    counts = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand").orderBy("p_size")
    upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("p_brand")))
    at = lambda e: F.min(F.when(F.col("upto") > F.expr(e), F.col("p_size")))
    return upto.groupBy("p_brand").agg(at("all * 9 div 10").alias("p90"), at("all div 2").alias("median"), at("all div 10").alias("p10"))


@query("SELECT p_partkey, CAST(least(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6) AS BIGINT) AS level FROM part")
def heading_levels(spark, d):
    rank = F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size")))
    return table(spark, d, "part").select("p_partkey", F.least(rank, F.lit(6)).cast("long").alias("level"))


@query("SELECT p_brand, arg_max(p_type, (n, p_type)) AS style FROM (SELECT p_brand, p_type, sum(length(p_name)) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def dominant_style(spark, d):
    sums = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum(F.length("p_name")).alias("n"))
    return sums.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("style"))


@query("SELECT conv_id, turn, CASE WHEN lead(turn) OVER w IS NOT NULL THEN lead(turn) OVER w - 1 ELSE turn END AS verse_end FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def verse_end_extension(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce(F.lead("turn").over(w) - 1, "turn").alias("verse_end"))


@query("""WITH x AS (SELECT conv_id, turn, '<verse osisID=\"' || conv_id || '.' || turn || '\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</verse>' AS v FROM conversations)
SELECT conv_id, '<chapter>' || string_agg(v, '' ORDER BY turn) || '</chapter>' AS xml FROM x GROUP BY 1""")
def osis_chapters(spark, d):
    verse = F.concat(F.lit('<verse osisID="'), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit('">'), xml_escape(F.col("text")), F.lit("</verse>"))
    parts = F.array_sort(F.collect_list(F.struct("turn", verse.alias("v"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("<chapter>"), F.array_join(F.transform(parts, lambda p: p["v"]), ""), F.lit("</chapter>")).alias("xml"))


@query("""SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS worst FROM documents GROUP BY 1""")
def layout_totals(spark, d):
    size = F.length("text").cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).alias("worst"))
