"""Homomorphic multiset hash of a text's paragraphs, in column expressions only.

A paragraph (a line of the text that is not empty) hashes to a wide vector: ``DENSE`` lanes of 32 bits from the whole
paragraph, and ``PACKED`` lanes of 60 bits, each three 20-bit counters, that add up the hash bits of its sentences.
A text's fingerprint is the sum of its paragraphs' vectors modulo 2^32 and 2^60. So paragraph order does not matter,
equal multisets of paragraphs have equal fingerprints, and ``added`` or ``removed`` change a fingerprint by a paragraph
without the rest of the text. The counters, read as signed sums, estimate the cosine of two sentence multisets.

Defined results: null text is empty; the empty text's fingerprint is all zeros, and its likeness is 1 to an empty
text and 0 to others; rows that share a doc_id are ordered by text; rows with null doc_id have no next document, so they
are edited with nothing and their near_next is against the empty text; a single row is its own next one; an empty
table gives an empty result; other columns are ignored. A counter holds up to 1,048,575 sentences of one text; beyond that it
carries into its neighbour, which keeps fingerprints equal for equal texts but makes the likeness meaningless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, cut, following

DENSE, HASHES, FIELDS = 8, 2, 20
PACKED = HASHES * FIELDS
_FIELD, _WORD, _LONG = "1099512676353L", "4294967295L", "1152921504606846975L"  # 1 | 1 << 20 | 1 << 40, 2^32 - 1, 2^60 - 1
VECTOR = "array<bigint>"


def vector(text: str) -> str:
    """SQL of a text's fingerprint: DENSE + 1 + PACKED longs (dense lanes, number of sentences, counters)."""
    t = f"coalesce({text}, '')"
    paragraphs = f"filter(split({t}, '\\n'), x -> x != '')"
    sentences = f"filter(split({t}, '[.!?\\n]+\\\\s*'), x -> x != '')"
    dense = f"transform(sequence(0, {DENSE - 1}), k -> aggregate(p, 0L, (a, x) -> (a + (xxhash64(x, k) & {_WORD})) & {_WORD}))"
    packed = [f"transform(sequence(0, {FIELDS - 1}), k -> aggregate(h, 0L, (a, x) -> (a + (shiftrightunsigned(x, k) & {_FIELD})) & {_LONG}))"]
    counters = [f"get(transform(array(transform(s, x -> xxhash64(x, {100 + n}))), h -> {packed[0]}), 0)" for n in range(HASHES)]
    return f"""concat(get(transform(array({paragraphs}), p -> {dense}), 0),
        get(transform(array({sentences}), s -> concat(array(cast(size(s) as long) & {_WORD}), {', '.join(counters)})), 0))"""


def _change(one: str, other: str, sign: str) -> str:
    """Lane by lane modulo each lane's power."""
    power = f"if(i <= {DENSE}, 4294967296L, 1152921504606846976L)"
    return f"transform({one}, (a, i) -> pmod(a {sign} get({other}, i), {power}))"


def added(fingerprint: str, paragraph: str) -> str:
    """SQL of the fingerprint after a paragraph is put in."""
    return f"get(transform(array({vector(paragraph)}), v -> {_change(fingerprint, 'v', '+')}), 0)"


def removed(fingerprint: str, paragraph: str) -> str:
    """SQL of the fingerprint after a paragraph is taken out."""
    return f"get(transform(array({vector(paragraph)}), v -> {_change(fingerprint, 'v', '-')}), 0)"


def text_of(fingerprint: str) -> Column:
    """Hexadecimal, 8 digits a lane of 32 bits, 15 a lane of 60."""
    return F.expr(f"lower(array_join(transform({fingerprint}, (x, i) -> lpad(hex(x), if(i <= {DENSE}, 8, 15), '0')), ''))")


def likeness(one: str, other: str) -> Column:
    """0 to 1: the estimated cosine of the sentence multisets; 1 for equal fingerprints."""
    lane = "(2 * (shiftright({0}, {1}) & 1048575L) - n)"
    spread = lambda v: f"get(transform(array(get({v}, {DENSE})), n -> flatten(transform(slice({v}, {DENSE + 2}, {PACKED}), x -> array(cast({lane.format('x', 0)} as double), cast({lane.format('x', 20)} as double), cast({lane.format('x', 40)} as double))))), 0)"
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    cosine = f"get(transform(array(struct({spread(one)} as a, {spread(other)} as b)), v -> {dot('v.a', 'v.b')} / nullif(sqrt({dot('v.a', 'v.a')} * {dot('v.b', 'v.b')}), 0D)), 0)"
    return F.expr(f"if({one} = {other}, 1D, least(1D, greatest(0D, coalesce({cosine}, 0D))))")


def with_next(docs: DataFrame, rows: int = 256, most: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, text) with the next document's text (ascending doc_id, then text; the last takes the first).

    Rows are dealt by blocks of ids, about ``rows`` in each; a block's last row takes the first row of the next block that
    is not empty. The first ids that this asks for are broadcast while there are at most ``most``, and joined by a shuffle
    beyond that. Texts are dealt once; what is ordered across blocks are ids.
    """
    ids = docs.filter("doc_id is not null").select("doc_id")
    block = block_of(ids, "doc_id", rows).alias("_block")
    firsts = cut(ids.groupBy(block).agg(F.min("doc_id").alias("_first")))
    after = cut(following(firsts, "_first", "_id").join(firsts, "_first").select("_block", "_id"))
    wanted = after.select("_id")
    wanted = F.broadcast(wanted) if after.count() <= most else wanted
    beyond = docs.join(wanted, docs.doc_id == F.col("_id"), "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min("text").alias("_beyond"))
    edge = after.join(beyond, "_id").select("_block", "_beyond")
    known = docs.filter("doc_id is not null").select("*", block)
    led = known.withColumn("_lead", F.lead(F.struct("text")).over(Window.partitionBy("_block").orderBy("doc_id", "text")))
    led = led.join(edge, "_block").select("doc_id", "text", F.when(F.col("_lead").isNotNull(), F.col("_lead.text")).otherwise(F.col("_beyond")).alias("next_text"))
    return led.unionByName(docs.filter("doc_id is null").withColumn("next_text", F.lit("")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pair = with_next(base).withColumn("n_chars", F.length("text").cast("long"))
    pair = pair.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(next_text, cast(n_chars div 4 as int)))"))
    vectors = pair.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[F.expr(vector(c)).alias(v) for c, v in (("text", "_own"), ("edited", "_edited"), ("next_text", "_next"))])
    # explode of one element keeps the vectors from being computed again wherever they are used.
    held = vectors.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct("_own", "_edited", "_next"))).alias("v"))
    return held.select("doc_id", "n_chars", "edited_sha256", text_of("v._own").alias("fingerprint"), text_of("v._edited").alias("edited_fingerprint"), likeness("v._own", "v._edited").alias("near_edited"), likeness("v._own", "v._next").alias("near_next"))
