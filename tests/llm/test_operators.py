"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexloom.llm import language_id, mixing, multiset_fingerprint, outlier_rules, packing, preference_format, quality_cnn, substring_dedup, training_order
from codexloom.llm.common import block_of
from codexloom.llm.queries import QUERIES, word_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"n_words": "x", "kept": 1, "score": "s", "weight": "w", "_t": 0, "tokens": 0, "topic": 0, "sequence_id": 0}


def docs_of(rng, n=40):
    word = lambda: rng.choice(["ab", "cd", "ef,", "gh", "ij.", "é", "k"])
    shared = " ".join(word() for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.4:
            text += "\n" + shared + "  " + " ".join(word() for _ in range(rng.randint(0, 9)))
        rows.append((i * 2 + 1, text))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, " \t\n"), (505, "w " * 400), (506, "w " * 390 + "end"), (507, "#$ |\n#$ |\nx" * 30), (None, rows[3][1]), (600, "tie " * 30), (600, "tie " * 31), (600, "tie " * 30)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return docs_of(random.Random(3))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(v) for c, v in CLASH.items()}).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize(("k", "m"), [(8, 3), (50, 16), (20, 20)])
def test_substring_dedup(docs, rows, k, m):
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - k + 1):
            if i is not None:
                g = tuple(w[a : a + k])
                first[g] = min(first.get(g, i), i)
    expected = Counter()
    for i, t, *_ in rows:
        w, gone = WORD.findall(t or ""), set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone |= set(range(a, a + k))
        expected[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = substring_dedup.remove_repeats(docs, k=k, m=m).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == expected
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(WORD.findall(t or ""))
    for r in got:
        own = WORD.findall(r["text"] or "")
        for s in r["sources"] or ():
            n = s["end"] - s["start"]
            same = lambda w: w[s["source_start"] : s["source_start"] + n] == own[s["start"] : s["end"]] or len(set(own[s["start"] : s["end"]])) == 1 and w[s["source_start"] : s["source_start"] + k] == own[s["start"] : s["start"] + k]  # noqa: B023, E731
            assert s["source"] < r["doc_id"] and any(map(same, texts[s["source"]]))


def thue_morse():
    """Two strings that polynomial hashes modulo 2^64 do not tell apart."""
    return ["".join(pair[bin(i).count("1") % 2] for i in range(2048)) for pair in ("ab", "ba")]


def test_strings_that_defeat_polynomial_hashes(spark, tmp_path):
    from codexloom.llm import ngram_join

    a, b = thue_morse()
    shared = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, a), (4, b), (5, " ".join(a)), (6, " ".join(b))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    sequence = {5: list(a), 6: list(b)}
    windows = {tuple(sequence[5][i : i + 50]) for i in range(2048 - 49)}
    gone = {j for i in range(2048 - 49) if tuple(sequence[6][i : i + 50]) in windows for j in range(i, i + 50)}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: len(gone)}
    classes = {r["doc_id"]: r["class_id"] for r in ngram_join.similarity_classes(df.filter("doc_id in (3, 4)")).collect()}
    assert classes == {3: 3, 4: 4}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in ((3, a), (4, b))}
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(df.filter("doc_id in (3, 4)"), word_tokenizer()).collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}


@pytest.mark.parametrize("n", [40, 80])
def test_near_copies_compact_in_runs_of_edges(spark, n, monkeypatch):
    """Each copy has one word of its own; few of its windows are compared singly, and what goes is what brute force takes."""
    from codexloom.llm import substring_dedup as sd

    base = [f"w{i}" for i in range(400)]
    texts = [" ".join([*base[: 60 + 3 * d], f"own{d}", *base[60 + 3 * d :]]) for d in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = sd.repeated_spans(df.withColumn("_t", F.lit("")))
    single = spans.filter("end - start = 50").count()
    opened = n * 2 * 50  # at least the windows around each own word's path would be compared singly
    assert single < opened / 5
    got = {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(df).collect()}
    seen, expected = set(), {}
    for d, text in enumerate(texts):
        w, gone = text.split(), set()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, x in enumerate(windows):
            if x in seen:
                gone.update(range(i, i + 50))
        seen.update(windows)
        expected[d] = len(gone)
    assert got == expected


def rows_of_joins(df):
    """Rows that each join of a collected query made."""
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if "Join" in node.nodeName():
            found.append(node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("period", [2, 3, 6])
def test_a_line_that_many_documents_repeat_is_asked_for_once_each(spark, period):
    """Each document repeats one line between words of its own; joins make a row for each different window, not for each."""
    docs, times = 12, 100
    lines = [" ".join(f"p{line}w{i}" for i in range(period)) for line in range(4)]
    texts = [" ".join(f"own{d}a{i}" for i in range(5 + d)) + "\n" + "\n".join([lines[d % 4]] * (times + d)) + f"\nend{d}" for d in range(docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = substring_dedup.remove_repeats(df)
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in out.collect()}
    assert max(rows_of_joins(out)) <= docs * (period + 2)
    seen, expected = set(), {}
    for d, text in enumerate(texts):
        w, gone = text.split(), set()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, x in enumerate(windows):
            if x in seen:
                gone.update(range(i, i + 50))
        seen.update(windows)
        expected[d] = (len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert got == expected and all(expected[d][0] >= times * period for d in range(4, docs))


def shuffles(df):
    """The columns of each shuffle of a collected query; one that is read again counts once."""
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def shuffled_bytes(spark):
    """Bytes that each stage of the session has shuffled so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


@pytest.mark.parametrize("again", [False, True])
def test_texts_and_runs_of_edges_are_shuffled_once(spark, again):
    """Long random words, so that the texts outweigh the rest; near copies of one passage, so that paths are opened."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=60))
    passage = [word() for _ in range(120)]
    texts = [" ".join([*(word() for _ in range(200)), *passage[: 60 + d], word(), *passage[60 + d :]]) for d in range(24)]
    rows = [*enumerate(texts), (None, texts[0]), *([(3, texts[4])] if again else [])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = shuffled_bytes(spark)
        out = substring_dedup.remove_repeats(df)
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())
        written = sum(n for stage, n in shuffled_bytes(spark).items() if stage not in known)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("text" in columns for columns in shuffles(out)) == sum("edges" in columns for columns in shuffles(out)) == 1
    assert written < 1.6 * sum(len(t) for _, t in rows)
    first, expected = {}, Counter()
    for i, t in rows:
        w = t.split(" ")
        for a in range(len(w) - 49):
            if i is not None:
                first[tuple(w[a : a + 50])] = min(first.get(tuple(w[a : a + 50]), i), i)
    for i, t in rows:
        w = t.split(" ")
        gone = {j for a in range(len(w) - 49) if i is not None and first[tuple(w[a : a + 50])] < i for j in range(a, a + 50)}
        expected[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    assert got == expected and sum(n for _, _, n, _ in got) > 1000


def test_texts_longer_than_a_step(spark):
    """One document of about 2.4 MB, which is a step of its own, in each operator that reads texts in steps."""
    from codexloom.llm import ngram_join
    from tokenizers import Tokenizer

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300_000)]
    rows = [(1, " ".join(words[1000:1200])), (2, " ".join(words)), (3, " ".join(words)), (4, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (200, 0), 2: (300_000, 200), 3: (300_000, 300_000), 4: (2, 0)}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(df).collect()} == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (4, 0)}
    ids = np.array([*Tokenizer.from_file(word_tokenizer()).encode(rows[1][1], add_special_tokens=False).ids, 1], "<u4")
    pieces = sorted((r["piece"], r["length"], r["ids_crc32"]) for r in packing.pack(df.filter("doc_id = 2"), word_tokenizer()).collect())
    assert pieces == [(i // 4096, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
    model = language_id.LanguageModel(["xx", "yy"], language_id.codewords(2), rng_weights(), 0.2)
    assert [r["score"] > 0 for r in language_id.predict(df, model).orderBy("doc_id").collect()] == [True] * 4
    scores = [r["score"] for r in quality_cnn.predict(df, quality_cnn.Net()).orderBy("doc_id").collect()]
    assert scores[1] == scores[2] and all(0 < x < 1 for x in scores)


def rng_weights():
    return np.random.default_rng(3).standard_normal((language_id.SIZE + 1, 1)).astype(np.float32)


def test_outlier_statistics_and_verdicts(docs, rows):
    expected = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
        often, covered = Counter(grams), set()
        for a, g in enumerate(grams):
            if often[g] > 1:
                covered |= set(range(a, a + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    got = outlier_rules.judge(docs).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", *outlier_rules.STATS, "base_failed")) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


def mcd(x, starts):
    """Mean and covariance of least determinant in numpy, from starts (mean, covariance); then the reweighted estimate."""
    floor, n = np.diag(np.square(outlier_rules.FLOORS)), len(x)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def moments(w, share):
        m = w @ x / w.sum()
        return m, (x.T * w @ x / w.sum() - np.outer(m, m)) * outlier_rules._consistency(share) + floor

    def step(m, c):
        bins = np.floor(np.log2(np.maximum(far(m, c), 1e-6)) * outlier_rules.BINS)
        own, number = np.unique(bins, return_inverse=True)
        count = np.bincount(number)
        part = np.clip((outlier_rules.SHARE * n - (np.cumsum(count) - count)) / count, 0, 1)
        return moments(part[number], outlier_rules.SHARE)

    found = []
    for m, c in sorted((step(*step(m, c)) for m, c in starts), key=lambda e: np.linalg.slogdet(e[1])[1])[:2]:
        while True:
            m2, c2 = step(m, c)
            if np.linalg.slogdet(c2)[1] >= np.linalg.slogdet(c)[1] - outlier_rules.FALL:
                break
            m, c = m2, c2
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    return moments((far(m, c) <= outlier_rules._quantile(0.975)).astype(float), 0.975)


def test_robust_distance_equals_numpy(spark):
    """Three groups, one with 40 % planted outliers, one with a null language, and one of two rows."""
    rng = random.Random(9)
    text = lambda letters, longest: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, longest))) for _ in range(rng.randint(20, 60)))
    junk = lambda: " ".join("#$|" + "x" * 30 + str(rng.random()) for _ in range(30))
    rows = [(i, text("abcdef", 8), "en", "a") for i in range(150)] + [(200 + i, junk(), "en", "a") for i in range(6)]
    rows += [(300 + i, text("abcdef", 8), "en", "b") for i in range(60)] + [(400 + i, junk(), "en", "b") for i in range(40)]
    rows += [(500 + i, text("ghijkl", 14), None, None) for i in range(70)] + [(600, text("abc", 5), "en", "c"), (601, text("abc", 5), "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"x0": F.lit("a"), "_key": F.lit(1), "m0": F.lit(2), "_lang": F.lit(3), "distance": F.lit(4)})
    got = outlier_rules.judge(df).orderBy("doc_id").collect()
    assert not any(r["base_failed"] for r in got) and {(r["x0"], r["_key"], r["m0"], r["_lang"]) for r in got} == {("a", 1, 2, 3)}
    steps, groups = np.array(outlier_rules.FLOORS) / outlier_rules.GRID, defaultdict(list)
    for r in got:
        own = [o for o in got if o["lang"] == r["lang"]]
        usual = sum(o["word_chars"] for o in own) / sum(o["n_words"] for o in own)
        v = np.array([(r["word_chars"] + 20 * usual) / (r["n_words"] + 20), np.log(1 + 100 * r["n_symbols"] / (r["n_words"] + 20)), np.log(1 + r["n_dup_lines"]), r["n_repeat_words"] / (r["n_words"] + 20)])
        v = np.floor(v / steps + 0.5) * steps
        groups[1, r["lang"], r["source"]].append((v, r["distance"]))
        groups[2, r["lang"], None].append((v, None))
    cells = spark.createDataFrame([((*k, ), *map(float, v), float(n)) for k, vs in groups.items() for v, n in Counter(tuple(x) for x, _ in vs).items()], "_key struct<level: int, lang: string, source: string>, x0 double, x1 double, x2 double, x3 double, w double")
    sizes = cells.groupBy("_key").agg(F.sum("w").alias("_size"), F.count("*").alias("_cells"))
    starts = defaultdict(list)
    for r in outlier_rules._starts(cells, sizes).collect():
        starts[tuple(r["_key"])].append((np.array([r[f"m{j}"] for j in range(4)]), np.array([[r[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])))
    assert all(len(own) >= 2 for k, own in starts.items() if len(groups[k]) > 50)
    for (level, lang, source), own in groups.items():
        if level == 1:
            x = np.array([v for v, _ in own])
            center, c = mcd(x, starts[level, lang, source])
            _, whole = mcd(np.array([v for v, _ in groups[2, lang, None]]), starts[2, lang, None])
            c = (len(x) * c + outlier_rules.PRIOR * whole) / (len(x) + outlier_rules.PRIOR)
            np.testing.assert_allclose([d for _, d in own], np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(c), x - center), rtol=1e-6, atol=1e-9)
    assert [r["doc_id"] for r in got if not r["kept"]] == [*range(200, 206), *range(400, 440)]


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 1000, 4097):
        index = np.arange(n)
        slot = training_order.permute(index, n, key=5)
        assert sorted(slot) == list(range(n))
        assert (training_order.permute(slot, n, 5, inverse=True) == index).all()
    assert (training_order.permute(np.arange(1000), 1000, 1) != training_order.permute(np.arange(1000), 1000, 2)).any()


def stream_of(rows, by_text):
    """All ids in the order of the stream, with the tokenizer itself; by_text: each text's hash."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    known = sorted(((i is not None, i or 0, by_text[text], text) for i, text, *_ in rows), key=lambda r: r[:3])
    return np.array([x for *_, text in known for x in (*t.encode(text or "", add_special_tokens=False).ids, 1)], "<u2")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_training_order_is_by_data_and_round_trips(spark, docs, rows, tmp_path, parts):
    by_text = {r["text"]: r["t"] for r in docs.select("text", F.xxhash64("text").alias("t")).distinct().collect()}
    whole = stream_of(rows, by_text)
    ordered = training_order.in_training_order(docs.repartition(parts), word_tokenizer(), key=1, length=16, per_shard=10)
    got = training_order.write_shards(ordered, str(tmp_path), word_tokenizer(), 16, 10).orderBy("slot").collect()
    n = -(-len(whole) // 16)
    padded = np.concatenate((whole, np.zeros(n * 16 - len(whole), "<u2"))).reshape(n, 16)
    number = training_order.permute(np.arange(n), n, 1, inverse=True)  # the sequence of each slot
    read = [x.tobytes() for x in training_order.read_from(str(tmp_path), 0, 10, 16)]
    assert read == [padded[k].tobytes() for k in number]
    assert [x.tobytes() for x in training_order.read_from(str(tmp_path), 13, 10, 16)] == read[13:]
    assert [(r["slot"], r["shard"], r["byte_offset"], r["crc32"]) for r in got] == [(s, s // 10, s % 10 * 32, zlib.crc32(x)) for s, x in enumerate(read)]
    assert sum(r["n_tokens"] for r in got) == len(whole)
    assert sum(r["records"] for r in training_order.manifest(spark.createDataFrame(got)).collect()) == n
    ids = {i for r in got for i in r["doc_ids"]}
    assert ids == {i for i, *_ in rows}


def test_training_order_query_writes_the_shards(spark, docs, rows, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(training_order, "shard_folder", lambda spark: f"{tmp_path}/shards", raising=False)
    got = QUERIES["op5_training_order"](spark, str(tmp_path)).orderBy("slot").collect()
    by_text = {r["text"]: r["t"] for r in docs.select("text", F.xxhash64("text").alias("t")).distinct().collect()}
    read = list(training_order.read_from(f"{tmp_path}/shards", 0))
    assert [zlib.crc32(x.tobytes()) for x in read] == [r["crc32"] for r in got]
    assert sum(r["n_tokens"] for r in got) == len(stream_of(rows, by_text))


def test_shard_folder_is_shared(spark):
    place = training_order.shard_folder(spark)
    assert place != training_order.shard_folder(spark)
    assert spark.sparkContext.getCheckpointDir().endswith(place.rpartition("/shards-")[0]) and not place.startswith("file:/tmp")


def test_fingerprints(spark, docs, rows):
    got = multiset_fingerprint.edited_fingerprints(docs).collect()
    known = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda x: x)
    expected = Counter()
    for n, (i, t) in enumerate(known):
        following, cut = known[(n + 1) % len(known)][1], len(t) // 4
        expected[i, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == expected
    assert len(got) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    one = {r["fingerprint"] for r in got if r["doc_id"] in (7, 500, 501)}
    assert len(one) == 1
    v = multiset_fingerprint.vector
    row = spark.sql("SELECT 'One. Two three.\nFour' AS a, 'Four\nOne. Two three.' AS b, 'Four' AS c, 'One. Two three.' AS p").selectExpr(
        f"{v('a')} = {v('b')} AS order_free", f"{multiset_fingerprint.added(v('c'), 'p')} = {v('a')} AS put_in", f"{multiset_fingerprint.removed(v('a'), 'p')} = {v('c')} AS taken_out", f"{v('a')} = {v('c')} AS other")
    assert list(row.first()) == [True, True, True, False]


def test_fingerprints_and_likeness_equal_brute_force(spark):
    """Lanes summed in Python from the hash function alone, and the likeness against the exact cosine of sentence counts."""
    rng = random.Random(31)
    pool = ["".join(rng.choice("abcdef ") for _ in range(30)).strip() for _ in range(300)]
    texts = ["\n".join(". ".join(rng.choice(pool[:120]) for _ in range(4)) + "." for _ in range(rng.randint(1, 25))) for _ in range(40)] + ["", "x", "One. Two"]
    lines, sentences = [[p for p in t.split("\n") if p] for t in texts], [[x for x in re.split(r"[.!?\n]+[ \t\n\r\f\v]*", t) if x] for t in texts]
    words = sorted({p for own in lines + sentences for p in own})
    made = spark.createDataFrame([(w,) for w in words], "w string").select("w", *[F.expr(f"xxhash64(w, {k})").alias(f"d{k}") for k in range(8)], *[F.expr(f"xxhash64(w, {100 + n})").alias(f"h{n}") for n in range(2)])
    known = {r["w"]: r for r in made.collect()}
    field = 1 | 1 << 20 | 1 << 40
    want = []
    for p, s in zip(lines, sentences, strict=True):
        dense = [sum(known[x][f"d{k}"] & 0xFFFFFFFF for x in p) % 2**32 for k in range(8)]
        counters = [sum((known[x][f"h{n}"] % 2**64 >> k) & field for x in s) % 2**60 for n in range(2) for k in range(20)]
        want.append([*dense, len(s), *counters])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in df.select("doc_id", F.expr(multiset_fingerprint.vector("text")).alias("v")).withColumn("t", multiset_fingerprint.text_of("v")).collect()}
    assert [got[i]["v"] for i in range(len(texts))] == want
    assert got[0]["t"] == "".join(f"{x:0{8 if i <= 8 else 15}x}" for i, x in enumerate(want[0]))
    near = {r["doc_id"]: r["near_next"] for r in multiset_fingerprint.edited_fingerprints(df).collect()}
    for i, own in enumerate(sentences[:39]):
        a, b = Counter(own), Counter(sentences[i + 1])
        cosine = sum(a[x] * b[x] for x in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        assert near[i] == pytest.approx(cosine, abs=0.3)


def test_next_documents_of_sparse_ids(spark):
    rng = random.Random(32)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)} | {0, 1, 2})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    for rows in (1, 7, 256):
        got = {r["doc_id"]: r["next_text"] for r in multiset_fingerprint.with_next(df, rows).collect()}
        assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


@pytest.mark.parametrize(("ids", "rows"), [([*range(20_000), 2**60], 256), ([*range(3000), *range(10**12, 10**12 + 3000), -(2**63), 2**63 - 1], 16), ([5], 256), ([1] * 50 + [2], 4), ([-(2**63), 2**63 - 1], 1)])
def test_blocks_of_ids_with_outliers(spark, ids, rows):
    """One id far from the others widens no block but its own."""
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3)
    got = sorted((r[0], r[1]) for r in df.select("doc_id", block_of(df, "doc_id", rows)).collect())
    blocks = [b for _, b in got]
    assert blocks == sorted(blocks)
    assert max(Counter(b for _, b in set(got)).values()) <= 2 * rows


def test_next_documents_with_an_outlier(spark):
    ids = [*range(2000), 2**60]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in multiset_fingerprint.with_next(df).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_rows_of_one_doc_id_whose_32_bit_hashes_clash(spark):
    shared, other = " ".join(f"s{i}" for i in range(50)), " ".join(f"o{i}" for i in range(60))
    both = spark.range(300_000).selectExpr(f"concat('{shared} ', id) as text").selectExpr("text", "hash(text) as h")
    pair = both.join(spark.range(300_000).selectExpr(f"concat('{other} ', id) as other").withColumn("h", F.expr("hash(other)")), "h").limit(1).collect()[0]
    df = spark.createDataFrame([(1, shared), (5, pair["text"]), (5, pair["other"]), (5, pair["other"])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(1, 50, 0), (5, 51, 50), (5, 61, 0), (5, 61, 0)]


def test_language_decoding_equals_brute_force(spark):
    """Margins, losses and shares worked out one n-gram and one bit at a time."""
    names, weights = ["aa", "bb", "cc"], np.random.default_rng(4).standard_normal((language_id.SIZE + 1, 3)).astype(np.float32)
    code = language_id.codewords(3)
    texts = ["Hello World", "ein Satz", "ü", "ab", "z" * 300]
    got = {r["text"]: r for r in language_id.predict(spark.createDataFrame([(t,) for t in texts], "text string"), language_id.LanguageModel(names, code, weights, 0.2)).collect()}
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    for text in texts:
        raw, x = text.lower().encode(), np.zeros(language_id.SIZE)
        for width, size, shift in ((3, language_id.TRIGRAMS, 0), (2, language_id.BIGRAMS, language_id.TRIGRAMS)):
            for i in range(len(raw) - width + 1):
                value = sum(b * k for b, k in zip(raw[i : i + width], (0x3D, 0x1F35, 0x2B1A7)[:width], strict=True))
                value = wrap((value ^ value >> 9) * 0x5BD1)
                x[shift + (value >> 4 & size - 1)] += 1
        x = np.sqrt(x)
        x /= max(np.linalg.norm(x), 1e-9)
        margin = [sum(x[k] * weights[k, b] for k in np.flatnonzero(x)) + weights[-1, b] for b in range(3)]
        loss = [sum(np.log1p(np.exp(-margin[b] * code[i, b])) for b in range(3)) for i in range(3)]
        share = np.exp(-np.array(loss))
        order = sorted(loss)
        r = got[text]
        assert (r["lang_pred"], r["ambiguous"]) == (names[int(np.argmin(loss))], order[1] - order[0] < 0.2)
        assert r["score"] == pytest.approx(share.max() / share.sum(), rel=1e-4)


def test_convolution_equals_loops():
    rng = np.random.default_rng(6)
    net, texts = quality_cnn.Net(), [b"", b"abc", bytes(rng.integers(97, 123, 1500).astype(np.uint8)), bytes(rng.integers(0, 256, 2500).astype(np.uint8))]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    emb, filters, bias, dense, dense_bias, out, out_bias = net.p
    step = quality_cnn.CHUNK - quality_cnn.OVERLAP
    for text, score in zip(texts, got, strict=True):
        pooled, begin = [], 0
        while True:
            part = text[begin : begin + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
            best = np.full(quality_cnn.FILTERS, -np.inf)
            for i in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                window = np.concatenate([emb[b] for b in part[i : i + quality_cnn.WIDTH]])
                best = np.maximum(best, window @ filters)
            pooled.append(np.maximum(best + bias, 0))
            begin += step
            if begin + quality_cnn.OVERLAP >= len(text):
                break
        both = np.concatenate((np.mean(pooled, 0), np.max(pooled, 0)))
        hidden = np.maximum(both @ dense + dense_bias, 0)
        assert score == pytest.approx(1 / (1 + np.exp(-(hidden @ out + out_bias[0]))), rel=1e-4)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 30):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (2 ** (n - 2) if n <= 7 else 10)


def test_language_held_out_accuracy(spark):
    rng = random.Random(2)
    parts = {"xx": ["tha", "ing", "ou"], "yy": ["ung", "sch", "ei"], "zz": ["ção", "ão", "lh"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(30))
    rows = [(i, make(lang), lang) for i in range(240) for lang in [rng.choice(list(parts))]]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !?", "yy"), (902, "", None), (None, rows[0][1], "yy")], "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    model = language_id.fit(df.filter("doc_id % 4 <> 2"), per_language=50)
    got = language_id.predict(df, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got)


def test_raking_meets_the_targets(spark, docs):
    rng = random.Random(5)
    cells = [(s, lang, t, rng.randint(50, 500)) for s in ("a", "b", None) for lang in ("en", "de") for t in ("x", "y")]
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.5}
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), powers, rounds=20).collect()
    whole = sum(c[3] for c in cells)
    for k, m in enumerate(mixing.MARGINS):
        sums, raked = Counter(), Counter()
        for c in cells:
            sums[c[k]] += c[3]
        for r in got:
            raked[r[m]] += r["raked"]
        total = sum(v**0.5 for v in sums.values())
        assert all(raked[v] == pytest.approx(whole * sums[v] ** 0.5 / total, rel=1e-6) for v in sums)
    drawn = mixing.mix(docs).collect()
    assert all(0 < r["probability"] <= 1 for r in drawn)
    for r in drawn:
        draw = int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:mix".encode()).hexdigest()[:8], 16) / 2**32
        assert draw < r["probability"]


def test_raking_goes_on_until_it_settles(spark):
    shape, powers = "source string, lang string, topic string, tokens long", {"source": 0.5, "lang": 0.5, "topic": 0.5}
    cells = [("a", "en", "x", 1000), ("a", "de", "x", 40), ("b", "de", "x", 10)]
    few = {(r["source"], r["lang"]): r["raked"] for r in mixing.rake(spark.createDataFrame(cells, shape), powers, rounds=5, most=5).collect()}
    got = {(r["source"], r["lang"]): r["raked"] for r in mixing.rake(spark.createDataFrame(cells, shape), powers, rounds=5).collect()}
    root_a, root_b, root_en, root_de = 1040**0.5, 10**0.5, 1000**0.5, 50**0.5
    b, en = 1050 * root_b / (root_a + root_b), 1050 * root_en / (root_en + root_de)
    exact = {("a", "en"): en, ("b", "de"): b, ("a", "de"): 1050 - en - b}
    assert all(got[k] == pytest.approx(exact[k], rel=1e-4) for k in exact)
    assert max(abs(few[k] / exact[k] - 1) for k in exact) > 1e-4
    apart = [("a", "en", "x", 900), ("b", "de", "y", 100)]  # targets that contradict each other end at the last marginal
    ends = {r["topic"]: r["raked"] for r in mixing.rake(spark.createDataFrame(apart, shape), {"source": 1.0, "lang": 0.5, "topic": 0.5}, rounds=5, most=10).collect()}
    assert ends["x"] == pytest.approx(750) and ends["y"] == pytest.approx(250)


@pytest.mark.parametrize("share", [0.02, 0.3, 0.5, 0.9, 1.0])
def test_share_holds_with_a_tiny_cell(spark, share):
    rng = random.Random(6)
    cells = [(s, lang, t, rng.randint(20_000, 900_000)) for s in ("a", "b", None) for lang in ("en", "de") for t in ("list", "prose")]
    cells += [("tiny", "en", "list", 3), ("tiny", "xx", "block", 40)]
    raked = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), {"source": 0.7, "lang": 0.8, "topic": 0.9})
    got, whole = mixing.probabilities(raked, share).collect(), sum(c[3] for c in cells)
    assert sum(r["tokens"] * r["probability"] for r in got) == pytest.approx(share * whole, rel=1e-6)
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(r["tokens"] * min(1, c * r["weight"]) for r in got) < share * whole else (low, c)
    assert all(r["probability"] == pytest.approx(min(1, high * r["weight"]), rel=1e-6, abs=1e-8) for r in got)
    unbounded = sum(r["tokens"] * r["probability"] for r in mixing.probabilities(raked).collect())
    assert unbounded < 0.02 * whole


def test_mix_draws_the_share(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randint(40, 60))), rng.choice(["en", "de"]), rng.choice(["a", "b"])) for i in range(3000)]
    df = spark.createDataFrame([*rows, (9000, "one two three", "xx", "tiny"), (9001, None, "en", "a")], "doc_id long, text string, lang string, source string")
    drawn = mixing.mix(df, share=0.4).collect()
    assert sum(r["tokens"] for r in drawn) == pytest.approx(0.4 * sum(len(r[1].split()) for r in rows), rel=0.08)
    assert {9000, 9001} <= {r["doc_id"] for r in drawn}
    for share in (0, -1, 1.1):
        with pytest.raises(ValueError, match="share"):
            mixing.mix(df, share=share)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t, capacity = Tokenizer.from_file(word_tokenizer()), 64
    got = packing.pack(docs, word_tokenizer(), capacity).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for j in range(0, len(ids), capacity):
            want[i, j // capacity, j, len(ids[j : j + capacity]), zlib.crc32(ids[j : j + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    room = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = [x for x in range(len(room)) if room[x] >= length]
        if fits:
            room[min(fits, key=lambda x: room[x])] -= length
        else:
            room.append(capacity - length)
    assert len(placed) == len(room)


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = quality_cnn.Net()
    net.p = [x.astype(np.float64) for x in net.p]
    raw = rng.integers(97, 123, 3000).astype(np.uint8)
    part, first = quality_cnn.chunks(raw, np.array([0, 1200, 1200, 3000]))
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        s = net.score(raw, np.array([0, 1200, 1200, 3000]))
        return -(weight * (target * np.log(s) + (1 - target) * np.log(1 - s))).sum()

    net._windows = lambda rows: np.lib.stride_tricks.sliding_window_view(net.p[0][rows].reshape(len(rows), -1), quality_cnn.WIDTH * quality_cnn.DIM, axis=1)[:, :: quality_cnn.STRIDE * quality_cnn.DIM]
    for k, g in enumerate(net.gradients(part, first, target, weight)):
        flat = net.p[k].reshape(-1)
        for at in rng.choice(len(flat), 3):
            keep, step = flat[at], 1e-5
            flat[at] = keep + step
            up = loss()
            flat[at] = keep - step
            down = loss()
            flat[at] = keep
            assert g.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-5)


def test_quality_held_out(spark):
    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(300))
    bad = lambda: " ".join(rng.choice(["$$$", "!!", "QX9"]) for _ in range(300))
    rows = [(i, good() if i % 3 else bad()) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(100)] + [(7, None), (None, 1)], "doc_id long, quality int")
    net = quality_cnn.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_cnn.predict(docs, net).collect()}
    assert all(got[i]["predicted"] == int(bool(i % 3)) for i in range(100, 120))
    assert len(got) == 123 and got[500]["score"] == got[501]["score"]
    constant = quality_cnn.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality_cnn.predict(docs, constant).collect()} == {1.0}


def test_preferences(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a, b = turn("user", "hi"), turn("assistant", "yes")
    rows = [(1, [a, b], [a, turn("assistant", "no")]), (2, [a, b], [a, b]), (3, None, [a]), (4, [a], []), (5, [turn(None, None), b], [turn(None, None), a])]
    df = spark.createDataFrame(rows, "conv_id long, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>").withColumn("prompt", F.lit(0))
    got = {r["conv_id"]: r for r in preference_format.format_preferences(df).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen"] == "<|assistant|>\nyes<|end|>\n" and got[1]["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [got[1]["chosen"][m["start"] : m["end"]] for m in got[1]["chosen_mask"]] == ["yes<|end|>\n"]
    assert [got[i]["degenerate"] for i in range(1, 6)] == [False, True, True, True, False]
    assert [got[i]["n_prompt_turns"] for i in range(1, 6)] == [1, 2, 0, 0, 1]
    assert got[5]["rejected_mask"] == [] and got[5]["prompt"] == "<||>\n<|end|>\n"
    raw = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r1"), (9, 0, "assistant", "r2"), (9, 0, "assistant", "r2"), (5, 0, "user", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    pairs = preference_format.mismatched_pairs(preference_format.conversations(raw), rows=1).collect()
    assert {p["conv_id"]: p["rejected"][-1]["text"] for p in pairs} == {1: "r2", 9: "r1"}


def test_empty_tables(none):
    assert substring_dedup.remove_repeats(none).count() == 0
    assert outlier_rules.judge(none).count() == 0
    assert multiset_fingerprint.edited_fingerprints(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none, word_tokenizer()).count() == 0
    assert training_order.in_training_order(none, word_tokenizer(), 1).count() == 0
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    labels = none.selectExpr("doc_id", "1 AS quality")
    assert quality_cnn.predict(none, quality_cnn.fit(none, labels)).count() == 0
    turns = none.selectExpr("doc_id AS conv_id", "doc_id AS turn", "lang AS role", "text")
    assert preference_format.format_preferences(preference_format.mismatched_pairs(preference_format.conversations(turns))).count() == 0


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert language_id.predict(docs, language_id.fit(docs)).first()["lang_pred"] == "und"


def test_registered():
    assert sorted({int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES}) == list(range(1, 14))
    assert json.dumps(sorted(QUERIES))
