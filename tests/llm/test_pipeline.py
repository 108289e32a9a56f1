import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import components, mixing, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows):
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    for _ in range(6):
        for (a, x), (b, y) in combinations(sets, 2):
            both = len(x & y)
            if (not x and not y) or both and both >= 0.8 * (len(x) + len(y) - both):
                root[a] = root[b] = min(root[a], root[b])
    return {i for i in root if root[i] == i}


def test_one_of_each_group_of_near_copies_stays(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    base = [[word() for _ in range(rnd.choice([30, 120, 400]))] for _ in range(25)]
    rows = []
    for i in range(220):
        words = list(rnd.choice(base)) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, len(words) // 40)):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, "tiny"), (504, "tiny")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = {r.doc_id for r in simhash.distinct_documents(docs.repartition(5)).collect()}
    assert got == survivors(rows)
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.distinct_documents(odd).collect()) == [(0, "other"), (4, "a b c")]
    assert simhash.distinct_documents(odd.limit(0)).count() == 0


def test_texts_that_share_all_but_a_block_are_near_copies(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows, expected = [], set()
    for i in range(300):  # of five texts one has a copy with a block of new words put in or in place of others
        words = [word() for _ in range(rnd.choice([150, 400]))]
        rows.append((2 * i, " ".join(words)))
        expected.add(2 * i)
        if i % 5 == 0:
            n, replaced, at = len(words), i % 2, rnd.randrange(10, len(words) // 2)
            block = int(n * rnd.uniform(0.06, 0.08)) if replaced else int(n * rnd.uniform(0.14, 0.18))
            rows.append((2 * i + 1, " ".join(words[:at] + [word() for _ in range(block)] + words[at + replaced * block :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.distinct_documents(docs.repartition(5)).collect()}
    assert survivors(rows) == expected and got == expected


def test_similar_sets_share_a_prefix():
    rnd = np.random.default_rng(3)
    last = np.sort(rnd.integers(0, 1 << 62, 50).astype(np.uint64))
    for _ in range(300):
        n = int(rnd.integers(1, 60))
        x = np.union1d(rnd.integers(0, 1 << 62, n).astype(np.uint64), rnd.choice(last, n // 4))
        y = np.union1d(rnd.permutation(x)[: rnd.integers(0, len(x) + 1)], rnd.integers(0, 1 << 62, rnd.integers(0, n // 4 + 1)).astype(np.uint64))
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert len(np.intersect1d(simhash.prefix(x, 0.8, last), simhash.prefix(y, 0.8, last)))
    assert not len(simhash.prefix(x[:0], 0.8, last))


def test_sizes_and_places_rule_out_no_similar_pair(spark):
    rnd, rows, similar = np.random.default_rng(4), [], set()
    last = np.sort(rnd.integers(0, 1 << 62, 20).astype(np.uint64))
    for k in range(300):
        n = int(rnd.integers(1, 80))
        x = np.union1d(rnd.integers(0, 1 << 62, n).astype(np.uint64), rnd.choice(last, n // 6))
        y = np.union1d(rnd.permutation(x)[: rnd.integers(len(x) * 2 // 3, len(x) + 1)], rnd.integers(0, 1 << 62, rnd.integers(0, n // 6 + 1)).astype(np.uint64))
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            similar.add(k)
        a, b = (list(simhash.prefix(s, 0.8, last)) for s in (x, y))
        rows += [(2 * k, 2 * k + 1, len(x), len(y), a.index(key), b.index(key)) for key in set(a) & set(b)]
    rows += [(1000, 1001, 10, 100, 0, 0), (1002, 1003, 100, 100, 0, 19)]  # by size; by place
    pairs = spark.createDataFrame(rows, "u long, v long, su int, sv int, pu int, pv int")
    found = simhash.possible(pairs, 0.8)
    assert 50 < len(similar) < 250 and similar <= {r.u // 2 for r in found.collect()}
    assert "Join" not in found._jdf.queryExecution().toString() and not found.where("u >= 1000").count()


def test_near_misses_and_rare_shingles(spark, monkeypatch):
    """60 texts of one base, no two of them similar: fewer rows are matched than there are pairs; the first shingles are the rarest."""
    rnd, rows, matched = random.Random(6), [], []
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    base = [word() for _ in range(140)]
    for i in range(60):
        words = list(base)
        for at in rnd.sample(range(6, 134), 3):
            words[at] = word()
        rows.append((i, " ".join(words)))
    rows += [(100, rows[7][1] + " end"), (101, "of its own " * 3)]
    possible = simhash.possible
    monkeypatch.setattr(simhash, "possible", lambda pairs, similarity: matched.append(pairs.count()) or possible(pairs, similarity))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.distinct_documents(docs.repartition(5)).collect()} == survivors(rows)
    assert sum(matched) < 60 * 59 // 2

    sets = [simhash._shingle_set(t.encode(), 5) for _, t in rows]
    n = {x: sum(x in own for own in map(set, sets)) for x in np.concatenate(sets)}
    end = np.uint64(int(simhash.COUNTED * 2**64))
    expected = set()
    for i, own in enumerate(sets):
        order = sorted(own, key=lambda x: (x >= end, n[x] if x < end else 0, x))
        expected |= {(int(x.view(np.int64)), i, len(own), k) for k, x in enumerate(order[: len(simhash.prefix(own, 0.8, own[:0]))]) if n[x] > 1}
        for other in sets[:i]:
            bits = sum(int(x).bit_count() for x in (simhash.signature(own) ^ simhash.signature(other)).view(np.uint64))
            assert bits <= len(np.setxor1d(own, other))
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "node long, text string")
    schema = "node long, fps array<long>, size int, counted int, sign array<long>, keys array<long>"
    sketches = simhash.map_batches(texts, simhash._sketch(5, 0.8), schema)
    assert {tuple(r) for r in simhash.prefixes(sketches, 0.8).collect()} == expected


def odd_documents(spark):
    long = "lorem ipsum dolor sit amet " * 40
    rows = [(1, "one plain text of some words", "en", "s", 28), (1, "one plain text of some words", "en", "s", 28), (1, "one plain text of some words", "en", "s", 28), (2, None, None, None, None), (3, "", "en", "s", 0)]
    rows += [(None, "no id at all", None, None, 5), (4, " \n\t ", "de", "s", 4), (5, long, "en", "t", len(long)), (6, long + "end", "en", "t", len(long) + 3), (7, "word " * 300_000, "en", "t", 1_500_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages_on_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, DATA).collect()
        assert stage(spark, docs.limit(0), DATA).count() == 0
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
        if name == names[0]:
            assert len(rows) == 10
        elif name == names[1]:  # texts without words are copies of one another, and 6 is a near copy of 5
            assert ids == [(False, 1), (False, 2), (False, 5), (False, 7), (True, 0)]
        elif name == names[2]:
            assert {i for none, i in ids if not none} == {1, 2, 3, 4, 5, 6, 7} and len(rows) == 10
        elif name == names[3]:
            assert not {2, 3, 4} & {r.doc_id for r in rows} and sum(r.doc_id == 1 for r in rows) <= 6
        else:
            assert sum(r.length for r in rows) == sum({(r.doc_id, r.start, r.offset, r.sequence_id): r.length for r in rows}.values())


def test_rows_that_repeat_share_what_the_mix_takes(spark):
    rows = [(1, "a b c d e", "en", "s", 9)] * 5 + [(2, "a b c d e f g", "en", "t", 13)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.source for r in corpus_pipeline.mixed(spark, docs, DATA).collect()]
    goals = dict(zip("st", mixing.targets([("s", 25), ("t", 21)]), strict=True))
    assert abs(5 * got.count("s") - goals["s"]) <= 5 and abs(7 * got.count("t") - goals["t"]) <= 7


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{DATA}/documents.parquet")], None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(stages[-1].columns)


def test_stages_take_effect(stages):
    before, clean, distinct, cut, mix, packed = [s.toPandas() for s in stages]
    assert len(clean) < len(before) and set(clean.doc_id) <= set(before.doc_id)
    assert set(distinct.doc_id) == survivors(list(zip(clean.doc_id, clean.text, strict=True)))
    assert set(cut.doc_id) <= set(distinct.doc_id) and cut.n_chars.sum() <= distinct.n_chars.sum()
    assert mix.groupby("doc_id").size().max() <= 2 and set(mix.doc_id) <= set(cut.doc_id)
    words = lambda d: d.text.str.encode("utf-8").map(lambda b: len(b.split())).sum()
    assert abs(words(mix) / words(cut) - 1.5) < 0.1 or words(mix) / words(cut) < 1.5
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed[packed.start == 0].doc_tokens.sum() == packed.length.sum()


def test_the_marks_come_in_a_few_jobs_whatever_the_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("marks", "marks")
    try:
        packed = simhash._marks(spark.range(5000).select((F.col("id") * 7 - 900).alias("node")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for key, value in held.items():
            spark.conf.set(key, value)
    marked = np.flatnonzero(np.unpackbits(packed))
    assert set(marked) == {(7 * i - 900) % (8 * len(packed)) for i in range(5000)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("marks")) < 10


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    labels, written = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: labels.append(label) or written(df, label))
    found = lambda links: {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long").coalesce(1)).collect()}
    assert found([(5, 1), (7, 1), (1, 9), (4, 3)]) == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    assert labels.count("stars") == 1
    assert [components.settled(spark.createDataFrame(x, "u long, v long")) for x in ([(2, 1), (3, 1)], [(3, 1), (3, 2)], [(3, 2), (2, 1)], [(4, 3), (9, 4), (2, 1)])] == [True, False, False, False]
    chain = [(i, i + 1) for i in range(40)]
    monkeypatch.setattr(components, "thinned", lambda links: links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    assert found(chain) == dict.fromkeys(range(41), 0)


def test_the_driver_holds_no_texts_while_it_trains(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'awful' if i % 2 else 'lovely'} w{i % 7} ünïcode {i}", "de") for i in range(60)] + [(60, "", "de"), (61, None, "de")], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, langs, **more: seen.append((type(texts), list(texts), marks, langs)) or train(texts, marks, langs, **more))
    model = toxicity.fit(docs, labels, learn=F.lit(True))
    kind, texts, marks, langs = seen[0]
    assert kind is toxicity.Lazy
    assert texts == [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").collect()]
    same = train(texts, marks, langs)
    assert (same.embedding == model.embedding).all() and same.offset == model.offset and same.thresholds == model.thresholds
