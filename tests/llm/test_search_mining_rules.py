"""Ranked search, hard negatives and learned rules against brute force and their definitions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ball_tree, decision_list, hard_negatives, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, k):
    held = [(i, Counter(folded(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(folded(text))
    out = []
    for item, terms in asked.items():
        found = []
        for place, (i, c, n) in enumerate(held):
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, place))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return Counter(out)


def test_ranked_search_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünïcode", "CAPS", "straße", "9", "a_b", "x-y"]
    docs = [(i, " ".join(rng.choices(words[: rng.choice([5, 30, 66])], k=rng.choice([0, 1, 4, 40])))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(90)] + [(500, None), (501, ""), (502, "\x00 !?"), (None, docs[3][1]), (None, "w1 w2"), (3, docs[3][1]), (503, "w0 " * 200_000)]
    items = [(1, "w1 w2 W3 caps ÜNÏCODE w1"), (2, None), (3, "nothing here"), (4, docs[7][1]), (None, "w5 w6"), (5, "straße"), (5, "w9 a_b"), (6, " ".join(words))]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, term string, score double").repartition(5)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    for k in (1, 10, 1000):
        found = ranked_search.search(frame, asked, k=k)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in found.collect()) == ranked(docs, items, k)


def test_groups_of_terms_and_small_trees_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"t{j}" for j in range(40)], k=12))) for i in range(300)]
    items = [(i, " ".join(rng.choices([f"t{j}" for j in range(40)], k=4))) for i in range(20)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "GROUP_TERMS", 20)
    assert Counter(tuple(r) for r in ranked_search.search(*frames, k=7).collect()) == ranked(docs, items, 7)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs, items).collect() == []
    assert ranked_search.search(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0)).collect() == []


def test_length_does_not_overflow():
    size = np.array([1])
    found = ranked_search.saturated(np.array([3]), np.array([10**7]), size, 10**12, 10**15)
    assert found[0] == 3 * 10**9 // (3000 + 20 * (50 + 50 * 10**7 * 10**12 // 10**15))


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_bounds_of_every_node_hold_and_prune(leaf):
    rng = np.random.default_rng(leaf)
    kinds = [np.arange(20 * g, 20 * g + 20) for g in range(6)]
    rows = [np.sort(rng.choice(kinds[i % 6], rng.integers(1, 9), replace=False)) for i in range(600)]
    size = np.array([len(r) for r in rows])
    data = ball_tree.Rows(np.concatenate(([0], np.cumsum(size))), np.concatenate(rows), rng.integers(1, 10**6, size.sum()))
    weight = rng.integers(0, 20_000, 120)
    tree = ball_tree.BallTree(data, weight, leaf_rows=leaf)
    scored = 0
    for g in range(30):
        query = np.sort(rng.choice(kinds[g % 6], 5, replace=False))
        exact = np.array([sum(int(weight[c]) * int(v) for c, v in zip(rows[i], data.vals[data.start[i] : data.start[i + 1]], strict=True) if c in query) for i in range(600)])
        local = np.flatnonzero(np.isin(tree.columns, query))
        bound = tree.bounds(local)
        for b, node in zip(bound, tree.nodes, strict=True):
            assert b >= exact[tree.order[node.begin : node.end]].max()
        best = ball_tree.Best(5)
        scored += tree.search(query, np.arange(600), best)
        want = sorted((-int(s), i) for i, s in enumerate(exact) if s > 0)[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids, strict=True)] == want
    assert scored < 0.6 * 30 * 600


def test_equal_rows_are_all_found_in_order():
    data = ball_tree.Rows(np.arange(101), np.zeros(100, np.int64), np.full(100, 7))
    best = ball_tree.Best(10)
    ball_tree.BallTree(data, np.array([3])).search(np.array([0]), np.arange(100)[::-1].copy(), best)
    assert best.ids.tolist() == list(range(10)) and set(best.scores.tolist()) == {21}


# ---- hard negatives


def mined(rows, positives=5, negatives=5, low=80, high=100):
    single = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = (label, [math.floor(256 * x) for x in v])
        single[i] = min(single.get(i, whole), whole)
    sizes = Counter(len(v) for _, v in single.values())
    dim = min(sizes, key=lambda d: (-sizes[d], d), default=0)
    single = {i: x for i, x in single.items() if len(x[1]) == dim}
    out = []
    for a in (i for i in single if i % 10 == 0):
        score = {i: sum(x * y for x, y in zip(single[a][1], v, strict=True)) for i, (_, v) in single.items()}
        order = sorted(single, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and single[i][0] == single[a][0]][:positives]:
            inside = [i for i in order if single[i][0] != single[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(inside[:negatives])]
    return Counter(out)


SCHEMA = "vec_id long, label int, embedding array<float>, id long, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in rows], SCHEMA).repartition(4)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), [float(np.float32(rng.choice([-1, 0.25, 0.5, 1, 1.5]))) for _ in range(4)]) for i in range(-40, 300)]
    rows += [(i, 1, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 460)]  # a third with one vector: ties
    rows += [(500, None, [1.0] * 4), (510, 1, None), (520, 1, [1.0, None, 1.0, 1.0]), (530, 1, [1.0, math.nan, 1.0, 1.0]), (540, 1, [1.0, math.inf, 1.0, 1.0]), (550, 1, [1.0]), (560, 2, []), (None, 1, [1.0] * 4)]
    rows += [rows[0], rows[50], (20, 0, [0.5] * 4)]
    want = mined(rows)
    for blocks in ((4096, 1024), (64, 7)):
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks[0])
        monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", blocks[1])
        found = hard_negatives.mine(frame(spark, rows), is_anchor=F.col("id") % 10 == 0)
        assert Counter(tuple(r) for r in found.collect()) == want and sum(want.values()) > 300


def test_hard_negatives_other_limits_and_empty(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    rows = [(i, x, [float(np.float32(c)) for c in v]) for i, x, v in rows]
    found = hard_negatives.mine(frame(spark, rows), is_anchor=F.col("id") % 10 == 0, positives=2, negatives=3, low=50, high=90)
    assert Counter(tuple(r) for r in found.collect()) == mined(rows, 2, 3, 50, 90)
    assert hard_negatives.mine(frame(spark, rows).limit(0), is_anchor=F.col("id") % 10 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, rows[:1]), is_anchor=F.lit(True)).collect() == []


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2**40, 3]]), np.array([[2**20 + 1, 5], [2**40, 1]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 2**40 + 15, 2**63 - 1]]


def test_keys_order_as_their_parts():
    rng = random.Random(4)
    parts = [(rng.choice([-(2**63), -5, 0, 7, 2**63 - 1]), rng.choice([-(2**63), -9, 0, 4, 2**63 - 1]), rng.randrange(-9, 9), rng.random() < 0.5) for _ in range(200)]
    keys = [hard_negatives.packed_key(*p) for p in parts]
    assert [hard_negatives.unpacked_key(k) for k in sorted(keys)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_anchors_at_even_distances_go_to_all_partitions():
    homes = Counter(hard_negatives.home(hard_negatives.packed_key(100 * i, 0, 0, False)) % 200 for i in range(20_000))
    assert len(homes) == 200 and max(homes.values()) < 3 * 100


def test_walk_does_not_hold_an_anchor():
    def pairs():
        for i in range(1_000_000):
            yield 1, 10**6 - i, i, i % 1000 == 0

    assert sum(1 for _ in hard_negatives.walk(pairs(), 5, 5, 80, 100)) == 25


# ---- learned rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = "".join(words)
    count = lambda few: sum(c in few for c in chars)
    return (len(words), len(chars), count("#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(lines), count(decision_list.CAPITALS), count("0123456789"), count(".!?"), sum(c.isalpha() for c in chars))


TEXTS = [None, "", " \t\n\x0b\x0c\r", "a", "a b", "a b c", "a b c a b c", "a a a a", "a b a b a b x", "x\n\nx\n x\nx\x1f\n\x1f\n\x1f", "#*$%&|<> é Ü 𝔘 1٣.!?", "A\r\nA\r\n\nB", " lead and trail ", "$1 \\1 [a-z] $1 \\1 [a-z]", "w " * 50_000, " ".join(f"w{i % 977}" for i in range(30_000))]


def test_statistics_equal_plain_counts(spark):
    rows = [(i, t, 5, "n") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], 5, "n"), (None, "a b c", 5, "n")]
    found = decision_list.statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words int, rule string"))
    assert found.columns == ["doc_id", "rule", *decision_list.COUNTS]
    assert Counter((r.doc_id, *r[2:]) for r in found.collect()) == Counter((i, *plain_counts(t)) for i, t, *_ in rows)
    assert decision_list.statistics(found.select("doc_id", F.lit("").alias("text")).limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    judged = decision_list.judge(decision_list.statistics(docs), decision_list.DecisionList((decision_list.Rule((decision_list.Condition("words", True, 1.0),)),)))
    plan = judged._jdf.queryExecution().toString() + decision_list.labelled_sample(docs, labels, "doc_id", "quality", 5, 1)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert [(r.rule, r.kept) for r in judged.collect()] == [("words > 1", False)]


def test_covering_finds_the_planted_rules():
    rng = np.random.default_rng(0)
    rows = {n: rng.random(3000) for n in decision_list.FEATURES}
    poor = (rows["symbols_per_char"] > 0.9) | ((rows["chars_per_word"] <= 0.3) & (rows["letters_per_char"] <= 0.4))
    found = decision_list.learn(rows, poor)
    rejected = np.logical_or.reduce([r.holds(rows) for r in found.rules])
    assert (rejected & poor).sum() > 0.97 * poor.sum() and (rejected & ~poor).sum() < 0.01 * (~poor).sum()
    assert {c.name for r in found.rules for c in r.conditions} >= {"symbols_per_char", "chars_per_word", "letters_per_char"}
    fresh = {n: rng.random(3000) for n in decision_list.FEATURES}
    truth = (fresh["symbols_per_char"] > 0.9) | ((fresh["chars_per_word"] <= 0.3) & (fresh["letters_per_char"] <= 0.4))
    assert (np.logical_or.reduce([r.holds(fresh) for r in found.rules]) != truth).mean() < 0.03


def test_noise_gives_no_rule():
    rng = np.random.default_rng(1)
    rows = {n: rng.random(2000) for n in decision_list.FEATURES}
    assert decision_list.learn(rows, rng.random(2000) < 0.1).rules == ()


def test_pruning_drops_what_does_not_help():
    rows = {n: np.zeros(100) for n in decision_list.FEATURES} | {"words": np.arange(100.0), "chars_per_word": np.arange(100.0) % 7}
    poor = np.arange(100) < 30
    rule = decision_list.Rule((decision_list.Condition("words", False, 29.5), decision_list.Condition("chars_per_word", True, 3.5)))
    assert decision_list.prune(rule, rows, poor, np.ones(100, bool)).conditions == rule.conditions[:1]


def test_fitted_list_judges_documents(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choices("lorem ipsum dolor sit amet consectetur".split(), k=60)) for _ in range(200)]
    bad = [" ".join(rng.choices("l#rem ip$um %% ## do|or".split(), k=60)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)] + [(None, "a", "x"), (999, None, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(320)] + [(5, 1), (None, 0), (999, None), (4000, 0)], "doc_id long, quality int")
    rules = decision_list.fit(docs, labels)
    judged = decision_list.judge(decision_list.statistics(docs), rules)
    kept = {r.doc_id: r.kept for r in judged.collect() if r.doc_id is not None and r.doc_id < 320}
    assert [kept[i] for i in range(320)] == [i < 200 for i in range(320)]
    assert judged.count() == 322
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert decision_list.fit(docs, none).rules == ()
    assert decision_list.judge(decision_list.statistics(docs), decision_list.DecisionList()).where("kept").count() == 322
    assert decision_list.fit(docs.limit(0), labels).rules == ()
