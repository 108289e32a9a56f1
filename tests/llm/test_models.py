import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import language_model, quality, toxicity

rnd = random.Random(6)
CALM = {"en": "the house by river stands old and many people walk there".split(), "de": "das haus am fluss steht alt und viele leute gehen dort".split()}
RUDE = {"en": ["stupidish", "idiot"], "de": ["dummer", "trottel"]}


def text(lang, toxic, n=40):
    words = [rnd.choice(CALM[lang]) + rnd.choice(["", "", ",", "."]) for _ in range(n)]
    if toxic:
        words[rnd.randrange(n)] = rnd.choice(RUDE[lang]) + rnd.choice(["", "er", "ish", "!"])
    return " ".join(words)


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, text(lang := rnd.choice(["en", "de"]), y := i % 3 == 0), lang, int(y)) for i in range(900)]
    docs = spark.createDataFrame([r[:3] for r in rows] + [(9001, None, None), (9002, "", "en"), (9003, ("calm words " * 60_000) + "idiot", "en"), (None, "idiot", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 1) for r in rows] + [(9001, None, 0), (77777, 1, 1)], "doc_id long, toxic int, lang int")
    model = toxicity.fit(docs, labels, learn=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.classify(docs.repartition(3), model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([(got[r[0]].toxic_score >= 0.5) == r[3] for r in held]) > 0.95
    assert got[9001].toxic_score == got[9002].toxic_score < 0.5 < got[9003].toxic_score and len(got) == 904
    assert all(0 <= r.toxic_score <= 1 for r in got.values())
    alone = toxicity.fit(docs, labels.where("toxic = 0"), learn=F.lit(True))
    assert toxicity.classify(docs.limit(5), alone).where("toxic_flag").count() == 0
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_blocks_of_a_text_score_like_the_whole():
    model = toxicity.start_model(np.random.default_rng(1))
    texts = [" ".join(rnd.choice("abcdefg") * rnd.randint(1, 5) for _ in range(300)) for _ in range(4)] + [""]
    whole = toxicity.score(model, texts)
    small, toxicity.BLOCK_WORDS = toxicity.BLOCK_WORDS, 37
    try:
        assert np.allclose(toxicity.score(model, texts), whole)
    finally:
        toxicity.BLOCK_WORDS = small


def test_score_against_a_naive_convolution():
    rng = np.random.default_rng(2)
    model = toxicity.start_model(rng)
    model.bias = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    texts = [" ".join(rnd.choice(["alpha", "beta", "Gamma", "delta's", "x1"]) for _ in range(n)) for n in (0, 1, 2, 3, 17)]
    for text_, got in zip(texts, toxicity.score(model, texts), strict=True):
        words = toxicity.words_of(text_)
        vectors = [np.mean([model.embedding[b] for b in toxicity.features(w)], axis=0) for w in words] or [np.zeros(toxicity.DIM)]
        z = model.offset
        for k, width in enumerate(toxicity.WIDTHS):
            padded = vectors + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
            for f in range(toxicity.FILTERS):
                best = max(sum(padded[at + j] @ model.filters[k][j][:, f] for j in range(width)) for at in range(len(vectors)))
                z += max(0.0, best + model.bias[k][f]) * model.weight[k * toxicity.FILTERS + f]
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_training_lowers_the_loss_and_ties_do_not_matter():
    texts = [text("en", y := i % 2 == 0, 12) for i in range(200)]
    labels = np.array([i % 2 == 0 for i in range(200)], np.float32)
    loss = lambda m: -np.mean(np.log(np.where(labels == 1, p := toxicity.score(m, texts), 1 - p)))
    few, many = (toxicity.train(texts, labels, ["en"] * 200, epochs=n) for n in (1, 12))
    assert loss(many) < loss(few) < 0.7
    assert np.array_equal(toxicity.score(many, texts), toxicity.score(toxicity.train(texts, labels, ["en"] * 200, epochs=12), texts))


def test_thresholds_by_language():
    scores = np.concatenate([np.linspace(0.3, 0.4, 30), np.linspace(0.0, 0.2, 70), np.linspace(0.8, 0.9, 30), np.linspace(0.5, 0.7, 70), [0.1] * 5])
    labels = np.concatenate([np.ones(30), np.zeros(70), np.ones(30), np.zeros(70), np.ones(5)])
    langs = ["en"] * 100 + ["de"] * 100 + ["fr"] * 5
    found = toxicity.calibrate(scores, labels, langs)
    assert 0.2 < found["en"] < 0.3 and 0.7 < found["de"] < 0.8 and "fr" not in found and "" in found
    assert toxicity.calibrate(scores[-5:], labels[-5:], langs[-5:]) == {"": 0.5}


def test_an_id_with_both_labels_is_toxic(spark):
    docs = spark.createDataFrame([(i, text("en", i % 2 == 0), "en") for i in range(300)], "doc_id long, text string, lang string")
    once = [(i, int(i % 2 == 0)) for i in range(300)]
    score = lambda rows: [r.toxic_score for r in toxicity.classify(docs, toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), F.lit(True))).orderBy("doc_id").collect()]
    assert score(once) == score([*once[::-1], *[(i, 0) for i in range(0, 300, 2)]])


def test_language_model_against_plain_counts(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rnd.choice(words[: 20 if rnd.random() < 0.7 else 3000]) for _ in range(rnd.randint(0, 200)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "A a  A\tb"), (103, "w1 " * 300_000), (3, "same id again"), (None, "no id")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int").repartition(4)
    learn = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    got = language_model.perplexity(frame, learn).collect()
    assert len(got) == len(docs)
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in docs]
    counts = Counter(w for i, ws in tokens if i is None or i % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((i if i is not None else -1, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 3)) for i, ws in tokens)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    assert language_model.perplexity(frame.limit(0), learn).count() == 0


def test_class_probabilities_add_up():
    model = language_model.start_model(np.ones(language_model.CLASSES, np.int64))
    context = np.tile(np.array([[3, 7]], np.int32), (language_model.CLASSES, 1))
    assert np.exp(model.log_prob(context, np.arange(language_model.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_normalised_scores_against_a_direct_softmax():
    rng = np.random.default_rng(4)
    model = language_model.start_model(rng.integers(0, 500, language_model.CLASSES))
    model.vectors, model.out, model.mix = (rng.normal(size=a.shape).astype(np.float32) for a in (model.vectors, model.out, model.mix))
    context, target = rng.integers(0, language_model.CLASSES + 1, (200, 2)), rng.integers(0, language_model.CLASSES, 200)
    z = sum(model.vectors[context[:, j]] * model.mix[j] for j in range(2)).astype(float) @ model.out.T.astype(float) + model.bias
    direct = z[np.arange(200), target] - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z.max(axis=1)
    assert np.allclose(language_model.Normalised(model)(context, target), direct, atol=1e-4)


def test_sections_of_a_long_text_go_on_where_the_last_one_ended():
    words = rnd.choices(range(50), k=300)
    whole = language_model.contexts(np.array(words, np.int32), np.array([300]))
    cut = [0, 1, 2, 120, 300]
    before = [np.array(words[max(0, a - 2) : a], np.int32) for a in cut[:-1]]
    assert np.array_equal(language_model.contexts(np.array(words, np.int32), np.diff(cut), before), whole)


def test_model_learns_what_follows_what():
    classes = np.tile(np.array([0, 1, 2, 3], np.int32), 20_000)
    counts = np.bincount(classes, minlength=language_model.CLASSES)
    model = language_model.start_model(counts)
    context = language_model.contexts(classes[:400], np.array([400]))
    before = model.log_prob(context, classes[:400]).mean()
    noise = (counts + 1.0) / (counts + 1.0).sum()
    language_model.Trainer(model, noise, 1).run(classes, np.array([len(classes)]))
    assert model.log_prob(context, classes[:400]).mean() > before / 3


def test_em_finds_reliable_labellers():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.85
    votes = np.full((20_000, 5), -1)
    for k, miss in enumerate((0.3, 0.4, 0.6, 0.6, 0.7)):
        wrong = np.where(good, rng.random(20_000) < 0.02, rng.random(20_000) < miss)
        votes[:, k] = np.where(wrong, ~good, good)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, right_good, right_poor = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.85) < 0.06 and (right_good > 0.9).all() and right_poor[0] > right_poor[4]
    p = quality.posterior(votes, share, right_good, right_poor)
    assert ((p >= 0.5) == good).mean() > 0.93


@pytest.mark.parametrize("share_good", [0.7, 0.4])
def test_em_recovers_labellers_of_any_accuracy(share_good):
    rng, right = np.random.default_rng(8), (0.95, 0.9, 0.8, 0.7, 0.6, 0.5)
    good = rng.random(60_000) < share_good
    votes = np.stack([np.where(rng.random(len(good)) < r, good, ~good) for r in right], axis=1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, right_good, right_poor = quality.estimate(patterns, counts.astype(float))
    assert abs(share - share_good) < 0.03
    assert np.abs(right_good - right).max() < 0.03 and np.abs(right_poor - right).max() < 0.03


def test_posterior_against_enumeration():
    share, right_good, right_poor = 0.6, np.array([0.9, 0.7, 0.55]), np.array([0.8, 0.65, 0.5])
    for votes in np.array(np.meshgrid(*[[-1, 0, 1]] * 3)).reshape(3, -1).T:
        good, poor = share, 1 - share
        for v, g, p in zip(votes, right_good, right_poor, strict=True):
            good *= {1: g, 0: 1 - g, -1: 1}[int(v)]
            poor *= {1: 1 - p, 0: p, -1: 1}[int(v)]
        assert quality.posterior(votes[None, :], share, right_good, right_poor)[0] == pytest.approx(good / (good + poor))


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(3)
    patterns = np.array(np.meshgrid(*[[-1, 0, 1]] * 4)).reshape(4, -1).T
    counts = rng.integers(0, 400, len(patterns)).astype(float)

    def likelihood(share, right_good, right_poor):
        total = 0.0
        for votes, n in zip(patterns, counts, strict=True):
            good = share * np.prod([g if v == 1 else 1 - g for v, g in zip(votes, right_good, strict=True) if v >= 0])
            poor = (1 - share) * np.prod([1 - p if v == 1 else p for v, p in zip(votes, right_poor, strict=True) if v >= 0])
            total += n * math.log(good + poor)
        return total

    steps = [likelihood(*quality.estimate(patterns, counts, rounds=k, rows=1e-9)) for k in (1, 2, 5, 20, 100)]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))


def test_quality_of_documents(spark):
    calm = [text("en", False, 60).capitalize() + "." for _ in range(250)]
    junk = ["%%% ".join(rnd.choice(CALM["en"]) for _ in range(60)) + "***" for _ in range(40)] + ["BUY!! NOW!! " * 20 for _ in range(20)]
    rows = [(i, t, 1) for i, t in enumerate(calm + junk)] + [(902, calm[0] * 20_000, 1), (900, None, 1), (901, "", 1), (None, calm[0], 1), (0, calm[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, vote_length int").repartition(3)
    got = quality.grade(docs, quality.fit(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    by = {r.doc_id: r.quality_score for r in got if r.doc_id is not None}
    assert np.mean([by[i] >= 0.5 for i in range(250)]) > 0.97 and np.mean([by[i] < 0.5 for i in range(250, 310)]) > 0.9
    assert quality.grade(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


def test_toxicity_learns_from_rows_beyond_the_drivers_sample(spark, monkeypatch):
    ids = [r.id for r in spark.range(1500).orderBy(F.xxhash64(F.lit(3), "id")).collect()]
    early = {*[i for i in ids if i % 3 == 0][:150], *[i for i in ids if i % 3][:150]}
    rows = []
    for i in range(1500):
        words = [rnd.choice(CALM["en"]) for _ in range(30)]
        if i % 3 == 0:
            words[rnd.randrange(30)] = "idiot" if i in early else "zounds"
        rows.append((i, " ".join(words), "en", int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "COPY_ROWS", 400)
    models = []
    for n, sent in ((3, toxicity.SENT_LABELS), (5, 10)):
        monkeypatch.setattr(toxicity, "SENT_LABELS", sent)
        models.append(toxicity.fit(docs.repartition(n), labels, F.lit(True), rows_per_class=100))
    asked = [" ".join([*CALM["en"], w, *CALM["en"]]) for w in ("zounds", "idiot", "river")]
    zounds, idiot, river = toxicity.score(models[0], asked)
    assert min(zounds, idiot) > 0.5 > river
    assert np.array_equal(toxicity.score(models[0], asked), toxicity.score(models[1], asked))
    assert models[0].thresholds == models[1].thresholds and set(models[0].thresholds) == {"", "en"}


def test_thresholds_of_counted_scores():
    rng = np.random.default_rng(2)
    steps, labels = rng.integers(0, 50, 4000), rng.integers(0, 2, 4000)
    langs = rng.choice(["en", "de"], 4000)
    kinds, times = np.unique(np.array([*zip(steps, labels, langs == "en", strict=True)]), axis=0, return_counts=True)
    counted = toxicity.calibrate(kinds[:, 0] / 50, kinds[:, 1], ["en" if e else "de" for e in kinds[:, 2]], times=times)
    assert counted == toxicity.calibrate(steps / 50, labels, langs.tolist())
