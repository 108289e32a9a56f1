"""Convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the mean of the hashed embeddings of the word, its
beginnings and its ending, so that unseen forms of a known stem are near it.
Filters of several widths run over the whole text; the maximum of each over
all places feeds a logistic layer.  Training takes every labelled row: a bounded
sample of each class starts the model, then copies of it learn from all rows in
passes, each from a part of them, and are averaged after each pass.  A fifth of
the rows sets a threshold for every language.
"""

from __future__ import annotations

import copy
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, discard, map_batches, text_bytes, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Labelled rows of each class that the driver trains on; more than these are learnt from in tasks.
ROWS_PER_CLASS = 3000
#: Passes over all rows, about how many rows a copy of the model learns from in each, and blocks of its parameters.
PASSES, COPY_ROWS, BLOCKS = 2, 2048, 64
#: Steps that scores of held rows are counted in.
STEPS = 10_000
#: Labels that are sent to all tasks; if there are more, packed texts meet them in a shuffle.
SENT_LABELS = 500_000
#: Words of a text handled at a time, and of a worker's cache of word embeddings.
BLOCK_WORDS, CACHE_WORDS = 50_000, 100_000
WORD = re.compile(r"[^\W_]+")


class Lazy(Sequence):
    """Items that are made when they are asked for, so that one is held at a time."""

    def __init__(self, make: Callable[[int], str], size: int) -> None:
        self.make, self.size = make, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int) -> str:
        return self.make(range(self.size)[at])


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[int]:
    """Buckets of a word, its beginnings of 3 to 6 letters and its ending."""
    parts = ["=" + word, *("^" + word[:n] for n in (3, 4, 5, 6)), "$" + word[-3:]]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    stamp: str = field(default_factory=lambda: uuid.uuid4().hex)

    def embed(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, DIM), np.float32)
        return self.embedding[np.array([features(w) for w in words])].mean(axis=1)


def start_model(rng: np.random.Generator) -> Model:
    scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Model(scale(BUCKETS, DIM), [scale(w, DIM, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], scale(FILTERS * len(WIDTHS)) * 0.3, 0.0)


def _responses(model: Model, x: np.ndarray, k: int) -> np.ndarray:
    """Filters of the k-th width at each place of a padded sequence."""
    n = len(x) - WIDTHS[k] + 1
    return sum(x[j : j + n] @ model.filters[k][j] for j in range(WIDTHS[k]))


def pooled(model: Model, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maximum response and its place for every text; texts are followed by max(WIDTHS) - 1 rows of zeros."""
    values, places = [], []
    for k in range(len(WIDTHS)):
        r = _responses(model, x, k)
        top = np.stack([r[s : s + n].argmax(axis=0) + s for s, n in zip(start, np.maximum(size, 1), strict=True)])
        values.append(r[top, np.arange(FILTERS)] + model.bias[k])
        places.append(top)
    return np.concatenate(values, axis=1), places


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    pad = max(WIDTHS) - 1
    step = np.maximum(sizes, 1) + pad
    return np.cumsum(step) - step, int(step.sum()) + pad


class Learner:
    """A model that learns by Adagrad on the logistic loss."""

    def __init__(self, model: Model, rate: float = 0.08) -> None:
        self.model, self.rate = model, rate
        self.seen = [np.full_like(p, 1e-4) for p in self._params()]
        self.seen_embedding, self.seen_offset = np.full(BUCKETS, 1e-4, np.float32), 1e-4

    def _params(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.bias, self.model.weight]

    def step(self, ids: list[np.ndarray], table: np.ndarray, labels: np.ndarray, cost: np.ndarray) -> None:
        """One batch: the words of its texts as rows of ``table``, their labels and what an error costs."""
        model, rate = self.model, self.rate
        sizes = np.array([len(x) for x in ids])
        start, total = _layout(sizes)
        own, back = np.unique(np.concatenate(ids), return_inverse=True)
        vectors = model.embedding[table[own]].mean(axis=1)
        word_at = np.full(total, -1, np.int64)
        word_at[np.concatenate([np.arange(s, s + n) for s, n in zip(start, sizes, strict=True)])] = back
        x = np.where((word_at >= 0)[:, None], vectors[word_at] if len(own) else 0, 0).astype(np.float32)
        z, places = pooled(model, x, start, sizes)
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ model.weight + model.offset, -30, 30)))
        d = ((p - labels) * cost / len(ids)).astype(np.float32)
        dz = d[:, None] * model.weight * (z > 0)
        grads_f, grads_b = [np.zeros_like(f) for f in model.filters], []
        moved_at, moved_by = [], []
        for k, width in enumerate(WIDTHS):
            dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
            grads_b.append(dk.sum(axis=0))
            for j in range(width):
                near = x[places[k] + j]  # rows x filters x dim
                grads_f[k][j] = np.einsum("rf,rfd->df", dk, near)
                moved_at.append((places[k] + j).ravel())
                moved_by.append((dk[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
        where, by = word_at[np.concatenate(moved_at)], np.concatenate(moved_by)
        real = where >= 0
        if real.any():
            grad_words = np.zeros((len(own), DIM), np.float32)
            np.add.at(grad_words, where[real], by[real])
            touched = np.unique(where[real])
            grad = np.repeat(grad_words[touched] / 6, 6, axis=0)
            buckets, slot = np.unique(table[own[touched]].ravel(), return_inverse=True)
            summed = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(summed, slot, grad)
            self.seen_embedding[buckets] += (summed**2).mean(axis=1)
            model.embedding[buckets] -= rate * summed / np.sqrt(self.seen_embedding[buckets])[:, None]
        for param, grad, total_sq in zip(self._params(), [*grads_f, *grads_b, h.T @ d], self.seen, strict=True):
            total_sq += grad**2
            param -= rate * grad / np.sqrt(total_sq)
        self.seen_offset += float(d.sum()) ** 2
        model.offset -= rate * float(d.sum()) / self.seen_offset**0.5

    def rows(self) -> np.ndarray:
        """A row for each bucket: its embedding and its sum of squares."""
        return np.column_stack([self.model.embedding, self.seen_embedding])

    def rest(self) -> np.ndarray:
        """All other numbers in a row."""
        return np.concatenate([*(p.ravel() for p in [*self._params(), *self.seen]), [self.model.offset, self.seen_offset]])

    def with_values(self, rows: np.ndarray, rest: np.ndarray) -> Learner:
        out = copy.deepcopy(self)
        out.model.embedding, out.seen_embedding = rows[:, :DIM].astype(np.float32), rows[:, DIM].astype(np.float32)
        at = 0
        for p in [*out._params(), *out.seen]:
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
        out.model.offset, out.seen_offset, out.model.stamp = float(rest[-2]), float(rest[-1]), uuid.uuid4().hex
        return out


def numbered_words(texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as rows of a table that has a word's buckets."""
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    return ids, np.fromiter(chain.from_iterable(map(features, index)), np.int64, 6 * len(index)).reshape(-1, 6)


def train(texts: Sequence[str], labels: np.ndarray, langs: list[str], epochs: int = 12, rate: float = 0.08, batch: int = 32, seed: int = 3) -> Model:
    """Adagrad on the logistic loss, classes weighted alike; a fifth of the rows calibrates thresholds."""
    rng = np.random.default_rng(seed)
    model = start_model(rng)
    held = rng.random(len(texts)) < 0.2
    if not labels[~held].any() or labels[~held].all():
        held[:] = False
    learnt(model, rng, texts, labels, held, epochs, rate, batch)
    if model.weight.any():
        tried = np.flatnonzero(held)
        model.thresholds = calibrate(score(model, Lazy(lambda i: texts[tried[i]], len(tried))), labels[held], [langs[i] for i in tried])
    return model


def learnt(model: Model, rng: np.random.Generator, texts: Sequence[str], labels: np.ndarray, held: np.ndarray, epochs: int = 12, rate: float = 0.08, batch: int = 32) -> Learner:
    """The model when it has learnt from the rows that are not ``held``; constant if they are of one class."""
    fit = np.flatnonzero(~held)
    positive = labels[fit].mean() if len(fit) else 0.0
    if not 0 < positive < 1:
        model.weight[:] = 0
        model.offset = float(np.log((positive * len(fit) + 0.5) / ((1 - positive) * len(fit) + 0.5)))
        return Learner(model, rate)
    ids, table = numbered_words(texts)
    cost = costs(labels, positive)
    learner = Learner(model, rate)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            learner.step([ids[r] for r in rows], table, labels[rows], cost[rows])
    return learner


def costs(labels: np.ndarray, positive: float) -> np.ndarray:
    """What an error costs, so that both classes weigh alike."""
    return np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32)


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 20, times: np.ndarray | None = None) -> dict[str, float]:
    """The threshold of best F1 for each language with at least ``least`` toxic rows; '' serves all others, 0.5 if they are too few.

    ``times`` says how many rows each score stands for.
    """
    out, langs_ = {}, np.array(langs, object)
    times = np.ones(len(labels), np.int64) if times is None else times
    for lang in ["", *sorted({x for x in langs if x})]:
        own = np.ones(len(labels), bool) if lang == "" else langs_ == lang
        s, n = scores[own], times[own]
        y = labels[own] * n
        if y.sum() < least:
            continue
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.cumsum(n[order]) + y.sum())
        f1[np.append(s[order][1:] == s[order][:-1], False)] = 0  # ties go together
        i = int(f1.argmax())
        below = s[order][i + 1] if i + 1 < len(s) else 0.0
        out[lang] = float(np.clip((s[order][i] + below) / 2, 0.05, 0.95))
    return {"": 0.5} | out


_cache: dict[str, int] = {}
_vectors = np.zeros((0, DIM), np.float32)
_owner = ""


def _forget() -> None:
    global _vectors, _owner
    _cache.clear()
    _vectors, _owner = np.zeros((0, DIM), np.float32), ""


def _looked_up(model: Model, words: list[str]) -> np.ndarray:
    """Embeddings of words, by a cache that belongs to the worker and to one model."""
    global _vectors, _owner
    new = list(dict.fromkeys(w for w in words if w not in _cache)) if _owner == model.stamp else None
    if new is None or len(_cache) + len(new) > CACHE_WORDS:
        _cache.clear()
        _vectors, _owner, new = np.zeros((0, DIM), np.float32), model.stamp, list(dict.fromkeys(words))
    if new:
        _cache.update(zip(new, range(len(_cache), len(_cache) + len(new)), strict=True))
        _vectors = np.concatenate([_vectors, model.embed(new)])
    return _vectors[np.fromiter(map(_cache.__getitem__, words), np.int64, len(words))]


def score(model: Model, texts: Sequence[str]) -> np.ndarray:
    """Probability of label 1 for each text, whatever its length; blocks of long texts overlap."""
    pad, best = max(WIDTHS) - 1, np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    pending: list[tuple[int, list[str]]] = []
    held = 0

    def flush() -> None:
        sizes = np.array([len(w) for _, w in pending])
        start, total = _layout(sizes)
        x = np.zeros((total, DIM), np.float32)
        x[np.concatenate([np.arange(s, s + n) for s, n in zip(start, sizes, strict=True)])] = _looked_up(model, [w for _, ws in pending for w in ws])
        z = []
        for k in range(len(WIDTHS)):
            r = _responses(model, x, k)
            # a text's places are followed by padding, where the others' do not reach
            z.append(np.stack([r[s : s + n].max(axis=0) for s, n in zip(start, np.maximum(sizes, 1), strict=True)]) + model.bias[k])
        z = np.concatenate(z, axis=1)
        for (row, _), own in zip(pending, z, strict=True):
            best[row] = np.maximum(best[row], own)

    for row, text in enumerate(texts):
        words = words_of(text)
        for at in range(0, max(1, len(words)), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS + pad]
            if pending and held + len(part) > BLOCK_WORDS:
                flush()
                pending, held = [], 0
            pending.append((row, part))
            held += len(part)
    if pending:
        flush()
    return 1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ model.weight + model.offset, -30, 30).astype(np.float64)))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with their texts packed: a third of the bytes come to the driver, which unpacks one text at a time."""
    pack = zstandard.ZstdCompressor(level=3).compress
    packed = pa.array([pack(x) for x in text_bytes(batch["text"])], pa.binary())
    return pa.record_batch({"doc_id": batch["doc_id"], "mark": batch["mark"], "packed": packed, "lang": batch["lang"], "toxic": batch["toxic"]})


def _copies(shared, number: int, positive: float, seed: int, batch: int = 32) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a copy of the model learns from one part of the rows: the buckets that it moved, block by block, and all other numbers."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, part = shared.value, int(group["part"].iloc[0])
        learner = copy.deepcopy(first)
        group = group.sort_values(["doc_id", "mark"], kind="stable")
        packed, labels = group["packed"].to_numpy(), group["toxic"].to_numpy(np.float32)
        cost, unpack = costs(labels, positive), zstandard.ZstdDecompressor().decompress
        order = np.random.default_rng([seed, number, part]).permutation(len(group))
        for at in range(0, len(order), SLICE_ROWS):
            own = order[at : at + SLICE_ROWS]
            ids, table = numbered_words(Lazy(lambda i, own=own: unpack(packed[own[i]]).decode(errors="replace"), len(own)))
            for low in range(0, len(own), batch):
                rows = own[low : low + batch]
                learner.step(ids[low : low + batch], table, labels[rows], cost[rows])
        rows, moved = learner.rows(), (learner.seen_embedding != first.seen_embedding)
        out = [(i, part, len(group), m.tobytes(), r[m].astype(np.float32).tobytes()) for i, (m, r) in enumerate(zip(np.array_split(moved, BLOCKS), np.array_split(rows, BLOCKS), strict=True))]
        return pd.DataFrame([*out, (BLOCKS, part, len(group), b"", learner.rest().astype(np.float64).tobytes())], columns=["block", "part", "weight", "moved", "data"])

    return run


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    """One block's mean over the copies, each weighted by its rows; a bucket's over those that moved it."""
    group, block = group.sort_values("part"), int(group["block"].iloc[0])
    if block == BLOCKS:
        data = sum(w * np.frombuffer(x, np.float64) for w, x in zip(group["weight"], group["data"], strict=True)) / group["weight"].sum()
        return pd.DataFrame({"block": [block], "moved": [b""], "data": [data.tobytes()]})
    size = len(group["moved"].iloc[0])
    total, weight = np.zeros((size, DIM + 1)), np.zeros(size)
    for w, moved, data in zip(group["weight"], group["moved"], group["data"], strict=True):
        mine = np.frombuffer(moved, bool)
        total[mine] += w * np.frombuffer(data, np.float32).reshape(-1, DIM + 1)
        weight[mine] += w
    some = weight > 0
    return pd.DataFrame({"block": [block], "moved": [some.tobytes()], "data": [(total[some] / weight[some, None]).astype(np.float32).tobytes()]})


def _passes(learner: Learner, rows: DataFrame, seed: int) -> Learner:
    """The model after ``PASSES`` passes over all ``rows`` (doc_id, mark, packed, toxic), dealt to copies by a hash."""
    spark = rows.sparkSession
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not 0 < toxic < n:
        return learner
    dealt = rows.select("doc_id", "mark", "packed", "toxic", F.pmod(F.xxhash64(F.lit(seed), "mark", "doc_id"), F.lit(-(-n // COPY_ROWS))).cast("int").alias("part"))
    for number in range(PASSES):
        shared = spark.sparkContext.broadcast(learner)  # BUCKETS x DIM numbers, as many come back
        copies = dealt.groupBy("part").applyInPandas(_copies(shared, number, toxic / n, seed), "block int, part int, weight long, moved binary, data binary")
        blocks = {r["block"]: r for r in copies.groupBy("block").applyInPandas(_averaged, "block int, moved binary, data binary").collect()}  # BLOCKS + 1 rows
        values = np.array_split(learner.rows(), BLOCKS)
        for i, own in enumerate(values):
            own[np.frombuffer(blocks[i]["moved"], bool)] = np.frombuffer(blocks[i]["data"], np.float32).reshape(-1, DIM + 1)
        learner = learner.with_values(np.concatenate(values), np.frombuffer(blocks[BLOCKS]["data"], np.float64))
        shared.destroy()
    return learner


def _thresholds(model: Model, rows: DataFrame, least: int = 20) -> dict[str, float]:
    """``calibrate`` over all ``rows`` (packed, lang, toxic): their scores are counted in ``STEPS`` steps, so that only counts come to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    unpack = zstandard.ZstdDecompressor

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed, opened = batch["packed"], unpack().decompress
        found = score(shared.value, Lazy(lambda i: opened(packed[i].as_py()).decode(errors="replace"), batch.num_rows))
        return pa.record_batch({"lang": batch["lang"], "toxic": batch["toxic"], "step": pa.array(np.round(found * STEPS).astype(np.int32))})

    counts = written(map_batches(rows.select("packed", "lang", "toxic"), scored, "lang string, toxic int, step int").groupBy("lang", "toxic", "step").agg(F.count(F.lit(1)).alias("n")), "toxic-scores")
    large = counts.groupBy("lang").agg(F.sum(F.col("toxic") * F.col("n")).alias("toxic")).where(F.col("toxic") >= least).select("lang")
    both = [counts.groupBy("toxic", "step").agg(F.sum("n").alias("n")).toPandas(), counts.join(F.broadcast(large), "lang", "left_semi").toPandas()]
    out = {"": 0.5}
    for found, langs in zip(both, ([""] * len(both[0]), both[1]["lang"].tolist()), strict=True):
        limits = calibrate(found["step"].to_numpy() / STEPS, found["toxic"].to_numpy(np.float64), langs, least, found["n"].to_numpy())
        out |= {k: v for k, v in limits.items() if (k == "") == (found is both[0])}
    discard(counts)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = ROWS_PER_CLASS, seed: int = 3) -> Model:
    """A model from all labelled rows for which ``learn`` holds.

    Up to ``rows_per_class`` rows of each label are trained on in the driver.
    If there are more, that many of each, by a seeded hash of their id, start the
    model there, and copies of it learn from all rows in tasks; the rows of a
    fifth of the ids are held back to set thresholds.  Labels other than 0 and 1
    and null texts are left out, an id with both labels counts as toxic; with
    one class alone the model is constant.  Rows are trained on in an order that
    depends on them alone.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)
    order = F.xxhash64(F.lit(seed), "doc_id")
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(lang, F.lit("")).alias("lang")).where("text IS NOT NULL")

    def packed(wanted: DataFrame, sent: bool = True) -> DataFrame:
        own = rows.join(F.broadcast(wanted), "doc_id") if sent else rows.withColumn("toxic", F.lit(None).cast("int"))
        found = map_batches(own.withColumn("mark", F.xxhash64("text")), _packed, "doc_id long, mark long, packed binary, lang string, toxic int")
        return found if sent else found.drop("toxic").join(wanted, "doc_id")

    def some(of: DataFrame) -> DataFrame:
        picked = [of.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(rows_per_class) for y in (0, 1)]
        return F.broadcast(picked[0].union(picked[1]))  # at most 2 x rows_per_class rows

    counts = [r["count"] for r in marked.groupBy("toxic").count().collect()]
    few = all(n <= rows_per_class for n in counts)
    every = None if few else written(packed(marked, sum(counts) <= SENT_LABELS), "toxic-rows")
    held = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0
    first = packed(some(marked)) if few else every.join(some(marked.where(~held)).select("doc_id"), "doc_id", "left_semi")
    own = first.orderBy("doc_id", "mark").limit(2 * rows_per_class).drop("mark").toPandas()
    unpack, texts = zstandard.ZstdDecompressor().decompress, own["packed"].tolist()
    opened, toxic = Lazy(lambda i: unpack(texts[i]).decode(errors="replace"), len(texts)), own["toxic"].to_numpy(np.float32)
    model = train(opened, toxic, own["lang"].tolist(), seed=seed) if few else None
    rng = np.random.default_rng(seed)
    learner = None if few else learnt(start_model(rng), rng, opened, toxic, np.zeros(len(texts), bool))
    # the driver needs neither the texts nor the embeddings of their words any more
    del own, texts, opened
    _forget()
    pa.default_memory_pool().release_unused()
    if few:
        return model
    model = _passes(learner, every.where(~held), seed).model
    model.thresholds = _thresholds(model, every.where(held))
    discard(every)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and toxic_score (0 to 1) and toxic_flag (over the threshold of the row's lang).

    Whole texts are read; null counts as empty, and empty texts have a score
    too.  lang picks the threshold only; without one, the general threshold
    holds.  Columns of the two names are replaced; repeated rows repeat.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x DIM numbers
    columns = [c for c in docs.columns if c not in ("toxic_score", "toxic_flag")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = score(shared.value, [x.decode() for x in text_bytes(part["row"].field("text"))])
                yield pa.record_batch({"row": part["row"], "toxic_score": pa.array(scores, pa.float64())})

    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"))
    scored = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, toxic_score double").select("row.*", "toxic_score")
    limit = F.lit(model.thresholds.get("", 0.5))
    if "lang" in columns:
        for lang, value in model.thresholds.items():
            if lang:
                limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return scored.withColumn("toxic_flag", F.col("toxic_score") >= limit)
