"""Log-bilinear language model trained in numpy with noise-contrastive estimation.

Words fall into classes: the most frequent have one each, all others share
classes by a hash of their ending.  The model predicts a class from the two
before it: context vectors, weighted component by component, meet the vectors
of the classes in batched matrix products, normalised over all classes.  Within
a shared class a word has its add-one share of the training counts, unseen
words included, so that probabilities add up to 1 over all words.

Every training document is counted and trained on.  Texts are written in parts
of bounded size; the words of each part are dealt by hash to be counted over
the corpus, and the counts that a part needs come back to it.  Each task trains
a copy of the model over its parts, and copies are averaged block by block.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, written

#: Classes of single words (the end of a text among them) and of shared ones; size of vectors.
FREQUENT, SHARED, DIM, CONTEXT = 512, 128, 24, 2
CLASSES = FREQUENT + SHARED
BEGIN = CLASSES  # stands before a text
#: Bytes of text in a part; tokens in a training step; noise words of a step.
PART, STEP, NOISE = 1 << 20, 2048, 64
END = b"\n"  # no word holds white space
BLOCKS = 16


def shared_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-3:]) % SHARED


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _int32(blob: bytes) -> np.ndarray:
    return np.frombuffer(_open(blob), np.int32)


@dataclass
class Model:
    """vectors: of context classes; out, bias: of predicted ones; mix: weights of each place."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    mix: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.vectors.ravel(), self.out.ravel(), self.bias, self.mix.ravel()]).astype(np.float32)

    @staticmethod
    def unflat(x: np.ndarray) -> Model:
        sizes = np.cumsum([(CLASSES + 1) * DIM, CLASSES * DIM, CLASSES])
        v, o, b, m = np.split(np.array(x, np.float32), sizes)
        return Model(v.reshape(-1, DIM), o.reshape(-1, DIM), b, m.reshape(CONTEXT, DIM))

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        return Normalised(self)(context, target)


class Normalised:
    """Natural log-probabilities under a model, by tables of all pairs of classes.

    A score is a sum over the places of the context, so its exponential is a
    product, and the normalisers of all contexts are one product of matrices.
    """

    def __init__(self, model: Model):
        self.near, self.far = ((model.vectors * model.mix[j]).astype(np.float64) @ model.out.T.astype(np.float64) for j in range(CONTEXT))
        self.near += model.bias
        top_near, top_far = self.near.max(axis=1, keepdims=True), self.far.max(axis=1, keepdims=True)
        self.log_norm = np.log(np.exp(self.near - top_near) @ np.exp(self.far - top_far).T) + top_near + top_far.T

    def __call__(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        first, second = context[:, 0], context[:, 1]
        return self.near[first, target] + self.far[second, target] - self.log_norm[first, second]


def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``, as an array of n rows."""
    order = np.argsort(index, kind="stable")
    own = index[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    out[own[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def start_model(counts: np.ndarray, seed: int = 13) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    bias = np.log((counts + 1) / (counts.sum() + len(counts))).astype(np.float32)
    return Model(small(CLASSES + 1, DIM), small(CLASSES, DIM), bias, np.ones((CONTEXT, DIM), np.float32))


def contexts(classes: np.ndarray, sizes: np.ndarray, before: list[np.ndarray] | None = None) -> np.ndarray:
    """The two classes before each token; ``sizes`` are the tokens of each text, ``before`` the classes that a later section of a text follows."""
    start = np.cumsum(sizes) - sizes
    out = np.full((len(classes), CONTEXT), BEGIN, np.int32)
    out[1:, 0] = classes[:-1]
    out[2:, 1] = classes[:-2]
    out[start, 0] = BEGIN
    out[start, 1] = BEGIN
    second = start[sizes > 1] + 1
    out[second, 1] = BEGIN
    for at, n, own in zip(start.tolist(), sizes.tolist(), before or [], strict=False):
        if len(own):
            out[at, 0] = own[-1]
            out[at + 1 : at + min(n, 2), 1] = own[-1]
            out[at, 1] = own[-2] if len(own) > 1 else BEGIN
    return out


class Trainer:
    """Noise-contrastive estimation with Adagrad; a step's tokens share their noise words."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int, rate: float = 0.1):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.log_noise, self.sums = np.log(noise * NOISE).astype(np.float32), np.cumsum(noise)
        self.seen_v, self.seen_o, self.seen_b = (np.full(n, 1e-3, np.float32) for n in (CLASSES + 1, CLASSES, CLASSES))
        self.seen_m = np.full((CONTEXT, DIM), 1e-1, np.float32)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.sums, self.rng.random(NOISE) * self.sums[-1]), CLASSES - 1)
        parts = [m.vectors[context[:, j]] for j in range(CONTEXT)]
        r = sum(p * m.mix[j] for j, p in enumerate(parts))
        own, other = m.out[target], m.out[noise]
        s = np.einsum("nd,nd->n", r, own) + m.bias[target] - self.log_noise[target]
        t = r @ other.T + (m.bias[noise] - self.log_noise[noise])
        g = -1 / (1 + np.exp(np.clip(s, -30, 30)))
        h = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        dr = g[:, None] * own + h @ other
        index = np.concatenate((target, noise))
        d_out = summed(index, np.concatenate((g[:, None] * r, h.T @ r)), CLASSES)
        d_bias = np.bincount(index, np.concatenate((g, h.sum(axis=0))), CLASSES).astype(np.float32)
        d_vectors = summed(context.T.ravel(), np.concatenate([dr * m.mix[j] for j in range(CONTEXT)]), CLASSES + 1)
        d_mix = np.stack([np.einsum("nd,nd->d", dr, p) for p in parts]) / len(target)
        for param, grad, seen in ((m.vectors, d_vectors / len(target) ** 0.5, self.seen_v), (m.out, d_out / len(target) ** 0.5, self.seen_o)):
            seen += (grad**2).mean(axis=1)
            param -= self.rate * grad / np.sqrt(seen)[:, None]
        d_bias /= len(target) ** 0.5
        self.seen_b += d_bias**2
        m.bias -= self.rate * d_bias / np.sqrt(self.seen_b)
        self.seen_m += d_mix**2
        m.mix -= self.rate * 0.1 * d_mix / np.sqrt(self.seen_m)

    def run(self, classes: np.ndarray, sizes: np.ndarray, before: list[np.ndarray] | None = None) -> None:
        context = contexts(classes, sizes, before)
        order = self.rng.permutation(-(-len(classes) // STEP))
        for k in order:
            self.step(context[k * STEP : (k + 1) * STEP], classes[k * STEP : (k + 1) * STEP])


# ---- parts of the corpus, their words, and counts over all parts


def _write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of bounded size: the texts of some documents, longer ones cut after a word."""
    schema = {"part": pa.string(), "row": pa.list_(pa.int64()), "doc_id": pa.list_(pa.int64()), "train": pa.list_(pa.bool_()), "last": pa.list_(pa.bool_()), "before": pa.list_(pa.binary()), "texts": pa.binary()}
    import uuid

    own: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        cols = [[x] for x in zip(*((r, i, t, e, b) for r, i, t, e, b, _ in own), strict=True)]
        data = [[uuid.uuid4().hex], *[[list(c[0])] for c in cols], [_pack(b"\0\n".join(x for *_, x in own))]]
        return pa.record_batch({c: pa.array(v, k) for (c, k), v in zip(schema.items(), data, strict=True)})

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for row, doc_id, train, text in zip(piece["row"].to_pylist(), piece["doc_id"].to_pylist(), piece["train"].to_pylist(), text_bytes(piece["text"]), strict=True):
                words, before = b" ".join(text.lower().split()), b""
                while True:
                    cut = words.find(b" ", PART) if len(words) > PART else -1
                    now, words = (words, b"") if cut < 0 else (words[:cut], words[cut + 1 :])
                    if own and size + len(now) > PART:
                        yield flush()
                        own, size = [], 0
                    own.append((row, doc_id, train, cut < 0, before, now))
                    size += len(now) + 16
                    before = b" ".join(now.rsplit(b" ", CONTEXT)[-CONTEXT:])
                    if cut < 0:
                        break
    if own:
        yield flush()


def _parts_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[list[bytes]]]]:
    """A part's row and the tokens of each of its texts; only the last section of a text has the end."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        texts = _open(row["texts"]).split(b"\0\n")
        yield row, [[*t.split(), END] if e else t.split() for t, e in zip(texts, row["last"], strict=True)]


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _parts_of(batch):
                counts: Counter = Counter()
                for train, words in zip(row["train"], texts, strict=True):
                    if train:
                        counts.update(words)
                    else:
                        counts.update(dict.fromkeys(words, 0))
                by: list[list[bytes]] = [[] for _ in range(buckets)]
                for w in sorted(counts):
                    by[zlib.crc32(w) % buckets].append(w)
                some = [b for b in range(buckets) if by[b]]
                yield pa.record_batch(
                    {
                        "part": pa.array([row["part"]] * len(some)),
                        "bucket": pa.array(some, pa.int32()),
                        "words": pa.array([_pack(b" ".join(by[b])) for b in some], pa.binary()),
                        "counts": pa.array([_pack(np.array([counts[w] for w in by[b]], np.int32).tobytes()) for b in some], pa.binary()),
                    }
                )

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket: totals of its shared classes, its most frequent words, and for each part the counts of its words."""
    rows: list[dict] = []

    def flush() -> pa.RecordBatch:
        total: Counter = Counter()
        lists = []
        for r in rows:
            words, counts = _open(r["words"]).split(b" "), _int32(r["counts"])
            lists.append(words)
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] += c
        seen = {w: c for w, c in total.items() if c}
        tokens, types = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for w, c in seen.items():
            k = shared_class(w) - FREQUENT
            tokens[k] += c
            types[k] += 1
        top = sorted(((c, w) for w, c in seen.items()), key=lambda x: (-x[0], x[1]))[:FREQUENT]
        kind = {"part": pa.string(), "bucket": pa.int32(), "counts": pa.binary(), "tokens": pa.list_(pa.int64()), "types": pa.list_(pa.int64()), "top": pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))}
        data = {
            "part": [None, *(r["part"] for r in rows)],
            "bucket": [rows[0]["bucket"]] * (len(rows) + 1),
            "counts": [None, *(_pack(np.array([total[w] for w in ws], np.int64).tobytes()) for ws in lists)],
            "tokens": [tokens, *[None] * len(rows)],
            "types": [types, *[None] * len(rows)],
            "top": [[{"word": w, "n": c} for c, w in top], *[None] * len(rows)],
        }
        return pa.record_batch({c: pa.array(data[c], k) for c, k in kind.items()})

    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["bucket"] != rows[0]["bucket"]:
                yield flush()
                rows = []
            rows.append(row)
    if rows:
        yield flush()


@dataclass
class Vocabulary:
    """What the corpus says, besides the counts of single words: bounded by the number of classes."""

    index: dict[bytes, int]  # classes of frequent words
    counts: np.ndarray  # training tokens of each class
    types: np.ndarray  # seen words of each shared class
    total_tokens: int
    total_types: int

    def classes(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        return np.array([c if (c := get(w)) is not None else shared_class(w) for w in words], np.int32)


def vocabulary(sums: DataFrame) -> Vocabulary:
    own = sums.where("part IS NULL")
    totals = own.select(F.posexplode(F.arrays_zip("tokens", "types"))).groupBy("pos").agg(F.sum("col.tokens").alias("tokens"), F.sum("col.types").alias("types")).collect()  # SHARED rows
    tokens, types = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in totals:
        tokens[r["pos"]], types[r["pos"]] = r["tokens"], r["types"]
    n, v = int(tokens.sum()), int(types.sum())
    top = own.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    index, counts = {}, np.zeros(CLASSES, np.int64)
    for k, r in enumerate(top):
        word = bytes(r["word"])
        index[word] = k
        counts[k] = r["n"]
        tokens[shared_class(word) - FREQUENT] -= r["n"]
        types[shared_class(word) - FREQUENT] -= 1
    counts[FREQUENT:] = tokens
    return Vocabulary(index, counts, types, n, v)


def _train(shared, seed: int):
    """One model for each task, over all its training texts, as blocks of parameters with their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        trainer, tokens = None, 0
        for batch in batches:
            for row, texts in _parts_of(batch):
                kept = [i for i, train in enumerate(row["train"]) if train and texts[i]]
                mine = [texts[i] for i in kept]
                if not mine:
                    continue
                if trainer is None:
                    noise = (known.counts + 1.0) / (known.counts + 1.0).sum()
                    trainer = Trainer(Model.unflat(model.flat()), noise, seed)
                classes = known.classes([w for t in mine for w in t])
                trainer.run(classes, np.array([len(t) for t in mine]), [known.classes(row["before"][i].split()) for i in kept])
                tokens += len(classes)
        if tokens:
            blocks = np.array_split(trainer.model.flat(), BLOCKS)
            yield pa.record_batch({"block": pa.array(range(BLOCKS), pa.int32()), "tokens": pa.array([tokens] * BLOCKS, pa.int64()), "values": pa.array([b.tolist() for b in blocks], pa.list_(pa.float32()))})

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the blocks in a partition, one row for each block."""
    sums: dict[int, np.ndarray] = {}
    weight: dict[int, int] = {}
    for batch in batches:
        for block, tokens, values in zip(batch["block"].to_pylist(), batch["tokens"].to_pylist(), batch["values"], strict=True):
            sums[block] = sums.get(block, 0) + tokens * values.values.to_numpy().astype(np.float64)
            weight[block] = weight.get(block, 0) + tokens
    if sums:
        yield pa.record_batch({"block": pa.array(list(sums), pa.int32()), "tokens": pa.array([weight[b] for b in sums], pa.int64()), "values": pa.array([(sums[b] / weight[b]).tolist() for b in sums], pa.list_(pa.float32()))})


def _score(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        log_prob = Normalised(model)
        base_norm = np.log10(known.total_tokens + known.total_types + 1) if known.total_tokens + known.total_types else 0.0
        shared_norm = np.log10(known.counts[FREQUENT:] + known.types + 1.0)
        for batch in batches:
            for row, texts in _parts_of(batch):
                words = [w for t in texts for w in t]
                if not words:
                    yield pa.record_batch({c: pa.array(v, k) for c, v, k in (("row", row["row"], pa.int64()), ("doc_id", row["doc_id"], pa.int64()), ("train", row["train"], pa.bool_()), ("n_tokens", [0] * len(texts), pa.int64()), ("n_known", [0] * len(texts), pa.int64()), ("base_score", [0.0] * len(texts), pa.float64()), ("score", [0.0] * len(texts), pa.float64()))})
                    continue
                by: list[list[bytes]] = [[] for _ in range(buckets)]
                for w in sorted(set(words)):
                    by[zlib.crc32(w) % buckets].append(w)
                count: dict[bytes, int] = {}
                for got in row["sums"]:
                    count.update(zip(by[got["bucket"]], np.frombuffer(_open(got["counts"]), np.int64).tolist(), strict=True))
                c = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
                sizes = np.array([len(t) for t in texts])
                filled = np.flatnonzero(sizes)
                classes = known.classes(words)
                log = log_prob(contexts(classes, sizes[filled], [known.classes(row["before"][i].split()) for i in filled]), classes) / np.log(10)
                rare = classes >= FREQUENT
                log[rare] += np.log10(c[rare] + 1.0) - shared_norm[classes[rare] - FREQUENT]
                start = (np.cumsum(sizes) - sizes)[filled]

                def each(x: np.ndarray, filled=filled, start=start, sizes=sizes) -> np.ndarray:
                    out = np.zeros(len(sizes), x.dtype)
                    out[filled] = np.add.reduceat(x, start)
                    return out

                yield pa.record_batch(
                    {
                        "row": pa.array(row["row"], pa.int64()),
                        "doc_id": pa.array(row["doc_id"], pa.int64()),
                        "train": pa.array(row["train"], pa.bool_()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "n_known": pa.array(each((c > 0).astype(np.int64))),
                        "base_score": pa.array(each(np.log10(c + 1.0) - base_norm)),
                        "score": pa.array(each(log.astype(np.float64))),
                    }
                )

    return run


def perplexity(docs: DataFrame, learn: Column, text: str = "text", id_column: str = "doc_id", seed: int = 13) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z in lower case,
    and each text ends with a token of its own.  base_score is the log10
    probability of the text under add-one word counts, score that of the model;
    both learn from the rows for which ``learn`` holds.  Null texts count as
    empty: they have the end alone.  Rows are told apart by a number of their
    own, so repeated or null ids do no harm; an empty table gives an empty
    result; other columns are not read.  The counts depend on the rows alone;
    the neural model also on which parts of the corpus a task trains on, so
    another split of the input changes ``score`` a little.
    """
    spark = docs.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text).alias("text"))
    parts = written(rows.mapInArrow(_write_parts, "part string, row array<long>, doc_id array<long>, train array<boolean>, last array<boolean>, before array<binary>, texts binary"), "lm-parts")
    words = parts.select("part", "train", "last", "texts").mapInArrow(_count_words(buckets), "part string, bucket int, words binary, counts binary")
    dealt = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    sums = written(dealt.mapInArrow(_sum_words, "part string, bucket int, counts binary, tokens array<long>, types array<long>, top array<struct<word: binary, n: long>>"), "lm-counts")
    known = vocabulary(sums)
    first = spark.sparkContext.broadcast((start_model(known.counts, seed), known))  # bounded by CLASSES x DIM
    copies = parts.select("train", "last", "before", "texts").mapInArrow(_train(first, seed), "block int, tokens long, values array<float>")
    blocks = copies.repartition(BLOCKS, "block").mapInArrow(_average, "block int, tokens long, values array<float>").orderBy("block").collect()  # BLOCKS rows
    model = Model.unflat(np.concatenate([np.array(b["values"], np.float32) for b in blocks])) if blocks else first.value[0]
    fitted = spark.sparkContext.broadcast((model, known))
    back = sums.where("part IS NOT NULL").groupBy("part").agg(F.collect_list(F.struct("bucket", "counts")).alias("sums"))
    scored = parts.join(back, "part").select("row", "doc_id", "train", "last", "before", "texts", "sums").mapInArrow(_score(fitted, buckets), "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "train", "n_tokens", "n_known", F.lit(known.total_tokens).cast("long").alias("train_tokens"), "base_score", "score")
