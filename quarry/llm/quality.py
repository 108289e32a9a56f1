"""Quality from weak labels: a label model by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers vote 1 (good), 0 (poor) or abstain on every document.
Their votes are counted by pattern over all documents - at most 3^labellers
patterns, whatever the corpus holds - and EM over those counts estimates each
labeller's accuracy and the share of good documents.  The posterior of a
pattern is the soft label on which a linear scorer over hashed features of the
text is trained; it scores every document, those without any vote too.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches, text_bytes

BUCKETS = 1 << 14
#: Bound of the rows that the scorer is fitted on; labellers are estimated on all rows.
FIT_ROWS = 6000
SHAPE = re.compile(r"[A-Z]+|[a-z]+|[^\W\d_]+|\d+|\s+|[^\w\s]|_", re.ASCII)


#: The labellers, in the order of their votes.
LABELLERS = ("length", "symbols", "marks", "capitals", "letters", "variety", "lines", "sentences", "words")
PLAIN = frozenset(".,;:'\"()?!-")


def votes_of(text: str) -> list[int]:
    """Votes of all labellers on a text: 1 (good), 0 (poor) or -1 (abstains)."""
    kinds, times = Counter(text), Counter(text.split())
    chars, n = max(1, len(text)), sum(times.values())
    count = lambda is_: sum(v for c, v in kinds.items() if is_(c))
    symbols = count(lambda c: not (c.isalnum() or c.isspace() or c in PLAIN)) / chars
    capitals, letters = count(str.isupper) / chars, count(str.isalpha) / chars
    marked = sum(v for w, v in times.items() if not w[-1].isalnum() and not w[-2:-1].isalnum()) / max(1, n)
    lines = [x for x in text.split("\n") if len(x) > 20]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    ends, mean = sum(kinds[c] for c in ".!?") / max(1, n), (len(text) - count(str.isspace)) / max(1, n)
    distinct = len(times) / max(1, n)
    vote = lambda good, poor: 0 if poor else 1 if good else -1
    return [
        vote(n >= 40, n < 8),
        vote(symbols < 0.005, symbols > 0.03),
        vote(marked < 0.02, marked > 0.2),
        vote(0.002 <= capitals <= 0.1, capitals > 0.3),
        vote(letters > 0.75, letters < 0.68),
        vote(n >= 20 and distinct > 0.4, n >= 20 and distinct < 0.25),
        vote(len(lines) >= 3 and repeated < 0.05, repeated > 0.3 and len(lines) > 0),
        vote(0.02 <= ends <= 0.3, n >= 20 and not 0.005 <= ends <= 0.5),
        vote(3 <= mean <= 9, not 2 <= mean <= 14),
    ]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, start_good: float = 0.98, start_poor: float = 0.4, rows: float = 4.0) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (-1: abstains): share of good documents, P(vote 1 | good), P(vote 0 | poor).

    Labellers are taken as independent given the class; abstaining tells
    nothing.  EM starts from labellers that seldom call a good document poor
    and miss many poor ones, which also says which class is the good one.  The
    start weighs as much as ``rows`` documents and no more, so that a labeller
    that never votes on a class keeps a defined value; the corpus decides.
    """
    n = counts.sum()
    good, right_good, right_poor = 0.8, np.full(votes.shape[1], start_good), np.full(votes.shape[1], start_poor)
    yes, cast = votes == 1, votes >= 0
    for _ in range(rounds):
        p = posterior(votes, good, right_good, right_poor)
        w1, w0 = counts * p, counts * (1 - p)
        new_good = (w1.sum() + 0.8 * rows) / (n + rows)
        new_right = (w1 @ yes + start_good * rows) / (w1 @ cast + rows)
        new_poor = (w0 @ (cast & ~yes) + start_poor * rows) / (w0 @ cast + rows)
        step = max(abs(new_good - good), np.abs(new_right - right_good).max(initial=0), np.abs(new_poor - right_poor).max(initial=0))
        good, right_good, right_poor = new_good, new_right, new_poor
        if step < 1e-7:
            break
    return good, right_good, right_poor


def posterior(votes: np.ndarray, good: float, right_good: np.ndarray, right_poor: np.ndarray) -> np.ndarray:
    """P(good | votes)."""
    yes, no = votes == 1, votes == 0
    log_good = np.log(good) + yes @ np.log(right_good) + no @ np.log(1 - right_good)
    log_poor = np.log(1 - good) + yes @ np.log(1 - right_poor) + no @ np.log(right_poor)
    return 1 / (1 + np.exp(np.clip(log_poor - log_good, -50, 50)))


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and L2-normalised weights of a text's words and of its runs of like characters."""
    counts: dict[str, int] = {}
    n = 0
    for word, times in Counter(text.split()).items():
        n += times
        counts["w" + word.lower()] = counts.get("w" + word.lower(), 0) + times
        for run in SHAPE.findall(word):
            kind = "A" if run.isupper() else "a" if run.isalpha() else "0" if run.isdigit() else run
            counts["s" + kind] = counts.get("s" + kind, 0) + times
    counts[f"n{min(12, n.bit_length())}"] = max(1, n // 4)
    counts[f"d{10 * sum(k[0] == 'w' for k in counts) // max(1, n)}"] = max(1, n // 4)
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    return np.fromiter((zlib.crc32(k.encode()) % BUCKETS for k in counts), np.int64, len(counts)), weight / np.sqrt((weight**2).sum())


@dataclass
class Scorer:
    weight: np.ndarray
    offset: float
    share: float
    right_good: np.ndarray
    right_poor: np.ndarray

    def __call__(self, texts: list[str]) -> np.ndarray:
        z = [self.weight[b] @ w for b, w in map(hashed, texts)]
        return 1 / (1 + np.exp(-np.clip(np.array(z) + self.offset, -30, 30)))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad; ``rows`` are those of ``hashed``."""
    rng, weight, seen, offset, seen_offset = np.random.default_rng(seed), np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, w = rows[i]
            g = 1 / (1 + np.exp(-np.clip(weight[b] @ w + offset, -30, 30))) - target[i]
            own, slot = np.unique(b, return_inverse=True)
            grad = np.bincount(slot, w * g, len(own)) + 1e-6 * weight[own]
            seen[own] += grad**2
            weight[own] -= rate * grad / np.sqrt(seen[own])
            seen_offset += g * g
            offset -= rate * g / seen_offset**0.5
    return weight, offset


NAMES = [f"vote_{k}" for k in LABELLERS]


def _votes(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = np.array([votes_of(x.decode()) for x in text_bytes(batch["_text"])], np.int32).reshape(-1, len(NAMES))
    return pa.record_batch({n: pa.array(np.ascontiguousarray(rows[:, i])) for i, n in enumerate(NAMES)})


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [x.decode() for x in text_bytes(batch["_text"])]
    rows = []
    for text in texts:
        b, w = hashed(text)
        own, slot = np.unique(b, return_inverse=True)  # no more than BUCKETS
        rows.append((own, np.bincount(slot, w, len(own))))
    return pa.record_batch(
        {
            "votes": pa.array([votes_of(t) for t in texts], pa.list_(pa.int32())),
            "buckets": pa.array([b for b, _ in rows], pa.list_(pa.int32())),
            "weights": pa.array([w for _, w in rows], pa.list_(pa.float32())),
        }
    )


def fit(docs: DataFrame, text: str = "text", id_column: str = "doc_id", fit_rows: int = FIT_ROWS, seed: int = 5) -> Scorer:
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    voted = map_batches(rows.select("_text"), _votes, ", ".join(f"{n} int" for n in NAMES))
    patterns = voted.groupBy(*NAMES).count().toPandas()  # at most 3^labellers rows
    votes, counts = patterns[NAMES].to_numpy(), patterns["count"].to_numpy(np.float64)
    good, right_good, right_poor = estimate(votes, counts) if len(votes) else (0.5, *np.full((2, len(NAMES)), 0.5))
    # at most fit_rows rows of BUCKETS numbers, however long the texts are
    found = map_batches(bounded_sample(rows, fit_rows, ["_id", "_text"], seed), _features, "votes array<int>, buckets array<int>, weights array<float>").toPandas()
    target = posterior(np.array(found["votes"].tolist()).reshape(len(found), len(NAMES)), good, right_good, right_poor)
    weight, offset = fit_linear([(np.asarray(b, np.int64), np.asarray(w, np.float64)) for b, w in zip(found["buckets"], found["weights"], strict=True)], target, seed=seed)
    return Scorer(weight, offset, good, right_good, right_poor)


def grade(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the votes, weak_label (their posterior) and quality_score (the scorer's).

    Whole texts are read; null counts as empty.  Columns of the new names are
    replaced; repeated rows repeat; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS numbers
    columns = [c for c in docs.columns if c not in ("weak_label", "quality_score", *NAMES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [x.decode() for x in text_bytes(part["_text"])]
                votes = np.array([votes_of(t) for t in texts], np.int32).reshape(-1, len(NAMES))
                weak = posterior(votes, model.share, model.right_good, model.right_poor)
                found = {n: pa.array(np.ascontiguousarray(votes[:, i])) for i, n in enumerate(NAMES)}
                yield pa.record_batch({"row": part["row"], **found, "weak_label": pa.array(weak), "quality_score": pa.array(model(texts))})

    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(text).alias("_text"))
    votes = ", ".join(f"{n} int" for n in NAMES)
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {votes}, weak_label double, quality_score double")
    return out.select("row.*", *NAMES, "weak_label", "quality_score")
