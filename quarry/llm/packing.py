"""Sequence packing by cutting-stock column generation.

Texts become token ids; each document is cut into full sequences and a
remainder, and a remainder of over half a sequence into that half and the rest:
large remainders alone would leave gaps that too few small ones could fill,
while halves pair up.  What is shorter than a sequence is a cutting-stock problem over their length histogram,
which has at most ``capacity`` - 1 rows whatever the corpus holds: a linear
program over patterns (multisets of lengths that fit a sequence), where a
knapsack dynamic program prices new patterns by the duals.  Patterns are
rounded down, and documents - ranked within their length - fill them.  The few
that rounding leaves over, in proportion to the number of lengths, are packed
best fit first, and the last of them cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import salted_rank, salts_for, text_bytes, written

_encoders: dict[str, Callable[[list[str]], list[list[int]]]] = {}
#: Texts on which the two libraries must agree before the faster one is used, besides what is known of the file.
PROBES = ["It's  a\ttest,\n\n 1234 km\u00a0away", " \u00e9t\u00e9 \u4e2d\u6587 \U0001f600!!", "<|endoftext|", "\u0085a\x1c b"]

#: A run of blanks for each of which tiktoken's pattern takes stack; it overflows at some hundred thousands.
LONG_BLANKS = re.compile(r"\s{50000}")


def _encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The ids that ``tokenizers`` gives for the file at ``path``, in its default setting.

    A plain byte-level BPE, whose merges are its tokens in order, is run by
    tiktoken over the file's own vocabulary, which is several times as fast and
    gives the same ids.  Texts that hold an added token, such as an end mark,
    or a very long run of blanks, and files of any other kind go to ``tokenizers``.
    """
    tokenizer = Tokenizer.from_file(path)

    def slow(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    try:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = [t["content"] for t in model["added_tokens"]]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        ordered = all(vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] == 256 + k for k, m in enumerate(merges))
        plain = model["normalizer"] is None and model["pre_tokenizer"]["type"] == "ByteLevel" and not model["pre_tokenizer"]["add_prefix_space"]
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocabulary.items() if token not in added}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if not (ordered and plain and [fast.encode_ordinary(x) for x in PROBES] == slow(PROBES)):
            return slow
    except (KeyError, TypeError, ValueError):
        return slow

    def by_slow(text: str) -> bool:
        return any(x in text for x in added) or LONG_BLANKS.search(text) is not None

    def mixed(texts: list[str]) -> list[list[int]]:
        return [slow([t])[0] if by_slow(t) else fast.encode_ordinary(t) for t in texts]

    return mixed


def encode(texts: list[str], tokenizer_path: str) -> list[list[int]]:
    """Token ids of each text, without special tokens."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = _encoder(tokenizer_path)
    return _encoders[tokenizer_path](texts)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, text: str = "text", id_column: str = "doc_id", copy_column: str | None = None) -> DataFrame:
    """(doc_id, copy, start, length, ids, doc_tokens): every id of every text and its end id, in pieces.

    ids is binary: little-endian unsigned 32-bit.  A null or empty text has the
    end id alone.
    """

    half = capacity // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: dict[str, list] = {"doc_id": [], "copy": [], "start": [], "length": [], "ids": [], "doc_tokens": []}
                ids = encode([x.decode() for x in text_bytes(part["_text"])], tokenizer_path)
                for doc_id, copy, own in zip(part["_id"].to_pylist(), part["_copy"].to_pylist(), ids, strict=True):
                    own = np.array([*own, end_id], "<u4")
                    starts = list(range(0, len(own), capacity))
                    if len(own) - starts[-1] > half and len(own) - starts[-1] < capacity:
                        starts.append(starts[-1] + half)
                    for start, end in zip(starts, [*starts[1:], len(own)], strict=True):
                        piece = own[start:end]
                        for column, value in zip(out.values(), (doc_id, copy, start, len(piece), piece.tobytes(), len(own)), strict=True):
                            column.append(value)
                kinds = {"ids": pa.binary()}
                yield pa.record_batch({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    copy = F.col(copy_column).cast("long") if copy_column else F.lit(0).cast("long")
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), copy.alias("_copy"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, copy long, start long, length long, ids binary, doc_tokens long")


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack: the counts of each size (index + 1) of largest total value that fit ``capacity``."""
    sizes = np.flatnonzero(value > 1e-12) + 1
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = sizes[: np.searchsorted(sizes, room, "right")]
        if len(fit):
            gain = best[room - fit] + value[fit - 1]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], choice[room] = gain[k], fit[k]
    pattern, room = np.zeros(len(value), np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def patterns(histogram: np.ndarray, capacity: int, gap: float = 2e-3, max_columns: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Column generation for the cutting-stock program of a size histogram.

    ``histogram[k]`` counts items of size k + 1.  Revised simplex from the
    patterns of one size each; stops when Lagrange's bound is within ``gap`` of
    the value, or after ``max_columns``.  Returns (pattern, how often), one for
    each size in use.
    """
    used = np.flatnonzero(histogram)
    if not len(used):
        return []
    m = len(used)
    # demands are perturbed a little, so that the simplex does not cycle
    level = histogram[used] * (1 + 1e-7 * np.arange(1, m + 1) / m)
    fill = capacity // (used + 1)
    columns, inverse, amount = np.diag(fill).astype(float), np.diag(1.0 / fill), level / fill
    for _ in range(max_columns):
        value = np.zeros(len(histogram))
        value[used] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = best_pattern(value, capacity)
        if worth <= 1 + max(1e-9, gap):  # the optimum is at least the value / worth
            break
        entering = inverse @ pattern[used]
        ratio = np.where(entering > 1e-9, amount / np.where(entering > 1e-9, entering, 1), np.inf)
        leave = int(ratio.argmin())
        columns[:, leave] = pattern[used]
        pivot = inverse[leave] / entering[leave]
        inverse -= np.outer(entering, pivot)
        inverse[leave] = pivot
        amount = np.maximum(inverse @ level, 0)
    out = []
    for column, often in zip(columns.T, amount, strict=True):
        pattern = np.zeros(len(histogram), np.int64)
        pattern[used] = np.rint(column)
        out.append((pattern, float(often)))
    return out


def plan(histogram: np.ndarray, capacity: int = 1024, grid: int = 4) -> list[tuple[int, int, int, int, int, int]]:
    """Where the ranked items of each length go; ``histogram[k]`` counts items of length k + 1.

    Rows (length, first rank, items, first sequence, a sequence, first slot):
    of the ranks from ``first rank`` on, ``items`` go to sequences from
    ``first sequence`` on, ``a sequence`` at a time, at offsets
    ``first slot`` + length * place.  Every item is placed exactly once.  The
    linear program sees lengths rounded up to ``grid``, the placing true ones.
    Rows are in proportion to the number of lengths, not of items.
    """
    left, taken = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def place(counts: dict[int, int], times: int) -> None:
        nonlocal sequence
        slot = 0
        for k, n in counts.items():
            rows.append((k + 1, int(taken[k]), n * times, sequence, n, slot))
            taken[k] += n * times
            left[k] -= n * times
            slot += n * (k + 1)
        sequence += times

    def fitting(wanted: list[tuple[int, int]]) -> dict[int, int]:
        """Lengths of each wanted (lowest, highest, how many) that are still there, the most frequent first."""
        counts: dict[int, int] = {}
        for low, high, n in wanted:
            for k in low + np.argsort(-left[low:high], kind="stable"):
                some = min(n, int(left[k]))
                if some:
                    counts[int(k)] = some
                    n -= some
                if not n:
                    break
            if n:
                return {}
        return counts

    coarse = np.add.reduceat(np.pad(left, (0, -len(left) % grid)), np.arange(0, len(left), grid))
    for pattern, often in sorted(patterns(coarse, capacity // grid), key=lambda x: -x[1]):
        times = int(often + 1e-6)
        wanted = [(int(g) * grid, min(int(g) * grid + grid, len(left)), int(pattern[g])) for g in np.flatnonzero(pattern)]
        while times > 0 and (counts := fitting(wanted)):
            n = min(times, *(int(left[k] // c) for k, c in counts.items()))
            place(counts, n)
            times -= n
    # what rounding leaves, a few items for each pattern: fill sequences from the longest item down
    while left.any():
        room, counts = capacity, {}
        while room > 0 and len(fits := np.flatnonzero(left[:room])):
            fits = [k for k in fits[::-1].tolist() if left[k] > counts.get(k, 0)]
            if not fits:
                break
            n = min(int(left[fits[0]]) - counts.get(fits[0], 0), room // (fits[0] + 1))
            counts[fits[0]] = counts.get(fits[0], 0) + n
            room -= n * (fits[0] + 1)
        place(counts, min(int(left[k] // n) for k, n in counts.items()))
    return rows


def assign(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """``parts`` with sequence_id and offset; needs doc_id, copy, start and length columns.

    Full pieces are sequences of their own and come after the packed ones.
    Ranks are dealt over salted windows: a length that a third of all documents
    share does not meet in one task.  Which of rows equal in doc_id, copy and
    start gets which place is open; each gets its own.  ``parts`` should be a
    written table: it is read for the histogram and again for the ranks.
    """
    spark = parts.sparkSession
    short, full = parts.where(F.col("length") < capacity), parts.where(F.col("length") == capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():  # capacity rows at most
        counts[row["length"]] = row["count"]
    histogram = counts[1:capacity]
    rows = plan(histogram, capacity)
    packed = max((r[3] + -(-r[2] // r[4]) for r in rows), default=0)
    schema = "_length long, _first long, _items long, _sequence long, _each long, _slot long"
    places = spark.createDataFrame(rows, schema)
    order = ["doc_id", "copy", "start"]
    ranked = salted_rank(short, ["length"], order, "_rank", salts_for(int(histogram.max(initial=0))))
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_items"))
    nth = F.col("_rank") - F.col("_first")
    # the places are bounded by the number of lengths, about two rows for each
    put = ranked.join(F.broadcast(places), inside).select(
        *parts.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_slot") + F.col("length") * (nth % F.col("_each"))).cast("long").alias("offset"),
    )
    alone = salted_rank(full.withColumn("_all", F.lit(0)), ["_all"], order, "_rank", 32 * salts_for(int(counts[capacity]) // 32))
    alone = alone.select(*parts.columns, (F.col("_rank") + F.lit(packed)).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return put.union(alone)


def padding(length):
    """Ids that a sequence of ``length`` is padded with: up to 1024, none at a power of two (a Column or int)."""
    return F.when(F.bit_count(length) == 1, F.lit(0)).otherwise(F.lit(1024) - length)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, copy_column: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places; ``ids`` (binary) only if ``keep_ids``.

    Rows of equal or null doc_id are packed as documents of their own.  An
    empty table gives an empty result; columns of ``docs`` besides id, text and
    ``copy_column`` are not read.
    """
    cut = pieces(docs, tokenizer_path, capacity, copy_column=copy_column)
    if not keep_ids:
        cut = cut.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return assign(written(cut, "pieces"), capacity)
