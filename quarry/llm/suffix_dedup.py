"""Exact substring dedup by prefix-free parsing, distributed over Spark.

What is compared are strings of ``length`` bytes, wherever they start.  A
rolling hash over ``TRIGGER`` bytes picks triggers that depend on content
alone: every window of ``length`` bytes has one, the leftmost smallest hash
inside it.  So equal windows have equal triggers, and the corpus can be dealt
by trigger; text whose triggers occur once goes no further.

What is dealt are units: the text that the windows of one trigger cover.  The
units of a bucket are put in corpus order by prefix-free parsing
(``prefix_free``): distinct phrases as a dictionary with its suffix array, the
parse of their ranks with its own, both combined.  Neighbours in that order
with ``length`` bytes in common are equal windows; of these the one that starts
first in the corpus stays, the others go.  Bytes decide, not hashes.

The jobs:

1. the rows are written once in parts of about ``PART`` text bytes, packed.
2. the triggers of each part are dealt by hash; a part gets back a bit for
   each of them that some other part has too.
3. each part resolves the windows that repeat within it, and deals units for
   those that other parts may have.
4. units meet by bucket and group of parts, groups of groups and so on: of a
   passage that every part holds, a group sends one unit on.
5. the spans that repeat go back to their part, where they are cut out.

Texts move packed, in parts, and only to their own flags and spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged_spans, text_bytes, written
from .prefix_free import rolling, window_classes

#: Bytes of a trigger that units are dealt by, and the text bytes handled at a time.
TRIGGER = 32
PART = 1 << 20
#: Bits of a hash that triggers are told apart by while they are counted; units are compared by their bytes.
ID_BITS = 48
#: Bytes of units put in order at a time, besides those of one trigger.
SORTED = 1 << 19
#: Parts whose units meet at a time.
GROUP = 1024
#: Parts for each task that resolves their units, so that tasks stay of one size.
TASK_PARTS = 16
LAST = (1 << 63) - 1


class Part:
    """Some documents' bytes, or a section of one; ``base`` is a piece's offset in its document."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int):
        self.row = np.array([p[0] for p in pieces], np.int64)
        self.base = np.array([p[1] for p in pieces], np.int64)
        self.text = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.length = length
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        self.start = np.cumsum(sizes) - sizes
        self._units(sizes)

    def _units(self, sizes: np.ndarray) -> None:
        """trigger, first, last: positions in ``text`` of each unit's trigger, first and last window; piece; id."""
        span, n = self.length - TRIGGER + 1, len(self.text)
        self.trigger = self.first = self.last = self.piece = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.uint64)
        if n < self.length or not (sizes >= self.length).any():
            return
        h = rolling(self.text, TRIGGER)
        bits = np.uint64(24)
        least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        ok = np.zeros(n + 1, np.int8)
        long = sizes >= self.length
        np.add.at(ok, self.start[long], 1)
        np.add.at(ok, self.start[long] + sizes[long] - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(ok[: len(least)], dtype=np.int8))
        trigger = (least[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
        self.trigger, self.first = trigger[new], at[new]
        self.last = at[np.concatenate((new[1:], [len(at)])) - 1]
        # the low bits: triggers are the least in their high ones
        self.id = h[self.trigger] & np.uint64((1 << ID_BITS) - 1)
        self.piece = np.searchsorted(self.start, self.first, "right") - 1


def sections(texts: list[bytes], length: int) -> Iterator[Part]:
    """The texts, whole, in parts of bounded size; a long one in several that overlap."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PART // 2):
            piece = text[at : at + PART // 2 + length - 1]
            if pieces and size + len(piece) > PART:
                yield Part(pieces, length)
                pieces, size = [], 0
            pieces.append((row, at, piece))
            size += len(piece)
    if pieces:
        yield Part(pieces, length)


# ---- rows in parts, and packed arrays


def _write_parts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rng = [], 0, np.random.default_rng()

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(rows)
            return pa.record_batch({"part": pa.array([int(rng.integers(0, 1 << 62))]), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            sizes = pa.compute.binary_length(batch["row"].field(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(np.cumsum(sizes[at:]), PART - size, "right"))
                if not fit and held:
                    yield flush()
                    held, size = [], 0
                    continue
                fit = max(1, fit)
                held.append(batch.slice(at, fit))
                size += int(sizes[at : at + fit].sum())
                at += fit
        if held:
            yield flush()

    return run


def _rows_of(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _sorted_packed(ids: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, which pack well."""
    steps = np.diff(ids, prepend=ids.dtype.type(0)).astype("<u8")
    return _packed(steps.view(np.uint8).reshape(-1, 8).T)


def _sorted_unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def _dealt(ids: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices) of ``ids``, in order of bucket and id."""
    bucket = (ids & np.uint64(buckets - 1)).astype(np.int64)
    order = np.lexsort((ids, bucket))
    ends = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[own[0]]), own) for own in np.split(order, ends) if len(own)]


def _triggers(text: str, length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            found = [part.id for part in sections(text_bytes(_rows_of(row["rows"])["row"].field(text)), length)]
            ids = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            dealt = _dealt(ids, buckets)
            if dealt:
                yield pa.record_batch({"bucket": pa.array([b for b, _ in dealt], pa.int32()), "part": pa.array([row["part"]] * len(dealt)), "ids": pa.array([_sorted_packed(ids[own]) for _, own in dealt], pa.binary())})

    return run


def _by(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """The rows of each key, from batches sorted by key."""
    rows: list[dict] = []
    for row in (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist()):
        if rows and any(row[k] != rows[0][k] for k in keys):
            yield rows
            rows = []
        rows.append(row)
    if rows:
        yield rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part and bucket a bit for each of its triggers: whether another part has it."""
    for rows in _by(batches, "bucket"):
        own = [_sorted_unpacked(r["ids"]) for r in rows]
        if len(own) < 2:
            continue
        ids = np.concatenate(own)
        order = np.argsort(ids)
        same = ids[order[1:]] == ids[order[:-1]]
        flag = np.zeros(len(ids), bool)
        flag[order[1:][same]] = flag[order[:-1][same]] = True
        flags = np.split(flag, np.cumsum([len(x) for x in own])[:-1])
        some = [i for i, f in enumerate(flags) if f.any()]
        if some:
            yield pa.record_batch({"part": pa.array([rows[i]["part"] for i in some]), "bucket": pa.array([rows[i]["bucket"] for i in some], pa.int32()), "bits": pa.array([np.packbits(flags[i]).tobytes() for i in some], pa.binary())})


# ---- units: windows that repeat, and those to be compared with other parts

#: bucket -1: ``meta`` holds spans of one part; else units, ``n`` of them, with ``META`` and their texts.
UNITS = "bucket int, grp long, part long, n int, meta binary, texts binary"
#: Of a unit: its part and row, order of its document (two numbers), where its trigger stands, and how far before it the first and last of its windows start.
META = ("part", "row", "order_key", "text_hash", "origin", "most", "least")


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the tuples of ``keys``, the first of most weight."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of set flags."""
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _later(classes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each window repeats one of a smaller rank; windows of one rank are the same place."""
    order = np.lexsort((rank, classes))
    c = classes[order]
    head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    least = np.repeat(rank[order[head]], np.diff(np.concatenate((head, [len(c)]))))
    out = np.zeros(len(classes), bool)
    out[order] = rank[order] != least
    return out


def resolve(ids: np.ndarray, texts: list[bytes], document: np.ndarray, origin: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of some units repeat one that starts earlier, in another unit or the same document.

    Units of one text have the same windows: the earliest stands for all, the
    others repeat it whole.  Only triggers that have several texts left need
    these in corpus order, as equal windows have equal triggers and no two
    windows of one unit are equal.  Returns (unit, begin, end) of the runs of
    repeated windows, begin and end counted in windows, and for each unit its
    first and last window that does not repeat (none: first > last).
    """
    n = len(texts)
    windows = np.fromiter(map(len, texts), np.int64, n) - length + 1
    distinct: dict[tuple, int] = {}
    of = np.array([distinct.setdefault((t, m), len(distinct)) for t, m in zip(texts, most.tolist(), strict=True)], np.int64)
    place = _ranks(document, origin)
    least = np.full(len(distinct), n, np.int64)
    np.minimum.at(least, of, place)
    lead = place == least[of]
    # the distinct texts, and the place of the earliest unit of each
    one = np.zeros(len(distinct), np.int64)
    one[of[lead]] = np.flatnonzero(lead)
    trigger = np.unique(ids[one], return_inverse=True)[1] if len(one) else one
    some = np.flatnonzero(np.bincount(trigger)[trigger] > 1) if len(one) else one
    some = some[np.argsort(trigger[some], kind="stable")]
    strings = [texts[i] for i in one[some]]
    start = np.concatenate(([0], np.cumsum([len(t) for t in strings], dtype=np.int64)))
    repeated = np.zeros(start[-1] + 1, bool)
    # whole triggers at a time, about SORTED bytes of them
    ends = np.append(np.flatnonzero(np.diff(trigger[some])) + 1, len(some))
    low = 0
    while low < len(some):
        high = int(ends[min(np.searchsorted(ends, max(low + 1, np.searchsorted(start, start[low] + SORTED))), len(ends) - 1)])
        own = start[low : high + 1] - start[low]
        classes = window_classes(np.frombuffer(b"".join(strings[low:high]), np.uint8), own, length)
        at = np.flatnonzero(classes >= 0)
        string = np.searchsorted(own, at, "right") - 1
        who = one[some[low + string]]
        repeated[start[low] + at[_later(classes[at], document[who] << 40 | origin[who] - most[who] + at - own[string])]] = True
        low = high
    # the runs of each string belong to all its leading units, which are one place
    begin, end = _runs(repeated)
    string = np.searchsorted(start, begin, "right") - 1
    first, last = np.zeros(len(distinct), np.int64), windows[one] - 1
    if len(strings):
        inside = np.zeros(len(repeated), bool)
        inside[:-1] = np.arange(start[-1]) - np.repeat(start[:-1], np.diff(start)) < np.repeat(windows[one[some]], np.diff(start))
        open_at = np.flatnonzero(np.append(inside[:-1] & ~repeated[:-1], True))
        first[some] = open_at[np.searchsorted(open_at, start[:-1])] - start[:-1]
        before = np.searchsorted(open_at, start[1:]) - 1
        last[some] = np.where(before >= 0, open_at[before], -1) - start[:-1]
        gone = first[some] >= windows[one[some]]
        first[some], last[some] = np.where(gone, 1, first[some]), np.where(gone, 0, last[some])
    leaders = np.flatnonzero(lead)
    by = leaders[np.argsort(of[leaders], kind="stable")]
    low, high = np.searchsorted(of[by], some[string]), np.searchsorted(of[by], some[string], "right")
    each = np.repeat(np.arange(len(begin)), high - low)
    unit = by[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(each))] if len(each) else np.zeros(0, np.int64)
    whole = np.flatnonzero(~lead)
    runs = np.concatenate((whole, unit)), np.concatenate((np.zeros(len(whole), np.int64), (begin - start[string])[each])), np.concatenate((windows[whole], (end - start[string])[each]))
    return *runs, np.where(lead, first[of], 1), np.where(lead, last[of], 0)


def _span_rows(part: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans as rows of ``UNITS``, packed by part."""
    order = np.argsort(part, kind="stable")
    groups = [g for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(g)]
    k = len(groups)
    return pa.record_batch(
        {
            "bucket": pa.array([-1] * k, pa.int32()),
            "grp": pa.array([0] * k, pa.int64()),
            "part": pa.array([int(part[g[0]]) for g in groups], pa.int64()),
            "n": pa.array([len(g) for g in groups], pa.int32()),
            "meta": pa.array([_packed(row[g], begin[g], end[g]) for g in groups], pa.binary()),
            "texts": pa.array([b""] * k, pa.binary()),
        }
    )


def _unit_rows(meta: dict[str, np.ndarray], texts: list[bytes], ids: np.ndarray, grp: int, buckets: int, part: int) -> pa.RecordBatch:
    dealt = _dealt(ids, buckets)
    return pa.record_batch(
        {
            "bucket": pa.array([b for b, _ in dealt], pa.int32()),
            "grp": pa.array([grp] * len(dealt), pa.int64()),
            "part": pa.array([part] * len(dealt), pa.int64()),
            "n": pa.array([len(own) for _, own in dealt], pa.int32()),
            "meta": pa.array([_packed(ids[own].astype(np.int64), *[meta[c][own] for c in META]) for _, own in dealt], pa.binary()),
            "texts": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts[i] for i in own)) for _, own in dealt], pa.binary()),
        }
    )


def _compared(ids: np.ndarray, texts: list[bytes], meta: dict[str, np.ndarray], document: np.ndarray, length: int) -> tuple[pa.RecordBatch, np.ndarray, list[bytes], dict[str, np.ndarray]]:
    """Spans of the windows that repeat, and the units that still have one that does not, cut to these."""
    unit, begin, end, first, last = resolve(ids, texts, document, meta["origin"], meta["most"], length)
    at = meta["origin"][unit] - meta["most"][unit]
    spans = _span_rows(meta["part"][unit], meta["row"][unit], at + begin, at + end - 1 + length)
    stay = np.flatnonzero(first <= last)
    left = {c: v[stay] for c, v in meta.items()}
    left["least"], left["most"] = left["most"] - last[stay], left["most"] - first[stay]
    return spans, stay, [texts[i][a : b + length] for i, a, b in zip(stay.tolist(), first[stay].tolist(), last[stay].tolist(), strict=True)], left


def _units(text: str, length: int, buckets: int):
    """Spans that repeat within a part, and units to resolve with other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            rows = _rows_of(row["rows"])
            order_key, text_hash = (rows[c].to_numpy(zero_copy_only=False) for c in ("order_key", "text_hash"))
            document = _ranks(order_key, text_hash)
            ids, texts, metas = [], [], []
            # which triggers another part has; those that this one has twice are compared here
            flagged = {b["bucket"]: b["bits"] for b in row["flags"] or []}
            found = list(sections(text_bytes(rows["row"].field(text)), length))
            own, times = np.unique(np.concatenate([p.id for p in found]), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            across = np.zeros(len(own), bool)
            for bucket, at in _dealt(own, buckets):
                if bucket in flagged:
                    across[at] = np.unpackbits(np.frombuffer(flagged[bucket], np.uint8), count=len(at)).astype(bool)
            for part in found:
                of = np.searchsorted(own, part.id)
                pick = np.flatnonzero(across[of] | (times[of] > 1))
                if not len(pick):
                    continue
                at, blob = part.row[part.piece[pick]], part.text.tobytes()
                shift = part.base[part.piece[pick]] - part.start[part.piece[pick]]
                trigger, first, last = part.trigger[pick], part.first[pick], part.last[pick]
                ids.append(part.id[pick])
                metas.append(np.stack((np.full(len(pick), row["part"]), at, order_key[at], text_hash[at], trigger + shift, trigger - first, trigger - last)))
                texts += [blob[b:e] for b, e in zip(first.tolist(), (last + length).tolist(), strict=True)]
            if not texts:
                continue
            ids, meta = np.concatenate(ids), dict(zip(META, np.concatenate(metas, axis=1), strict=True))
            spans, stay, texts, meta = _compared(ids, texts, meta, document[meta["row"]], length)
            yield spans
            out = np.flatnonzero(across[np.searchsorted(own, ids[stay])])
            if len(out):
                yield _unit_rows({c: v[out] for c, v in meta.items()}, [texts[i] for i in out], ids[stay][out], 0, buckets, row["part"])

    return run


def _resolved(length: int, buckets: int, onward: bool):
    """Spans, those that came and those that repeat among the units of a bucket and group; with ``onward`` also the units left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans_apart() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = pa.compute.less(batch["bucket"], 0)
                passed.append(batch.filter(spans))
                yield batch.filter(pa.compute.invert(spans))

        passed: list[pa.RecordBatch] = []
        for rows in _by(spans_apart(), "bucket", "grp"):
            metas, texts = [], []
            for r in rows:
                metas.append(np.frombuffer(_unpacked(r["meta"]), np.int64).reshape(len(META) + 1, r["n"]))
                blob, at = _unpacked(r["texts"]), 0
                for size in (metas[-1][6] - metas[-1][7] + length).tolist():
                    texts.append(blob[at : at + size])
                    at += size
            table = np.concatenate(metas, axis=1)
            ids, meta = table[0].view(np.uint64), dict(zip(META, table[1:], strict=True))
            spans, stay, texts, meta = _compared(ids, texts, meta, _ranks(meta["order_key"], meta["text_hash"]), length)
            yield spans
            if onward and len(stay):
                yield _unit_rows(meta, texts, ids[stay], rows[0]["grp"], buckets, 0)
            yield from passed
            passed.clear()
        yield from passed

    return run


# ---- the operator


def parts_of(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(part, rows): the rows of ``docs`` packed, about ``PART`` text bytes at a time, with the keys that order documents."""
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keys = [F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("order_key"), text_hash.alias("text_hash")]
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *keys)
    return written(rows.mapInArrow(_write_parts(text), "part long, rows binary"), "parts")


def repeated_spans(parts: DataFrame, length: int, text: str) -> DataFrame:
    """(part, spans array<binary>): packed (row, begin, end) of the spans to remove; they may overlap."""
    n = parts.count()
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_PARTS)
    buckets = 1 << (max(16, min(n // 2, GROUP), n // GROUP) - 1).bit_length()
    met = parts.mapInArrow(_triggers(text, length, buckets), "bucket int, part long, ids binary")
    flags = met.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "part long, bucket int, bits binary")
    flags = flags.groupBy("part").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    found = parts.join(flags, "part", "left").mapInArrow(_units(text, length, buckets), UNITS)
    groups, group = -(-n // GROUP), F.xxhash64("part")
    while True:
        # spans of a part pass through, spread over all tasks
        dealt = found.withColumn("grp", F.when(F.col("bucket") < 0, F.col("part")).otherwise(F.pmod(group, F.lit(max(1, groups)))))
        dealt = dealt.repartition(tasks, "bucket", "grp").sortWithinPartitions("bucket", "grp")
        found = dealt.mapInArrow(_resolved(length, buckets, groups > 1), UNITS)
        if groups <= 1:
            return found.groupBy("part").agg(F.collect_list("meta").alias("spans"))
        groups, group = -(-groups // GROUP), F.col("grp")


def cut(text: bytes, begin: np.ndarray, end: np.ndarray, whole_characters: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text without the given spans, and its maximal removed runs.

    With ``whole_characters`` a run gives back the bytes of UTF-8 characters
    that it covers in part, so that the rest is valid text.
    """
    begin, end = merged_spans(np.asarray(begin, np.int64), np.asarray(end, np.int64))
    runs, left, at = [], [], 0
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        if whole_characters:
            while b < e and text[b] & 0xC0 == 0x80:
                b += 1
            while e > b and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
        if b < e:
            runs.append((b, e))
            left.append(text[at:b])
            at = e
    left.append(text[at:])
    return b"".join(left), runs


def dedup(docs: DataFrame, length: int = 100, text: str = "text", id_column: str = "doc_id", whole_characters: bool = False) -> DataFrame:
    """``docs`` with kept (binary) and removed (array<struct<begin, end>>, byte offsets of maximal runs).

    Every byte covered by a ``length``-byte string that also starts earlier -
    in a document of smaller id, or at a smaller offset of the same one - is
    removed; strings are judged on the input and never cross documents.  Null
    texts count as empty.  Rows without an id come after all others, by a hash
    of their text; rows that share an id are ordered by that hash too, and rows
    equal in id and text count as one document (each gets its result).  All
    columns of ``docs`` are kept, except that kept and removed replace columns
    of those names.  ``length`` is at least the ``TRIGGER`` bytes.
    """
    if length < TRIGGER:
        raise ValueError(f"strings of under {TRIGGER} bytes have no trigger")
    rows = docs.select(*[c for c in docs.columns if c not in ("kept", "removed")])
    parts = parts_of(rows, text, id_column)
    joined = parts.join(repeated_spans(parts, length, text), "part", "left").select("rows", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for found in _each(batches):
            batch = _rows_of(found["rows"])
            spans = [np.frombuffer(_unpacked(s), np.int64).reshape(3, -1) for s in found["spans"] or []]
            row, begin, end = np.concatenate(spans, axis=1) if spans else np.zeros((3, 0), np.int64)
            order = np.argsort(row, kind="stable")
            at = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            cuts = [cut(t, begin[order[at[i] : at[i + 1]]], end[order[at[i] : at[i + 1]]], whole_characters) for i, t in enumerate(text_bytes(batch["row"].field(text)))]
            removed = [[{"begin": b, "end": e} for b, e in runs] for _, runs in cuts]
            yield pa.record_batch({"row": batch["row"], "kept": pa.array([k for k, _ in cuts], pa.binary()), "removed": pa.array(removed, kind)})

    out = joined.mapInArrow(run, f"row {rows.schema.simpleString()}, kept binary, removed array<struct<begin: long, end: long>>")
    return out.select("row.*", "kept", "removed")

