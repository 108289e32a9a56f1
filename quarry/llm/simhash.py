"""SimHash near-dedup by anchor-point covering.

The anchors are pairs of codewords of the perfect binary Golay code (23 bits,
4096 words, covering radius 3) over two 23-bit blocks of a fingerprint.  Every
fingerprint has one home: the anchor within the covering radius in each block.
It is replicated to every anchor within covering radius plus threshold, where
the threshold is shared by the two blocks: two fingerprints that differ in i
and j bits of the blocks, i + j <= t, meet at each other's homes, which lie
within 3 + i and 3 + j.  Fingerprints are compared, on all 64 bits, only where
one is at home and the other a replica.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from itertools import combinations, islice
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, text_bytes, written
from .components import connected_components, thinned

BLOCK = 23
RADIUS = 3
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101
#: Shingles hashed at a time, so that a very long text needs no more memory.
SHINGLE_BLOCK = 1 << 18
LAST = (1 << 63) - 1

xxh = partial(xxhash.xxh64_intdigest, seed=42)


def majority(parts: list[np.ndarray]) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half of the hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes, words: int):
    """XXH64 (seed 42) of the word shingles of a text, in blocks of bounded size."""
    tokens = text.lower().split()
    if not tokens:
        return
    if len(tokens) <= words:
        yield np.array([xxh(b" ".join(tokens))], np.uint64)
        return
    shingles = map(xxh, map(b" ".join, zip(*(islice(tokens, k, None) for k in range(words)), strict=False)))
    left = len(tokens) - words + 1
    while left > 0:
        yield np.fromiter(shingles, np.uint64, n := min(left, SHINGLE_BLOCK))
        left -= n


def simhash(text: bytes, words: int) -> int:
    return majority(list(shingle_hashes(text, words)))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long) for every row; null or wordless texts get fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [simhash(x, words) for x in text_bytes(batch["_text"])]
        return pa.record_batch({"doc_id": batch["_id"], "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    return map_batches(rows, run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    """The syndrome of each of the 23 unit vectors."""
    units = []
    for k in range(BLOCK):
        x = 1 << k
        for shift in range(BLOCK - 12, -1, -1):
            if x >> (shift + 11) & 1:
                x ^= GOLAY << shift
        units.append(x)
    return np.array(units, np.int64)


@lru_cache(maxsize=4)
def _offsets(slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start by syndrome, error patterns, extra weight over the radius) of weight up to RADIUS + slack.

    A word plus an error pattern of its own syndrome is a codeword; patterns
    are ordered by syndrome.  Weights under the radius count as the radius.
    """
    units, patterns, weights, syndromes = _syndromes(), [], [], []
    for weight in range(RADIUS + slack + 1):
        chosen = list(combinations(range(BLOCK), weight))
        at = np.array(chosen, np.int64).reshape(len(chosen), weight)
        patterns.append((np.int64(1) << at).sum(axis=1).astype(np.int64))
        syndromes.append(np.bitwise_xor.reduce(units[at], axis=1))
        weights.append(np.full(len(at), max(0, weight - RADIUS), np.int64))
    syndrome, pattern, extra = map(np.concatenate, (syndromes, patterns, weights))
    order = np.lexsort((pattern, extra, syndrome))
    return np.searchsorted(syndrome[order], np.arange(2049)), pattern[order], extra[order]


@lru_cache(maxsize=1)
def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word."""
    units = _syndromes()

    def spread(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for u in part:
            out = np.concatenate((out, out ^ u))
        return out

    return spread(units[:12]), spread(units[12:])


def _near_codewords(block: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword, extra weight) of all codewords within RADIUS + slack of each 23-bit word."""
    low, high = _syndrome_tables()
    start, pattern, extra = _offsets(slack)
    s = low[block & 0xFFF] ^ high[block >> 12]
    count = start[s + 1] - start[s]
    row = np.repeat(np.arange(len(block)), count)
    at = np.repeat(start[s] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(row))
    return row, block[row] ^ pattern[at], extra[at]


def anchors(fps: np.ndarray, threshold: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus threshold; threshold 0: homes alone."""
    bits = fps.view(np.uint64) >> np.uint64(shift)
    mask = np.uint64((1 << BLOCK) - 1)
    first, second = (bits & mask).astype(np.int64), (bits >> np.uint64(BLOCK) & mask).astype(np.int64)
    row_a, word_a, extra_a = _near_codewords(first, threshold)
    row_b, word_b, extra_b = _near_codewords(second, threshold)
    count_b = np.bincount(row_b, minlength=len(fps))
    start_b = np.concatenate(([0], np.cumsum(count_b)[:-1]))
    count = count_b[row_a]
    left = np.repeat(np.arange(len(row_a)), count)
    right = np.repeat(start_b[row_a] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(left))
    fits = extra_a[left] + extra_b[right] <= threshold
    left, right = left[fits], right[fits]
    return row_a[left], word_a[left] << BLOCK | word_b[right]


def _placed(threshold: int, block_rows: int = 4096) -> Callable:
    def run(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), block_rows):
                part = fps[at : at + block_rows]
                row, anchor = anchors(part, threshold)
                yield pa.record_batch({"anchor": pa.array(anchor), "fp": pa.array(part[row])})

    return run


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(u, v): every pair of different fingerprints of ``fps`` (distinct, column fp) within ``threshold`` bits, once.

    A fingerprint has at most sum(C(64, k), k <= threshold) partners, so the
    result stays in proportion to the input whatever the texts are.
    """
    home = fps.select("fp").mapInArrow(_placed(0), "anchor long, fp long").select("anchor", F.col("fp").alias("u"))
    replica = fps.select("fp").mapInArrow(_placed(threshold), "anchor long, fp long").select("anchor", F.col("fp").alias("v"))
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    return replica.join(home.hint("shuffle_hash"), "anchor").where(close).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``threshold`` differing bits, the row's own included.  Equal fingerprints
    count as linked, the fingerprint 0 of wordless texts among them.  Rows with
    a null id are kept and never name a component (null only where all ids of
    it are null); repeated rows give repeated results; other columns of
    ``docs`` are not read.
    """
    rows = written(fingerprints(docs, words, text, id_column), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(thinned(links(groups, threshold)))
    joined = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


# ---- near copies by similarity: fingerprints join groups early, prefixes of the shingle sets propose every other pair

#: Fingerprints (of words, by different seeds) that propose pairs, and their threshold on the anchor bits.
TABLES, SLACK = 2, 2
#: Bits, of 64, in which fingerprints of similar texts seldom differ: pairs that do are left to the prefixes.
NEAR = 10
#: Share of all shingles (those of the smallest hashes) that are counted and come first, the rarest before the others: cost depends on it, results do not.
COUNTED = 0.4
#: Bits of a text's signature.
SIGNATURE = 512
#: Bounds of the bits that mark the texts that are wanted.
MARK_BITS = (1 << 16, 1 << 26)


def least_common(size: int, similarity: float) -> int:
    """Shingles that a set of ``size`` has at least in common with any that is similar enough."""
    return math.ceil(similarity * size - 1e-9)


def prefix(shingles: np.ndarray, similarity: float, last: np.ndarray) -> np.ndarray:
    """The first of a sorted set of shingles, in one order for all texts, so many that two similar sets share one.

    A similar set leaves out fewer than the prefix holds.  The shingles in
    ``last`` (sorted) come after all others, else the order is by hash.
    """
    n = len(shingles)
    late = np.zeros(n, bool)
    if n and len(last):
        late = last[np.minimum(np.searchsorted(last, shingles), len(last) - 1)] == shingles
    return np.concatenate((shingles[~late], shingles[late]))[: n - least_common(n, similarity) + 1 if n else 0]


def _shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.concatenate(list(shingle_hashes(text, words)) or [np.zeros(0, np.uint64)]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bit for each remainder of hashes, 1 if an odd number of the set have it.

    A shingle that only one of two sets holds changes one bit, so signatures
    differ in no more bits than the sets do in shingles.
    """
    odd = np.bincount((shingles & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch(words: int, similarity: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Word fingerprints of each text, its numbers of distinct and of counted shingles, their signature and those that its prefix may hold, by hash."""
    end, none = np.uint64(int(COUNTED * (1 << 64))), np.zeros(0, np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, sizes, counted, signs, keys = [], [], [], [], []
        for text in text_bytes(batch["text"]):
            own = list(dict.fromkeys(text.lower().split()))
            rows = []
            for seed in range(TABLES):
                parts = [np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), own[at : at + SHINGLE_BLOCK]), np.uint64) for at in range(0, len(own), SHINGLE_BLOCK)]
                rows.append(np.int64(np.uint64(majority(parts))) if parts else np.int64(0))
            out.append([int(x) for x in rows])
            shingles = _shingle_set(text, words)
            sizes.append(len(shingles))
            counted.append(int(np.searchsorted(shingles, end)))
            signs.append(signature(shingles))
            keys.append(max(shingles[: counted[-1]], prefix(shingles, similarity, none), key=len).view(np.int64))
        columns = {"size": pa.array(sizes, pa.int32()), "counted": pa.array(counted, pa.int32()), "sign": pa.array(signs, pa.list_(pa.int64())), "keys": pa.array(keys, pa.list_(pa.int64()))}
        return pa.record_batch({"node": batch["node"], "fps": pa.array(out, pa.list_(pa.int64())), **columns})

    return run


def prefixes(sketches: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size, pos): the shingles of each text's prefix that other texts hold too, with their places in its order.

    The order is one for all texts: counted shingles by the number of texts
    that hold them, then all others; by hash within these.  The counted ones
    that a text alone holds come first and make no row, so most prefixes are
    full before they reach a shingle that is shared by chance.
    """
    keyed = sketches.select("node", F.posexplode("keys").alias("pos", "key"))
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    rows = shared.join(sketches.select("node", "size", "counted"), "node").withColumn("late", F.col("pos") >= F.col("counted"))
    own = Window.partitionBy("node")
    nth = F.row_number().over(own.orderBy("late", F.when(~F.col("late"), F.col("n")), "pos"))
    alone = F.col("counted") - F.count(F.when(~F.col("late"), 1)).over(own)
    placed = rows.withColumn("pos", F.when(F.col("late"), F.col("pos")).otherwise(alone + nth - 1).cast("int"))
    return placed.where(F.col("pos") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9)).select("key", "node", "size", "pos")


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bit for each remainder of the nodes (distinct), packed: texts without theirs are none of them."""
    bits = min(MARK_BITS[1], max(MARK_BITS[0], 1 << (16 * nodes.count()).bit_length()))

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(MARK_BITS[0], np.uint8)
        part[own["bit"].to_numpy() % MARK_BITS[0]] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(part).tobytes()]})

    bit = F.pmod("node", F.lit(bits)).alias("bit")
    found = nodes.select(bit).withColumn("chunk", F.floor(F.col("bit") / MARK_BITS[0])).groupBy("chunk").applyInPandas(pack, "chunk long, bits binary")
    out = np.zeros((bits // MARK_BITS[0], MARK_BITS[0] // 8), np.uint8)
    for row in found.collect():  # 8 KB each, 1,024 at most; one job, not one for each partition
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _marked_texts(marks) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The words of the texts whose node is marked, packed: a third of the size of their shingles' hashes or less."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit = batch["node"].to_numpy() % (8 * len(marks.value))
        batch = batch.filter(pa.array(marks.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 == 1))
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.record_batch({"node": batch["node"], "packed": pa.array([pack(b" ".join(t.lower().split())) for t in text_bytes(batch["text"])], pa.binary())})

    return run


def _similar(words: int, at_least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Those of the pairs (u, v, a, b) whose texts are similar enough; the texts of the last few u are kept at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), {}

        def shingles(packed: bytes) -> np.ndarray:
            return _shingle_set(unpack.decompress(packed), words)

        for batch in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            keep = []
            for u, a, b in zip(batch["u"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                if u not in held:
                    while len(held) >= 8:
                        del held[next(iter(held))]
                    held[u] = shingles(a)
                x, y = held[u], shingles(b)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= at_least * max(len(x), len(y)) else 0
                keep.append(bool(both) and both >= at_least * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch({"u": batch["u"].filter(mask), "v": batch["v"].filter(mask)})

    return run


def _table_anchors(batches):
    """(place, node, fp) for all anchors of all tables within covering radius plus half the threshold.

    Of two fingerprints within the threshold, one half-way between them has its
    home within the radius; so both reach that anchor.  A place is an anchor
    with the number of its table above its bits.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            fps = part["fps"].flatten().to_numpy(zero_copy_only=False).reshape(-1, TABLES)
            for t in range(TABLES):
                own = np.ascontiguousarray(fps[:, t])
                row, anchor = anchors(own, SLACK // 2)
                yield pa.record_batch({"place": pa.array(anchor | t << 2 * BLOCK), "node": part["node"].take(pa.array(row)), "fp": pa.array(own[row])})


def possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) that may be similar enough by numbers.

    ``pairs`` has a row for each shingle that their prefixes share, with the
    sizes su, sv of both sets and its places pu, pv in their order.  Sizes and
    places rule most chance pairs out before any row of theirs is counted.
    """
    least, most = F.least("su", "sv"), F.greatest("su", "sv")
    enough = (F.col("su") + F.col("sv")) * (similarity / (1 + similarity)) - 1e-6
    # up to a shared shingle and behind it, the sets have no more in common than the lesser of both parts
    around = F.least("pu", "pv") + F.least(F.col("su") - F.col("pu"), F.col("sv") - F.col("pv"))
    counted = pairs.where((least >= most * similarity - 1e-9) & (around >= enough)).groupBy("u", "v", "su", "sv").agg(F.count(F.lit(1)).alias("n"))
    # what the prefixes of both do not share lies behind the end of one of them
    return counted.where(F.col("n") + F.ceil(most * similarity - 1e-9) - 1 >= enough).select("u", "v")


def similar_texts(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root): texts, by node (long), that share a chain of links of at least ``similarity``.

    ``texts`` has node and text; rows of one node hold one text.  Links are all
    pairs whose Jaccard similarity over distinct shingles is high enough; a
    pair is compared unless a chain of links joins it already.

    1. fingerprints: at each anchor the smallest node is compared to all others
       whose fingerprint is near, so a group of copies costs in proportion to
       its size.
    2. prefixes of the shingle sets, of which similar sets share a part: at
       each shingle the smallest node is compared to those of other classes.
    3. every pair of different classes that shares enough of its prefixes and
       whose signatures differ in few enough bits: no link between classes is
       missed.

    Texts are dealt packed, and only those that are compared.
    """
    spark = texts.sparkSession
    sketched = map_batches(texts.select("node", "text"), _sketch(words, similarity), "node long, fps array<long>, size int, counted int, sign array<long>, keys array<long>")
    sketches = written(sketched.groupBy("node").agg(F.min(F.struct("fps", "size", "counted", "sign", "keys")).alias("s")).select("node", "s.*"), "sketches")

    def verified(proposed: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that are similar enough, as a written table."""
        pairs = written(proposed.select("u", "v").distinct(), "pairs")
        nodes = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
        marks = spark.sparkContext.broadcast(_marks(nodes))
        held = map_batches(texts.select("node", "text"), _marked_texts(marks), "node long, packed binary")
        held = held.groupBy("node").agg(F.min("packed").alias("packed"))
        side = lambda node, name: held.select(F.col("node").alias(node), F.col("packed").alias(name))
        both = pairs.join(side("v", "b"), "v").join(side("u", "a"), "u").select("u", "v", "a", "b")
        found = written(both.mapInArrow(_similar(words, similarity), "u long, v long"), "links")
        discard(pairs, nodes)
        marks.destroy()
        return found

    places = sketches.select("node", "fps").mapInArrow(_table_anchors, "place long, node long, fp long")
    centres = places.groupBy("place").agg(F.min(F.struct("node", "fp")).alias("c"), F.max("node").alias("most")).where("c.node < most").select("place", "c")
    near = F.bit_count(F.col("c.fp").bitwiseXOR(F.col("fp"))) <= NEAR
    first = verified(places.join(centres, "place").where((F.col("node") > F.col("c.node")) & near).select(F.col("c.node").alias("u"), F.col("node").alias("v")))
    roots = written(connected_components(first), "roots")

    held = written(prefixes(sketches, similarity), "prefixes")

    def open_keys(roots: DataFrame) -> DataFrame:
        """(key, node, size, pos, root) of the keys whose texts are of several classes; the others have nothing left to compare."""
        rooted = held.join(roots, "node", "left").select("key", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("node", "root", "size", "pos")).alias("c")).where("low <> high").select("key", "c")
        return written(rooted.join(several, "key"), "open")

    met = open_keys(roots)
    star = met.where(F.col("root") != F.col("c.root")).select(F.col("c.node").alias("u"), F.col("node").alias("v"), F.col("c.size").alias("su"), F.col("size").alias("sv"), F.col("c.pos").alias("pu"), F.col("pos").alias("pv"))
    second = verified(possible(star, similarity))
    discard(met, roots)
    joined = first.union(second)
    met = open_keys(written(connected_components(joined), "roots"))
    parts = [f"x{k}" for k in range(SIGNATURE // 64)]
    signs = sketches.select("node", *(F.col("sign")[k].alias(x) for k, x in enumerate(parts)))
    signed = written(met.drop("c").join(signs, "node"), "open")
    end = lambda x: signed.select("key", F.col("node").alias(x), *(F.col(c).alias(c + x) for c in parts), *(F.col(c).alias(c[0] + x) for c in ("root", "size", "pos")))
    # of two similar sets few enough shingles are in one alone
    apart = reduce(add, (F.bit_count(F.col(x + "u").bitwiseXOR(F.col(x + "v"))) for x in parts))
    near = apart <= (F.col("su") + F.col("sv")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    rest = end("u").join(end("v"), "key").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & near)
    third = verified(possible(rest, similarity))
    discard(met, signed, held, sketches)
    return connected_components(joined.union(third))


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near copies does: that of the smallest id.

    Groups are chained by equal texts and by the links of ``similar_texts``.
    Null texts count as empty, and texts without words are copies of one
    another.  A row without an id stays only if its group has no other; of rows
    equal in id and text one stays.  All columns of ``docs`` are kept.

    A text's node is a hash of it.  Texts that differ but share one, as a
    second hash shows, keep the links of one of them; the others stay.
    """
    number = F.col(id_column).cast("long")
    own = F.when(F.length(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))) > 0, F.col(text)).otherwise("")
    node, check = F.xxhash64(own), F.xxhash64(F.lit(1), F.reverse(own))
    groups = docs.select(number.alias("_id"), node.alias("_node"), check.alias("_check")).groupBy("_node", "_check")
    groups = written(groups.agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("least")), "texts")
    found = similar_texts(docs.select(node.alias("node"), F.col(text).alias("text")), words, similarity)
    named = groups.withColumn("_main", F.min("_check").over(Window.partitionBy("_node")))
    classed = named.join(found, F.col("_node") == F.col("node"), "left").select("_node", "_check", "least", F.when(F.col("_check") == F.col("_main"), F.coalesce("root", "_node")).alias("root"), F.when(F.col("_check") != F.col("_main"), F.col("_check")).alias("apart"))
    stays = classed.groupBy("root", "apart", F.when(F.col("apart").isNotNull(), F.col("_node")).alias("_n")).agg(F.min(F.struct("least", "_node", "_check")).alias("s"))
    stays = stays.select(F.col("s._node").alias("_node"), F.col("s._check").alias("_check"), F.coalesce("s.least.id", F.lit(LAST)).alias("_key"), F.col("s.least.none").alias("_none"))
    rows = docs.withColumns({"_node": node, "_check": check, "_key": F.coalesce(number, F.lit(LAST)), "_none": number.isNull()})
    kept = rows.join(stays, ["_node", "_check", "_key", "_none"])
    order = [F.col(c) for c in docs.columns if dict(docs.dtypes)[c] in ("string", "bigint", "int")]
    first = Window.partitionBy("_node", "_check", "_key", "_none").orderBy(*order)
    return kept.withColumn("_row", F.row_number().over(first)).where("_row = 1").select(*docs.columns)
