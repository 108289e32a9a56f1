"""Hybrid search: BM25 and exact cosine in blocks, reciprocal-rank fusion, rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import portuguese
from quarry.functions.text import tokens
from quarry.operators.ordered import top_k

#: Candidates of a leg, of a fusion, final passages, and BM25 constants.
LEG, FUSED, FINAL = 150, 50, 8
K1, B, AVERAGE = 1.2, 0.75, 256.0
BLOCK = 4096
#: Of a pair of blocks: terms of documents, terms of queries; documents and queries of a product, pairs that are added up at a time.
CELL, ASKED, DOCUMENTS, QUERIES, HITS = 8_000_000, 4_000_000, 4096, 1024, 1 << 18
#: A term is a dense row if more than one in so many pairs has it.  Words of texts that are looked up at a time.
DENSE, WORDS = 128, 4_000_000
#: Words that are folded at a time, and kept with what they are folded to by a task.
FOLDED, KNOWN = 500_000, 500_000
#: Terms that are sent to all tasks, as one array of texts; more are met in a shuffle of the words.
SENT_TERMS = 8_000_000
#: Vectors of a block, which is compared ``BLOCK`` at a time.
VECTORS = 1 << 15


#: Rows of a table that is sent to all tasks; a larger one is shuffled.
SENT_ROWS = 500_000


def sent(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small; else as it is."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


@dataclass(frozen=True)
class Analysis:
    """How texts become terms: the words that count, and what each of them is reduced to (nothing: itself), as a column and for one word."""

    name: str
    words: Callable[[Column], Column]
    fold: Callable[[Column], Column] | None = None
    plain: Callable[[str], str] | None = None


LETTERS = Analysis("letters", tokens)
PORTUGUESE = Analysis("portuguese", portuguese.kept_words, portuguese.stem, portuguese.stem_word)


def asked_terms(queries: DataFrame, analysis: Analysis = LETTERS, *columns: str) -> DataFrame:
    """(query_id, columns..., term): the distinct terms of each query."""
    listed = queries.select("query_id", *columns, F.explode(F.array_distinct(analysis.words(F.col("text")))).alias("term"))
    return listed if analysis.fold is None else listed.withColumn("term", analysis.fold(F.col("term"))).distinct()


def postings(docs: DataFrame, text: str = "text", id_column: str = "doc_id", analysis: Analysis = LETTERS, terms: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf, length, more...): a row for each distinct term of a document; of ``terms`` alone, if given.

    Terms that no query has are left out before anything is grouped; ``length``
    counts all words.  An analysis that folds a word by itself does so where the
    texts are read, each distinct word once for many texts, and no row of a
    posting is shuffled; should a document come in several rows, these are put
    together.  Another one folds each distinct word of all texts once, and the
    texts' words are looked up.
    """
    if analysis.plain is not None:
        keys = ["id", *more]
        words = docs.select(F.col(id_column).alias("id"), *more, analysis.words(F.col(text)).alias("words")).select(*keys, F.size("words").cast("long").alias("length"), "words")
        kinds = {f.name: f.dataType.simpleString() for f in words.schema}
        found = words.mapInArrow(_folded(keys, analysis.plain), ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "term string, tf long, length long"]))
        if terms is not None:
            found = found.join(sent(terms.select("term").distinct()), "term", "left_semi").select(*keys, "term", "tf", "length")
        if words.select(*keys).count() == words.select(*keys).distinct().count():
            return found
        return found.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    listed = docs.select(F.col(id_column).alias("id"), *more, analysis.words(F.col(text)).alias("_w")).select("id", *more, F.size("_w").alias("length"), F.explode("_w").alias("term"))
    wanted = sent(terms.select("term").distinct()) if terms is not None else None
    if analysis.fold is not None:
        folded = _written(listed.select(F.col("term").alias("_word")).distinct().withColumn("_folded", analysis.fold(F.col("_word"))))
        if wanted is not None:
            folded = folded.join(wanted.withColumnRenamed("term", "_folded"), "_folded", "left_semi")
        listed = listed.join(sent(folded), F.col("term") == F.col("_word")).select("id", *more, "length", F.col("_folded").alias("term"))
    elif wanted is not None:
        listed = listed.join(wanted, "term", "left_semi")
    return listed.groupBy("id", *more, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").cast("long").alias("length"))


def idf(posts: DataFrame, documents: int | Column) -> DataFrame:
    """(term, df, idf) over the whole collection."""
    n = F.lit(documents) if isinstance(documents, int) else documents
    # all columns are named, so that this reads the rows of the postings that their weights read, and they are made once
    return posts.groupBy("term").agg(F.count(F.when((F.col("tf") > 0) & (F.col("length") > 0), 1)).alias("df")).withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def weighed(posts: DataFrame, documents: int, asked: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE) -> DataFrame:
    """(term, id, w): the weight of each posting of the terms that are asked for."""
    rare = idf(posts, documents).join(asked.select("term").distinct(), "term", "left_semi")
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    return posts.join(rare, "term").select("term", "id", w.alias("w"))


def bm25(queries: DataFrame, posts: DataFrame | Packed, documents: int, k: int = LEG, k1: float = K1, b: float = B, average: float = AVERAGE, allowed: Column | None = None, analysis: Analysis = LETTERS) -> DataFrame:
    """(query_id, id, score, rank): the k best documents for each of ``queries`` (query_id, text).

    Each distinct query term counts once.  Weights come from the whole
    collection; ``allowed`` (on query_id and id) filters before the ranking.
    ``posts`` may be those of the queries' terms alone, and packed.
    """
    asked = asked_terms(queries, analysis)
    if allowed is None:
        return best_of_blocks(asked, posts if isinstance(posts, Packed) else packed_postings(posts, asked), documents, k, k1, b, average)
    if isinstance(posts, Packed):
        raise ValueError("a condition on pairs needs postings as rows")
    weights = weighed(posts, documents, asked, k1, b, average)
    hits = weights.join(sent(asked), "term").where(allowed)
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


@dataclass(frozen=True)
class Packed:
    """A row for each document with a term that is asked for: (id, more..., length, nos, tfs), and the numbers of the terms: (term, no)."""

    rows: DataFrame
    terms: DataFrame


def numbered_terms(asked: DataFrame) -> DataFrame:
    """(term, no): the distinct terms of ``asked``, numbered from 1."""
    from quarry.operators.ordered import numbered

    return numbered(asked.select("term").distinct(), ["term"], "no")


def _slices(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with about so many words, and the row in which each word is."""
    sizes = batch["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(words, upto[-1] if len(upto) else 0, words)) + 1, [batch.num_rows])))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(low, high - low), np.repeat(np.arange(high - low), sizes[low:high])


def _folded(keys: list[str], fold: Callable[[str], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys..., length, words) to (keys..., term, tf, length), a row for each term of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for part, row in _slices(batch, FOLDED):
                words = part["words"].flatten().dictionary_encode()
                if len(known) > KNOWN:
                    known.clear()
                stems = [known[w] if w in known else known.setdefault(w, fold(w)) for w in words.dictionary.to_pylist()]
                terms = pa.array(stems, pa.string()).dictionary_encode()
                no = terms.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64)
                pairs, counts = np.unique(row << 32 | no, return_counts=True)
                own = pa.array(pairs >> 32)
                heads = {c: part[c].take(own) for c in [*keys, "length"]}
                out = {**{c: heads[c] for c in keys}, "term": terms.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), "tf": pa.array(counts.astype(np.int64)), "length": heads["length"]}
                if len(pairs):
                    yield pa.record_batch(out)

    return run


def _counted(shared, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys..., length, words) to (keys..., length, nos, tfs): the terms in ``shared`` that a text has, by number, and how often."""

    def pack(part: pa.RecordBatch, row: np.ndarray) -> pa.RecordBatch:
        no = pc.index_in(part["words"].flatten(), value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        there = no >= 0
        pairs, counts = np.unique(row[there] << 32 | no[there] + 1, return_counts=True)
        row, no = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)
        own = np.unique(row)
        offsets = pa.array(np.append(np.searchsorted(row, own), len(row)).astype(np.int32))
        heads = {c: part[c].take(pa.array(own)) for c in [*keys, "length"]}
        return pa.record_batch({**heads, "nos": pa.ListArray.from_arrays(offsets, pa.array(no)), "tfs": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row in _slices(batch, WORDS):
                out = pack(part, row)
                if out.num_rows:
                    yield out

    return run


def packed(docs: DataFrame, asked: DataFrame, text: str = "text", id_column: str = "doc_id", analysis: Analysis = LETTERS, more: tuple[str, ...] = ()) -> Packed:
    """The documents' terms that are in ``asked``, packed where the texts are read: no row is made of a word, and none is shuffled.

    The analysis does not fold words.  Up to ``SENT_TERMS`` terms are sent to
    all tasks as one array and looked up there.  Should a document come in
    several rows, these are put together.
    """
    if analysis.fold is not None:
        return packed_postings(postings(docs, text, id_column, analysis, asked, more), asked, more)
    terms = _written(numbered_terms(asked))
    if terms.count() > SENT_TERMS:
        return packed_postings(postings(docs, text, id_column, analysis, asked, more), asked, more, terms)
    keys, context = ["id", *more], docs.sparkSession.sparkContext
    listed = docs.select(F.col(id_column).alias("id"), *more, analysis.words(F.col(text)).alias("words")).select(*keys, F.size("words").cast("long").alias("length"), "words")
    held = terms.select("no", "term").toArrow().sort_by("no")["term"].combine_chunks()
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema if f.name in keys)
    rows = _written(listed.mapInArrow(_counted(context.broadcast(held), keys), f"{head}, length long, nos array<int>, tfs array<int>"))
    if rows.count() != rows.select(*keys).distinct().count():
        each = rows.select(*keys, "length", F.explode(F.arrays_zip("nos", "tfs")).alias("t")).groupBy(*keys, "t.nos").agg(F.sum("t.tfs").cast("int").alias("tf"), F.first("length").alias("length"))
        rows = _written(_gathered(each.withColumnRenamed("nos", "no"), keys))
    return Packed(rows, terms)


def _gathered(each: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., length, nos, tfs) of rows (keys..., length, no, tf)."""
    whole = each.groupBy(*keys).agg(F.first("length").alias("length"), F.collect_list(F.struct("no", "tf")).alias("_t"))
    return whole.select(*keys, "length", F.col("_t.no").alias("nos"), F.col("_t.tf").alias("tfs"))


def packed_postings(posts: DataFrame, asked: DataFrame, more: tuple[str, ...] = (), terms: DataFrame | None = None) -> Packed:
    """Postings (id, more..., term, tf, length) of the terms of ``asked``, packed; ``terms`` has their numbers, if there are some."""
    terms, keys = numbered_terms(asked) if terms is None else terms, ["id", *more]
    each = posts.join(sent(terms), "term").select(*keys, F.col("length").cast("long").alias("length"), F.col("no").cast("int").alias("no"), F.col("tf").cast("int").alias("tf"))
    return Packed(_written(_gathered(each, keys)), terms)


def _written(df: DataFrame) -> DataFrame:
    """``df`` written once: what follows reads it again and again."""
    from quarry.sources.store import Store

    store = Store.scratch(df.sparkSession)
    store.rewrite("packed", df)
    return store.read("packed")


def best_of_blocks(asked: DataFrame, packed: Packed, documents: int, k: int, k1: float = K1, b: float = B, average: float = AVERAGE) -> DataFrame:
    """(query_id, id, score, rank): the k documents of the highest BM25 score for each query of ``asked`` (query_id, term).

    Exact, rounded to 6 digits.  Queries and documents that have a term in
    common are no rows: both sides are cut into blocks, each pair of blocks is
    scored in one task as products of matrices, and only its k best of each
    query are ranked together.  If ``asked`` and ``packed`` have a column group, a
    query is compared to the documents of its group alone; null is no group.
    """
    grouped = ["group"] if "group" in asked.columns and "group" in packed.rows.columns else []
    rows, terms = packed.rows, packed.terms.withColumn("no", F.col("no").cast("int"))
    wanted = asked.select("query_id", *grouped, "term").distinct().join(sent(terms), "term").select("query_id", *grouped, "no")
    for c in grouped:
        rows, wanted = rows.where(F.col(c).isNotNull()), wanted.where(F.col(c).isNotNull())
    wanted = _written(wanted)
    frequency = packed.rows.select(F.explode("nos").alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("df"))
    rare = frequency.select("no", F.log((F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    held, cells = rows.agg(F.count(F.lit(1)), F.sum(F.size("nos"))).first()
    n = max(-(-(cells or 0) // CELL), min(rows.sparkSession.sparkContext.defaultParallelism, -(-held // DOCUMENTS)), 1)
    m = max(1, -(-wanted.count() // ASKED))
    spread = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    keys = [*grouped, "rb", "qb"]
    left = rows.select(*grouped, spread("id", n).alias("rb"), each(m).alias("qb"), "id", "length", "nos", "tfs")
    dealt = wanted.withColumn("qb", spread("query_id", m))
    texts = dealt.groupBy(*grouped, "qb", "query_id").agg(F.collect_list("no").alias("nos")).withColumn("idfs", F.lit(None).cast("array<double>"))
    weights = dealt.select(*grouped, "qb", "no").distinct().join(rare, "no").groupBy(*grouped, "qb", F.pmod("no", F.lit(64))).agg(F.collect_list(F.struct("no", "idf")).alias("_t"))
    idfs = weights.select(*grouped, "qb", F.lit(None).cast(dict(asked.dtypes)["query_id"]).alias("query_id"), F.col("_t.no").alias("nos"), F.col("_t.idf").alias("idfs"))
    right = texts.select(*grouped, "qb", "query_id", "nos", "idfs").unionByName(idfs).withColumn("rb", each(n))

    def compare(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        known, texts = ask[ask["idfs"].notna()], ask[ask["idfs"].isna()]
        if not len(own) or not len(known) or not len(texts):
            return pd.DataFrame({"query_id": texts["query_id"][:0], "id": own["id"][:0], "score": np.zeros(0)})
        own = own.sort_values("id", kind="stable")
        no, idf = np.concatenate(known["nos"].to_numpy()), np.concatenate(known["idfs"].to_numpy())
        order = np.argsort(no)
        no, idf = no[order], idf[order]

        def flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row, place in ``no``, whether it is there) of all numbers of some rows."""
            row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
            all_of = np.concatenate(lists.to_numpy())
            place = np.minimum(np.searchsorted(no, all_of), len(no) - 1).astype(np.int32)
            return row, place, no[place] == all_of

        parts = []
        for at in range(0, len(own), DOCUMENTS):
            some = own.iloc[at : at + DOCUMENTS]
            row, place, there = flat(some["nos"])
            tf = np.concatenate(some["tfs"].to_numpy())[there]
            row, place = row[there], place[there]
            w = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * some["length"].to_numpy()[row] / average))
            order = np.argsort(place, kind="stable")
            parts.append((len(some), row[order], place[order], w[order]))
        ids, starts, found = own["id"].to_numpy(), np.arange(0, len(own), DOCUMENTS), []
        for at in range(0, len(texts), QUERIES):
            some = texts.iloc[at : at + QUERIES]
            row, place, there = flat(some["nos"])
            best = Best(len(some), k)
            for start, part in zip(starts, parts, strict=True):
                best.add(_products(len(some), row[there], place[there], *part), start)
            row, doc, score = best.taken()
            found.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[row], "id": ids[doc], "score": score}))
        return pd.concat(found)

    kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def _products(queries: int, asks: np.ndarray, terms: np.ndarray, documents: int, row: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of all pairs: (asks, terms) are the queries' terms, (row, place, w) the documents' weights by term.

    Terms that many of both sides have are products of dense matrices, the others are added up pair by pair.
    """
    out = np.zeros((queries, documents))
    order = np.argsort(terms, kind="stable")
    asks, terms = asks[order], terms[order]
    term, first, times = np.unique(terms, return_index=True, return_counts=True)
    start, end = np.searchsorted(place, term), np.searchsorted(place, term, side="right")
    held = end - start
    many = times * held > out.size / DENSE
    own = np.flatnonzero(many)
    for at in range(0, len(own), 512):
        some = own[at : at + 512]
        q, d = np.zeros((queries, len(some))), np.zeros((len(some), documents))
        for j, t in enumerate(some):
            q[asks[first[t] : first[t] + times[t]], j] = 1
            d[j, row[start[t] : end[t]]] = w[start[t] : end[t]]
        out += q @ d
    few = np.flatnonzero(np.repeat(~many & (held > 0), times))
    few = few[np.argsort(asks[few], kind="stable")]  # query by query, so that what is added up lies close together
    asks, start, held = asks[few], np.repeat(start, times)[few], np.repeat(held, times)[few]
    if len(asks):
        upto = np.cumsum(held)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(HITS, upto[-1], HITS)), [len(asks)])))
        flat = out.ravel()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            size = held[low:high]
            at = np.repeat(start[low:high] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = slice(int(asks[low]) * documents, (int(asks[high - 1]) + 1) * documents)
            flat[own] += np.bincount(np.repeat((asks[low:high] - asks[low]).astype(np.int64) * documents, size) + row[at], w[at], own.stop - own.start)
    return out


class Best:
    """The k best columns of each row, rounded to 6 digits, of blocks of columns that come in order; equal scores by column, none that is not above ``above``."""

    def __init__(self, rows: int, k: int, above: float = 0.0):
        self.rows, self.k = rows, k
        self.above, self.least = above, np.full(rows, -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, scores: np.ndarray, start: int) -> None:
        # what rounds to more than the least of k is above it by less than a digit at most
        floor, cut = np.maximum(self.least - 1e-6, self.above), scores.shape[1] - self.k
        open_ = np.flatnonzero(np.isneginf(self.least)) if cut > 0 else []
        if len(open_):  # no k are known yet: at least the k best of this block, and all that round like the last of them
            floor[open_] = np.maximum(np.partition(scores[open_], cut, axis=1)[:, cut] - 1e-6, self.above)
        row, column = np.nonzero(scores > floor[:, None])
        near = np.round(scores[row, column], 6)
        kept = near > self.least[row]
        row, column, near = row[kept], column[kept], near[kept]
        self.found.append((row, column + start, near))
        self.pending += len(row)
        if self.pending > 2 * self.rows * self.k:
            self.settle()

    def settle(self) -> None:
        row, column, score = map(np.concatenate, zip(*self.found, strict=True))
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        size = np.bincount(row, minlength=self.rows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.least[row[nth == self.k - 1]] = score[nth == self.k - 1]
        kept = nth < self.k
        self.found = [(row[kept], column[kept], score[kept])]
        self.pending = int(kept.sum())

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle()
        return self.found[0]


def cosine(queries: DataFrame, vectors: DataFrame, k: int = LEG, allowed: Column | None = None, same_id: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of ``vectors`` (id, vector) to each of ``queries`` (query_id, vector).

    Exact, in double precision, rounded to 6 digits.  Both sides are cut into
    blocks by a hash, and every pair of blocks is one product of matrices with
    its own k best; only those are ranked together.  ``allowed`` is a condition
    on columns group of both sides, compared for equality inside the blocks if
    both have a column of that name, and a query's day is held against the
    days [from_day, to_day) of a row if both have them, before anything is cut.
    ``same_id`` keeps a query's own id.
    """
    grouped = "group" in queries.columns and "group" in vectors.columns
    dated = "day" in queries.columns and {"from_day", "to_day"} <= set(vectors.columns)
    extra = ["group"] if grouped else []
    held, asks = vectors.count(), max(1, -(-queries.count() // BLOCK))
    rows = max(1, -(-held // VECTORS), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-held // BLOCK)))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(spread("id", rows).cast("int").alias("rb"), each(asks).alias("qb"), "id", "vector", *extra, *(["from_day", "to_day"] if dated else []))
    right = queries.select(each(rows).alias("rb"), spread("query_id", asks).cast("int").alias("qb"), "query_id", "vector", *extra, *(["day"] if dated else []))

    def compare(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id", kind="stable")
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(own) and len(ask):
            m, q = np.stack(own["vector"].to_numpy()).astype(float), np.stack(ask["vector"].to_numpy()).astype(float)
            m, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (m, q))
            ids, asked = own["id"].to_numpy(), ask["query_id"].to_numpy()
            for at in range(0, len(q), QUERIES):
                some = slice(at, at + QUERIES)
                best = Best(len(asked[some]), k, -np.inf)
                for start in range(0, len(m), BLOCK):
                    part = slice(start, start + BLOCK)
                    near = q[some] @ m[part].T
                    near[np.isnan(near)] = -np.inf
                    if grouped:
                        near[ask["group"].to_numpy()[some, None] != own["group"].to_numpy()[None, part]] = -np.inf
                    if dated:
                        day = ask["day"].to_numpy()[some, None]
                        near[(day < own["from_day"].to_numpy()[None, part]) | (day >= own["to_day"].to_numpy()[None, part])] = -np.inf
                    if not same_id:
                        near[asked[some, None] == ids[None, part]] = -np.inf
                    best.add(near, start)
                row, column, score = best.taken()
                out.append(pd.DataFrame({"query_id": asked[some][row], "id": ids[column], "score": score}))
        return pd.concat(out)

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(compare, "query_id long, id long, score double")
    return top_k(found if allowed is None else found.where(allowed), ["query_id"], [F.desc("score"), F.asc("id")], k)


def fuse(legs: list[DataFrame], k: int = FUSED, constant: int = 2) -> DataFrame:
    """(query_id, id, score, rank): reciprocal-rank fusion of legs (query_id, id, rank from 1).

    Ranks count from 0 in the sum; ties are broken by id before the cut.
    """
    both = legs[0].select("query_id", "id", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("query_id", "id", "rank"))
    scored = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank") - 1)), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def rerank(candidates: DataFrame, score: Column, k: int = FINAL * 2) -> DataFrame:
    """Stable order by a new score, ties by the old rank; rerank_score is null for the identity (a null score)."""
    scored = candidates.withColumn("rerank_score", score.cast("double")).withColumnRenamed("rank", "fusion_rank")
    return top_k(scored, ["query_id"], [F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.asc("fusion_rank")], k)


def rerank_text(label: Column, text: Column) -> Column:
    """What a reranker reads: the full label, then the text."""
    return F.concat_ws("\n", label, text)


def overlap_score(question: Column, passage: Column) -> Column:
    """Share of the question's distinct words that a passage has: a scorer that needs no model."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(asked, tokens(passage))) / F.greatest(F.size(asked), F.lit(1)), 6)


def model_scorer(score: Callable[[list[str], list[str]], list[float]], batch: int = 16):
    """A reranker from any function of questions and passages, run on Arrow batches."""

    @F.pandas_udf("double")
    def run(question: pd.Series, passage: pd.Series) -> pd.Series:
        parts = [score(question[i : i + batch].tolist(), passage[i : i + batch].tolist()) for i in range(0, len(question), batch)]
        return pd.Series([float(x) for p in parts for x in p], dtype="float64")

    return run


@dataclass(frozen=True)
class Encoder:
    """A model that turns texts into vectors, documents and queries each in their own way.

    Texts of a task are taken ``window`` at a time, sorted by length and given
    to the model ``batch`` at a time, so that a batch has texts of about one
    length; vectors come back in the order of their rows.  A null text has no vector.
    """

    name: str
    dimension: int
    documents: Callable[[list[str]], np.ndarray]
    queries: Callable[[list[str]], np.ndarray]
    window: int = 512
    batch: int = 32

    def document(self, text: str | Column) -> Column:
        return self._column(self.documents)(text)

    def query(self, text: str | Column) -> Column:
        return self._column(self.queries)(text)

    def _column(self, encode: Callable[[list[str]], np.ndarray]):
        window, batch, dimension = self.window, self.batch, self.dimension

        @F.pandas_udf("array<float>")
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in texts:
                rows, out = part.tolist(), [None] * len(part)
                known = [i for i, x in enumerate(rows) if x is not None]
                for at in range(0, len(known), window):
                    order = sorted(known[at : at + window], key=lambda i: -len(rows[i]))
                    for start in range(0, len(order), batch):
                        some = order[start : start + batch]
                        found = np.asarray(encode([rows[i] for i in some]), np.float32)
                        if found.shape != (len(some), dimension):
                            raise ValueError(f"the model gave {found.shape} for {len(some)} texts of dimension {dimension}")
                        for i, v in zip(some, found, strict=True):
                            out[i] = v.tolist()
                yield pd.Series(out, dtype=object)

        return run


def hashed_encoder(dimension: int = 64):
    """A deterministic text encoder for tests and offline use: hashed words, signed and normalised."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        import zlib

        def one(text: str | None) -> list[float]:
            v = np.zeros(dimension)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % dimension] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return pd.Series([one(t) for t in texts])

    return run


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, documents: int, leg: int = LEG, fused: int = FUSED, posts: DataFrame | Packed | None = None) -> DataFrame:
    """Both legs over the same documents, then fusion.  queries: query_id, text, vector; docs: doc_id, text; vectors: id, vector."""
    posts = packed(docs, asked_terms(queries)) if posts is None else posts
    sparse = bm25(queries, posts, documents, leg)
    dense = cosine(queries.select("query_id", "vector"), vectors, leg)
    return fuse([dense, sparse], fused)


def missing_model_fields(meta: dict, model: str, dimension: int) -> list[str]:
    """What differs between an index's record and the model in use."""
    return [k for k, v in (("model", model), ("dimension", dimension)) if meta.get(k) != v]
