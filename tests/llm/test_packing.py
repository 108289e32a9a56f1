import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from quarry.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_once(seed):
    rng = np.random.default_rng(seed)
    histogram = rng.integers(0, 30, 1023) * (rng.random(1023) < 0.3)
    used, seen = defaultdict(int), defaultdict(list)
    for length, first, items, sequence, each, slot in packing.plan(histogram):
        seen[length].append((first, items))
        for nth in range(items):
            used[sequence + nth // each, slot + length * (nth % each)] = length
    for length, count in enumerate(histogram, 1):
        at = 0
        for first, items in sorted(seen[length]):
            assert first == at
            at += items
        assert at == count
    ends = defaultdict(list)
    for (sequence, slot), length in used.items():
        ends[sequence].append((slot, slot + length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 1024
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert packing.plan(np.zeros(1023, np.int64)) == []


def test_knapsack_finds_the_best_pattern():
    value = np.zeros(9)
    value[[2, 4]] = 3.1, 5.0
    worth, pattern = packing.best_pattern(value, 10)
    assert worth == pytest.approx(10.0) and pattern[4] == 2


def test_packing_is_a_lossless_round_trip(spark):
    texts = ["one two  three", None, "", "word " * 3000, "é中\n\n x" * 200, "<|endoftext|> a", "same", "same"]
    docs = spark.createDataFrame([(i if i != 6 else 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(docs.repartition(3), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        whole[r.doc_id].append((r.start, struct.unpack(f"<{r.length}I", r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        if i not in (6, 7):
            assert [x for _, ids in sorted(whole[i]) for x in ids] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    assert len(whole[7]) == 2  # repeated ids are documents of their own
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ids_are_those_of_the_unchanged_tokenizer():
    tokenizer, rnd = Tokenizer.from_file(PATH), random.Random(4)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "word", "'s", "123", "é", "中", "\u0085", "\U0001f600", "\t", "...", " the"]
    texts = ["<|endoftext|> a", "a<|endoftext|>b", *("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(800))]
    assert packing.encode(texts, PATH) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encode(["<|endoftext|> a"], PATH) == [[50256, 257]]


@pytest.mark.parametrize("seed", range(3))
def test_sequences_are_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1023, (rng.gamma(1.3, 180, 40_000)).astype(int) + 1)
    lengths = np.concatenate([[512, x - 512] if x > 512 else [x] for x in lengths])
    histogram = np.bincount(lengths[lengths > 0], minlength=1024)[1:1024]
    sequences = max(s + -(-n // each) for _, _, n, s, each, _ in packing.plan(histogram))
    least = int(np.ceil(histogram @ np.arange(1, 1024) / 1024))
    assert least <= sequences <= 1.01 * least + 5


def test_query_digest(spark):
    from quarry.llm.queries import op5_cutting_stock_packing

    row = op5_cutting_stock_packing(spark, "/root/testdata/sf0.001").orderBy("doc_id", "start").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 0").first().text
    ids = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]
    assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{row.length}I", *ids[: row.length])) and row.doc_tokens == len(ids)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x " + " \t" * 600_000 + "y", " " * 400_000], ids=["blanks", "newlines", "letters", "mixed", "hard blanks"])
def test_long_runs_have_the_ids_of_tokenizers(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encode([text, "a b"], path) == [e.ids for e in Tokenizer.from_file(path).encode_batch([text, "a b"], add_special_tokens=False)]
