import random

import numpy as np
import pytest
from quarry.llm import prefix_free, suffix_dedup


def brute(rows, length):
    """Covered bytes of each document, straight from the definition."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        covered = [False] * len(data)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                covered[s : s + length] = [True] * length
            seen.add(data[s : s + length])
        out.append(bytes(b for b, c in zip(data, covered) if not c))
    return out


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages, base = [text(40) for _ in range(4)], text(120)
    rows = []
    for i in range(120):
        t = text(rnd.randint(0, 150))
        if i % 3 == 0:
            t = t[: len(t) // 2] + rnd.choice(passages) + t[len(t) // 2 :]
        if i % 4 == 1:
            words = base.split()
            words[rnd.randrange(len(words))] = word()
            t = " ".join(words)
        if i % 10 == 9:
            t = "ab" * rnd.randint(40, 200) + passages[0] + "z" * 150
        rows.append((i, t))
    return [*rows, (200, None), (201, ""), (202, passages[1] * 3)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_repeated_byte_goes(spark, partitions):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs, 100).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, 100)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    long = "lorem ipsum dolor sit amet " * 9 + "end"
    rows = [(1, long, "x"), (1, long, "y"), (None, long, None), (None, None, "n"), (2, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = suffix_dedup.dedup(docs, 100).collect()
    assert len(got) == 5
    first = {bytes(r.kept) for r in got if r.doc_id == 1}
    assert len(first) == 1  # equal rows count as one document
    last = [r for r in got if r.doc_id is None and r.text is not None]
    assert bytes(last[0].kept) == b"" and [tuple(x) for x in last[0].removed] == [(0, len(long))]
    assert suffix_dedup.dedup(docs.limit(0), 100).count() == 0


def test_whole_characters_give_valid_text():
    text = "é".encode() * 4
    kept, runs = suffix_dedup.cut(text, [1], [5], whole_characters=True)
    assert runs == [(2, 4)] and kept.decode() == "é" * 3


@pytest.mark.parametrize("seed", range(6))
def test_corpus_order_against_sorting(seed):
    rnd = random.Random(seed)
    for _ in range(30):
        alphabet, length = rnd.choice([b"a", b"ab", b"abc\0", bytes(range(256))]), rnd.choice([8, 9, 20, 57, 100])
        some = lambda n: bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, n)))  # noqa: E731, B023
        base, strings = some(400), []
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(base))
            strings.append(some(150) + base[at : at + rnd.randint(0, 300)] + some(150))
        start = np.cumsum([0, *map(len, strings)])
        text = np.frombuffer(b"".join(strings), np.uint8)
        order, common = prefix_free.corpus_order(text, start, length)
        ends = np.repeat(start[1:], np.diff(start))
        suffixes = [text[p : ends[p]].tobytes()[:length] for p in order]
        assert sorted(order.tolist()) == [p for p in range(len(text)) if p + length <= ends[p]] and suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
            assert a[:n] == b[:n] and (n == length or a[n] != b[n])
        classes = prefix_free.window_classes(text, start, length)
        assert len({(text[p : p + length].tobytes(), classes[p]) for p in order}) == len({text[p : p + length].tobytes() for p in order}) == len({classes[p] for p in order})


def test_repeated_text_is_sorted_once():
    rnd = random.Random(1)
    once = bytes(rnd.randrange(97, 123) for _ in range(20_000))
    sizes, init = [], prefix_free.Dictionary.__init__
    prefix_free.Dictionary.__init__ = lambda self, phrases, depth: (sizes.append(sum(map(len, phrases))), init(self, phrases, depth))[1]
    try:
        for copies in (1, 30):
            prefix_free.window_classes(np.frombuffer(once * copies, np.uint8), np.arange(copies + 1) * len(once), 100)
    finally:
        prefix_free.Dictionary.__init__ = init
    assert sizes[1] == sizes[0]


@pytest.mark.parametrize("size", [600, 5_000])
def test_small_parts_and_groups_of_groups(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "PART", size)
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = suffix_dedup.parts_of(docs, "text", "doc_id")
    assert parts.count() > 9
    out = [bytes(r.kept) for r in suffix_dedup.dedup(docs, 100).orderBy("doc_id").collect()]
    assert out == brute(rows, 100)
