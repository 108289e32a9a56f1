import random
import re

import numpy as np
import pytest
import xxhash
from quarry.llm import simhash
from quarry.llm.components import connected_components


def plain(text, words):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(links, nodes):
    root = {n: n for n in nodes}
    for _ in nodes:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    return root


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    block = rng.integers(0, 1 << 23, 500)
    row, word, _ = simhash._near_codewords(block, 0)
    assert (np.bincount(row, minlength=500) == 1).all()
    assert (np.bitwise_count(block[row] ^ word) <= 3).all()


@pytest.mark.parametrize("threshold", [1, 2])
def test_close_fingerprints_meet_at_a_home(threshold):
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 1)
        b = a.copy()
        for bit in rng.choice(64, threshold, replace=False):
            b ^= np.int64(1) << np.int64(bit)
        home = set(simhash.anchors(a, 0)[1].tolist())
        assert len(home) == 1 and home <= set(simhash.anchors(b, threshold)[1].tolist())


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \t\n", "ONE", "one", "a b", "x y z"]
    for _ in range(90):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(60)] = word()
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs.repartition(3)).collect()}
    fps = {i: plain(t, 3) for i, t in rows}
    pairs = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = smallest_reachable(pairs, list(fps))
    assert got == {i: (fps[i], roots[i]) for i in fps}


def test_null_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "same text here"), (4, "same text here"), (4, "same text here"), (None, "other words stand here")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id is None, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, False, 4), (False, False, 4), (True, False, 4), (True, True, 0)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 500), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[500] == 500
