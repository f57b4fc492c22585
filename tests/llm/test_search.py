"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    coded = [(i, Counter(plain_terms(t))) for i, t in docs]
    coded = [(i, c, sum(c.values())) for i, c in coded if c]
    n_docs, n_words = len(coded), sum(n for _, _, n in coded)
    df = Counter(t for _, c, _ in coded for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in coded:
            m = 75 + 25 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_terms():
    text = "The cat\x00sat—on_the MAT2 Éa\x85b\xa0c é\x7fz `x{y"
    assert [w.decode() for w in search.terms_of(text.encode())] == plain_terms(text)
    assert search.terms_of(None) == search.terms_of(b" \n") == []


def test_varints_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128], [2**64 - 1, 0, 2**63], (rng.integers(0, 2**62, 500) >> rng.integers(0, 62, 500)).tolist()):
        data, sizes = search.varints(np.array(values, dtype=np.uint64))
        assert search.numbers(data.tobytes()).tolist() == values and sizes.sum() == len(data)
    for ids in ([], [None], [-(2**63), -1, 0, 2**63 - 1, None, None], [5, 5, 5]):
        assert search._ids_of(search._id_bytes(ids)) == ids


def corpus():
    rng = random.Random(11)
    common, rare = ["the", "of", "und", "é", "4"], [f"w{k}" for k in range(120)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare).upper() for _ in range(n))
    docs = [(k * 13 % 401 - 50, text(rng.choice([1, 3, 20, 200]))) for k in range(400)]
    docs += [(900, None), (901, ""), (902, " -- "), (None, "w1 w2 the"), (None, "w1 w2 the"), (3, "w1 w2 the"), (3, "w1 w2 the"), (950, "w7 " * 9000)]
    docs += [(1000 + k, "w1 w2 the") for k in range(40)]  # a group of copies: ties by id
    items = [("a", "w1 w2"), ("a", "w1 w2"), ("b", None), ("c", "!!"), (None, "the the of w9"), ("d", "nowhere w7 w7"), ("e", text(60)), ("f", "the"), ("g", "absent")]
    return docs, items + [(f"q{k}", text(rng.randrange(1, 25))) for k in range(25)]


@pytest.mark.parametrize("shard_words,block_terms,k", [(300, 40, 20), (10**9, 10**9, 20), (2000, 100, 3), (1, 10**9, 1)])
def test_search_matches_brute_force(spark, shard_words, block_terms, k):
    docs, items = corpus()
    if shard_words == 1:
        docs, items = docs[::5] + docs[-48:], items[:9]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as shard", "'x' as term", "2 as q").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 as score", "2 as doc_id", "3 as rank")
    index = search.build_index(frame, shard_words=shard_words)
    got = [tuple(r) for r in search.search(index, asked, k, block_terms=block_terms).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=key) == sorted(plain_search(docs, items, k), key=key)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert search.search_documents(docs, items).collect() == []
    some = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "doc_id bigint, text string")
    assert search.search_documents(some, items.limit(0)).collect() == []
    assert [tuple(r) for r in search.search_documents(some, items).collect()] == plain_search([(1, "w1 w2"), (2, "w3")], [("a", "w1")])
    numbered = spark.createDataFrame([(7, "w3")], "item_id int, text string")
    assert [r.item_id for r in search.search_documents(some, numbered).collect()] == [7]


def test_skipping_leaves_no_result_out():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        lists, scores = [], np.zeros(n, dtype=np.int64)
        for _ in range(int(rng.integers(1, 7))):
            places = np.flatnonzero(rng.random(n) < rng.random())
            if not len(places):
                continue
            p = search._Postings.__new__(search._Postings)
            shares = rng.integers(1, 5, len(places)) * int(rng.choice([1, 10, 100]))
            p.places, p.shares, p.most = search.array("q", places.astype(np.int64).tobytes()), search.array("q", shares.astype(np.int64).tobytes()), int(shares.max())
            q = int(rng.integers(1, 3))
            lists.append((p, q))
            scores[places] += shares * q
        ids = sorted(rng.integers(-20, 20, n).tolist())
        best = [(int(s), -100, 100) for s in rng.integers(1, 300, int(rng.integers(0, k + 1)))]
        search.heapify(best)
        want = sorted([e[:2] for e in best] + [(int(s), -i) for s, i in zip(scores, ids, strict=True) if s], reverse=True)[:k]
        search.merge_documents(lists, ids, best, k)
        assert sorted((e[:2] for e in best), reverse=True) == want
