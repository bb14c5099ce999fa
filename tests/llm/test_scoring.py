"""The n-gram model against counts of whole texts, and its tries against plain sequences."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import scoring
from tessella.llm.trie import STEPS, Rising, Trie, probability, quantised

ODD = [None, "", " ", "a", "A b", "the The THE the", "x y z " * 50, "É é", "x" * 3000, "a b c d e f g a b c"]


def coarse(p):
    return float(probability(quantised(np.array([p])))[0])


def brute(rows):
    texts = []
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        texts.append(([*re.findall(r"[^\x20\x09-\x0D]+", low), None], zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1))
    grams = lambda t: list(zip([0, 0, *t], [0, *t], t))
    one = Counter(w for t, held in texts if not held for w in t)
    three = Counter(g for t, held in texts if not held for g in grams(t))
    two, pairs, words, after_pair, after_word = Counter(), Counter(), Counter(), Counter(), Counter()
    for (u, v, w), n in three.items():
        two[v, w] += n
        pairs[u, v] += n
        words[v] += n
        after_pair[u, v] += 1
    for v, _ in two:
        after_word[v] += 1
    total = sum(one.values())
    for (i, _), (t, held) in zip(rows, texts):
        base = [(one[w] + 0.5) / (total + 0.5 * (len(one) + 1)) for w in t]
        score = 0
        for (u, v, w), p in zip(grams(t), map(coarse, base)):
            if words[v]:
                p = (two[v, w] + after_word[v] * p) / (words[v] + after_word[v])
            if pairs[u, v]:
                p = (three[u, v, w] + after_pair[u, v] * p) / (pairs[u, v] + after_pair[u, v])
            score += math.log10(p)
        yield i, held, len(t), sum(one[w] > 0 for w in t), total, sum(map(math.log10, base)), score


def compare(docs, **sizes):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6), round(r[6], 2))
    got = sorted((tuple(r) for r in scoring.score_texts(docs, **sizes).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) < 1.5 * w[2] / STEPS  # a step per token for each time it is rounded
    return got


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 40, "part_bytes": 30}, {"batch_bytes": 40, "part_bytes": 30, "hot": 20}, {"batch_bytes": 40, "part_bytes": 300, "hot": 5}])
def test_odd_texts(spark, sizes):
    rows = [(i, t, 1) for i, t in enumerate(ODD * 2)] + [(None, "a b", 1), (3, "q r s", 1)]
    compare(spark.createDataFrame(rows, "doc_id long, text string, part int"), **sizes)


@pytest.mark.parametrize("hot", [300, 30])
def test_words_and_pairs_in_several_parts(spark, hot):
    """With a limit this low, common words and pairs are dealt over parts, and nothing changes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = compare(docs, batch_bytes=60_000, part_bytes=30_000, hot=hot)
    assert rows == sorted((tuple(r) for r in scoring.score_texts(docs).collect()), key=lambda r: r[0])
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > 0.85 * sum(r[5] for r in held)  # logarithms below 0: the model does better


def test_nothing_trains(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {tuple(r)[1:] for r in scoring.score_texts(docs).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (1, 10**12), (5, 3), (1000, 100), (1000, 10**6), (20_000, 10**5), (3000, 1 << 50)])
def test_rising_sequences(n, most):
    x = np.sort(np.random.default_rng(n).integers(0, most, n))
    r = Rising(Rising.arrays(x))
    assert r.at(np.arange(n)).astype(np.int64).tolist() == x.tolist()
    q = np.unique(np.concatenate([x, x + 1, np.arange(50), [most + 5]])).astype(np.uint64)
    at, equal = r.find(q)
    assert at.tolist() == np.searchsorted(x, q.astype(np.int64)).tolist()
    assert equal.tolist() == np.isin(q.astype(np.int64), x).tolist()


def test_trie_is_compact():
    rng = np.random.default_rng(3)
    v, u, w = np.unique(np.stack([rng.integers(0, 500, 50_000), rng.integers(0, 5000, 50_000), rng.integers(0, 3000, 50_000)]), axis=1)
    trie = Trie.build(v, u, w, np.ones(len(v), np.int64), np.full(len(v), 5000, np.uint16))
    bits = sum(64 * (len(s.low) + len(s.high)) for s in (trie.words, trie.to_next, trie.next, trie.to_before, trie.before, trie.to_last, trie.last))
    assert bits / len(v) < 40  # three numbers and three pointers of a trigram
    assert (trie.score(v, u, w, np.full(len(v), 5000, np.uint16)) == trie.last_code[: len(v)]).all()
