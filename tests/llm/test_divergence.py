"""Divergence audit against plain Python, on odd tables and in blocks and chunks of any size."""

import collections
import random
import re

import numpy as np
import pytest

from lakeloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, block string, value double"


def brute(rows, least_docs=3, top=200):
    """rows: (text, lang, source)."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    docs, counts, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source, own = lang or "", source or "", terms(text or "")
        groups.add((lang, source))
        docs.update((lang, t) for t in set(own))
        counts.update((lang, source, t) for t in own)
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least_docs:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        v, mine = kept[lang], {g[1] for g in groups if g[0] == lang}
        total = {s: sum(counts[lang, s, t] for t in v) for s in mine}
        p = {s: {t: 1 + 10**9 * (counts[lang, s, t] + 1) // (total[s] + len(v)) for t in v} for s in mine}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in mine) + 1) // (sum(total.values()) + len(v)) for t in v}
        pairs = [(-sum((p[source][t] - p[s][t]) ** 2 // p[s][t] for t in v), s.encode()) for s in mine if s != source]
        telling = [(-((p[source][t] - q[t]) ** 2 // q[t]), t.encode()) for t in v if counts[lang, source, t] and p[source][t] > q[t]]
        for part, found in (("pair", pairs), ("term", sorted(telling)[:top])):
            out += [(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(sorted(found), 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(x) for x in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    words = ["".join(r.choice("abcdeÉß𝒳") for _ in range(r.randint(1, 4))) for _ in range(120)]
    out = []
    for k in range(260):
        n = r.choice([0, 3, 30, 60])
        text = r.choice([" ", "-", "1"]).join(r.choice(words[: r.choice([5, 40, 120])]).upper() if r.random() < 0.2 else r.choice(words) for _ in range(n))
        out.append((k, text, r.choice(["en", "en", "de"]), f"src{r.randrange(7)}"))
    out += [(1000, None, "en", "empty"), (1001, "a b a", None, "src1"), (1002, "a b", None, None), (1003, "a", "", ""), (1004, "one", "fr", "a"), (1005, "two", "fr", "b"), (1006, None, None, "é"), (1007, "w " * 30_000, "en", "long"), out[5], out[5], (1008, "a", "xx", "alone")]
    return out


@pytest.mark.parametrize("block, chunk, kept_terms", [(4096, 64, 200_000), (8, 2, 50), (1, 3, 1), (32, 1, 10)])
def test_audit(spark, rows, monkeypatch, block, chunk, kept_terms):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("KEPT_TERMS", kept_terms)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(*x, "t", 1, "b", 0.5) for x in rows], SCHEMA).repartition(3)
    want = brute([x[1:] for x in rows])
    assert got(divergence.audit(docs)) == want and len(want) > 300
    if block == 8:
        assert got(divergence.audit(docs, least_docs=20, top=2)) == brute([x[1:] for x in rows], 20, 2)
        assert got(divergence.audit(docs, least_docs=10**6)) == brute([x[1:] for x in rows], 10**6)
        assert not got(divergence.audit(docs.limit(0)))


def test_shares():
    """Long division up to counts whose product with SCALE leaves 64 bits."""
    r = random.Random(2)
    data = [(n, n + r.randrange(10**13), r.randrange(1, 10**7)) for n in [0, 1, 10**10, 10**13, *(r.randrange(10**13) for _ in range(50))]] + [(0, 0, 1), (0, 0, 0), (5, 5, 1)]
    n, t, v = np.array(data).T
    assert divergence.shares(n, t + v).tolist() == [1 + 10**9 * (n + 1) // max(1, t + v) for n, t, v in data]


def test_trees_share_nodes_and_price_pairs_once():
    r = np.random.default_rng(5)
    leaves = np.where(r.random((6, 64)) < 0.1, r.integers(1, 4, (6, 64)), 0)
    leaves[4], leaves[5] = leaves[3], 0
    roots, values, levels = divergence.hash_consed(leaves)
    assert roots[4] == roots[3] and len(levels) == 6 and all(len(set(map(tuple, level.T))) == level.shape[1] for level in levels)
    assert sum(level.shape[1] for level in levels) < 6 * 63 / 2
    a, b = np.nonzero(np.ones((6, 6)))
    pair, x, y, times = divergence.leaf_pairs(roots[a], roots[b], levels)
    assert len(set(zip(pair, x, y))) == len(pair)
    for k in range(len(a)):
        want = collections.Counter(zip(leaves[a[k]].tolist(), leaves[b[k]].tolist()))
        here = pair == k
        assert {(int(values[i]), int(values[j])): int(n) for i, j, n in zip(x[here], y[here], times[here])} == want
