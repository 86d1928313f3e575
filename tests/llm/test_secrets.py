"""The randomness battery and the false-discovery control against plain Python; prefixes; texts with very many matches."""

import collections
import math
import random
import re
import time

import pytest

from lakeloom.llm import secrets

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def tail(z):
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-40)


def truth(token):
    """encoding, p_words, p_random by definition."""
    body = re.sub(secrets.PREFIX, "", token.rstrip("="))
    name, _, alphabet = next(e for e in secrets.ENCODINGS if re.search(e[1], body))
    n, k = len(body), len(alphabet)
    pairs = sum(c * (c - 1) for c in collections.Counter(body).values()) / (n * (n - 1))
    at = [alphabet.index(c) for c in body]

    def z(q2, q3):
        return (pairs - q2) / math.sqrt((4 * (n - 2) * (q3 - q2 * q2) + 2 * (q2 - q2 * q2)) / (n * (n - 1)))

    high = [x >= k / 2 for x in at]
    m = sum(high)
    expected = 2 * m * (n - m) / n + 1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    p_runs = 1e-9 if m in (0, n) else min(1, 2 * tail(abs((runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9)))))
    mean = sum(at) / n
    scatter = sum((x - mean) ** 2 for x in at)
    serial = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:] + at[:1])) / scatter if scatter else 1.0
    half = -sum(map(math.log, (tail(z(1 / k, 1 / k**2)), p_runs, min(1, 2 * tail(abs((serial + 1 / (n - 1)) * math.sqrt(n)))))))
    return name, tail(-z(*secrets.TEXT_SKEW.get(name, secrets.WORDS_SKEW))), math.exp(-half) * (1 + half + half * half / 2)


@pytest.fixture(scope="module")
def tokens():
    r = random.Random(9)
    alphabets = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", BASE62.lower()[:26], BASE62[:26] + "234567", BASE62 + "+/", BASE62 + "-_", BASE62[26:]]
    out = ["".join(r.choice(a) for _ in range(r.randint(20, 90))) for a in alphabets for _ in range(25)]
    out += ["".join(r.choice(["some", "word", "here", "under", "over", "_", "/"]) for _ in range(r.randint(7, 20))) for _ in range(120)]
    return [t for t in out if len(t) >= 20] + ["ghp_" + "".join(r.choice(BASE62) for _ in range(36)), "sk_live_" + "".join(r.choice(BASE62) for _ in range(24)) + "==", "a" * 40]


def test_battery_and_control(spark, tokens):
    found = secrets.battery(spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k int, token string")).cache()
    ps = collections.defaultdict(list)
    for x in found.collect():
        name, p_words, p_random = truth(x.token)
        assert x.encoding == name and math.isclose(x.p_words, p_words, rel_tol=1e-3, abs_tol=2e-7) and math.isclose(x.p_random, p_random, rel_tol=1e-2, abs_tol=1e-5), x
        ps[int(math.log2(x.n))].append(min(int(-math.log10(x.p_words) * secrets.BINS_PER_DECADE), secrets.BINS - 1))
    want = {}
    for band, bins in ps.items():
        passing = [b for b in set(bins) if 10 ** (-b / secrets.BINS_PER_DECADE) <= secrets.FDR * sum(x >= b for x in bins) / len(bins)]
        if passing:
            want[band] = min(passing)
    assert {x.band: x.least_bin for x in secrets.thresholds(found).collect()} == want and len(want) > 1


def test_prefixes_are_left_out(spark, tokens):
    found = {x.token: x for x in secrets.battery(spark.createDataFrame([(t,) for t in tokens[-3:]], "token string")).collect()}
    assert [int(found[t].n) for t in tokens[-3:]] == [36, 32, 40] and found[tokens[-3]].encoding == "base64"


def test_candidates_touch_no_base_span(spark):
    r = random.Random(3)
    free = ["".join(r.choice(BASE62) for _ in range(44)) for _ in range(3)]
    text = f"é {free[0]} token={free[1]} x\x01{free[2]} AKIA{'B7' * 8} zz{'0123456789abcdef' * 2}zz-{free[0]} end"
    (x,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    got = [(s.kind, text[s.start : s.stop]) for s in x.found]
    assert [k for k in got if k[0] == "random"] == [("random", free[0]), ("random", free[2])]
    assert [k for k, _ in got] == ["random", "assign", "random", "access", "hex"]


def test_many_matches_take_linear_time(spark):
    """100,000 base spans, and as many candidates, in one text each."""
    r = random.Random(4)
    texts = [" ".join(f"token=abc{k:06d}" for k in range(100_000)), " ".join("".join(r.choice(BASE62) for _ in range(24)) for _ in range(100_000))]
    began = time.time()
    a, b = sorted(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_assign", "n_random", "spans").collect())
    assert a.n_assign == 100_000 and a.spans.endswith(f"assign:{len(texts[0]) - 15}:{len(texts[0])}") and b.n_random > 30_000  # 24 symbols prove little: some 36 % pass
    assert time.time() - began < 120
