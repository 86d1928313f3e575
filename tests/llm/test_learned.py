"""What language identification and toxicity learn, against plain Python."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import language_id, toxicity

CLASH = "doc_id long, text string, lang string, id int, score string, held_out int, dense double"


def grams(text):
    """Hashed runs of one to three signs; letters lower-cased, all else one blank."""
    plain = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    if not plain.strip():
        return None
    m = 0xFFFFFFFF
    c = [ord(x) for x in plain]
    one = [x * 0x9E3779B1 & m for x in c]
    two = [((one[k] ^ (c[k + 1] * 0x85EBCA77 & m)) * 0xC2B2AE3D) & m for k in range(len(c) - 1)]
    three = [((two[k] ^ (c[k + 2] * 0x27D4EB2F & m)) * 0x165667B1) & m for k in range(len(c) - 2)]
    return [h >> 32 - language_id.HASH_BITS for h in one + two + three]


def learned(rows):
    """A function from texts to (language, score), by the definition of the codes. rows: (doc_id, text, lang)."""
    taught = [(grams(t or ""), lang) for i, t, lang in rows if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    counts = collections.defaultdict(collections.Counter)
    for g, lang in taught:
        if g:
            counts[lang].update(g)
    langs = sorted(counts)
    size = 1 << language_id.HASH_BITS
    rate = {lang: {g: (c[g] + language_id.SMOOTH) / (c.total() + language_id.SMOOTH * size) for g in range(size)} for lang, c in counts.items()}
    code = language_id.codewords(len(langs)).tolist()
    weights = []
    for bit in zip(*code):
        sides = [[lang for lang, b in zip(langs, bit) if b == side] for side in (1, -1)]
        mean = lambda names, g: sum(rate[x][g] for x in names) / len(names)
        weights.append([math.log(mean(sides[0], g)) - math.log(mean(sides[1], g)) if sides[1] else 0.0 for g in range(size)])
    margins = lambda g: [sum(w[x] for x in g) / len(g) for w in weights]
    right, n = [[0] * len(weights) for _ in langs], [0] * len(langs)
    for g, lang in taught:
        if g:
            k = langs.index(lang)
            n[k] += 1
            for b, m in enumerate(margins(g)):
                right[k][b] += (m > 0) - (m < 0) == code[k][b]
    trust = [[(x + 1) / (n[k] + 2) for x in right[k]] for k in range(len(langs))]

    def decode(text):
        g = grams(text or "")
        if not g or not langs:
            return "und", 0.0
        m = margins(g)
        loss = [sum(t / sum(trust[k]) * math.log1p(math.exp(-language_id.SHARPNESS * c * x)) for t, c, x in zip(trust[k], code[k], m)) for k in range(len(langs))]
        chance = [math.exp((min(loss) - x) * language_id.SHARPNESS) for x in loss]
        best = loss.index(min(loss))
        return langs[best], chance[best] / sum(chance)

    return decode


@pytest.mark.parametrize("n_langs", [1, 2, 4])
def test_codes_and_decoding(spark, n_langs):
    r = random.Random(n_langs)
    signs = {"en": "abcdeé ", "de": "defghß ", "fr": "ghijaç ", "xx": "klmnabd "}
    langs = list(signs)[:n_langs]
    rows = [(k, "".join(r.choice(signs[lang]) for _ in range(r.choice([3, 30, 90]))), lang) for k in range(90) for lang in [r.choice(langs)]]
    rows += [(100, None, "en"), (101, " 12 ", "en"), (102, "ABC abc", None), (None, "kkk", "de"), (103, "word " * 20_000, "en"), rows[5], rows[5], (104, "ЖЖ", None)]
    docs = spark.createDataFrame([(*x, 7, "s", 1, 0.5) for x in rows], CLASH).repartition(3)
    decode = learned(rows)
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    want = sorted((repr(i), *decode(t)) for i, t, _ in rows)
    found = sorted((repr(x.doc_id), x.lang_pred, x.score) for x in got.collect())
    assert [x[:2] for x in found] == [x[:2] for x in want] and all(math.isclose(a[2], b[2], rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(found, want))


def test_lexicons(spark):
    r = random.Random(2)
    words = [f"word{k}" for k in range(40)] + ["vile", "vilest", "vileness"]
    rows = [(k, " ".join(r.choice(words[: 40 + 3 * (k % 4 == 0)]) for _ in range(15)), int(k % 4 == 0), k // 4 % 2) for k in range(300)]
    found = toxicity._lexicons(spark.createDataFrame(rows, "id long, body string, toxic int, half int").repartition(5))
    for halves, got in zip(((0,), (1,), (0, 1)), found):
        mine = [(set(toxicity.terms_of(set(t.split()))), y) for _, t, y, h in rows if h in halves]
        n = collections.Counter(y for _, y in mine)
        tally = collections.Counter((t, y) for terms, y in mine for t in terms)
        odds = {t: math.log((tally[t, 1] + 0.5) / (n[1] + 1)) - math.log((tally[t, 0] + 0.5) / (n[0] + 1)) for t, _ in tally if tally[t, 1] >= toxicity.LEAST_DOCS}
        want = {t: x for t, x in odds.items() if x > 1}
        assert got.keys() == want.keys() and all(math.isclose(got[t], x, rel_tol=1e-12) for t, x in want.items()) and {"vile", "4vile"} <= got.keys()


def test_features():
    """Densities, nearness and rates, counted by hand."""
    lexicon = {"vile": 3.0, "rot": 1.5, "4rott": 2.0}
    text = "YOU are so v1le, vile!! rotten rotter... soooo b a dé "
    got = toxicity.features_of(text, lexicon, toxicity.roots_of(lexicon))
    words = ["you", "are", "so", "vile", "vile", "rotten", "rotter", "soooo", "b", "a", "dé"]
    n, chars = len(words), len(text)
    want = [math.log1p(n), math.log1p(chars), 2, 200 / n, 1, 3.0, 6.0, 600 / n, 2, 400 / n, 0, 0, 0, 0, 1, 100 / n, 100 * 3 / chars, 100 / n, 200 / chars, 200 / n, 100 / n, 200 / n]  # "oooo" holds two runs of three
    assert got == pytest.approx(want)
    assert toxicity.features_of(None, lexicon, toxicity.roots_of(lexicon)) == [0.0] * len(want) == toxicity.features_of("", {}, frozenset())


def test_scores_are_calibrated(spark, monkeypatch):
    """The isotonic step is that of pooling adjacent violators; scores don't depend on how rows are dealt."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeimnorst") for _ in range(5)) for _ in range(150)]
    rows = [(k, " ".join([*(r.choice(words) for _ in range(20)), *(["zzvile"] if r.random() < (0.8 if k % 3 == 0 else 0.15) else [])]), int(k % 3 == 0)) for k in range(500)]
    docs = spark.createDataFrame([(i, t, "en", 7, "s", 1, 0.5) for i, t, _ in rows], CLASH)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen, real = [], toxicity.IsotonicRegression

    class Watched:
        def fit(self, held):
            seen.extend((x.features, x.label) for x in held.collect())
            model = real().fit(held)
            seen.append(model)
            return model

    monkeypatch.setattr(toxicity, "IsotonicRegression", Watched)
    got = toxicity.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    scores = {x.doc_id: x.score for x in got.collect()}
    model, held = seen[-1], sorted(seen[:-1])
    pools = []  # [value, weight], of rising values
    for chance in sorted({x for x, _ in held}):
        labels_here = [y for x, y in held if x == chance]
        pools.append([sum(labels_here) / len(labels_here), len(labels_here)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (a, m), (b, n) = pools[-2:]
            pools[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    assert sorted({round(v, 9) for v in model.predictions}) == sorted({round(v, 9) for v, _ in pools}) and len(held) > 60
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 500
    assert {x.score for x in toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1.0} and toxicity.toxicity(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, s in scores.items() if s < 0.5}
    again = toxicity.toxicity(docs.repartition(7), labels.repartition(3)).select("doc_id", F.col("score")).collect()
    assert {x.doc_id: x.score for x in again} == scores
