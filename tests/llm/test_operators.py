"""Each operator on a small table with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import collections
import hashlib
import html
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lakeloom.llm import bpe, embedding_dedup, exact_dedup, graph, html_extraction, language_id, licenses, minhash_dedup, mixing, secrets, toxicity
from lakeloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, kept boolean, ID string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case; further columns have names that operators might use themselves."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdeimnorst") for _ in range(r.randint(2, 6))) for _ in range(80)]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \n\t", LONG, LONG, "Ärger ABC", "Ärger abc", "ärger abc", "one two", "ONE two", *base, *base, base[0].upper()]
    for b in base:
        ws = b.split()
        for k in (3, 20, 40):
            texts.append(" ".join([*ws[:k], "changed", *ws[k + 1 :]]))
            texts.append(" ".join([*ws[:k], "other", "things", *ws[k + 5 :]]))
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None, "x", 0.5, False, "y") for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, base[1], "en", "src0", 1, "x", 0.5, True, "y"), (None, "alone here", "en", "src0", 1, "x", 0.5, True, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(6000, 6500)] + [(7, 7), (None, 3)]
    got = {x.u: x.v for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    star = dict(graph.spanning_edges((a, b) for a, b in edges if a is not None and a != b))
    assert got == star and not graph.connected_components(spark.createDataFrame([], "a long, b long")).collect()


def test_secrets(odd, none, spark):
    def base(t):
        out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))

    r = random.Random(4)
    random_token = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    texts = [f"é𝄞 {random_token} token=ab token: secretvalue1 x", "token=token:abcdef", "AKIA" + "A" * 15, "AKIA" + "B7" * 8 + " end", "0123456789abcdef" * 2, "schverlicheinpfauungundweiter " * 3, "a" * 19 + "/" * 30, None, "", 'api_key : "abc.def-7" PASSWORD=\'longer_one\'']
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert got[k].base_sha256 == hashlib.sha256(base(t or "").encode()).hexdigest(), t
        assert [s for s in got[k].spans.split(",") if s and not s.startswith("random")] == [s for s in base(t or "").split(",") if s]
    assert f"random:3:{3 + 60}" in got[0].spans.split(",") and sum(x.n_random for x in got.values()) == 1
    assert secrets.scan(odd).count() == odd.count() and not secrets.scan(none).collect()


def test_language_id(spark, odd, none):
    got = QUERIES["op2_language_id"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(truth) and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    rows = {x.doc_id: x for x in language_id.identify(odd).collect()}
    assert rows[0].lang_pred == rows[2].lang_pred == "und" and rows[3].lang_pred == "en"
    assert not language_id.identify(none).collect() and language_id.identify(odd.filter("lang is null")).first().lang_pred == "und"
    for k in range(1, 12):
        code = language_id.codewords(k)
        assert len({tuple(c) for c in code}) == k


def test_html_extraction(spark):
    def article(page):
        parts = re.split(r"</?(?:p|h1)>", re.search("<article>(.*?)</article>", page, re.S)[1])
        return "\n\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts) if t)

    pages = {x.page_id: x.html for x in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for x in QUERIES["op3_html_extraction"](spark, SF).collect():
        assert x.text == article(pages[x.page_id]) and x.n_chars == len(x.text)
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (4, "u", '<nav><a href="/">Home</a></nav><article><h1>Tea &amp; <i>cake</i></h1><p>One\n  two<br>three.</p><div class="comments"><p>Nice!</p></div></article><footer>&copy; me</footer>'), (5, "u", "<article><p>" + "long text, " * 20_000)]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {x.page_id: x.text for x in got}
    assert by[1] == by[2] == "" and by[4] == "Tea & cake\n\nOne two three." and len(by[5]) == len("long text, " * 20_000) - 1
    field = html_extraction.train(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "html")
    right = total = 0
    for page, labels in html_extraction.practice_pages(60, seed=77):
        found = field.decode(html_extraction.features_of(html_extraction.blocks_of(page)))
        right, total = right + sum(a == b for a, b in zip(found, labels)), total + len(labels)
    assert right / total > 0.95


def test_viterbi_and_gradient():
    """The decoded labels are the best of all labellings."""
    field = html_extraction.Field([([["a"], ["b"], ["a", "c"]], [1, 0, 1]), ([["b"], ["b"]], [0, 0]), ([["c"]], [1])])
    names = [["a"], ["b", "c"], ["x"], ["b"], ["c"]]
    score = lambda y: sum(field.weights[field.index[n]] for f, v in zip(names, y) if v for n in f if n in field.index) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
    ways = [[n >> k & 1 for k in range(5)] for n in range(32)]
    assert math.isclose(score(field.decode(names)), max(map(score, ways)))


def same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert collections.Counter(tuple(r[n] for n in names) for r in df.collect()) == collections.Counter(tuple(r[k] for k in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, name):
    same_as_duckdb(spark, name)


def test_licences(spark, odd, none):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including use. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, express or implied.'
    rows = [(1, f"Some words. {mit} More."), (2, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (3, None), (4, "a licensed driver"), (5, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")]
    got = {x.doc_id: x for x in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].licenses for k in range(1, 6)] == ["MIT", "MIT,CC-BY-NC-4.0", "", "", ""] and got[5].unmatched == "<MitNotice>"
    trigger = re.compile(licenses.TRIGGER)
    assert all(trigger.search(p) for p in licenses.SENTENCES.values()) and all(trigger.search(f'{w} under x') for w in ('licensed', 'released', 'distributed', 'available', 'published', 'provided', 'covered', 'governed'))
    assert licenses.licences(odd).count() == odd.count() and not licenses.licences(none).collect()


def test_mixing(odd, none):
    got = mixing.mix(odd, targets={"src0": 0.5}, epochs=3.0).collect()
    counts = collections.Counter((x.doc_id, x.text) for x in got)
    sizes = collections.Counter()
    for x in odd.collect():
        sizes[x.source] += len(x.text or "")
    left = sum(v**mixing.ALPHA for s, v in sizes.items() if s != "src0")
    rates = {s: (0.5 if s == "src0" else 0.5 * v**mixing.ALPHA / left) * sum(sizes.values()) * 3.0 / v for s, v in sizes.items()}
    for (i, t), rows in collections.Counter((x.doc_id, x.text, x.source) for x in odd.collect()).items() and {(x.doc_id, x.text): x for x in odd.collect()}.items():
        u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        n, c, k, rate = 0, math.exp(-rates[rows.source]), 0, rates[rows.source]
        p = c
        while c <= u:
            k += 1
            p *= rate / k
            c, n = c + p, n + 1
        repeats = sum(x.doc_id == i and x.text == t for x in odd.collect())
        assert counts[i, t] == n * repeats
    assert not mixing.mix(none).collect() and mixing.mixed_corpus(odd).columns == odd.columns


def test_toxicity(spark, odd, none):
    r = random.Random(8)
    words = ["".join(r.choice("abcdeimnorst") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for k in range(600):
        ws, bad = [r.choice(words) for _ in range(40)], k % 6 == 0
        ws[7:7] = ["you", r.choice(["zzvile", "zzrotten", "zzfoul"])] if bad else ["you"]
        rows.append((k, " ".join(ws)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == 600 and 60 < len(held) < 180 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert sum(x.predicted == int(x.doc_id % 6 == 0) for x in held) / len(held) > 0.95
    assert toxicity.drop_toxic(docs, marks).count() == sum(not x.predicted for x in got)
    assert toxicity.toxicity(odd, marks).count() == odd.count() and toxicity.drop_toxic(odd, marks).columns == odd.columns
    assert {x.score for x in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.0} and not toxicity.toxicity(none, marks).collect()


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    r = random.Random(3)
    texts = ["".join(r.choice("abthein's éΣİ<|>endoftx.!?0129\n\t\x1c") for _ in range(r.randint(0, 60))) for _ in range(800)] + ["a<|endoftext|>B<|startoftext|>'S", None, "", "x" * 3000, "ab" * 5000, "!" * 700, "naïve ΑΣ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in bpe.detokenize(bpe.tokenize(docs)).collect():
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert x.ids == ids and x.n_tokens == len(ids) and x.decoded == decoded
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.tokenize(odd).count() == odd.count() and not bpe.tokenize(none).collect()


@pytest.mark.parametrize("limits", [{}, {"CELL_ROWS": 40, "MOST_SHOWN": 9.0}, {"CELL_ROWS": 6, "SPLIT": 1, "PER_FIT": 60, "PER_CELL": 4, "SALT_ROWS": 20, "HOT_SHARE": 9, "MOST_SHOWN": 3.0}, {"CELL_ROWS": 3, "SPLIT": 1, "PER_FIT": 50, "PER_CELL": 10, "MOST_CELLS": 3, "MOST_SHOWN": 9.0, "SALT_ROWS": 7, "HOT_SHARE": 50}])
def test_embeddings(spark, monkeypatch, limits):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    rows = [(k, (centers[k % 12] + rng.normal(size=8) * 0.13).astype(np.float32).tolist(), k % 3) for k in range(400)]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(300)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [1.0] * 7 + [None], 1), (2004, [1.0] * 7 + [float("nan")], 1), (2005, rows[5][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[7][1], rows[7][2]), rows[9], rows[9], (rows[11][0], rows[12][1], rows[12][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    links, pairs = [0] * len(good), []  # of each row
    for k, (i, v, lab) in enumerate(good):
        for n, (j, w, other) in enumerate(good[:k]):
            if lab == other and len(v) == len(w) and cos(v, w) >= 0.98:
                links[k] += 1
                links[n] += 1
                if i is not None and j is not None:
                    pairs.append((i, j))
    star = dict(graph.spanning_edges(pairs))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    for name, value in limits.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    df = df.selectExpr("*", "'x' as id", "label as home", "0 as `group`", "1 as m").repartition(5)
    got = embedding_dedup.near_dups(df).collect()
    assert len(got) == len(rows) and len(pairs) > 1000
    assert collections.Counter((x.vec_id, x.n_links) for x in got if x.n_links) == collections.Counter((g[0], n) for g, n in zip(good, links) if n)
    for x in got:
        assert (x.vec_id is None or x.component_id == star.get(x.vec_id, x.vec_id)) and x.kept == (x.vec_id == x.component_id)
    assert not embedding_dedup.near_dups(df.limit(0)).collect()


def weak(text):
    """A digest with many collisions."""
    return F.substring(exact_dedup.digest_of(text), 1, 1)


@pytest.mark.parametrize("digest", [exact_dedup.digest_of, weak])
def test_exact_dedup(odd, none, digest):
    groups = collections.defaultdict(list)
    for x in odd.collect():
        groups[lower(x.text)].append(x.doc_id)
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    want = collections.Counter((i, largest(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()
    if digest is exact_dedup.digest_of:
        assert collections.Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    assert collections.Counter((x.doc_id, x.keep_id, x.group_size) for x in got) == collections.Counter(k[:3] for k in want.elements())
    assert sum(x.kept for x in got) == len(groups) and all(x.doc_id == x.keep_id for x in got if x.kept)
    kept = exact_dedup.keep_one(odd, digest=digest)
    assert kept.columns == odd.columns and sorted(lower(x.text) for x in kept.collect()) == sorted(groups)
    assert not exact_dedup.exact_dedup(none, digest=digest).collect() and not exact_dedup.keep_one(none, digest=digest).collect()


def test_digest_index(spark, odd):
    """Memtables are flushed apart, merged in levels of at most fanout runs, and asked through their filters."""
    rows = odd.repartition(12).select(exact_dedup.digest_of(F.col("text")).alias("digest"), F.col("doc_id").alias("id"))
    index = exact_dedup.DigestIndex(spark, fanout=4)
    for _ in range(2):
        index.flush(rows)
    level = index.compact()
    assert index.rows().select("run").distinct().count() == 24 and [x.select("run").distinct().count() for x in index.levels] == [6, 2, 2, 1]
    for x in [*index.flushed, *index.levels]:
        for _, file in x.select("run", "digest", F.input_file_name().alias("file")).toPandas().groupby("file"):
            found = [(r, bytes(d)) for r, d in zip(file["run"], file["digest"])]
            assert found == sorted(found)
    assert level.count() == level.select("digest").distinct().count() and level.agg(F.sum("n_rows")).first()[0] == 2 * odd.count()
    assert {x.id for x in index.lookup([hashlib.sha256(b"one two").digest()]).collect()} == {8, 9}


def test_dedup_uses_its_index(spark, odd, monkeypatch):
    """The main path flushes several memtables, merges them in levels, and reads texts again through the filter alone."""
    made, asked = [], []
    compact, keep = exact_dedup.DigestIndex.compact, exact_dedup.KeyFilter.keep
    monkeypatch.setattr(exact_dedup.DigestIndex, "compact", lambda self: (level := compact(self)) and made.append((self.rows().select("run").distinct().count(), len(self.levels))) or level)
    monkeypatch.setattr(exact_dedup.KeyFilter, "keep", lambda self, rows, h: asked.append((rows.count(), (got := keep(self, rows, h)).count())) or got)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3900).cast("string")).alias("text")).repartition(9)
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == 3900
    assert made == [(9, 2)]
    ((before, after),) = asked
    assert before == 4000 and 200 <= after < 800
    monkeypatch.setattr(exact_dedup.KeyFilter, "keep", lambda self, rows, h: rows.limit(0))
    assert exact_dedup.exact_dedup(odd, digest=lambda text: F.substring(exact_dedup.digest_of(F.left(text, F.lit(0))), 1, 1)).select("keep_id").distinct().count() <= 2  # no bytes, no verdict on collisions


def shingle_truth(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    return sets, dict(graph.spanning_edges(pairs))


def test_minhash_dedup(odd, none):
    sets, star = shingle_truth([(x.doc_id, x.text) for x in odd.collect()])
    size = dict(sets)
    got = minhash_dedup.near_dups(odd).collect()
    assert len(got) == len(sets) and len(star) > 20
    for x in got:
        if x.doc_id is not None:
            assert x.component_id == star.get(x.doc_id, x.doc_id) and x.n_shingles == len(size[x.doc_id])
        assert x.kept == (x.doc_id == x.component_id)
    kept = minhash_dedup.keep_one(odd)
    ids = collections.Counter(x.doc_id for x in kept.collect())
    assert kept.columns == odd.columns and ids[None] == 2 and {i for i in ids if i is not None} == {i for i in size if i is not None and star.get(i, i) == i} and all(n == 1 for i, n in ids.items() if i is not None)
    assert not minhash_dedup.near_dups(none).collect() and not minhash_dedup.keep_one(none).collect()


def test_pigeonhole():
    """Signatures within the guaranteed distance share a key."""
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 65536, minhash_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = r.choice(minhash_dedup.SYMBOLS, minhash_dedup.GUARANTEED, replace=False)
        b[at] += 1
        x, y = minhash_dedup.signature_keys(np.stack([a, b]))
        assert (x == y).any()


def test_minhash_blocks(spark, monkeypatch):
    """Variants that are similar to their base alone, which isn't their bucket's first: found by blocks of any size."""
    r = random.Random(5)
    rows = []
    for group in range(3):
        base = ["".join(r.choice("abcdeimnorst") for _ in range(6)) for _ in range(60 + group)]
        rows += [(100 * group + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(4, 56)]
        rows.append((100 * group + 99, " ".join(base)))
    _, star = shingle_truth(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4, 512):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        assert {x.doc_id: x.component_id for x in minhash_dedup.near_dups(docs).collect()} == {i: star.get(i, i) for i, _ in rows}


@pytest.mark.parametrize("block, threshold", [(3, 75), (512, 75), (3, 50), (512, 90)])
def test_prefixes_lose_no_pair(spark, monkeypatch, block, threshold):
    """All pairs of different components with a common key that share enough come out of the prefixes, whatever their sizes; others rarely do."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    r = random.Random(block + threshold)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(160):
        words = list(base[: r.choice([30, 60, 75, 90])])
        for _ in range(r.choice([0, 1, 2, 3, 9])):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = {k: minhash_dedup.shingle_set(t.encode()) for k, t in enumerate(texts)}
    sigs = {k: minhash_dedup.signature(s) for k, s in sets.items()}
    comp = {k: 0 if k % 3 else k for k in sets}  # one large component
    keys = {k: set(minhash_dedup.signature_keys(sig[None]).ravel().tolist()) for k, sig in sigs.items()}
    want = {(a, b) for a in sets for b in range(a + 1, 160) if comp[a] != comp[b] and keys[a] & keys[b] and minhash_dedup.jaccard_at_least(sets[a], sets[b], threshold)}
    rows = spark.createDataFrame([(k, comp[k], len(sets[k]), sigs[k].tobytes()) for k in sets], "id long, comp long, n long, sig binary")
    prefixes = minhash_dedup._prefixes(rows, spark.createDataFrame(list(enumerate(texts)), "id long, body string"), threshold).cache()
    pairs = minhash_dedup._cross_pairs(prefixes, rows, threshold, False).collect()
    got = {(x.a, x.b) for x in pairs}
    alike = lambda a, b: (-int((sigs[a] == sigs[b]).sum()), b)
    best = {a: min((b for p in got if a in p for b in p if b != a), key=lambda b: alike(a, b)) for a in {x for p in got for x in p}}
    assert {(x.a, x.b) for x in minhash_dedup._cross_pairs(prefixes, rows, threshold, True).collect()} == {(min(p), max(p)) for p in best.items()}
    assert len(got) == len(pairs) and want <= got and all(comp[a] != comp[b] and keys[a] & keys[b] for a, b in got)
    assert len(want) > 50 and len(got) < 0.8 * 160 * 159 / 2


def test_templates_stay_linear(spark, monkeypatch):
    """Documents that share a template, but not enough of it, meet under keys; their prefixes don't."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeimnorst") for _ in range(6))
    seen = {}
    materialize = minhash_dedup.materialize
    monkeypatch.setattr(minhash_dedup, "materialize", lambda df, label, *a: seen.__setitem__(label, (out := materialize(df, label, *a)).count()) or out)
    for own in (45, 22):  # similarities of some 0.45 and 0.65
        base = [word() for _ in range(100)]
        for n in (150, 450):
            docs = spark.createDataFrame([(k, " ".join([*base, *(word() for _ in range(own))])) for k in range(n)], "doc_id long, text string")
            assert minhash_dedup.near_dups(docs).filter("kept").count() == n
            assert seen["open-sets"] > 0.9 * n and seen["prefixes"] <= 10 * n and seen["blocks"] == 0 and seen["cross-pairs"] == 0


def test_minhash_rows_of_one_identifier(spark):
    """Rows that share an identifier but not their text stay; of like ones the same one on each run."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeimnorst") for _ in range(6))
    base = [[word() for _ in range(60)] for _ in range(4)]
    change = lambda b, k: " ".join([*b[:k], "changed", *b[k + 1 :]])
    rows = [(1, " ".join(base[0]), 1), (1, " ".join(base[1]), 2), (1, " ".join(base[0]).upper(), 3), (1, change(base[0], 30), 4), (2, change(base[0], 20), 5), (2, " ".join(base[2]), 6), (3, change(base[2], 9), 7), (1, " ", 8), (1, None, 9), (2, "", 10), (5, " ".join(base[3]), 11), (5, " ".join(base[3]), 12), (5, " ".join(base[3]), 12), (None, " ".join(base[3]), 13), (None, change(base[1], 5), 14)]
    sets = [minhash_dedup.shingle_set((t or "").encode()) for _, t, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and minhash_dedup.jaccard_at_least(sets[a], sets[b], 75)]
    star = dict(graph.spanning_edges(links))
    group = [star.get(k, k) for k in range(len(rows))]
    seen = []
    for parts in (1, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(parts)
        found = sorted(repr(tuple(x)) for x in minhash_dedup.near_dups(docs).collect())
        least = lambda k: rows[k][0] if not len(sets[k]) else min((rows[m][0] for m in range(len(rows)) if group[m] == group[k]), default=None)
        want = [(i, len(sets[k]), None if i is None else least(k)) for k, (i, _, _) in enumerate(rows)]
        assert found == sorted(repr((i, n, c, i == c)) for i, n, c in want)
        kept = sorted(minhash_dedup.keep_one(docs).collect(), key=repr)
        seen.append(kept)
        of = [next(k for k, row in enumerate(rows) if row == tuple(x)) for x in kept]
        assert len(kept) == len({group[k] for k in range(len(rows))}) and {group[k] for k in of} == set(group) and all(rows[k][0] == least(k) for k in of if rows[k][0] is not None)
    assert seen[0] == seen[1] == seen[2] and {2, 6, 8, 9, 10, 13, 14} <= {x.id for x in seen[0]}


def test_hot_keys_meet_like_others(spark, monkeypatch):
    r = np.random.default_rng(3)
    sigs = r.integers(0, 3, (300, minhash_dedup.SYMBOLS)).astype(np.uint16)
    by_key = collections.defaultdict(set)
    for i, keys in enumerate(minhash_dedup.signature_keys(sigs).reshape(300, -1).view(np.int64)):
        for slot, key in enumerate(keys):
            by_key[int(key)].add((i, slot))
    want = sorted((key, i, slot, min(m)[0]) for key, m in by_key.items() if len(m) > 1 for i, slot in m)
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "id long, sig binary").repartition(3)
    for least in (2, 8, 10**9):
        monkeypatch.setattr(minhash_dedup, "HOT_LEAST", least)
        assert sorted((x.key, x.id, x.slot, x.center) for x in minhash_dedup._buckets(reps).collect()) == want


def test_smallest_members_meet_in_copies(spark, monkeypatch):
    """Large groups of near copies, all of whose buckets are hot or none: each meets its smallest member, whatever copies there are."""
    r = random.Random(8)
    rows = []
    for group in range(2):
        base = ["".join(r.choice("abcdeimnorst") for _ in range(6)) for _ in range(80)]
        rows += [(1000 * group + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(80)]
    _, star = shingle_truth(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for spread, least in ((3, 2), (3, 10**9), (1000, 2)):
        monkeypatch.setattr(minhash_dedup, "SPREAD", spread)
        monkeypatch.setattr(minhash_dedup, "HOT_LEAST", least)
        assert {x.doc_id: x.component_id for x in minhash_dedup.near_dups(docs).collect()} == {i: star.get(i, i) for i, _ in rows}
    stars = spark.createDataFrame([(a, b) for a in (1, 2) for b in range(10, 40)], "a long, b long")
    salts = spark.createDataFrame([(1, 7)], "a long, salts int")
    met = minhash_dedup._salted(stars, salts).join(minhash_dedup._copies(stars.select("a").distinct(), salts), ["a", "salt"]).collect()
    assert sorted((x.a, x.b) for x in met) == [(a, b) for a in (1, 2) for b in range(10, 40)] and {x.salt for x in met if x.a == 1} == set(range(7)) and {x.salt for x in met if x.a == 2} == {0}


def test_minhash_on_documents(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _, star = shingle_truth(docs)
    assert {x.doc_id: x.component_id for x in QUERIES["op10_minhash_dedup"](spark, SF).collect()} == {i: star.get(i, i) for i, _ in docs}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, rows = docs, docs.collect()
        docs = stage(spark, docs, SF)
        assert name.startswith("BPE") or docs.columns == before.columns
        after = docs.collect()
        if name == "toxicity":
            bad = {x.doc_id for x in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
            gone = {x.doc_id for x in rows} - {x.doc_id for x in after}
            assert len(gone - bad) <= 0.1 * len(rows)
        elif name == "exact dedup":
            assert sorted(x.doc_id for x in after) == sorted({lower(x.text): x.doc_id for x in sorted(rows, key=lambda x: x.doc_id)}.values())
        elif name.startswith("MinHash"):
            _, star = shingle_truth([(x.doc_id, x.text) for x in rows])
            assert sorted(x.doc_id for x in after) == sorted(x.doc_id for x in rows if star.get(x.doc_id, x.doc_id) == x.doc_id)
        elif name.startswith("mixing"):
            assert {x.doc_id for x in after} <= {x.doc_id for x in rows} and after
        else:
            assert sorted(x.doc_id for x in after) == sorted(x.doc_id for x in rows)


def test_many_cells():
    """Over a thousand centroids: gaps come from a matrix product, and the assignment shows every pair in one cell. Other groups stay whole."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 6)) * 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centroids = embedding_dedup.spherical_kmeans(unit, 1100, 2)
    ids = [1100, *range(3000), 5000, 5001]
    vecs = [centroids.tobytes(), *(v.tobytes() for v in x), x[0].tobytes(), x[1].tobytes()]
    groups, home = [7] * 3001 + [8, 9], [-1] + [0] * 3002
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), pa.array([1] * 3003, pa.int64()), pa.array(vecs, pa.binary()), pa.array(groups, pa.int64()), pa.array(home, pa.int32())], names=["id", "rep", "m", "vec", "group", "home"])
    shown = collections.defaultdict(dict)
    for part in embedding_dedup._cells(0.98, 0)([batch.slice(0, 1700), batch.slice(1700)]):
        for i, home, cell in zip(*(part.column(k).to_pylist() for k in (0, 5, 6))):
            shown[i][cell] = home
    assert shown.pop(5000) == shown.pop(5001) == {-1: 1} and len(shown) == 3000
    for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))):
        assert sum(shown[a][c] | shown[b][c] for c in shown[a].keys() & shown[b].keys()) == 1
    assert all(sum(cells.values()) == 1 for cells in shown.values())


def test_cells_stay_bounded(spark, monkeypatch):
    """A hundredth of the production constants: the largest cell doesn't grow with the number of vectors, and few are shown often."""
    for name, value in (("CELL_ROWS", 40), ("PER_FIT", 200), ("MOST_CELLS", 12)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(4)
    largest, shown = {}, {}
    for n in (500, 2000, 8000):
        x = rng.normal(size=(n // 25, 24))[rng.integers(0, n // 25, n)] + rng.normal(size=(n, 24)) * 0.1
        rows = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(x)], "id long, vec binary").selectExpr("id", "id as rep", "1L as m", "vec", "5L as `group`", "0 as home")
        level = 0
        while (cut := embedding_dedup._cut(rows, n, 0.98, level)) is not None and level < embedding_dedup.LEVELS:
            rows, level = cut, level + 1
        largest[n], shown[n] = rows.groupBy("group").count().agg(F.max("count")).first()[0], rows.count() / n
    assert max(largest.values()) <= 40 * embedding_dedup.SPLIT and max(shown.values()) < 6
