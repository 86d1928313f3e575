"""BPE against the tokenizers library, character by character, and its fits against merging anew."""

import random
import sys
import unicodedata
from pathlib import Path

import pytest

from lakeloom.llm import bpe

Tokenizer = pytest.importorskip("tokenizers").Tokenizer


@pytest.fixture(scope="module")
def trie():
    spec = Path(bpe.default_vocabulary()).read_text(encoding="utf-8")
    return bpe.TrieBpe(spec, bpe.unicode_differences(spec))


def test_every_letter_number_and_sign(trie):
    """Each code point of the planes that hold letters, and each 37th of the others, inside a word."""
    library = Tokenizer.from_file(bpe.default_vocabulary())
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or 0x2FF00 <= c < 0x34000 or c % 37 == 0)]
    texts = ["A" + chr(c) + "b" for c in points]
    wrong = [hex(c) for c, e, (ids, _) in zip(points, library.encode_batch(texts, add_special_tokens=False), trie.encode(texts)) if " ".join(map(str, e.ids)) != ids]
    assert not wrong


def test_every_pair_of_marks(trie):
    """Each mark before and after each other one, behind a letter, and with signs that the library knows or not between them."""
    normal = Tokenizer.from_file(bpe.default_vocabulary()).normalizer.normalize_str
    mine = lambda t: trie.composed(t).replace("Σ", "σ").lower()
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    assert len(marks) > 900
    wrong = [(a, b) for a in marks for b in marks if (t := f"e{a}{b}") and normal(t) != mine(t)]
    assert not wrong
    r = random.Random(4)
    pieces = [*marks, *"aeoçéΑ가각\U00011935\U00011930\U00011938"]
    for _ in range(20_000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(2, 9)))
        assert normal(t) == mine(t.translate(trie.lower_of)), ascii(t)


def test_marks_reach_the_ids(trie):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    texts = [f"e{a}{b} {b}{a}" for a in marks for b in ("\u0301", "\u0323", "\u0d3c", "\u09fe")] + ["\u05a2\u0d3c", "\u09fe\u0c55", "\U00011935\U00011930"]
    wrong = [t for t, e, (ids, _) in zip(texts, library.encode_batch(texts, add_special_tokens=False), trie.encode(texts)) if " ".join(map(str, e.ids)) != ids]
    assert not wrong


def test_fits_are_those_of_merging(trie):
    r = random.Random(6)
    tokens = sorted(t for t in trie.names if t in trie.symbols)
    some = r.sample(tokens, 400) + [trie.vocab[t] for t in ("a", "aa", "th", "the", "ing", "er")]
    alone = {t for t in some if trie.merged([trie.token_of[c] for c in trie.symbols[t]])[0] == [t]}
    assert alone == {t for t in some if trie.fit(-1, t)}
    for _ in range(4000):
        a, b = r.choice(sorted(alone)), r.choice(some)
        if not trie.symbols[a][-1] > "\xff":  # a word's last symbol ends it
            assert trie.fit(a, b) == (trie.merged([trie.token_of[c] for c in trie.symbols[a] + trie.symbols[b]])[0] == [a, b])


def test_words_not_met_again_are_dropped(trie, monkeypatch):
    """Few kept words and steps, and slices of a text each, change nothing."""
    r = random.Random(7)
    texts = [" ".join("".join(r.choice("abtheins") for _ in range(r.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    want = list(trie.encode(texts))
    for name, value in (("KEPT_WORDS", 50), ("KEPT_STEPS", 40), ("SLICE_CHARS", 200)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.TrieBpe(Path(bpe.default_vocabulary()).read_text(encoding="utf-8"))
    assert list(small.encode(texts)) == want and len(small.known) < 500


def test_without_the_library_nothing_is_encoded(spark, monkeypatch):
    """Python's own Unicode tables give other ids, so a missing library must not look like a result."""
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    with pytest.raises(ImportError):
        bpe.tokenize(spark.createDataFrame([(1, "e\u0c3c\u0301")], "doc_id long, text string"))
