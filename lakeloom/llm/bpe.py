"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a slice of rows form a trie of byte symbols, the last symbol of a word being its word-end form. Sorted
words list such a trie in depth-first order: each enters it where it parts from the word before it, so only the nodes
below that are visited. A visited node gets the last token of its prefix's encoding: the one token that ends there and is
compatible with the last token of what precedes it (two tokens are compatible if no merge across their border comes
before the merges that make them). A prefix that words share is thus encoded once; going back over the last tokens
gives a word's encoding. Which tokens can end at a node is a state that is handed down like the last tokens.
Words are encoded where they are read, so no text is shuffled. Encoded words are kept for later slices of the task; once
they are many, those not met again are dropped.

Letters, digits, lower case and composed marks follow the installed tokenizers library, whose Unicode tables are older or newer than those
of Python and of the regex module; where it is missing, nothing is encoded: ImportError.

Defined results: a null text counts as empty; empty texts have no tokens; texts are processed whole, however long; rows
that repeat are encoded alike; columns other than the identifier's and the text's aren't looked at; an empty table gives an
empty result. The vocabulary is a JSON file of the tokenizers library (byte-level BPE with a word-end suffix); its path
is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory, table

KEPT_WORDS, KEPT_STEPS, SLICE_CHARS = 100_000, 150_000, 1_000_000
BLOCK_CHARS = 4096  # code points that are compared with the library at a time
ALWAYS = 1 << 60  # a merge rank beyond all others


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def char_ranges(chars: set[str]) -> str:
    """The inside of a character class, in ranges."""
    points = np.array(sorted(map(ord, chars)), int)
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in np.split(points, np.flatnonzero(np.diff(points) > 1) + 1))


def unicode_differences(spec: str) -> tuple[dict[str, str], dict[str, str], str]:
    """Where the tokenizers library differs from Python: for `L` and `N` the characters that it doesn't class so, lower-case forms, and marks that it doesn't know.

    Characters are asked for that the regex module classes as letters or numbers, or that Python changes or doesn't know. Marks that
    the library doesn't know are starters to it: they neither change places with others nor join what stands before them.
    """
    import regex
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    split = {k: pre_tokenizers.Split(Regex(rf"\p{{{k}}}+"), "removed", invert=True).pre_tokenize_str for k in "LN"}
    lower = lambda c: unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()
    normal = Tokenizer.from_str(spec).normalizer.normalize_str
    unlike, lowered, unknown = {k: [] for k in split}, {}, set()
    for block in range(0x80, 0x110000, BLOCK_CHARS):  # all at once would leave the driver's Python 100 MB larger
        every = [chr(c) for c in range(block, min(block + BLOCK_CHARS, 0x110000)) if not 0xD800 <= c < 0xE000]
        classed = {k: regex.findall(rf"\p{{{k}}}", "".join(every)) for k in split}
        for k, mine in classed.items():
            unlike[k] += sorted(set(mine).difference(*(word for word, _ in split[k]("".join(mine)))))
        asked = {c for c in every if lower(c) != c} | {c for mine in classed.values() for c in mine if unicodedata.category(c) == "Cn"}
        lowered |= {c: low for c in asked if (low := normal(c)) != lower(c)}
        swapped = [(c, f"x{c}\u0334" if unicodedata.combining(c) > 1 else f"x\u0301{c}") for c in every if unicodedata.combining(c)]
        joined = [(whole[1], whole) for c in every if len(whole := unicodedata.normalize("NFD", c)) == 2 and unicodedata.normalize("NFC", whole) == c]
        unknown |= {c for c, text in swapped + joined if normal(text) != lower(text)}
    return {k: "".join(out) for k, out in unlike.items()}, lowered, "".join(sorted(unknown))


class TrieBpe:
    def __init__(self, spec: str, differences: tuple[dict[str, str], dict[str, str], str] = ({"L": "", "N": ""}, {}, "")):
        import regex

        spec = json.loads(spec)
        model = spec["model"]
        self.vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        # A symbol is one character here: the byte, plus 256 in word-end form.
        as_byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        self.token_of: dict[str, int] = {}
        for token, i in self.vocab.items():
            ends = token.endswith(suffix)
            s = (token[: -len(suffix)] if ends else token).translate(as_byte)
            self.token_of[s[:-1] + chr(ord(s[-1]) + 256) if ends else s] = i
        self.symbols = {i: s for s, i in self.token_of.items()}
        self.sizes = {i: len(s) for s, i in self.token_of.items()}
        self.beginnings = {s[:k] for s in self.token_of for k in range(1, len(s) + 1)}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        unlike, self.lower_of = differences[0], str.maketrans(differences[1])
        self.unlike = {*unlike["L"], *unlike["N"], *differences[1]}
        self.maybe_unlike = re.compile(rf"[{min(self.unlike)}-\U0010ffff]").search if self.unlike else lambda text: None
        self.cut_marks = re.compile(f"([{char_ranges({*differences[2]})}]+)").split if differences[2] else None
        self.least_mark = min(differences[2], default="\U0010ffff")
        for k, out in unlike.items():  # the same pattern, with classes that leave some characters out
            if out:
                pattern = pattern.replace(rf"\p{{{k}}}", rf"[\p{{{k}}}--[{char_ranges({*out})}]]")
        self.exact_pattern, self.exact_words = "(?V1)" + pattern, None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        # White space is in none of the pattern's classes, so turning runs of it into blanks first would change no word.
        ascii_pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[\p{L}]+", "[a-z]+").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", r"\t-\r a-z0-9")
        self.ascii_words = re.compile(ascii_pattern).findall if "\\p" not in ascii_pattern else self.words
        self.made: dict[int, tuple[int, int, int]] = {}  # a token's last merge: its rank, and what it merges
        self.fits: dict[int, bool] = {}
        self.steps: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merged(self, tokens: list[int]) -> tuple[list[int], tuple[int, int, int]]:
        """Merge by rank, lowest first, leftmost first among equals; also the last merge made."""
        last = (-1, -1, -1)
        while len(tokens) > 1:
            best = min((self.ranks.get(p, (ALWAYS, 0)) + (k,) for k, p in enumerate(zip(tokens, tokens[1:]))))
            if best[0] == ALWAYS:
                break
            k = best[2]
            last = (best[0], *tokens[k : k + 2])
            tokens[k : k + 2] = [best[1]]
        return tokens, last

    def last_merge(self, token: int) -> tuple[int, int, int] | None:
        """The merge that makes a token of its own symbols; None if they merge to something else."""
        if (m := self.made.get(token)) is None:
            got, m = self.merged([self.token_of[c] for c in self.symbols[token]])
            self.made[token] = m = m if got == [token] else ()
        return m or None

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that are a token's border (side 1: its end, 2: its start) while it is made, each with the rank of the merge that ends it."""
        out, until = [(token, ALWAYS)], self.last_merge(token)
        while until[0] >= 0:
            token = until[3 - side]
            out.append((token, until[0]))
            until = self.last_merge(token)
        return out[::-1]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are; left < 0: whether right alone is what its symbols merge to."""
        if left < 0 or not self.last_merge(right):
            return self.last_merge(right) is not None
        one, two = self.edge(left, 1), self.edge(right, 2)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = one[i], two[j]
            across = self.ranks.get((a, b), (ALWAYS,))[0]
            if across < min(a_until, b_until + 1):  # among equal merges the leftmost comes first
                return False
            if a_until == b_until == ALWAYS:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def step(self, key: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The longest end of key that begins a token, and the tokens that key ends with, longest first, with their sizes."""
        if len(self.steps) > KEPT_STEPS:
            self.steps.clear()
        state = key
        while state not in self.beginnings:
            state = state[1:]
        ends = tuple((self.token_of[s], len(s)) for k in range(len(state)) if (s := state[k:]) in self.token_of)
        found = self.steps[key] = (state, ends)
        return found

    def path(self, word: str) -> str:
        b = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")
        return b[:-1] + chr(ord(b[-1]) + 256)

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet: walk their trie depth first, handing states and last tokens down it."""
        states, last, before = [""], [-1], ""
        names, sizes, fits, steps = self.names, self.sizes, self.fits, self.steps
        for path, word in sorted([(self.path(w), w) for w in words]):
            size = len(path)
            d, most = 0, min(size, len(before))
            while d < most and path[d] == before[d]:
                d += 1
            del states[d + 1 :], last[d + 1 :]
            state, before = states[d], path
            while d < size:
                key = state + path[d]
                d += 1
                state, ends = steps.get(key) or self.step(key)
                for token, length in ends:
                    left = last[d - length]
                    pair = left << 20 | token
                    if (ok := fits.get(pair)) is None:
                        if len(fits) > KEPT_STEPS:
                            fits.clear()
                        ok = fits[pair] = self.fit(left, token)
                    if ok:
                        break
                else:
                    raise AssertionError("a byte symbol always fits")
                states.append(state)
                last.append(token)
            ids = []
            while d:
                token = last[d]
                ids.append(token)
                d -= sizes[token]
            ids.reverse()
            self.known[word] = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]))

    def exact(self):
        """Finds words by the classes of the tokenizers library; few texts need it."""
        import regex

        if self.exact_words is None:
            self.exact_words = regex.compile(self.exact_pattern).findall
        return self.exact_words

    def composed(self, text: str) -> str:
        """The text in NFC as the library knows it: marks that it doesn't know stay where they are and cut what is normalised."""
        if self.cut_marks and max(text) >= self.least_mark and len(parts := self.cut_marks(text)) > 1:
            return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(parts))
        return unicodedata.normalize("NFC", text)

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand for themselves, as a NUL and their text."""
        out: list[str] = []
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                out.append("\0" + part)
            elif part:
                if part.isascii():
                    out += self.ascii_words(part.lower())
                    continue
                part, find = self.composed(part), self.words
                if self.maybe_unlike(part) and not self.unlike.isdisjoint(part):
                    part, find = part.translate(self.lower_of), self.exact()
                out += find(part.replace("Σ", "σ").lower())  # each character is lower-cased by itself, so a final sigma has no form of its own
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its decoded text; words meet the trie slice by slice."""
        at = 0
        while at < len(texts):
            size, words = 0, []
            while at < len(texts) and (not words or size + len(texts[at]) <= SLICE_CHARS):
                words.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.known) > KEPT_WORDS:
                self.older, self.known = self.known, {}
            new = set().union(*words) - self.known.keys()
            again = new & self.older.keys()
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            new -= again
            for w in [w for w in new if w[0] == "\0" and w[1:] in self.special]:
                self.known[w] = (str(self.special[w[1:]]), w[1:])
                new.discard(w)
            self.learn(new)
            for ws in words:
                ids, names = zip(*map(self.known.__getitem__, ws)) if ws else ((), ())
                yield " ".join(ids), " ".join(names)


def encoder(spec: str, differences: tuple[dict[str, str], dict[str, str], str], with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        bpe = TrieBpe(spec, differences)  # a task's own: Spark deals tasks over all of its idle workers, and each would keep one
        try:
            for batch in batches:
                ids, counts, id_hashes, text_hashes = [], [], [], []
                for a, b in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                    counts.append(a.count(" ") + 1 if a else 0)
                    if with_ids:
                        ids.append(np.fromstring(a, np.int32, sep=" "))
                    id_hashes.append(hashlib.sha256(a.encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest())
                cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        finally:
            del bpe
            release_memory()

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each document: id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, the token ids themselves."""
    spec = Path(vocabulary or default_vocabulary()).read_text(encoding="utf-8")  # under 2 MB, read where the driver is
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    encode = encoder(spec, unicode_differences(spec), with_ids)
    release_memory()  # the driver's, of the comparison with the library
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("body")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def detokenize(encoded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """encoded with `decoded`: the token names joined by blanks, as a vocabulary without a decoder is decoded. Null ids give null."""
    spec = Path(vocabulary or default_vocabulary()).read_text(encoding="utf-8")

    @F.arrow_udf("string")
    def names(ids: pa.Array) -> pa.Array:
        s = json.loads(spec)
        of = {i: t for t, i in s["model"]["vocab"].items()} | {t["id"]: t["content"] for t in s["added_tokens"]}
        return pa.array([None if x is None else " ".join(of[i] for i in x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("decoded", names(ids_col))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), with_ids=False)
