"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks, the stretches of text between borders of block elements. Each block has features of its
ancestors (tags, class and id words, whether one is hidden) and of its text (length, link share, punctuation, telling words). The field has two labels,
content and boilerplate, and learns by gradient ascent on the log-likelihood of labelled pages. These are pages of many
layouts, written by `practice_pages` with a label for each block, and at most PAGES of the table's own pages that
mark their article by an <article> or <main> element, which labels their blocks. `labelled` replaces both. What teaches is bounded:
own pages have under TEACH_CHARS characters, and their first TEACH_BLOCKS blocks count. What is extracted is not.
Telling words are a feature where there is one for every TELLING_CHARS characters or so: the odd one in prose tells nothing.

Text: character references decoded, white space inside a block made one blank, blocks joined by two line feeds; scripts, styles
and other elements without page text never become blocks; a slash at the end of such a tag doesn't close it, as in HTML. A quote
that opens an attribute's value and has no partner up to the page's end opens none; from there on tags end at the next `>`. A
script that no end tag closes because of a comment inside ends at its first end tag. A `<` after the last `>` is text. Elements in more than
DEPTH open ones don't add to their blocks' ancestors. Defined results: null and empty pages give empty text; repeated
rows are treated alike; a null page_id or url stays null; further columns aren't looked at; pages of any length take linear
time; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, table

PAGES, PRACTICE, STEPS, PENALTY = 200, 300, 200, 0.0002
TEACH_CHARS, TEACH_BLOCKS, TELLING_CHARS, DEPTH = 50_000, 400, 400, 512
#: Elements that begin and end blocks; elements whose content is no page text; elements without an end tag.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
TO_END = frozenset("script style textarea title".split())  # without an end tag they run to the page's end; the others don't
PAIRED = frozenset("noscript template svg iframe object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag that ends an open element of the second set, up to a parent of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "nav"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
TELLING = re.compile(r"cookie|subscri|newsletter|comment|repl(?:y|ies)|share|sign (?:in|up)|log ?in|advert|sponsor|copyright|©|rights reserved|read more|related|privacy|terms|follow us|menu|search|previous|next", re.I).findall
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A tag's rest in its usual form, with a slash at its end; then the parts of any other.
_PLAIN_TAG = re.compile(r"""(?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`/]+(?=[\s>])))?+)*+\s*(/?)>""")
_SPACE, _ATTRIBUTE_NAME, _EQUALS, _UNQUOTED = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_EMPTY_COMMENT, _COMMENT_END = re.compile("-?>"), re.compile("--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in TO_END}
_SCRIPT_PART = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAYBE_HIDDEN = re.compile("hidden|display", re.I)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([^;!]*)", re.I)
HIDDEN = "[hidden]"  # stands among an element's words, and can't be one of them


def hidden(attributes: str) -> bool:
    """Whether an opening tag's attributes hide its element; words inside other attributes' values don't."""
    if not _MAYBE_HIDDEN.search(attributes):
        return False
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))  # the first of a name holds
    display = _DISPLAY.findall(found.get("style", ""))
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or [d.strip().lower() for d in display[-1:]] == ["none"]


class Tokenizer:
    """A page's tags by the states of HTML's tokenizer: data, attribute names and values, raw text, scripts with comments inside, and comments.

    Where a state would swallow the page's rest, as a quote without a partner does, that state is left out from there on.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.nested = page, True, True
        self.last = {mark: page.rfind(mark) for mark in (">", '"', "'", "]]>")}

    def tag(self, pos: int) -> tuple[int, bool]:
        """Where the tag ends whose attributes begin here, and whether a slash of its own, not of a value, closes it."""
        page = self.page
        if self.quotes and (m := _PLAIN_TAG.match(page, pos)):
            return m.end(), bool(m[1])
        at, start = pos, pos
        while self.quotes:
            space = _SPACE.match(page, at)
            at = space.end()
            if page.startswith(">", at):
                return at + 1, space[0].endswith("/")
            if at >= len(page):
                self.quotes = False
                break
            at = _ATTRIBUTE_NAME.match(page, at).end()
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ('"', "'"):
                    if at >= self.last[quote]:
                        self.quotes = False
                    at = page.find(quote, at + 1) + 1
                elif quote != ">":
                    at = _UNQUOTED.match(page, at).end()
        end = page.find(">", start) + 1
        return end, page[end - 2] == "/"

    def comment(self, at: int) -> int:
        """The end of the comment that opens here: `-->` or `--!>`, or at once `>` or `->`."""
        m = _EMPTY_COMMENT.match(self.page, at + 4) or _COMMENT_END.search(self.page, at + 4)
        return m.end() if m else len(self.page)

    def raw(self, name: str, at: int) -> int:
        """The end of the end tag that closes a raw text element."""
        if name == "script" and self.nested:
            hidden = inner = False  # inside <!-- -->; inside a script in there
            pos = at
            while m := _SCRIPT_PART.search(self.page, pos):
                pos = m.end()
                if m[0] == "<!--":
                    hidden, pos = True, pos - 2
                elif m[0] == "-->":
                    hidden = inner = False
                elif m[1]:
                    if not inner:
                        return self.tag(pos)[0] or len(self.page)
                    inner = False
                else:
                    inner = hidden
            self.nested = False  # no end that way: the first end tag is one
        closing = _RAW_END[name].search(self.page, at)
        return (closing and self.tag(closing.end())[0]) or len(self.page)

    def tags(self) -> list[tuple[int, int, bool, str, str, bool]]:
        """(start, end, whether it closes, name, attributes, slash) in order; comments, declarations and what elements of TO_END hold have no name."""
        out, at, page = [], 0, self.page
        while 0 <= (at := page.find("<", at)):
            if page.startswith("<!--", at):
                end = self.comment(at)
                out.append((at, end, False, "", "", False))
            elif at > self.last[">"]:
                break
            elif m := _NAME.match(page, at):
                end, slash = self.tag(m.end())
                name = m[2].lower()
                attributes = page[m.end() : end - 1 - slash]
                if name in TO_END and not m[1]:  # a slash closes foreign elements alone
                    end, name = self.raw(name, end), ""
                out.append((at, end, bool(m[1]), name, attributes, slash))
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find("]]>", at) + 3 if page.startswith("<![CDATA[", at) and at < self.last["]]>"] else page.find(">", at) + 1
                out.append((at, end, False, "", "", False))
            else:
                end = at + 1
            at = end
        return out


def paired_ends(tags: list) -> dict[int, int]:
    """For each tag that opens an element of PAIRED with an end tag: the number of that end tag. Of these, svg alone is closed by a slash."""
    ends, opened = {}, {}
    for k, (_, _, closes, name, _, slash) in enumerate(tags):
        if name in PAIRED:
            if closes and opened.get(name):
                ends[opened[name].pop()] = k
            elif not closes and not (slash and name == "svg"):
                opened.setdefault(name, []).append(k)
    return ends


def blocks_of(page: str) -> list[tuple[str, frozenset[str], frozenset[str], str, int]]:
    """A page's leaf blocks: tag of the nearest ancestor, all ancestors' tags, their class and id words, text, and characters inside links."""
    out, stack, parts = [], [], []  # stack: (tag, tags so far, words so far)
    in_link, linked = False, 0
    none: frozenset[str] = frozenset()

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append((*(stack[-1] if stack else ("", none, none)), text, linked))
        parts, linked = [], 0

    def read(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text)
            parts.append(text)
            linked += len(text) * in_link

    tags = Tokenizer(page).tags()
    ends = paired_ends(tags)
    at = skip = 0
    deep: Counter = Counter()  # open elements beyond DEPTH
    for k, (start, end, closes, tag, attributes, _) in enumerate(tags):
        if k < skip:
            continue
        read(page[at:start])
        at = end
        if closes:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS:
                close()
                if deep[tag]:
                    deep[tag] -= 1
                    continue
                for j in range(len(stack) - 1, -1, -1):
                    if stack[j][0] == tag:
                        del stack[j:]
                        deep.clear()
                        break
        elif k in ends:
            skip, at = ends[k] + 1, tags[ends[k]][1]
            parts.append(" ")
        elif tag in PAIRED:
            parts.append(" ")
        elif tag == "br":
            parts.append("\n")
        elif tag == "a":
            in_link = True
        elif tag in BLOCKS:
            close()
            in_link = in_link and tag not in ("li", "nav", "article", "footer", "section")
            if stack and stack[-1][0] == "p" and tag not in ("button", "label", "option", "select"):
                stack.pop()
            if tag in IMPLIED:
                implied, parents = IMPLIED[tag]
                for j in range(len(stack) - 1, -1, -1):
                    if stack[j][0] in parents:
                        break
                    if stack[j][0] in implied:
                        del stack[j:]
                        break
            if tag not in VOID and len(stack) >= DEPTH:
                deep[tag] += 1
            elif tag not in VOID:
                words = {w for g in _NAMES.findall(attributes) for w in re.findall("[a-z]+", "".join(g).lower())} | ({HIDDEN} if hidden(attributes) else set())
                _, above, said = stack[-1] if stack else ("", none, none)
                stack.append((tag, above if tag in above else above | {tag}, said if words <= said else said | words))
        elif not tag and page.startswith("<", start) and page[start + 1 : start + 2].isalpha():
            parts.append(" ")  # a script or the like
    read(page[at:])
    close()
    return out


def features_of(blocks: list) -> list[list[str]]:
    """Names of the features that hold for each block."""
    found, has = [], {"article", "main"}.intersection(set().union(*{b[1] for b in blocks}))
    for k, (leaf, tags, words, text, linked) in enumerate(blocks):
        f = ["bias", f"leaf:{leaf}", f"size:{min(8, int(math.log2(1 + text.count(' '))))}", f"links:{round(4 * linked / max(1, len(text)))}"]
        f += [f"in:{t}" for t in tags] + [f"class:{w}" for w in words]
        if has:
            f.append("inside" if has & tags else "outside")
        told = TELLING(text)
        f += [f"tells:{w}" for w in {w.lower() for w in told}] if len(told) * TELLING_CHARS > len(text) else []
        f.append("stop" if text[-1:] in ".!?…" else "open")
        if not k:
            f.append("first")
        if k == len(blocks) - 1:
            f.append("last")
        found.append(f)
    return found


class Field:
    """Weights of the conditional random field: one a feature (for content against boilerplate), and the transitions."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]]):
        names = sorted({n for f, _ in pages for b in f for n in b})
        self.index = {n: k for k, n in enumerate(names)}
        self.weights, self.moves = np.zeros(len(names)), np.zeros((2, 2))
        if pages:
            self._learn(pages)

    def _learn(self, pages: list) -> None:
        """Full-batch Adam on the penalised mean log-likelihood; sums over labellings by forward-backward, all pages at once."""
        pages = [p for p in pages if p[0]]
        longest = max(len(y) for _, y in pages)
        gold = np.zeros((len(pages), longest), int)
        mask = np.zeros((len(pages), longest), bool)
        cell, feature = [], []
        for p, (blocks, y) in enumerate(pages):
            gold[p, : len(y)], mask[p, : len(y)] = y, True
            for k, names in enumerate(blocks):
                cell += [p * longest + k] * len(names)
                feature += [self.index[n] for n in names]
        cell, feature, total = np.array(cell), np.array(feature), mask.sum()
        pairs = mask[:, 1:]
        told = np.bincount(feature, weights=gold.ravel()[cell], minlength=len(self.weights))
        moved = np.zeros((2, 2))
        np.add.at(moved, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        theta = np.zeros(len(self.weights) + 4)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            w, t = theta[:-4], theta[-4:].reshape(2, 2)
            score = np.zeros((*gold.shape, 2))
            score[:, :, 1] = np.bincount(cell, weights=w[feature], minlength=gold.size).reshape(gold.shape)
            ahead, behind = score.copy(), np.zeros_like(score)
            for k in range(1, longest):
                new = score[:, k] + np.logaddexp(ahead[:, k - 1, :1] + t[0], ahead[:, k - 1, 1:] + t[1])
                ahead[:, k] = np.where(mask[:, k, None], new, ahead[:, k - 1])
            for k in range(longest - 2, -1, -1):
                x = score[:, k + 1] + behind[:, k + 1]
                new = np.stack([np.logaddexp(t[a, 0] + x[:, 0], t[a, 1] + x[:, 1]) for a in (0, 1)], axis=1)
                behind[:, k] = np.where(mask[:, k + 1, None], new, 0)
            norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            chance = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None]) * mask
            joint = ahead[:, :-1, :, None] + t[None, None] + (score + behind)[:, 1:, None, :] - norm[:, None, None, None]
            grad = np.concatenate([told - np.bincount(feature, weights=chance.ravel()[cell], minlength=len(w)), (moved - np.exp(joint[pairs]).sum(axis=0)).ravel()]) / total - PENALTY * theta
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            theta += 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); features never seen in learning weigh nothing."""
        get, w, t = self.index.get, self.weights, self.moves.tolist()
        best, back = None, []
        for names in features:
            s = sum(w[k] for n in names if (k := get(n)) is not None)
            if best is None:
                best = (0.0, s)
                continue
            ways = [(best[0] + t[0][y], best[1] + t[1][y]) for y in (0, 1)]
            back.append([int(b > a) for a, b in ways])
            best = (max(ways[0]), max(ways[1]) + s)
        if best is None:
            return []
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


BOILERPLATE_WORDS = frozenset("nav navbar menu ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert sidebar widget footer comment comments reply replies disqus share social related breadcrumb breadcrumbs newsletter subscribe login search popup modal pagination".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form button menu select option label dialog".split())


def own_labels(blocks: list) -> list[int] | None:
    """Labels of a page that marks its article; None for other pages."""
    if not any({"article", "main"} & b[1] for b in blocks):
        return None
    return [int(bool({"article", "main"} & tags) and not BOILERPLATE_TAGS & tags and not BOILERPLATE_WORDS & words) for _, tags, words, _, _ in blocks]


def practice_pages(n: int = PRACTICE, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    """Pages of varied layout with a label for each of their blocks."""
    r, hide = random.Random(seed), random.Random(seed + 1)

    def prose(least: int, most: int) -> str:
        words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        return " ".join(words).capitalize() + r.choice(["."] * 6 + ["", "!", "?"])

    def many(tag: str, attrs: str, items: list[str], inner: str = "li") -> tuple[str, int]:
        return f"<{tag}{attrs}>" + "".join(f"<{inner}>{x}</{inner}>" for x in items) + f"</{tag}>", len(items)

    def maybe_hidden(element: str, chance: float) -> str:
        way = hide.choice([" hidden", ' aria-hidden="true"', ' style="display: none"'])
        return re.sub(r"^<\w+", lambda m: m[0] + way, element) if hide.random() < chance else element

    link = lambda: f'<a href="/x">{prose(1, 3)}</a>'

    def junk(kind: str) -> tuple[str, int]:
        if kind == "nav":
            return many("nav", r.choice(["", ' class="menu"']), [link() for _ in range(r.randint(2, 8))])
        if kind == "menu":
            return many(r.choice(["ul", "div"]), ' class="menu navbar"', [link() for _ in range(r.randint(2, 8))], r.choice(["li", "p"]))
        if kind == "header":
            return f"<header><div>{prose(1, 4)}</div><p>{prose(2, 9)}</p></header>", 2
        if kind == "form":
            return f'<form><label>{prose(1, 3)}</label><input name="q"><button>{r.choice(["Search", "Sign up", "Subscribe", prose(1, 1)])}</button></form>', 2
        if kind in ("aside", "footer"):
            k = r.randint(1, 4)
            return f"<{kind}>" + "".join(f"<p>{r.choice([link(), prose(4, 20), '&copy; ' + prose(2, 9)])}</p>" for _ in range(k)) + f"</{kind}>", k
        if kind == "comments":
            k = r.randint(1, 5)
            tag, head = r.choice(["section", "div", "ol"]), r.choice(["", "<h2>Comments</h2>", f"<h3>{prose(1, 3)}</h3>"])
            item = r.choice(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<p class="reply">{}</p>', "<blockquote>{}</blockquote>"])
            return f'<{tag} {r.choice(["class", "id"])}="{r.choice(["comments", "comment", "comment-list", "reader-comments", "replies", "comments-area"])}">{head}' + "".join(item.format(prose(1, 40)) for _ in range(k)) + f"</{tag}>", k + bool(head)
        tag, words = r.choice(["div", "section", "p"]), r.choice(sorted(BOILERPLATE_WORDS))
        return f'<{tag} class="{words}">{prose(2, 30)}</{tag}>', 1

    kinds = ["nav", "menu", "header", "form", "aside", "footer", "comments"] + ["classed"] * 5
    for _ in range(n):
        parts, labels = [], []

        def add(kind: str) -> None:
            text, k = junk(kind)
            parts.append(maybe_hidden(text, 0.1))
            labels.extend([0] * k)

        for kind in r.sample(kinds, r.randint(1, 5)):
            add(kind)
        opening, closing = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>")] * 2 + [("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main" class="post entry body">', "</div>"), ("<div>", "</div>")])
        parts.append(maybe_hidden(opening, 0.02))
        if r.random() < 0.9:
            parts.append(f"<h1>{prose(2, 12)}</h1>")
            labels.append(1)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            draw = r.random()
            if draw < 0.75:
                parts.append(f"<p>{r.choice(['', '<b>'])}{prose(1, 120)}{r.choice(['', ' ' + link() + ' ' + prose(1, 9)])}</p>")
                labels.append(1)
            elif draw < 0.85:
                tag = r.choice(["h2", "h3", "blockquote", "pre"])
                parts.append(f"<{tag}>{prose(1, 20)}</{tag}>")
                labels.append(1)
            elif draw < 0.93:
                text, k = many(r.choice(["ul", "ol"]), "", [prose(1, 20) for _ in range(r.randint(1, 5))])
                parts.append(text)
                labels.extend([1] * k)
            else:
                add(r.choice(["aside", "form", "classed", "classed"]))
        if r.random() < 0.4:
            add("comments")
        parts.append(closing)
        for kind in r.sample(kinds, r.randint(0, 5)):
            add(kind)
        yield f"<!DOCTYPE html><html><head><title>{prose(2, 9)}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>", labels


def train(pages: DataFrame, id_col: str, html_col: str, labelled: list[tuple[str, list[int]]] | None = None) -> Field:
    taught = []
    for page, labels in practice_pages() if labelled is None else labelled:
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError(f"a labelled page has {len(blocks)} blocks and {len(labels)} labels")
        taught.append((features_of(blocks), labels))
    if labelled is None:
        short = pages.filter(F.length(html_col) < TEACH_CHARS).select(id_col, html_col)
        own = short.filter(drawn("page", F.xxhash64(id_col, html_col), 2 * PAGES / max(1, short.select(id_col).count()))).distinct()
        for page in sorted(x[1] for x in own.orderBy(F.xxhash64(id_col, html_col)).limit(PAGES).collect()):  # of some 2 * PAGES rows in all
            if labels := own_labels(blocks := blocks_of(page)):
                taught.append((features_of(blocks)[:TEACH_BLOCKS], labels[:TEACH_BLOCKS]))
    return Field(taught)


def extractor(field: Field):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for page in batch.column(2).to_pylist():
                blocks = blocks_of(page or "")
                text = "\n\n".join(b[3] for b, y in zip(blocks, field.decode(features_of(blocks))) if y)
                texts.append(text)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["id", "url", "text", "n_chars"])

    return extract


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """A row for each page: id, url, text, n_chars."""
    field = train(pages, id_col, html_col, labelled)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(extractor(field), "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
