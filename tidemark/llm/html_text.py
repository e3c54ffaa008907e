"""Main text of HTML pages by a linear-chain conditional random field over their leaf blocks.

A page is read into leaf blocks: runs of text that no block element interrupts, with the elements around
them.  A block's features are those elements, hints in their class, id and role, and the block's text; a
chain of two labels (main text or not) over a page's blocks is trained by gradient ascent on labelled pages
and decoded by Viterbi.  The labelled pages are drawn by `training_pages`, with a fixed seed, from layouts of
articles, menus, headers, footers, side bars, notices, adverts, forms and reader comments; their words are
random, so that the layout decides.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches

# The elements of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements that are left out with all they hold, if they end.
UNSEEN = frozenset("noscript template svg".split())
#: What an opening element ends, unless one of the second stands in between.
ENDS = {
    "p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
#: Words in class, id and role, by what they hint at.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer bottom copyright contentinfo legal colophon",
    "side": "sidebar aside widget widgets related rail complementary recommended trending popular",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay paywall disclaimer",
    "talk": "comment comments discussion replies reply disqus reaction reactions respond",
    "form": "form search subscribe subscription newsletter signup login share sharing social",
    "main": "article content post entry story main body text",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW | UNSEEN}
_NAME = re.compile(r"[a-z]+")


class Element(NamedTuple):
    tag: str
    parent: Element | None
    path: frozenset[str]
    link: bool
    above: Element | None  # the nearest block element around it

    @property
    def block(self) -> Element | None:
        """The nearest block element, this one included; none at the top."""
        return self if self.tag in BLOCK else self.above


class Block(NamedTuple):
    text: str
    path: frozenset[str]
    linked: int  # characters in links


@lru_cache(maxsize=4096)
def _own(tag: str, attributes: str) -> frozenset[str]:
    """Features of an element, which all blocks in it have."""
    out = {f"in={tag}"} if tag in BLOCK else set()
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        out |= {f"hint={_HINT[x]}" for x in _NAME.findall((a or b or c).lower()) if x in _HINT}
    if _HIDDEN.search(attributes):
        out.add("hint=hidden")
    return frozenset(out)


@lru_cache(maxsize=65536)
def _joined(outer: frozenset[str], own: frozenset[str], tag: str) -> frozenset[str]:
    """Features of the elements around a block, its nearest block element's own mark replaced."""
    if tag not in BLOCK:
        return outer | own
    return frozenset(x for x in outer if not x.startswith("at=")) | own | {f"at={tag}"}


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order; white space in a block is one space.

    Time is in proportion to the page, however broken it is: counts of open elements tell whether an end has a beginning.
    """
    out: list[Block] = []
    now, text, linked = Element("", None, frozenset(), False, None), [], 0
    # open block elements by name, and for each (and the top) the open others by name inside it
    opened, inside = Counter(), [Counter()]
    at, n, last = 0, len(page), page.rfind(">")
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, now.path, linked))
            text.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if now.link:
                linked += len(raw.strip())

    def close(element: Element) -> None:
        """Go up to the parent of an open element."""
        nonlocal now
        while True:
            if now.tag in BLOCK:
                opened[now.tag] -= 1
                inside.pop()
            else:
                inside[-1][now.tag] -= 1
            ended, now = now, now.parent
            if ended is element:
                break

    while at < n:
        # without a > nothing more begins but a comment
        found = _TOKEN.search(page, at) if at <= last else _COMMENT.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if found.re is _COMMENT:
            continue
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in UNSEEN and tag not in endless:
            if not closing and not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in RAW and not closing:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            if tag == "textarea":
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if opened[tag] if tag in BLOCK else inside[-1][tag]:
                here = now
                while here.tag != tag:
                    here = here.parent
                close(here)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in ENDS or tag in BLOCK:
            ends, walls = ENDS.get(tag, ({"p"}, set()))
            here = now.block
            while here and here.tag not in ends and here.tag not in walls and tag == "tr" and here.tag in ("td", "th"):
                here = here.parent.block
            if here and here.tag in ends:
                close(here)
        own = Element(tag, now, _joined(now.path, _own(tag, attributes), tag), now.link or tag == "a", now.block)
        if tag in BLOCK:
            opened[tag] += 1
            inside.append(Counter())
        else:
            inside[-1][tag] += 1
        now = own
    flush()
    return out


# --- the chain ---------------------------------------------------------------------------------------------------


def text_features(block: Block, i: int, n: int) -> list[str]:
    chars, words = len(block.text), block.text.count(" ") + 1
    share = block.linked / chars
    return [
        f"chars={min(8, chars.bit_length())}", f"words={min(6, words.bit_length())}", f"links={0 if share == 0 else 1 if share < 0.5 else 2}", f"stop={block.text[-1] in '.!?…:;'}",
        f"marks={any(c in block.text for c in '©®|»')}", f"first={i == 0}", f"last={i == n - 1}",
    ]


class Chain(NamedTuple):
    """Weights of features for label 1 over label 0, and of transitions from label to label."""

    weights: dict[str, float]
    moves: np.ndarray

    def decode(self, page: list[Block]) -> list[bool]:
        """The most likely labels (Viterbi); of equal ones, not main text."""
        if not page:
            return []
        stay0, up, down, stay1 = (float(x) for x in self.moves.ravel())
        zero, one, back = 0.0, 0.0, []
        for i, block in enumerate(page):
            said = self._path(block.path) + sum(self.weights.get(f, 0.0) for f in text_features(block, i, len(page)))
            if i:
                back.append((down + one > stay0 + zero, stay1 + one > up + zero))
                zero, one = max(stay0 + zero, down + one), max(up + zero, stay1 + one)
            one += said
        labels = [one > zero]
        for to_zero, to_one in reversed(back):
            labels.append(to_one if labels[-1] else to_zero)
        return labels[::-1]

    def _path(self, path: frozenset[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in sorted(path))


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 10, rate: float = 0.5, prior: float = 1e-3) -> Chain:
    """Weights of the largest penalised likelihood that stepwise gradient ascent (AdaGrad) finds."""
    names: dict[str, int] = {"": 0}  # the first fills up rows
    coded = []
    for page, labels in pages:
        if page:
            rows = [[names.setdefault(f, len(names)) for f in sorted(b.path) + text_features(b, i, len(page))] for i, b in enumerate(page)]
            most = max(map(len, rows))
            coded.append((np.array([r + [0] * (most - len(r)) for r in rows]), np.array(labels, int)))
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    sum_w, sum_moves = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for k in order.permutation(len(coded)):
            rows, labels = coded[k]
            chance, pairs = _expected(w[rows].sum(axis=1), moves)
            step = -prior * w
            np.add.at(step, rows, (labels - chance)[:, None])
            step[0] = 0.0
            move = -pairs - prior * moves
            np.add.at(move, (labels[:-1], labels[1:]), 1)
            sum_w += step**2
            sum_moves += move**2
            w += rate * step / np.sqrt(sum_w)
            moves += rate * move / np.sqrt(sum_moves)
    return Chain({f: float(w[i]) for f, i in names.items() if f}, moves)


def _either(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    top = a if a > b else b
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def _expected(said: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 of each block, and expected number of each transition (forward-backward)."""
    says, n = said.tolist(), len(said)
    (a, b), (c, d) = moves.tolist()
    forward, backward = [(0.0, says[0])], [(0.0, 0.0)]
    for x in says[1:]:
        zero, one = forward[-1]
        forward.append((_either(zero + a, one + c), _either(zero + b, one + d) + x))
    for x in says[:0:-1]:
        zero, one = backward[-1][0], backward[-1][1] + x
        backward.append((_either(a + zero, b + one), _either(c + zero, d + one)))
    backward.reverse()
    total = _either(*forward[-1])
    chance = np.array([math.exp(f[1] + g[1] - total) for f, g in zip(forward, backward, strict=True)])
    pairs = np.zeros((2, 2))
    for i in range(n - 1):
        (zero, one), (next0, next1) = forward[i], backward[i + 1]
        next1 += says[i + 1]
        pairs += [[math.exp(zero + a + next0 - total), math.exp(zero + b + next1 - total)], [math.exp(one + c + next0 - total), math.exp(one + d + next1 - total)]]
    return chance, pairs


# --- labelled pages ----------------------------------------------------------------------------------------------


def training_pages(n: int = 500, seed: int = 9) -> list[tuple[str, str]]:
    """(page, main text) pairs with layouts, words and lengths drawn by chance."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäéñ"))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    maybe = lambda p: rng.random() < p

    def words(most: int) -> str:
        said = " ".join("".join(rng.choice(letters, int(rng.integers(1, 10)))) for _ in range(int(rng.integers(1, most + 1))))
        return said.capitalize() + pick(".", ".", ".", "", "!", "?", ":")

    def named(kind: str) -> str:
        # some names hint at nothing
        name = pick(*HINTS[kind].split()) if maybe(0.8) else "".join(rng.choice(letters[:26], int(rng.integers(3, 9))))
        return f' {pick("class", "class", "id")}="{pick("", "site-", "page_", "my-")}{name}"'

    def links() -> str:
        inner = "".join(f'<li><a href="#">{words(3)}</a></li>' for _ in range(int(rng.integers(1, 8))))
        return f"<ul>{inner}</ul>" if maybe(0.7) else re.sub("</?li>", " ", inner)

    def prose(most: int = 40) -> str:
        return "".join(f"<p>{words(most)}</p>" if maybe(0.8) else f"<div>{words(most)}</div>" for _ in range(int(rng.integers(1, 4))))

    def aside(kind: str) -> str:
        inner = {"menu": links, "head": lambda: f"<h1>{words(5)}</h1>" + links() * maybe(0.4), "foot": lambda: pick(f"&copy; {words(9)}", prose(9), links())}.get(kind, lambda: pick(prose(), words(20), f"<h3>{words(4)}</h3>" + links(), prose()))()
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        if tag and maybe(0.6):
            return f"<{tag}{named(kind) if maybe(0.3) else ''}>{inner}</{tag}>"
        box = pick("div", "section", "div")
        return f"<{box}{named(kind)}>{inner}</{box}>"

    out = []
    for _ in range(n):
        truth: list[str] = []

        def main(tag: str, most: int) -> str:
            said = words(most)
            truth.append(said)  # noqa: B023
            return f"<{tag}>{said}</{tag}>"

        body = []
        for _ in range(int(rng.integers(0, 12))):
            body.append(pick(*["p"] * 9, "ul", "quote", "h2", "h3", "pre", "cell", "open", "div"))
        inner = main("h1", 12) if maybe(0.8) else ""
        for kind in body:
            if kind == "ul":
                inner += "<ul>" + "".join(main("li", 12) for _ in range(int(rng.integers(1, 5)))) + "</ul>"
            elif kind == "quote":
                inner += "<blockquote>" + main("p", 30) + "</blockquote>"
            elif kind == "cell":
                inner += "<table><tr>" + main("td", 5) + main("td", 5) + "</tr></table>"
            elif kind == "open":
                inner += "<p><b>" + main("b", 30)[3:-4] + "<br>"
            else:
                inner += main(kind, 4 if kind in ("h2", "h3") else pick(2, 12, 60, 60, 400))
            if maybe(0.12):
                inner += aside(pick("ad", "side", "form", "note"))
        tag = pick("article", "article", "article", "main", "main", "div", "section")
        article = f"<{tag}{named('main') if tag in ('div', 'section') or maybe(0.2) else ''}>{inner}"
        if maybe(0.1):
            article += aside("talk")
        article += f"</{tag}>"
        bare, alone = maybe(0.2), maybe(0.2)
        before = [aside(k) for k in ("head", "menu", "ad", "note", "side") if not bare and maybe(0.4)]
        after = [aside(k) for k in ("talk", "side", "ad", "form", "note", "foot") if not alone and maybe(0.4)]
        if maybe(0.3):
            article = f"<main>{article}</main>"
        page = "".join([*before, article, *after])
        if maybe(0.3):
            page = f"<div{pick('', ' class=\"wrap\"', ' id=\"page\"')}>{page}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{}}</style></head><body>{page}</body></html>", "\n".join(truth)))
    return out


def labelled(page: str, main: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a page, and which of them are the lines of its main text, in order."""
    found, lines, labels = blocks(page), main.split("\n") if main else [], []
    left = list(lines)
    for block in found:
        labels.append(bool(left) and block.text == left[0])
        if labels[-1]:
            left.pop(0)
    return found, labels


@lru_cache(maxsize=1)
def fitted() -> Chain:
    """The chain, trained once in a process; every process gets the same."""
    return train([labelled(*x) for x in training_pages()])


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, is_main in zip(found, chain.decode(found), strict=True) if is_main)


_TEXTS = "id long, text string"


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(page, chain) for page in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    return run


def extract(pages: DataFrame, chain: Chain | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` and the main text of each row; empty if there is none, or for a null or empty page.

    Character references are decoded, white space in a block is one space, blocks are joined by a line end.
    Repeated rows, and rows with nulls in other columns, come out like any other; extra columns don't.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(chain or fitted())
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_extracted(shared), f"{schema}, text string")
