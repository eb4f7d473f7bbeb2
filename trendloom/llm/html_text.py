"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags. Features of a block are the
tags around it, words in their class, id and role attributes, and what its text looks like. The field
has two labels (article or not) and is trained on labelled pages, which `html_training` makes from many
layouts; Viterbi finds the best labelling of a page, and the article's blocks are its text.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm import html_training
from trendloom.llm.common import spread

DIMENSIONS = 1 << 13
EPOCHS = 150
RATE, DECAY = 0.1, 1e-4

#: Fixed values of HTML: tags that stay inside a line, that have no content, whose content is never text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
#: The tag that ends a raw element; it is looked for before the page's last ">" only, so that unended ones are passed once.
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
DROPPED = set("head noscript template object svg math canvas audio video select button datalist map".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
P_SCOPE = set("td th caption table html body template object marquee applet button".split())
#: A tag that opens closes the nearest of these, but not beyond those after the bar.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

#: A tag with more than 512 stretches of quoted and bare attributes ends at its first ">", so that none is looked at again and again.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'){0,512}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S)
#: All that is left, as the last group of TOKEN.
REST = re.compile(r"()()()()()()([^<]+|<)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))?)?""")
#: Attributes whose words are features.
TOLD = set("class id role hidden aria-label".split())

#: Words of class, id and role attributes by what they usually mark.
MARKS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager toc skip",
    "ad": "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored dfp commercial",
    "side": "sidebar side aside related widget widgets rail recommended popular trending more",
    "comment": "comment comments disqus reply replies respond discussion thread reader feedback",
    "foot": "footer foot copyright legal colophon contentinfo imprint",
    "head": "header masthead branding logo site tagline topnav",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay warning message flash paywall",
    "form": "form search subscribe newsletter signup login contact register",
    "share": "share social follow sharing tweet",
    "article": "article content post entry main story body text page blog news",
}
MARK_OF = {w: k for k, words in MARKS.items() for w in words.split()}
#: Words that page furniture uses.
FURNITURE = set("""cookie cookies subscribe newsletter copyright rights reserved privacy policy terms login sign share tweet follow
comment comments reply advertisement sponsored related menu home search contact about impressum datenschutz anmelden kommentare
suche werbung accueil recherche commentaires publicité mentions légales inicio buscar comentarios publicidad aviso""".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


@functools.cache
def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


@functools.lru_cache(65536)
def tag_features(tag: str, attributes: str) -> tuple[frozenset[int], bool]:
    """Slots of a tag's features, and whether it is hidden."""
    found, hidden = {f"in:{tag}"}, False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        if (name := name.lower()) not in TOLD:
            continue
        hidden |= name == "hidden"
        for w in SPLIT.split("".join(values)):
            w = w.lower()
            if w in MARK_OF:
                found.add(f"mark:{MARK_OF[w]}")
            if w and name != "aria-label":
                found.add(f"word:{w}")
    return frozenset(map(slot, found)), hidden


class Around:
    """What stands around a block: the slots that an element adds, and what is around that element."""

    __slots__ = ("added", "outer")

    def __init__(self, added: tuple[int, ...], outer: Around | None):
        self.added, self.outer = added, outer

    def all(self) -> Iterator[int]:
        node: Around | None = self
        while node:
            yield from node.added
            node = node.outer


@dataclass
class Block:
    text: str
    around: Around
    parent: str
    linked: float


class Stack:
    """The open elements. Each knows what is around it, and the nearest block-level tag and its place; where each tag is open
    and how often each slot is around is known, too, so nothing is looked for along the stack, however deep it is."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.slots: list[frozenset[int]] = []
        self.around: list[Around] = [Around((), None)]
        self.blocks: list[tuple[str, int]] = [("", -1)]
        self.places: dict[str, list[int]] = {}
        self.times: dict[int, int] = {}

    def push(self, tag: str, slots: frozenset[int]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        added = tuple(s for s in slots if not self.times.get(s))
        self.around.append(Around(added, self.around[-1]) if added else self.around[-1])
        self.blocks.append(self.blocks[-1] if tag in INLINE else (tag, len(self.tags)))
        self.tags.append(tag)
        self.slots.append(slots)
        for s in slots:
            self.times[s] = self.times.get(s, 0) + 1

    def pop_to(self, depth: int) -> None:
        for tag, slots in zip(self.tags[depth:], self.slots[depth:], strict=True):
            self.places[tag].pop()
            for s in slots:
                self.times[s] -= 1
        del self.tags[depth:], self.slots[depth:], self.around[depth + 1 :], self.blocks[depth + 1 :]

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def nearest(self, tags: Iterable[str], barrier: Iterable[str]) -> int:
        """The place of the innermost of these tags, -1 if one of the barrier's stands inside of it."""
        found = max(map(self.last, tags))
        return found if found > max(map(self.last, barrier), default=-1) else -1


def blocks(page: str) -> list[Block]:
    """Leaf blocks with some text, in page order; references decoded, white space made single spaces."""
    found: list[Block] = []
    stack = Stack()
    pieces: list[str] = []
    links, around = 0, None
    dropped = 0  # depth of the stack at which dropped content began, plus one

    def close_block() -> None:
        nonlocal pieces, links, around
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                slots, parent = around
                found.append(Block(text, slots, parent, min(1.0, links / max(len(text), 1))))
        pieces, links, around = [], 0, None

    def pop_to(depth: int) -> None:
        nonlocal dropped
        stack.pop_to(depth)
        if dropped > depth:
            dropped = 0

    at, ends = 0, page.rfind(">") + 1  # beyond the last ">" nothing is a tag
    while m := TOKEN.match(page, at) if at < ends or page.startswith("<!--", at) else REST.match(page, at):
        at = m.end()
        if (words := m[7]) is not None:
            if not dropped:
                if around is None and not words.isspace():
                    around = (stack.around[-1], stack.blocks[-1][0])
                pieces.append(words)
                links += len(words) if stack.last("a") >= 0 else 0
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag in INLINE:
                depth = stack.last(tag)
                if depth > stack.blocks[-1][1]:
                    pop_to(depth)
                elif tag == "br":
                    pieces.append(" ")
            else:
                close_block()
                depth = stack.nearest((tag,), P_SCOPE if tag == "p" else ())
                if depth >= 0:
                    pop_to(depth)
            continue
        if tag == "body" and dropped and stack.tags[dropped - 1] == "head":
            pop_to(dropped - 1)
        if tag in RAW:
            if tag in ("textarea", "iframe"):
                close_block()
            end = RAW_END[tag].search(page, at, ends)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            close_block()
            if tag in CLOSES_P and (depth := stack.nearest(("p",), P_SCOPE)) >= 0:
                pop_to(depth)
            if tag in SIBLINGS:
                closed, barrier = (x.split() for x in SIBLINGS[tag])
                if (depth := stack.nearest(closed, barrier)) >= 0:
                    pop_to(depth)
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID or attributes.rstrip().endswith("/") and tag in DROPPED:
            continue
        slots, hidden = tag_features(tag, attributes)
        stack.push(tag, slots)
        if (hidden or tag in DROPPED) and not dropped:
            dropped = len(stack.tags)
    close_block()
    return found


def _grade(part: int, whole: int) -> int:
    """How much of a whole: 0 none, then 1 to 4 by doubling shares from a thirty-second on."""
    return 0 if not part else min(4, max(1, (32 * part // max(whole, 1)).bit_length()))


def own_features(found: list[Block]) -> list[list[int]]:
    """Slots of each block's own features, which look at the whole block."""
    out = []
    for i, b in enumerate(found):
        words = b.text.split()
        furniture = sum(w.strip(".,:;!?()|·").lower() in FURNITURE for w in words)
        names = [
            "bias", f"parent:{b.parent}", f"words:{len(words).bit_length()}", f"linked:{int(b.linked * 4)}",
            f"ends:{'.' if b.text[-1] in '.!?…”\"' else 'x'}", f"furniture:{_grade(furniture, len(words))}",
            f"digits:{sum(map(b.text.count, '0123456789')) * 5 // len(b.text)}",
            f"sign:{_grade(sum(map(b.text.count, '©|»›')), len(words))}", f"first:{i == 0}", f"last:{i == len(found) - 1}",
            f"parent:{b.parent}:words:{len(words).bit_length()}",
        ]
        out.append(list(map(slot, names)))
    return out


def block_features(found: list[Block]) -> list[list[int]]:
    """Slots of all features of each block, those around it included."""
    return [[*own, *b.around.all()] for own, b in zip(own_features(found), found, strict=True)]


@dataclass
class Model:
    """`emission[slot, label]`, `transition[label, label]`; label 1 is the article."""

    emission: np.ndarray
    transition: np.ndarray

    def local(self, features: list[list[int]]) -> np.ndarray:
        """Score of each block for each label."""
        owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
        slots = np.array([s for f in features for s in f], np.int64)
        return np.stack([np.bincount(owner, self.emission[slots, k], len(features)) for k in (0, 1)], axis=1)

    def around(self, found: list[Block]) -> np.ndarray:
        """What stands around each block adds to its scores; each element's part is summed once."""
        known: dict[Around | None, tuple[float, float]] = {None: (0.0, 0.0)}
        for b in found:
            path, node = [], b.around
            while node not in known:
                path.append(node)
                node = node.outer
            for node in reversed(path):
                outer = known[node.outer]
                known[node] = tuple(outer[k] + sum(self.emission[s, k] for s in node.added) for k in (0, 1))
        return np.array([known[b.around] for b in found]).reshape(-1, 2)

    def viterbi(self, local: np.ndarray) -> np.ndarray:
        """The best labels of a page's blocks with these scores."""
        n = len(local)
        labels, back = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        if not n:
            return labels
        (t00, t01), (t10, t11) = self.transition.tolist()
        local = local.tolist()
        a, b = local[0]
        for i in range(1, n):
            x, y = (a + t00, b + t10), (a + t01, b + t11)
            back[i] = x[1] > x[0], y[1] > y[0]
            a, b = max(x) + local[i][0], max(y) + local[i][1]
        labels[-1] = b > a
        for i in range(n - 1, 0, -1):
            labels[i - 1] = back[i, labels[i]]
        return labels

    def decode(self, features: list[list[int]]) -> np.ndarray:
        return self.viterbi(self.local(features))

    def main_text(self, page: str) -> str:
        found = blocks(page)
        labels = self.viterbi(self.local(own_features(found)) + self.around(found))
        return " ".join(b.text for b, k in zip(found, labels.tolist(), strict=True) if k)


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Model:
    """Fits the field to pages of (features of each block, label of each block): the conditional likelihood's
    gradient from forward and backward sums over all pages in step, followed by Adam."""
    pages = sorted((p for p in pages if p[1]), key=lambda p: -len(p[1]))
    n, most = len(pages), len(pages[0][1])
    place = {(i, t): i * most + t for i, p in enumerate(pages) for t in range(len(p[1]))}
    owner = np.array([place[i, t] for i, p in enumerate(pages) for t, f in enumerate(p[0]) for _ in f])
    slots = np.array([s for p in pages for f in p[0] for s in f])
    gold = np.zeros((n, most), np.int64)
    sizes = np.array([len(p[1]) for p in pages])
    for i, p in enumerate(pages):
        gold[i, : len(p[1])] = p[1]
    inside = np.arange(most) < sizes[:, None]
    true = np.stack([(gold == 0) & inside, (gold == 1) & inside], axis=2).astype(float)
    pairs = np.einsum("nti,ntj->ij", true[:, :-1], true[:, 1:])
    theta = [np.zeros((DIMENSIONS, 2)), np.zeros((2, 2))]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
    for step in range(1, epochs + 1):
        emission, transition = theta
        local = np.stack([np.bincount(owner, emission[slots, k], n * most) for k in (0, 1)], axis=1).reshape(n, most, 2)
        ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        ahead[:, 0] = local[:, 0]
        for t in range(1, most):
            ahead[:, t] = local[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + transition, axis=1)
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(transition + (local[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), 0.0)
        total = np.logaddexp.reduce((ahead + behind)[:, 0], axis=1)
        share = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
        both = ahead[:, :-1, :, None] + transition + (local + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        off = (true - share).reshape(-1, 2)
        gradient = [np.stack([np.bincount(slots, off[owner, k], DIMENSIONS) for k in (0, 1)], axis=1) / n - DECAY * emission, (pairs - expected) / n]
        for k, g in enumerate(gradient):
            first, second = moments[k]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            theta[k] = theta[k] + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(*theta)


def labelled(page: str) -> tuple[list[list[int]], list[int]]:
    """Features and labels of a training page, whose article's blocks hold html_training.SIGN."""
    found = blocks(page)
    labels = [int(html_training.SIGN in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(html_training.SIGN, "") or "."
    return block_features(found), labels


@functools.cache
def model(pages: int = html_training.PAGES, seed: int = html_training.SEED) -> Model:
    return train([labelled(p) for p in html_training.pages(pages, seed)])


def extract(pages: DataFrame, trained: Model | None = None) -> DataFrame:
    """`page_id, url, text, n_chars` of every row of `pages(page_id, url, html)`.

    A null or empty html, or one without an article, gives the empty text. Repeated rows each give a row.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(trained or model())  # 2 * DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shipped.value.main_text(p.as_py() or "") for p in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return spread(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
