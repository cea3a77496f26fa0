"""Main text of web pages: a recurrent labeller over a page's leaf blocks.

A page is read into its leaf blocks, the runs of text between block-level tags.  A block is the bag of its
tag path (hashed tags, and names and words of class, id and role, of all open elements) and a vector of its words
(hashed), its own tag and a few figures; a bidirectional LSTM reads the blocks of a page in order, so each is judged in the context of the
whole page.  The model is trained on generated pages of many layouts (``layouts``), once a driver.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layouts
from .common import map_columns
from .labeller import Labeller, Places

#: Numbers that stand for tag paths, and widths of the parts of a block's vector: hashed words, its tag, figures.
PATHS, WORDS, TAGS, FIGURES = 4096, 128, 32, 6
WIDTH = WORDS + TAGS + FIGURES
#: Generated pages that the model is trained on, and passes over them.
TRAINING_PAGES, EPOCHS = 3000, 8
THRESHOLD = 0.5
#: Elements that never show text, and those that have no content.
UNSEEN = frozenset("script style noscript template svg iframe object canvas audio video title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line: they do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag closes where the end tag is left out, up to an element that holds such.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def bucket(token: str, width: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % width


@lru_cache(1 << 10)
def tag_bucket(tag: str) -> int:
    return bucket(tag, TAGS)


@lru_cache(1 << 14)
def element_tokens(tag: str, names: str) -> frozenset[int]:
    """Numbers of a tag, of its class, id and role names, and of their words, whole and by the first four letters."""
    words = {w.lower() for w in NAME.findall(names)}
    return frozenset(bucket(t, PATHS) for t in (f"<{tag}", *(f"={n.lower()}" for n in names.split()), *(f".{w}" for w in words), *(f".{w[:4]}*" for w in words)))


class BlockReader(HTMLParser):
    """Leaf blocks of a page, in order, as (text, characters within links, path, tag)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, frozenset[int], str]] = []
        self.open: list[tuple[str, frozenset[int]]] = [("", frozenset({0}))]
        self.counts: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.unseen: str | None = None
        self.depth = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, self.open[-1][1], self.open[-1][0]))
        self.parts, self.linked, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            self.depth += tag == self.unseen
            return
        if tag in UNSEEN:
            self.unseen, self.depth = tag, 1
            return
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            self.links += tag == "a"
            return
        self.end_block()
        if tag in VOID:
            return
        if self.open[-1][0] == "p":
            self.close_to(len(self.open) - 1)
        if tag in CLOSES:
            own, within = CLOSES[tag]
            at = next((k for k in range(len(self.open) - 1, max(0, len(self.open) - 64), -1) if self.open[k][0] in own | within), 0)
            while at and self.open[at][0] in own:
                self.close_to(at)
                at -= 1
        values = dict(attrs)
        names = " ".join(filter(None, (values.get("class"), values.get("id"), values.get("role"))))
        if "hidden" in values or "display:none" in (values.get("style") or "").replace(" ", ""):
            names += " hidden"
        path = self.open[-1][1] | element_tokens(tag, names[:200])
        self.open.append((tag, self.open[-1][1] if len(path) == len(self.open[-1][1]) else path))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def close_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.counts[tag] -= 1
        del self.open[at:]

    def handle_endtag(self, tag):
        if self.unseen:
            self.depth -= tag == self.unseen
            if not self.depth:
                self.unseen = None
            return
        if tag in INLINE:
            self.links -= tag == "a" and self.links > 0
            return
        self.end_block()
        if self.counts.get(tag):
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.close_to(at)

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def read(self, html: str) -> list[tuple[str, int, frozenset[int], str]]:
        self.feed(html)
        self.close()
        self.end_block()
        return self.blocks


class TruthReader(BlockReader):
    """For generated pages: a comment tells whether the blocks that begin after it are main text."""

    def __init__(self):
        super().__init__()
        self.main, self.begun, self.truth = False, None, []

    def handle_comment(self, data):
        if data in layouts.MARKS:
            self.main = data == layouts.MARKS[1]

    def handle_data(self, data):
        if self.begun is None and data.strip() and not self.unseen:
            self.begun = self.main
        super().handle_data(data)

    def end_block(self):
        before = len(self.blocks)
        super().end_block()
        self.truth += [bool(self.begun)] * (len(self.blocks) - before)
        self.begun = None


#: Odd numbers that weigh a word's bytes by their place, and the bytes of punctuation, which weigh nothing.
PLACES = (np.arange(1, 33, dtype=np.uint32) * np.uint32(2654435761)) | np.uint32(1)
COUNTED = np.array([0 if chr(b) in " \n.,:;!?()[]\"'" else 1 for b in range(256)], np.uint32)


def word_shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, WORDS) square roots of the shares of hashed words in each text, and the number of its words.

    A word's hash is the sum of its bytes in lower case, weighed by their places: a few passes over all bytes.
    """
    data = np.frombuffer("\n".join(texts).lower().encode("utf-8", "replace"), np.uint8)
    apart = (data == 32) | (data == 10)
    begins = ~apart & np.concatenate(([True], apart[:-1]))
    starts = np.flatnonzero(begins)
    place = np.arange(len(data)) - np.maximum.accumulate(np.where(begins, np.arange(len(data)), 0))
    weighed = data * COUNTED[data] * PLACES[place & 31]
    hashes = np.add.reduceat(weighed, starts, dtype=np.uint32)
    owner = np.cumsum(data == 10)[starts]
    counts = np.bincount(owner * WORDS + ((hashes * np.uint32(2246822519)) >> np.uint32(16)).astype(np.int64) % WORDS, minlength=len(texts) * WORDS).reshape(-1, WORDS)
    words = counts.sum(axis=1)
    return np.sqrt(counts / words[:, None]), words


@lru_cache(1 << 14)
def path_bag(path: frozenset[int]) -> np.ndarray:
    return np.array(sorted(path), np.int64)


def block_places(blocks: list[tuple[str, int, frozenset[int], str]], first: int, last: int) -> Places:
    """The places of blocks ``first`` to ``last`` of a page."""
    texts, linked, paths, tags = zip(*blocks[first:last])
    out, n = np.zeros((last - first, WIDTH), np.float32), np.array(list(map(len, texts)))
    out[:, :WORDS], words = word_shares(texts)
    out[np.arange(len(texts)), [WORDS + tag_bucket(tag) for tag in tags]] = 1.0
    signs = [(text[-1] in ".!?", sum(map(text.count, "0123456789")) / len(text), "©" in text) for text in texts]
    figures = out[:, -FIGURES:]
    figures[:, 0], figures[:, 1], figures[:, 2] = np.log1p(words) / 5, np.minimum(1.0, np.array(linked) / n), np.log1p(n / words) / 3
    figures[:, 3:6] = signs
    known: dict[frozenset[int], int] = {}
    which = np.array([known.setdefault(path, len(known)) for path in paths])
    return Places(out, list(map(path_bag, known)), which)


def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """A labeller trained on ``pages`` generated pages; every other one without its words, so that they decide little."""
    model, read = Labeller(WIDTH, PATHS), []
    for number, html in enumerate(layouts.generate(pages, seed)):
        reader = TruthReader()
        blocks = reader.read(html)
        if blocks:
            places = block_places(blocks, 0, len(blocks))
            if number % 2:
                places.vectors[:, :WORDS] = 0
            read.append((places, np.array(reader.truth)))
    model.train(read, epochs)
    return model


@lru_cache(1)
def production_model() -> Labeller:
    return train()


def label_pages(model: Labeller, pages: list[str], part: int = 512) -> list[list[str]]:
    """The texts of each page's main blocks."""
    read = [BlockReader().read(html) for html in pages]
    lengths = np.array([len(b) for b in read], np.int64)
    if not lengths.sum():
        return [[] for _ in pages]
    sent = np.concatenate([model.project(block_places(b, at, min(at + part, len(b)))) for b in read for at in range(0, len(b), part)])
    scores, starts = model.scores(sent, lengths), np.cumsum(lengths) - lengths
    return [[block[0] for block, s in zip(b, scores[start : start + len(b)]) if s >= THRESHOLD] for b, start in zip(read, starts)]


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page: its main blocks in page order, joined by line feeds.

    Character references are decoded; white space within a block, line breaks too, becomes one space.  A
    null or empty page, and one without main text, has an empty text; null ids and urls stay null.  Pages
    are read whole, however long or deep; unclosed and stray tags are read as browsers do in the common cases.
    Repeated rows give repeated rows, further columns are not read, an empty table gives none.
    """
    model = production_model() if model is None else model

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = ["\n".join(found) for found in label_pages(model, [h or "" for h in rows["html"]])]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_columns(chosen, work, "page_id long, url string, text string, n_chars long", 128)
