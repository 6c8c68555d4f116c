"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between block-level tags, with the path of tags, classes and
ids above it. Each block is a vector of hashed path parts, hashed words and a few measures; a bidirectional
LSTM reads the whole sequence and labels every block as main text or not.

The labeller is trained here, on a bounded sample of the pages (``max_training_pages``, by hash order, documented
bound). Their blocks get weak labels from what the markup says (navigation, header, footer, sidebar, advert,
notice, form, comments: not main text; names count for the part they are given to, not for an element that holds the
page, and a header inside an article is the article's), and copies of the pages are dressed with further such
containers, filled with the pages' own text, so that names which the sample lacks are known too.

Edge cases: a null or empty html has no blocks and an empty text; equal pages come out alike; a page that is cut off keeps
the text up to the cut, without an unfinished tag; time grows with a page's length, not with its depth; without pages nothing is trained.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<",
    re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z]+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "template", "noscript", "textarea", "svg")}
CLOSE_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
#: What page authors call the parts that are not the article.
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select menu title dialog fieldset".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer dialog discussion footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toolbar topbar widget".split())

#: Elements that hold the page, and words in names that say what an element has beside it or which state it is in.
WHOLE = frozenset("html body main".split())
STATES = frozenset("has with without no is show hide".split())
#: Containers whose parts make up a path.
NEAREST = 24

PATH_BINS, WORD_BINS, MEASURES, HIDDEN = 320, 48, 4, 24
WIDTH = PATH_BINS + WORD_BINS + MEASURES
CELLS_AT_ONCE = 8192


@dataclass
class Block:
    """Text of a leaf, the parts of its path, and how much of the text is inside links."""

    text: str
    path: tuple[str, ...]
    linked: float


class Element:
    """An open tag with its parent, and what its subtree holds."""

    __slots__ = ("tag", "names", "parent", "holds", "in_article", "part", "above", "depth")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.names, self.parent = tag, names_of(attributes) if "=" in attributes else (), parent
        #: titles, paragraphs and main parts below
        self.holds = [int(tag == "h1"), int(tag == "p"), int(tag == "main")]
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.depth = parent.depth + 1 if parent else 0
        self.part = "<header@article" if tag == "header" and self.in_article else f"<{tag}"
        #: the different tags above, so that what lies far out still counts
        self.above: frozenset[str] = parent.above if parent else frozenset()
        if parent and parent.part not in self.above and len(self.above) <= NEAREST:
            self.above |= {parent.part}

    def parts(self) -> tuple[str, ...]:
        """``<tag`` and ``.name`` of the element. The heading of an article is not that of the site. Names say nothing of an
        element that holds the page: html, body, main, and what has a title with paragraphs, or a main part, in it."""
        titles, paragraphs, mains = self.holds
        if self.tag in WHOLE or mains or (titles and (paragraphs > 1 or self.tag == "article")):
            return (self.part,)
        return (self.part, *(f".{n}" for n in self.names))


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of an element's classes, id and role; a name such as with-sidebar tells of something else than the element."""
    out = []
    for found in NAMES.findall(attributes):
        for name in "".join(found).split():
            words = [w.lower() for w in PARTS.findall(name)]
            if not STATES.intersection(words[:-1]):
                out += words
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; character references decoded, white space turned into single spaces.

    Every step costs the same however deep the tags are nested.
    """
    found: list[tuple[str, Element | None, bool, float]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    is_open: dict[str, int] = {}
    texts: list[str] = []
    in_link, links, at, end = False, 0, 0, len(page)

    def close():
        nonlocal links
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                found.append((text, stack[-1] if stack else None, in_link, links / max(1, sum(map(len, texts)))))
            texts.clear()
        links = 0

    def pop():
        is_open[stack.pop().tag] -= 1

    while at < end:
        token = TOKEN.match(page, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            text = token[0]
            if text[0] != "<" or len(text) == 1:
                texts.append(entities.unescape(text) if "&" in text else text)
                if in_link:
                    links += len(text)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                texts.append(" ")
            elif tag == "a":
                in_link = not token[1]
            continue
        close()
        if token[1]:
            if is_open.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
                in_link = False
        elif tag in RAW:
            over = RAW[tag].search(page, at)
            at = over.end() if over else end
        elif tag not in VOID and not token[3].endswith("/"):
            in_link = False
            if tag in CLOSE_PARAGRAPH and stack and stack[-1].tag == "p":
                pop()
            if tag in CLOSES_ITSELF and stack and stack[-1].tag == tag:
                pop()
            stack.append(Element(tag, token[3], stack[-1] if stack else None))
            elements.append(stack[-1])
            is_open[tag] = is_open.get(tag, 0) + 1
    close()
    for element in reversed(elements):  # children come after their parents
        if element.parent:
            for n, held in enumerate(element.holds):
                element.parent.holds[n] += held
    return [Block(text, path_of(element) + ("<a",) * linked, share) for text, element, linked, share in found]


def path_of(element: Element | None) -> tuple[str, ...]:
    """Parts of the nearest containers, outermost first, behind the tags of those further out."""
    near: list[tuple[str, ...]] = []
    above = sorted(element.above) if element and element.depth > NEAREST else ()
    while element and len(near) <= NEAREST:
        near.append(element.parts())
        element = element.parent
    return (*above, *(part for parts in reversed(near) for part in parts))


def weak_label(block: Block) -> bool:
    """Whether the markup gives no hint that the block is other than main text."""
    for part in block.path:
        if part[1:] in (BOILERPLATE_TAGS if part[0] == "<" else BOILERPLATE_NAMES):
            return False
    return True


#: Each part of a path sets two bins, so that parts are rarely taken for one another.
_bins: dict[str, list[int]] = {}


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block: hashed path parts, hashed words, and measures."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for row, block in zip(out, blocks):
        for part in block.path:
            if part not in _bins:
                if len(_bins) > 100_000:
                    _bins.clear()
                raw = part.encode("utf-8", "surrogatepass")
                _bins[part] = [zlib.crc32(raw) % PATH_BINS, zlib.adler32(raw[::-1] * 3) % PATH_BINS]
            row[_bins[part]] = 1.0
        words = block.text.encode("utf-8", "surrogatepass").split(b" ")
        hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_BINS
        counts = np.bincount(hashed, minlength=WORD_BINS)
        row[PATH_BINS:PATH_BINS + WORD_BINS] = counts / np.sqrt((counts * counts).sum())
        row[-MEASURES:] = np.log1p(len(block.text)) / 8, np.log1p(len(words)) / 6, block.linked, block.text[-1] in ".!?"
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over block vectors with a logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.weights: dict[str, np.ndarray] = {}
        for way in ("fw", "bw"):
            self.weights[f"{way}_x"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.weights[f"{way}_h"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1.0  # remember at first
            self.weights[f"{way}_b"] = bias
        self.weights["out"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        self.weights["out_b"] = np.zeros(1, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states over (time, pages, WIDTH); where the mask is 0 the state stays zero."""
        w_h = self.weights[f"{way}_h"]
        gates_x = x @ self.weights[f"{way}_x"] + self.weights[f"{way}_b"]
        steps = range(len(x)) if way == "fw" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, tape = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            z = gates_x[t] + h @ w_h
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new_c = (f * c + i * g) * m
            tanh_c = np.tanh(new_c)
            new_h = o * tanh_c * m
            tape.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = new_h, new_c
            out[t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds of main text for (time, pages)."""
        both = np.concatenate([self._run(way, x, mask)[0] for way in ("fw", "bw")], axis=2)
        return (both @ self.weights["out"])[..., 0] + self.weights["out_b"]

    def _gradients(self, x, mask, labels) -> dict[str, np.ndarray]:
        runs = {way: self._run(way, x, mask) for way in ("fw", "bw")}
        both = np.concatenate([runs["fw"][0], runs["bw"][0]], axis=2)
        odds = (both @ self.weights["out"])[..., 0] + self.weights["out_b"]
        error = ((_sigmoid(odds) - labels) * mask / mask.sum())[..., None].astype(np.float32)
        grads = {"out": np.einsum("tph,tpo->ho", both, error), "out_b": error.sum((0, 1))}
        back = error @ self.weights["out"].T
        for way, part in (("fw", back[..., :HIDDEN]), ("bw", back[..., HIDDEN:])):
            w_h = self.weights[f"{way}_h"]
            d_x = np.zeros_like(self.weights[f"{way}_x"])
            d_h, d_b = np.zeros_like(w_h), np.zeros(4 * HIDDEN, np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh_c, m in reversed(runs[way][1]):
                dh = (dh + part[t]) * m
                dc = (dc + dh * o * (1 - tanh_c**2)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh_c * o * (1 - o),
                                     dc * i * (1 - g**2)], axis=1)
                d_x += x[t].T @ dz
                d_h += h.T @ dz
                d_b += dz.sum(0)
                dh, dc = dz @ w_h.T, dc * f
            grads |= {f"{way}_x": d_x, f"{way}_h": d_h, f"{way}_b": d_b}
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], *, rounds: int = 10, batch: int = 24,
              rate: float = 0.01, seed: int = 3) -> None:
        """Adam over batches of (vectors, labels) of whole pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps = 0, rounds * -(-len(pages) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = [pages[i] for i in order[at:at + batch]]
                x, mask = padded([v for v, _ in some])
                labels = np.zeros(mask.shape, np.float32)
                for p, (_, y) in enumerate(some):
                    labels[:len(y), p] = y
                step += 1
                for k, g in self._gradients(x, mask, labels).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                    self.weights[k] -= (rate * (1 - 0.95 * step / steps) * move).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Flags of the blocks of each page; pages of like length are read side by side."""
        flags: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= CELLS_AT_ONCE:
                stop += 1
            group = order[at:stop]
            scores = self.scores(*padded([features(pages[i]) for i in group]))
            for column, i in enumerate(group):
                flags[i] = scores[:len(pages[i]), column] > 0
            at = stop
        return flags


def padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, WIDTH) and the mask of what is there."""
    longest = max(map(len, vectors))
    x, mask = np.zeros((longest, len(vectors), WIDTH), np.float32), np.zeros((longest, len(vectors)), np.float32)
    for p, v in enumerate(vectors):
        x[:len(v), p], mask[:len(v), p] = v, 1.0
    return x, mask


def dressed(blocks: list[Block], texts: list[str], rng: np.random.Generator) -> list[Block]:
    """The page with boilerplate containers around and inside its main part, under names drawn at random."""
    out = list(blocks)
    tags, names = sorted(BOILERPLATE_TAGS), sorted(BOILERPLATE_NAMES)
    main = [b for b in blocks if weak_label(b)]
    for _ in range(rng.integers(2, 7)):
        at = int(rng.integers(0, len(out) + 1))
        inside = main[int(rng.integers(len(main)))].path[:-1] if main and rng.random() < 0.5 else ("<html", "<body")
        head = (f"<{tags[int(rng.integers(len(tags)))]}",) if rng.random() < 0.4 else (
            f"<{('div', 'section', 'ul', 'p', 'article')[int(rng.integers(5))]}", f".{names[int(rng.integers(len(names)))]}")
        leaf = f"<{('p', 'li', 'div', 'h2', 'span')[int(rng.integers(5))]}"
        new = [Block(texts[int(rng.integers(len(texts)))], (*inside, *head, leaf), float(rng.random() < 0.5))
               for _ in range(rng.integers(1, 5))]
        out[at:at] = new
    shell = (("<html", "<body", "<article"), ("<html", "<body", "<main"), ("<html", "<body", "<div", ".content"), ("<html", "<body"),
             ("<html", "<body", "<div", ".post"), ("<html", "<body", "<section"))[int(rng.integers(6))]
    leaves = (("<p",), ("<h1",), ("<h2",), ("<ul", "<li"), ("<ol", "<li"), ("<blockquote", "<p"), ("<pre",),
              ("<table", "<tr", "<td"), ("<header@article", "<h1"), ("<header@article", "<p"), ("<div",), ("<section", "<p"), ("<p",), ("<ul", "<li"), ("<ul", "<li"))
    return [Block(b.text, (*shell, *leaves[int(rng.integers(len(leaves)))]), b.linked) if weak_label(b) and rng.random() < 0.7 else b
            for b in out]


def train_labeller(pages: list[str], *, copies: int = 6, seed: int = 5) -> BlockLabeller:
    """A labeller fitted to weakly labelled pages and dressed copies of them."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks_of, pages) if b]
    texts = sorted({b.text[:400] for page in parsed for b in page})
    shown = [*parsed, *(dressed(p, texts, rng) for p in parsed for _ in range(copies))]
    labeller = BlockLabeller()
    if shown:
        labeller.train([(features(p), np.array([weak_label(b) for b in p], np.float32)) for p in shown])
    return labeller


def extract_main_text(pages: DataFrame, *, max_training_pages: int = 96) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    hashed = rows.where("html IS NOT NULL").select(row_key("page_id", "html").alias("h")).distinct()
    picked = [r.h for r in hashed.orderBy("h").limit(max_training_pages).collect()]
    sample = rows.where(row_key("page_id", "html").isin(picked)).dropDuplicates(["page_id", "html"]) if picked else rows.limit(0)
    labeller = spark.sparkContext.broadcast(
        train_labeller([r.html for r in sample.orderBy("page_id", "html").limit(max_training_pages).collect()]))

    def stream(batches):
        for batch in batches:
            ids, urls, pages_html = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), 400):
                parsed = [blocks_of(h or "") for h in pages_html[at:at + 400]]
                flags = labeller.value.label(parsed)
                texts = ["\n".join(b.text for b, keep in zip(p, f) if keep) for p, f in zip(parsed, flags)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at:at + 400], pa.int64()), pa.array(urls[at:at + 400], pa.string()), pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, parsed)), pa.int64()),
                    pa.array([int(f.sum()) for f in flags], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return rows.mapInArrow(stream, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
