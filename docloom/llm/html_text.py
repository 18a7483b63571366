"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags) in page order. Each block is two bags of hashed
features, the tags, classes and ids on its path and its words, and five measures of its text. A numpy bidirectional LSTM reads the
page's blocks both ways and labels every block as article or not with the whole page in view. The network is trained
here: a bounded, seeded sample of pages (``SAMPLE_PAGES``, pages of at most ``SAMPLE_BYTES``) gets labels from what its
markup declares (article or main against navigation, adverts, forms, comments and the like). Copies of it with such
parts added teach forms that the sample lacks, and copies whose paths have lost their telling names (every container a
plain div, classes gone or random) keep their labels, so that links, lengths, punctuation, words and neighbours must
tell where no name does.

Null and empty pages give empty text. Scripts, styles, templates, comments and declarations hold no blocks. Cut-off
pages keep what stands before the cut; an unfinished tag at the end is dropped. No page or block is shortened. Repeated
rows repeat; columns other than the page's id, url and html are left out.
"""

from __future__ import annotations

import html
import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

SAMPLE_PAGES = 250
SAMPLE_BYTES = 65_536
PATH_DIM, WORD_DIM = 512, 1024
PATH_EMB, WORD_EMB, SCALARS, HIDDEN = 16, 4, 5, 24

# How HTML names things.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HIDDEN_TAGS = "script|style|noscript|template|iframe|object|textarea|select|button"  # a slash does not close these
ARTICLE_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset("nav header footer aside form title head menu dialog".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement sponsored sponsor promo promotion banner nav navbar menu breadcrumb breadcrumbs header footer sidebar aside widget cookie cookies consent notice gdpr newsletter subscribe signup login share social related recommended comment comments reply respond disqus popup modal".split()
)

_INSIDE = r"(?:[^'\">]|\"[^\"]*\"|'[^']*'|['\"])*?"  # of a tag; a quote that is never closed is an ordinary character
_PART = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN_TAGS})(?=[\s/>]){_INSIDE}(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    rf"|<svg(?=[\s/>]){_INSIDE}(?:/>|>.*?(?:</svg\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(>|\Z)|([^<]+)|<",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?,;](?=\s|$)")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[str, ...], ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order; a path entry is an open element's tag and the words of its class, id and role."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                out.append(Block(clean, tuple(e for e in stack if e[0] not in INLINE), linked))
            text.clear()
        linked = 0

    def pop_to(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    for m in _PART.finditer(page or ""):
        raw = m.group(6)
        if raw is not None or m.group(0) == "<":
            text.append(m.group(0))
            linked += len(m.group(0)) if in_link else 0
            continue
        tag = m.group(3)
        if tag is None:
            continue
        if not m.group(5):  # the page ends inside this tag
            break
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = 0 if m.group(2) else 1
            continue
        flush()
        if m.group(2):
            pop_to((tag,), ())
            continue
        if tag in CLOSES_P:
            pop_to(("p",), ("td", "th", "li", "table", "div", "article", "section", "body"))
        if tag in SIBLINGS:
            pop_to(SIBLINGS[tag], ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"))
        if tag == "body":
            pop_to(("head",), ())
        if tag not in VOID and not m.group(4).endswith("/"):
            words = [w for a in _ATTR.finditer(m.group(4)) for w in _NAME.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())]
            stack.append((tag, *words))
    flush()
    return out


def declared_label(path: tuple[tuple[str, ...], ...]) -> int:
    """What the markup says: 1 inside article or main unless some part on the path is something else."""
    if any(e[0] in OTHER_TAGS or OTHER_WORDS & set(e[1:]) for e in path):
        return 0
    return int(any(e[0] in ARTICLE_TAGS or {"article", "content", "main", "post", "story", "entry"} & set(e[1:]) for e in path))


class Features:
    """Hashed features of blocks; hashes are kept by word."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.paths: dict[tuple, list[int]] = {}

    def word(self, w: str) -> int:
        h = self.words.get(w)
        if h is None:
            h = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM
            if len(self.words) >= 300_000:
                self.words.clear()
            self.words[w] = h
        return h

    def path(self, path: tuple) -> list[int]:
        found = self.paths.get(path)
        if found is None:
            names = [n for e in path for n in (e[0], *(f".{w}" for w in e[1:]))]
            names += [f"{a[0]}>{b[0]}" for a, b in zip(path, path[1:])] + ([f"leaf:{path[-1][0]}"] if path else ["none"])
            found = [zlib.crc32(n.encode("utf-8", "surrogatepass")) % PATH_DIM for n in names]
            if len(self.paths) >= 100_000:
                self.paths.clear()
            self.paths[path] = found
        return found

    def of(self, blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        word = self.word
        words = [[word(w) for w in b.text.split(" ")] for b in blocks]
        scalars = np.array(
            [
                [math.log1p(len(b.text)) / 8, min(1.0, b.linked / len(b.text)), math.log1p(len(w)) / 6, math.log1p(len(_STOP.findall(b.text))) / 3, b.text[-1] in ".!?:;\"'”»)"]
                for b, w in zip(blocks, words)
            ],
            np.float32,
        )
        return [self.path(b.path) for b in blocks], words, scalars.reshape(-1, SCALARS)


def _mean_rows(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embedding means -> bidirectional LSTM -> logistic output, with its own training by Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.n_in = PATH_EMB + WORD_EMB + SCALARS
        shape = {"path": (PATH_DIM, PATH_EMB), "word": (WORD_DIM, WORD_EMB), "out": (2 * HIDDEN, 1), "bias": (1,)}
        for side in "fb":
            shape |= {f"x{side}": (self.n_in, 4 * HIDDEN), f"h{side}": (HIDDEN, 4 * HIDDEN), f"c{side}": (4 * HIDDEN,)}
        spread = lambda k, s: 0.6 if k in ("path", "word") else 0.6 / np.sqrt(s[0])
        self.w = {k: (r.normal(0, spread(k, s), s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        for side in "fb":
            self.w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open

    def to_bytes(self) -> bytes:
        """The trained weights, to be kept for other runs."""
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Labeller:
        model = cls()
        with np.load(io.BytesIO(data)) as kept:
            model.w = {k: kept[k] for k in model.w}
        return model

    def inputs(self, path: list, word: list, scalars: np.ndarray) -> np.ndarray:
        return np.hstack([_mean_rows(self.w["path"], path), _mean_rows(self.w["word"], word), scalars])

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (batch, time, HIDDEN); the state stands still where the mask is 0."""
        batch, time, _ = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((batch, time, HIDDEN), np.float32)
        pre = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return (both @ self.w["out"])[:, :, 0] + self.w["bias"]

    def _back(self, x: np.ndarray, side: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh = np.zeros((len(x), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        wx, wh = self.w[f"x{side}"], self.w[f"h{side}"]
        for t, h0, c0, i, f, o, g, tc, m in reversed(kept):
            dh = dh + d_out[:, t]
            dn = m * dh
            d_new_c = m * dc + dn * o * (1 - tc * tc)
            dz = np.hstack([d_new_c * g * i * (1 - i), d_new_c * c0 * f * (1 - f), dn * tc * o * (1 - o), d_new_c * i * (1 - g * g)])
            grads[f"x{side}"] += x[:, t].T @ dz
            grads[f"h{side}"] += h0.T @ dz
            grads[f"c{side}"] += dz.sum(axis=0)
            dx[:, t] = dz @ wx.T
            dh = dz @ wh.T + (1 - m) * dh
            dc = d_new_c * f + (1 - m) * dc
        return dx

    def fit(self, pages: list[tuple[list, list, np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Labeller:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, last = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for a in range(0, len(pages), batch):
                group = [pages[k] for k in order[a : a + batch]]
                sizes = [len(p[3]) for p in group]
                at = [(b, t) for b, n in enumerate(sizes) for t in range(n)]
                rows, cols = np.array([b for b, _ in at]), np.array([t for _, t in at])
                path, word = [x for p in group for x in p[0]], [x for p in group for x in p[1]]
                x = np.zeros((len(group), max(sizes), self.n_in), np.float32)
                x[rows, cols] = self.inputs(path, word, np.vstack([p[2] for p in group]))
                mask, y = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
                mask[rows, cols], y[rows, cols] = 1, np.concatenate([p[3] for p in group])
                kf, kb = [], []
                both = np.concatenate([self._run(x, mask, "f", kf), self._run(x, mask, "b", kb)], axis=2)
                d = (_sigmoid((both @ self.w["out"])[:, :, 0] + self.w["bias"]) - y) * mask / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1)
                grads["bias"] = d.sum(keepdims=True)[0]
                d_both = d[:, :, None] * self.w["out"][:, 0]
                dx = self._back(x, "f", kf, d_both[:, :, :HIDDEN], grads) + self._back(x, "b", kb, d_both[:, :, HIDDEN:], grads)
                dx = dx[rows, cols]
                for name, lists, part in (("path", path, dx[:, :PATH_EMB]), ("word", word, dx[:, PATH_EMB : PATH_EMB + WORD_EMB])):
                    n = np.array([len(v) for v in lists])
                    flat = np.fromiter((i for v in lists for i in v), np.int64, int(n.sum()))
                    np.add.at(grads[name], flat, np.repeat(part / n[:, None], n, axis=0).astype(np.float32))
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - (rate * (1.5 - 1.4 * step / last) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], features: Features, cells: int = 16_384) -> list[np.ndarray]:
        """The probability of every block; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= cells:
                b += 1
            group = [pages[k] for k in order[a:b]]
            sizes = [len(g) for g in group]
            rows = np.repeat(np.arange(len(group)), sizes)
            cols = np.concatenate([np.arange(n) for n in sizes])
            x = np.zeros((len(group), max(sizes), self.n_in), np.float32)
            x[rows, cols] = self.inputs(*features.of([block for g in group for block in g]))
            mask = np.zeros(x.shape[:2], np.float32)
            mask[rows, cols] = 1
            p = _sigmoid(self.logits(x, mask))
            for j, k in enumerate(order[a:b]):
                out[k] = p[j, : sizes[j]]
            a = b
        return out


_ADDED = (
    ('<header class="site-header"><div class="logo">{}</div></header>', '<div class="cookie-notice"><p>{}</p></div>', '<aside class="sidebar"><h3>{}</h3><ul><li>{}</li></ul></aside>', '<div class="banner ad">{}</div>', '<form class="login"><label>{}</label><p>{}</p></form>', '<div class="breadcrumb">{}</div>'),
    ('<section class="comments"><h2>{}</h2><div class="comment"><p>{}</p></div></section>', '<div class="related"><ul><li><a href="#">{}</a></li></ul></div>', '<form><p>{}</p></form>', '<div class="newsletter"><p>{}</p></div>', '<aside><p>{}</p></aside>', '<div class="share social">{}</div>', '<div id="comments"><ol><li><p>{}</p></li></ol></div>'),
)


def varied(page: str, texts: list[str], r: np.random.Generator) -> str:
    """The page with parts that are no article before, after or inside it, filled with texts of other pages."""
    fill = lambda form: re.sub(r"\{\}", lambda _: html.escape(texts[int(r.integers(len(texts)))]), form)
    before = "".join(fill(_ADDED[0][k]) for k in np.flatnonzero(r.random(len(_ADDED[0])) < 0.3))
    after = "".join(fill(_ADDED[1][k]) for k in np.flatnonzero(r.random(len(_ADDED[1])) < 0.3))
    inside = fill(_ADDED[int(r.integers(2))][int(r.integers(6))]) if r.random() < 0.5 else ""
    page = page.replace("<article>", before + "<article>", 1)
    ps = [m.start() for m in re.finditer("<p>", page)]
    if inside and len(ps) > 2:
        at = ps[int(r.integers(1, len(ps)))]
        page = page[:at] + inside + page[at:]
    page = page.replace("</article>", "</article>" + after, 1)
    if r.random() < 0.15:
        page = page.replace("<article>", '<main><div class="content">', 1).replace("</article>", "</div></main>", 1)
    return page


#: Tags that hold parts of a page; without their names they are plain containers.
_PARTS = frozenset("article main section nav header footer aside form menu dialog".split())


def unnamed(blocks: list[Block], r: np.random.Generator, classes: str, leaves: float = 0.0) -> list[Block]:
    """The blocks with paths that tell less: parts as plain div, class words "kept", "gone" or "random".

    ``leaves``: the chance that a page's paragraphs, its lists or its headings are plain as well; half as often, all of
    them are table cells.
    """
    made: dict[str, str] = {}
    box = "td" if r.random() < leaves / 2 else "div"
    plain = _PARTS.union(*(tags for tags in (("p",), ("ul", "ol", "li"), ("h1", "h2", "h3", "h4")) if r.random() < leaves))

    def word(w: str) -> str:
        return made.setdefault(w, "".join(chr(97 + int(k)) for k in r.integers(0, 26, 5)))

    def entry(e: tuple[str, ...]) -> tuple[str, ...]:
        names = e[1:] if classes == "kept" else tuple(map(word, e[1:])) if classes == "random" else ()
        return (box if e[0] in plain else e[0], *names)

    return [Block(b.text, tuple(map(entry, b.path)), b.linked) for b in blocks]


def shortened(blocks: list[Block], r: np.random.Generator, share: float = 0.3) -> list[Block]:
    """The blocks, some of them cut to a few words: samples may lack short headings and paragraphs."""

    def cut(b: Block) -> Block:
        words = b.text.split(" ")
        n = int(r.integers(1, 9))
        heading = bool(b.path) and b.path[-1][0] in ("h1", "h2", "h3", "h4")
        if len(words) <= n or r.random() > (2 * share if heading else share):
            return b
        text = " ".join(words[:n]) + (b.text[-1] if b.text[-1] in ".!?" else "")
        return Block(text, b.path, len(text) if b.linked >= len(b.text) else 0)

    return [cut(b) for b in blocks]


def trimmed(blocks: list[Block], label: list[int], r: np.random.Generator, share: float = 0.3) -> tuple[list[Block], list[int]]:
    """The page with a shorter article, without what stands before it, or without what follows it, each by chance."""
    article = [k for k, y in enumerate(label) if y]
    if not article:
        return blocks, label
    keep = np.ones(len(blocks), bool)
    if r.random() < share:
        a = int(r.integers(len(article)))
        gone = np.delete(article, slice(a, a + int(r.integers(1, 5))))
        keep[gone] = False
    if r.random() < share:
        keep[: article[0]] = False
    if r.random() < share:
        keep[article[-1] + 1 :] = False
    return [b for b, k in zip(blocks, keep) if k], [y for y, k in zip(label, keep) if k]


def train(pages: list[str], seed: int = 7) -> Labeller:
    """A labeller from sample pages, varied copies of them and copies without names; without pages, an untaught one."""
    r = np.random.default_rng(seed)
    texts = [b.text for p in pages for b in blocks_of(p)] or ["text"]
    features, data = Features(), []

    def add(blocks: list[Block], label: list[int], other_words: bool = False) -> None:
        path, words, scalars = features.of(blocks)
        if other_words:  # as in a language that the sample lacks
            words = [r.integers(0, WORD_DIM, len(w)).tolist() for w in words]
        data.append((path, words, scalars, np.array(label, np.float32)))

    for page in pages:
        for k in range(3):
            blocks = blocks_of(varied(page, texts, r) if k else page)
            if not blocks:
                continue
            label = [declared_label(b.path) for b in blocks]
            if k:
                blocks, label = trimmed(shortened(blocks, r), label, r)
            add(blocks, label)
            for again in range(1 + (k == 0)):
                if again:
                    blocks, label = trimmed(shortened(blocks, r), label, r)
                add(unnamed(blocks, r, ("gone", "random", "gone", "kept")[int(r.integers(4))], 0.3), label, bool(r.random() < 0.5))
    return Labeller(seed).fit(data) if data else Labeller(seed)


def sample_pages(pages: DataFrame, n: int = SAMPLE_PAGES, max_bytes: int = SAMPLE_BYTES, html_col: str = "html") -> list[str]:
    """At most n distinct pages with low content hashes, of those up to ``max_bytes`` long: bounded and the same each time."""
    fit = pages.select(F.col(html_col).alias("h")).filter(F.octet_length("h").between(1, max_bytes)).withColumn("o", F.xxhash64("h", F.lit(7)))
    sample = hash_sample(fit, "o", pages.count(), n, distinct="h")
    return [r["h"] for r in sample.collect()]


def main_text(page: Column, model) -> Column:
    """Text of the blocks labelled as article, one line each; ``model`` is a broadcast Labeller."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        features, out = Features(), []
        for a in range(0, len(pages), 256):
            batch = [blocks_of(p.as_py()) for p in pages[a : a + 256]]
            for blocks, p in zip(batch, model.value.label(batch, features)):
                out.append("\n".join(b.text for b, q in zip(blocks, p) if q >= 0.5))
        return pa.array(out, pa.string())

    return extract(page)


def extract_text(pages: DataFrame, n_sample: int = SAMPLE_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages`` (repeated rows repeat).

    ``model`` (see ``Labeller.to_bytes``) spares the training.
    """
    model = pages.sparkSession.sparkContext.broadcast(model or train(sample_pages(pages, n_sample, html_col=html_col)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("__html"))
    rows = rows.select("page_id", "url", main_text(F.col("__html"), model).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
