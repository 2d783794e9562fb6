"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks of text. Each block is described by the hashed names on its tag path, its hashed words and a few
rates; a bidirectional LSTM in numpy reads the whole sequence of a page and labels every block as article or not. It is
trained here: on pages that a generator writes, with the words of a bounded sample of pages, and on that sample itself
where its markup names the article.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, tidied

#: Pages of the sample, and pages that the generator writes.
SAMPLE, WRITTEN = 150, 900
PATHS, WORDS, HIDDEN, PATH_SIZE, WORD_SIZE = 1024, 128, 16, 20, 6

# Names of HTML elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Elements whose content is no text.
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S,
)
#: Elements of other vocabularies: a slash closes them, and the start of an element of HTML ends one that nothing closes.
FOREIGN = frozenset(("svg", "math"))
#: Hidden elements that may hold others of their kind.
NESTED = FOREIGN | {"template", "object"}
_ENDS = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>" if t in NESTED else rf"<(/){t}(?=[\s/>])[^>]*>", re.I) for t in HIDDEN_TAGS}
_OF_HTML = re.compile(r"<(?:p|div|section|article|main|aside|nav|header|footer|h[1-6]|ul|ol|li|dl|dt|dd|table|pre|blockquote|body|span|br|hr|img)(?=[\s/>])", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECES = re.compile(r"[a-z]{2,}")


class Path:
    """The names on the way to a block: those of one element and, linked, those around it.

    What is asked of a path is kept with each element, so that a page of any depth costs no more than its elements.
    """

    __slots__ = ("parent", "names", "length", "hashes")

    def __init__(self, parent: Path | None = None, names: tuple[str, ...] = ()):
        self.parent, self.names = parent, names
        self.length = len(names) + (parent.length if parent else 0)
        above = parent.hashes if parent else frozenset()
        own = {_hashed(n) for n in names}
        self.hashes = above if own <= above else above | own

    def __len__(self) -> int:
        return self.length

    def __iter__(self) -> Iterator[str]:
        held, at = [], self
        while at is not None:
            held.append(at.names)
            at = at.parent
        return (n for names in reversed(held) for n in names)


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATHS


@dataclass
class Block:
    path: Path
    text: str
    linked: float


class _Hidden:
    """Where the contents of a page's hidden elements end. Tags of a kind are looked up once for a page."""

    def __init__(self, page: str):
        self.page, self.tags = page, {}

    def _closed(self, name: str, at: int) -> int | None:
        """The end of the end tag that closes an element that begins before ``at``: the first behind which one more has been closed than begun."""
        if name not in self.tags:
            starts, ends, depths, first = [], [], [], {}
            depth = 0
            for m in _ENDS[name].finditer(self.page):
                depth += -1 if m[1] else 0 if name in FOREIGN and m[0].endswith("/>") else 1
                first.setdefault(depth, []).append(len(starts))
                starts.append(m.start())
                ends.append(m.end())
                depths.append(depth)
            self.tags[name] = starts, ends, depths, first
        starts, ends, depths, first = self.tags[name]
        i = bisect_left(starts, at)
        found = first.get((depths[i - 1] if i else 0) - 1, [])
        k = bisect_left(found, i)
        return ends[found[k]] if k < len(found) else None

    def end(self, name: str, at: int) -> int:
        """Where the content of a hidden element that begins at ``at`` ends, its end tag included.

        One without an end tag hides what is left of the page; an object hides nothing then, and a drawing or formula ends
        where HTML goes on.
        """
        closed = self._closed(name, at)
        if closed is not None:
            return closed
        if name == "object":
            return at
        on = _OF_HTML.search(self.page, at) if name in FOREIGN else None
        return on.start() if on else len(self.page)


#: Elements beyond which the start of an item closes no earlier one.
_AROUND_ITEMS = ("ul", "ol", "table", "div", "section", "article", "blockquote")


def blocks(page: str | None) -> list[Block]:
    """The blocks of text of a page in order: character references decoded, white space as one space, none empty."""
    page = page or ""
    out: list[Block] = []
    root, hidden = Path(), _Hidden(page)
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = {}  # of each tag, where it stands on the stack
    buffer: list[str] = []
    links = [0, 0]  # depth of anchors, characters inside them
    path = root

    def flush() -> None:
        nonlocal path
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append(Block(path, text, min(1.0, links[1] / max(1, len(text)))))
            buffer.clear()
        links[1] = 0

    def say(text: str) -> None:
        nonlocal path
        if text:
            if not buffer:
                path = stack[-1][1] if stack else root
            buffer.append(text)
            if links[0]:
                links[1] += len(text)

    def close(tag: str) -> None:
        if places.get(tag):
            upto = places[tag][-1]
            while len(stack) > upto:
                gone, _ = stack.pop()
                places[gone].pop()
                links[0] -= gone == "a"

    at = 0
    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[4] or "").lower()
        if name in HIDDEN_TAGS and not m[1]:
            if not (name in FOREIGN and page.endswith("/>", m.start(), at)):
                at = hidden.end(name, at)
            continue
        if m[2] is None:
            continue
        tag = name
        if tag not in INLINE:
            flush()
        if m[1]:
            close(tag)
        elif tag not in VOID:
            if tag in CLOSES_ITSELF and places.get(tag) and not any(places.get(t) and places[t][-1] > places[tag][-1] for t in _AROUND_ITEMS):
                close(tag)
            names = (tag,)
            if m[3]:
                for n in _NAMES.finditer(m[3]):
                    names += tuple("." + p for p in _PIECES.findall((n[1] or n[2] or n[3] or "").lower()))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, Path(stack[-1][1] if stack else root, names)))
            links[0] += tag == "a"
    say(page[at:])
    flush()
    return out


def _rates(b: Block, place: float, count: int) -> list[float]:
    n = len(b.text)
    return [np.log1p(n) / 6, b.linked, sum(map(b.text.count, ".,;!?")) / n * 10, place, float(b.text[-1] in ".!?:;\"'"), len(b.path) / 10, np.log1p(count) / 4]


def described(page: list[Block], cache: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each block the hashed names on its path, the shares of its hashed words, and rates."""
    paths, words, rates = [], np.zeros((len(page), WORDS), np.float32), np.zeros((len(page), 7), np.float32)
    for i, b in enumerate(page):
        key = (b.path.hashes, b.path.names[-1:])
        if key not in cache:
            if len(cache) > 50_000:
                cache.clear()
            cache[key] = np.array(sorted(key[0] | {_hashed("/" + n) for n in key[1]}) or [0])
        paths.append(cache[key])
        own = b.text.encode("utf-8", "surrogatepass").split()
        if own:
            words[i] = np.bincount([zlib.crc32(w) % WORDS for w in own], minlength=WORDS) / len(own)
        rates[i] = _rates(b, i / max(1, len(page) - 1), len(page))
    return paths, words, rates


class Labeller:
    """Embeddings of paths and words, an LSTM in each direction, and a logistic output that also sees the inputs."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + 7
        self.w = {
            "path": r.normal(0, 0.3, (PATHS, PATH_SIZE)), "word": r.normal(0, 0.3, (WORDS, WORD_SIZE)),
            **{f"{d}{k}": r.normal(0, 0.2, s) if k != "b" else np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)] for d in "fb" for k, s in (("x", (size, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)), ("b", 0))},
            "out": r.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p[0]) for p in pages)
        x = np.zeros((steps, len(pages), PATH_SIZE + WORD_SIZE + 7), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for j, (paths, words, rates) in enumerate(pages):
            n = len(paths)
            x[:n, j, :PATH_SIZE] = [self.w["path"][p].sum(axis=0) for p in paths]
            x[:n, j, PATH_SIZE : PATH_SIZE + WORD_SIZE] = words @ self.w["word"]
            x[:n, j, PATH_SIZE + WORD_SIZE :] = rates
            mask[:n, j] = 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        z_all = x @ self.w[d + "x"] + self.w[d + "b"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_all[t] + h @ self.w[d + "h"]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        return out

    def probabilities(self, pages: list) -> list[np.ndarray]:
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        for s in range(0, len(order), 256):
            part = order[s : s + 256]
            x, mask = self._inputs([pages[i] for i in part])
            both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2)
            p = 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"][0])))
            for j, i in enumerate(part):
                out[i] = p[: len(pages[i][0]), j]
        return out

    def _back(self, x, mask, d, keep, grad_out, grads) -> np.ndarray:
        gx = np.zeros_like(x)
        gh, gc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, c, i, f, o, u, th, m in reversed(keep):
            gh = gh + grad_out[t]
            a = gh * m
            b = gc * m + a * o * (1 - th**2)
            gz = np.concatenate([b * u * i * (1 - i), b * c * f * (1 - f), a * th * o * (1 - o), b * i * (1 - u**2)], axis=1)
            grads[d + "x"] += x[t].T @ gz
            grads[d + "h"] += h.T @ gz
            grads[d + "b"] += gz.sum(axis=0)
            gx[t] = gz @ self.w[d + "x"].T
            gh = gz @ self.w[d + "h"].T + gh * (1 - m)
            gc = b * f + gc * (1 - m)
        return gx

    def train(self, pages: list, labels: list[np.ndarray], epochs: int = 8, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over batches of pages of like length."""
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        shuffle = random.Random(seed)
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]), shuffle.random()))
            runs = [order[s : s + 24] for s in range(0, len(order), 24)]
            shuffle.shuffle(runs)
            for part in runs:
                x, mask = self._inputs([pages[i] for i in part])
                kf, kb = [], []
                both = np.concatenate([self._run(x, mask, "f", kf), self._run(x, mask, "b", kb), x], axis=2)
                p = 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"][0])))
                y = np.zeros_like(p)
                for j, i in enumerate(part):
                    y[: len(labels[i]), j] = labels[i]
                e = (p - y) * mask / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                grads["out"] = np.einsum("tn,tnk->k", e, both)
                grads["bias"] = np.array([e.sum()], np.float32)
                gb = e[:, :, None] * self.w["out"]
                gx = gb[:, :, 2 * HIDDEN :] + self._back(x, mask, "f", kf, gb[:, :, :HIDDEN], grads) + self._back(x, mask, "b", kb, gb[:, :, HIDDEN : 2 * HIDDEN], grads)
                for j, i in enumerate(part):
                    for t, path in enumerate(pages[i][0]):
                        grads["path"][path] += gx[t, j, :PATH_SIZE]
                    grads["word"] += pages[i][1].T @ gx[: len(pages[i][0]), j, PATH_SIZE : PATH_SIZE + WORD_SIZE]
                step += 1
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (0.3 if epoch >= epochs - 2 else 1) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


# Names that pages give to what isn't their article, by kind, and to what is.
OTHER = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager", "head": "header masthead topbar top site-header branding logo banner",
    "foot": "footer site-footer bottom copyright colophon legal credits", "side": "sidebar aside side rail widget widgets related recommended popular trending tags more",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall message", "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses feedback", "form": "form search login contact survey poll", "share": "share social sharing follow",
}
OWN = "content article post entry story main body text article-body post-content entry-content page-content main-content"
OTHER_TAGS = {"menu": "nav div ul", "head": "header div", "foot": "footer div", "side": "aside div section", "notice": "div section aside dialog", "advert": "div aside ins section", "comment": "section div ol", "form": "form", "share": "div ul"}


def written(words: list[str], seed: int) -> tuple[str, None]:
    """A page by the generator. Each block's first word says whether it is part of the article: ``yesyes`` or ``nono``."""
    r = random.Random(seed)

    def some(a: int, b: int) -> str:
        n = r.randint(a, b)
        out = " ".join(r.choice(words) for _ in range(n))
        return out[:1].upper() + out[1:] + r.choice(["", ".", "."])

    def named(names: str) -> str:
        return r.choice(["", f' {r.choice(["class", "id"])}="{r.choice(names.split())}"', f' class="{r.choice(names.split())} {r.choice(words).strip(".,")}"'])

    def other(kind: str) -> str:
        tag = r.choice(OTHER_TAGS[kind].split())
        plain = tag in {"nav", "header", "footer", "aside", "form"}
        names = OTHER[kind]
        attributes = named(names) if plain else f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}{r.choice(["", "-1", " box", "-wrap"])}"'
        if kind in {"menu", "share"} or (kind in {"foot", "head", "side"} and r.random() < 0.4):
            items = "".join(r.choice(['<li><a href="/x">nono {0}</a></li>'] * 3 + ["<li>nono {0}</li>"]).format(some(1, 3)) for _ in range(r.randint(1, 9)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>nono {some(1, 3)}</label><input name=q><select><option>nono {some(1, 2)}</option></select><textarea>nono {some(1, 4)}</textarea><button>nono {some(1, 2)}</button>"
        elif kind == "comment":
            one = lambda: r.choice([f'<div class="comment"><b>nono {some(1, 2)}</b><p>nono {some(4, 40)}</p></div>', f"<li><p>nono {some(3, 60)}</p></li>", f"<p>nono {some(5, 50)}</p>"])
            inner = r.choice(["", f"<h2>nono {some(1, 3)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        else:
            inner = r.choice([f"nono {some(2, 30)}", f"<p>nono {some(2, 40)}</p>", f"<h{r.randint(1, 4)}>nono {some(1, 6)}</h4>", f"<h{r.randint(1, 4)}>nono {some(1, 4)}</h3><p>nono {some(3, 25)}</p>", f"<div>nono {some(1, 12)}</div>", f"<span>nono {some(1, 9)}</span> <a href=#>{some(1, 3)}</a>", f"&copy; nono {some(2, 10)}"]) * r.randint(1, 2)
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def piece() -> str:
        k = r.random()
        if k < 0.7:
            return f"<p>yesyes {some(*r.choice([(1, 3), (4, 15), (15, 90)]))}</p>"
        if k < 0.78:
            return f"<p><b>yesyes {some(5, 60)}<br>"
        if k < 0.84:
            return f"<h{r.randint(2, 4)}>yesyes {some(1, 6)}</h2>"
        if k < 0.9:
            return "<ul>" + "".join(f"<li>yesyes {some(1, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.94:
            return f"<blockquote><p>yesyes {some(5, 30)}</p></blockquote>"
        if k < 0.97:
            return f"<table><tr><td>yesyes {some(1, 5)}</td><td>yesyes {some(1, 5)}</td></tr></table>"
        return f"<pre>yesyes {some(3, 20)}</pre>"

    inside = lambda: other(r.choice(["advert", "side", "share", "notice", "form"])) if r.random() < 0.12 else ""
    title = r.choice([f"<h1>yesyes {some(2, 9)}</h1>", f"<h1>yesyes {some(2, 9)}</h1>", ""])
    article = title + "".join(piece() + inside() for _ in range(r.randint(1, 14)))
    tag = r.choice(["article", "article", "main", "div", "section"])
    article = f"<{tag}{named(OWN) if tag in {'article', 'main'} else f' class={chr(34)}{r.choice(OWN.split())}{chr(34)}'}>{article}{other('comment') if r.random() < 0.2 else ''}</{tag}>"
    if r.random() < 0.3:
        article = f"<{r.choice(['main', 'div class=wrapper', 'div id=page'])}>{article}</div></main>"
    before = "".join(other(k) for k in ("head", "menu", "advert", "notice", "form", "side", "share") if r.random() < 0.45)
    after = "".join(other(k) for k in ("share", "comment", "side", "form", "advert", "notice", "foot", "menu") if r.random() < 0.45)
    return f"<!DOCTYPE html><html><head><title>nono {some(2, 9)}</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """Labels from markup that names the article; None where it doesn't."""
    if not any(n in ("article", "main") for b in page for n in b.path):
        return None
    names = {"." + p for kind, x in OTHER.items() for n in x.split() for p in _PIECES.findall(n)} | {"nav", "header", "footer", "aside", "form", "title"}
    out = []
    for b in page:
        first = next((i for i, n in enumerate(b.path) if n in ("article", "main")), None)
        out.append(float(first is not None and not names & set(list(b.path)[first:])))
    return np.array(out, np.float32)


def learn(pages: DataFrame, id: str = "page_id", column: str = "html") -> Labeller:
    """A labeller trained on pages of the generator and on the ``SAMPLE`` pages whose ids have the smallest hashes."""
    some = pages.filter(F.col(column).isNotNull() & (F.length(column) < 200_000)).select(F.col(id).alias("id"))
    ids = materialise(some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).distinct(), "sample")
    # The sample's ids are few by its bound.
    got = pages.select(F.col(id).alias("id"), F.col(column).alias("html")).join(F.broadcast(ids), "id").orderBy("id", "html").select("html").collect()
    real = [blocks(r.html) for r in got]
    words = [w for page in real for b in page for w in b.text.split()][:20_000] or ["word", "text", "page"]
    words = [w for w in words if not set(w) & set("<>&\"'=")] or ["word"]
    own: list[tuple[list[Block], np.ndarray]] = []
    for k in range(WRITTEN):
        page, labels = [], []
        for b in blocks(written(words, k)):
            keep, drop = "yesyes" in b.text, "nono" in b.text
            text = " ".join(w for w in b.text.split() if w not in ("yesyes", "nono"))
            if (keep or drop) and text:
                page.append(Block(b.path, text, b.linked))
                labels.append(float(keep))
        own.append((page, np.array(labels, np.float32)))
    own += [(page, y) for page in real if page and (y := weak_labels(page)) is not None]
    own = [(p, y) for p, y in own if 0 < len(p) <= 400]
    model, cache = Labeller(), {}
    model.train([described(p, cache) for p, _ in own], [y for _, y in own])
    return model


def extract(pages: DataFrame, model: Labeller, keep: list[str], column: str = "html") -> DataFrame:
    """The columns ``keep`` of each page, with ``text``: its article's blocks, joined by a space.

    Null and empty pages, and pages without an article, have an empty text. Repeated rows each come back. ``keep``
    mustn't hold ``text``; other columns aren't read.
    """
    schema = pages.select(*keep).schema.add("text", "string")
    n = len(keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in slices(batches, 512):
            found = [blocks(x) for x in batch.column(n).to_pylist()]
            p = model.probabilities([described(b, cache) for b in found])
            text = [" ".join(b.text for b, q in zip(page, own) if q >= 0.5) for page, own in zip(found, p)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(text, pa.string())], [*keep, "text"])

    return pages.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(column).alias("_html")).mapInArrow(tidied(rows), schema)
