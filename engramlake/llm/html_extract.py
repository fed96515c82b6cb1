"""HTML extraction: a recurrent labeller decides for every block whether it is main text.

Each page is its sequence of leaf blocks. A block is a vector of its hashed tag path, its hashed words and
a few lengths; a bidirectional LSTM in numpy reads the whole page in both directions and labels
every block. It is trained on at most ``TRAIN_PAGES`` pages of the table, chosen by hash of their
identifier, each also in variants with further page furniture put in (``VARIANTS``), so that
elements which these pages happen not to have are known too. The labels to learn come from the element names
and class names listed below. A class name counts whole or in a clear compound (``site-footer``, ``ad-box``; not
``no-sidebar`` or ``legal-history``), and not on html, body and the elements around the article, which say
something of the page and not of the block. Every page is then labelled by the model alone, whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.html_blocks import blocks
from engramlake.llm.shingles import word_hashes
from engramlake.llm.store import releasing

TRAIN_PAGES = 120
TRAIN_BLOCKS = 60  # longer training pages are cut into windows of so many blocks
VARIANTS = 8
HIDDEN = 16
EPOCHS = 24
PATH_BITS = 384
WORD_BITS = 48
BATCH_PAGES = 256
BATCH_BYTES = 2 << 20
CELLS = 8192  # blocks whose vectors are held at once

# Element names and class words whose blocks are not main text (training labels).
FURNITURE_TAGS = frozenset("head title nav header footer aside form button select option textarea menu dialog label fieldset legend input".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer "
    "masthead adsbygoogle gdpr complementary respond cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search comment comments reply replies discussion "
    "disqus share sharing social related recommended widget pagination pager copyright legal disclaimer toolbar tags".split()
)
# What may stand before and after these words in a name of furniture.
NAMES_BEFORE = frozenset("site page global primary secondary main sub top bottom left right inner outer mobile sticky fixed skip user blog post article entry google".split())
NAMES_AFTER = frozenset(
    "left right top bottom primary secondary box bar list item items link links button buttons icon icons wrap wrapper container inner outer block area section slot "
    "unit module panel row col column group title heading image text content body form field author meta count toggle trail post posts article articles story stories x".split()
)
# Words of names that say nothing of furniture, for the variants.
PLAIN_WORDS = "history content layout single open archive chapter intro page wrap science lead detail view grid theme col main hero figure part summary report".split()
MAIN_TAGS = frozenset("article main".split())
ROOT_TAGS = frozenset("html body".split())

Block = tuple[str, tuple[str, ...], int]
_PART = re.compile(r"[a-z]+")
_FURNITURE: dict[str, tuple[str, ...]] = {}


def furniture_words(name: str) -> tuple[str, ...]:
    """The furniture words of a class, id or role name that names furniture, as a whole or in a clear compound."""
    found = _FURNITURE.get(name)
    if found is None:
        if len(_FURNITURE) > 100_000:
            _FURNITURE.clear()
        parts = _PART.findall(name)
        at = next((k for k, part in enumerate(parts) if part in FURNITURE_WORDS), len(parts))
        clear = all(part in NAMES_BEFORE for part in parts[:at]) and all(part in FURNITURE_WORDS or part in NAMES_AFTER for part in parts[at:])
        found = _FURNITURE[name] = tuple(part for part in parts[at:] if part in FURNITURE_WORDS) if clear else ()
    return found


def _element_end(path: Sequence[str], at: int) -> int:
    """Where the element that begins at ``at`` ends, with its names."""
    at += 1
    while at < len(path) and path[at][0] == "@":
        at += 1
    return at


def article_paths(paths: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Paths down to the main and the article element that hold the page's text: at most one of each kind.

    Of several the one outside furniture elements, then outside named furniture, then without such a name, then with most blocks.
    """
    found: dict[str, Counter[tuple[str, ...]]] = {"main": Counter(), "article": Counter()}
    own: dict[tuple[str, ...], int] = {}
    for path, times in Counter(map(tuple, paths)).items():
        for at, word in enumerate(path):
            if word in MAIN_TAGS:
                down = path[: _element_end(path, at)]
                found[word][down] += times
                own[down] = at
    out: list[tuple[str, ...]] = []
    for counts in found.values():
        if counts:
            best = max(
                counts,
                key=lambda p: (not any(w in FURNITURE_TAGS for w in p), not _named_furniture(p[: own[p]], out), not _named_furniture(p, out), counts[p], len(p)),
            )
            out.append(best)
    return out


def _page_words(path: Sequence[str], articles: Sequence[Sequence[str]]) -> list[str]:
    """The path without the names of html, body and the elements that hold an article of the page or are it."""
    shared = 0
    for article in articles:
        same = next((k for k, (a, b) in enumerate(zip(path, article, strict=False)) if a != b), min(len(path), len(article)))
        while same and (same < len(path) and path[same][0] == "@" or same < len(article) and article[same][0] == "@"):
            same -= 1  # only whole elements are the same
        shared = max(shared, same)
    out, root = [], False
    for at, word in enumerate(path):
        if word[0] != "@":
            root = at < shared or word in ROOT_TAGS
        if word[0] != "@" or not root:
            out.append(word)
    return out


def _named_furniture(path: Sequence[str], articles: Sequence[Sequence[str]]) -> bool:
    return any(word[0] == "@" and furniture_words(word[1:]) for word in _page_words(path, articles))


def labels_of(paths: Sequence[Sequence[str]]) -> list[bool]:
    """Training labels of a page: no furniture on the path, and inside the article where the page has one."""
    articles = article_paths(paths)
    known: dict[tuple[str, ...], bool] = {}
    for path in set(map(tuple, paths)):
        clean = not any(word in FURNITURE_TAGS for word in path) and not _named_furniture(path, articles)
        known[path] = clean and (not articles or any(word in MAIN_TAGS for word in path))
    return [known[tuple(path)] for path in paths]


def is_main(path: Sequence[str], whole_page: Sequence[Sequence[str]]) -> bool:
    """Training label of one block of a page."""
    return labels_of([*whole_page, path])[-1]


_SLOTS: dict[str, tuple[int, int]] = {}


def _slots(word: str) -> tuple[int, int]:
    """Two places of a path word, so that two words rarely look the same."""
    found = _SLOTS.get(word)
    if found is None:
        if len(_SLOTS) > 100_000:
            _SLOTS.clear()
        code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        found = _SLOTS[word] = (code % (PATH_BITS // 2), PATH_BITS // 2 + code // PATH_BITS % (PATH_BITS // 2))
    return found


def vectors(page_blocks: Sequence[Block], at: int = 0, to: int | None = None, articles: Sequence[Sequence[str]] | None = None) -> np.ndarray:
    """One row per block of the page, or of its blocks ``at`` to ``to``: hashed path words, hashed text words, lengths and link share.

    Names of html, body and the elements around the article are left out; a name of furniture counts as its words, any
    other name only as a name, and a page without article is told.
    """
    whole = len(page_blocks)
    articles = article_paths([path for _, path, _ in page_blocks]) if articles is None else articles
    page_blocks = page_blocks[at:to]
    n = len(page_blocks)
    out = np.zeros((n, PATH_BITS + WORD_BITS + 5), np.float32)
    known: dict[tuple[str, ...], list[int]] = {}
    for row, (text, path, linked) in enumerate(page_blocks):
        if path not in known:
            words = [] if articles else ["?"]
            for word in _page_words(path, articles):
                words += [word] if word[0] != "@" else [f"@{w}" for w in furniture_words(word[1:])] or ["@"]
            known[path] = [slot for word in words for slot in _slots(word)]
        for slot in known[path]:
            out[row, slot] += 1.0
        size = len(text)
        tail = out[row, PATH_BITS + WORD_BITS :]
        tail[0], tail[1] = np.log1p(size) / 5, min(1.0, linked / max(1, size))
        tail[2], tail[3], tail[4] = float(text[-1:] in ".!?"), (at + row) / whole, 1.0
    if n:
        hashes, counts = word_hashes(pa.array([t.encode("utf-8", "surrogatepass") for t, _, _ in page_blocks], pa.large_binary()))
        slots = np.repeat(np.arange(n), counts) * WORD_BITS + (hashes % np.uint64(WORD_BITS)).astype(np.int64)
        words = np.bincount(slots, minlength=n * WORD_BITS).reshape(n, WORD_BITS)
        out[:, PATH_BITS : PATH_BITS + WORD_BITS] = words / np.maximum(1, counts)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.1, (inputs, 4 * hidden)).astype(np.float32)
            self.p["h" + side] = rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + side] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.2, 2 * hidden).astype(np.float32)
        self.p["e"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, traced: bool = True) -> tuple[np.ndarray, list]:
        steps, pages, h = x.shape[0], x.shape[1], self.hidden
        drive = x @ self.p["x" + side] + self.p["c" + side]
        state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out, trace = np.zeros((steps, pages, h), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = drive[t] + state @ self.p["h" + side]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if traced:
                trace.append((t, state, cell, i, f, o, g, squashed, m))
            state, cell = m * (o * squashed) + (1 - m) * state, m * new + (1 - m) * cell
            out[t] = state
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds of main text, (blocks, pages), for padded input (blocks, pages, features)."""
        both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]], axis=2)
        return both @ self.p["o"] + self.p["e"]

    def long_scores(self, page_blocks: Sequence[Block]) -> np.ndarray:
        """Log odds of main text of one page of any length, whose vectors are made ``CELLS`` blocks at a time."""
        h, n = self.hidden, len(page_blocks)
        articles = article_paths([path for _, path, _ in page_blocks])
        total = np.full(n, self.p["e"][0], np.float32)
        starts = range(0, n, CELLS)
        for side, weights, order in (("f", self.p["o"][:h], starts), ("b", self.p["o"][h:], reversed(starts))):
            state, cell = np.zeros(h, np.float32), np.zeros(h, np.float32)
            for at in order:
                drive = vectors(page_blocks, at, at + CELLS, articles) @ self.p["x" + side] + self.p["c" + side]
                for t in range(len(drive)) if side == "f" else range(len(drive) - 1, -1, -1):
                    z = drive[t] + state @ self.p["h" + side]
                    gates = _sigmoid(z[: 3 * h])
                    cell = gates[h : 2 * h] * cell + gates[:h] * np.tanh(z[3 * h :])
                    state = gates[2 * h :] * np.tanh(cell)
                    total[at + t] += state @ weights
        return total

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = self.hidden
        runs = {side: self._run(x, mask, side) for side in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ self.p["o"] + self.p["e"])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        d = mask * (p - y) / total
        grads = {"o": np.tensordot(d, both, 2).astype(np.float32), "e": np.array([d.sum()], np.float32)}
        for k, side in enumerate("fb"):
            d_out = d[:, :, None] * self.p["o"][k * h : (k + 1) * h]
            d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            d_drive = np.zeros((*x.shape[:2], 4 * h), np.float32)
            grads["h" + side] = np.zeros_like(self.p["h" + side])
            for t, state, cell, i, f, o, g, squashed, m in reversed(runs[side][1]):
                ds = d_state + d_out[t]
                live = m * ds
                dc = m * d_cell + live * o * (1 - squashed**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), live * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                d_drive[t] = dz
                grads["h" + side] += state.T @ dz
                d_state = (1 - m) * ds + dz @ self.p["h" + side].T
                d_cell = (1 - m) * d_cell + dc * f
            grads["x" + side] = np.tensordot(x, d_drive, ([0, 1], [0, 1])).astype(np.float32)
            grads["c" + side] = d_drive.sum((0, 1))
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, size: int = 32, rate: float = 0.02, seed: int = 7) -> None:
        """Adam over batches of (vectors, labels) pages of like length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        pages = sorted(pages, key=lambda page: len(page[1]))
        step = 0
        for epoch in range(epochs):
            pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
            for at in rng.permutation(range(0, len(pages), size)):
                x, mask, y = padded([v for v, _ in pages[at : at + size]], [z for _, z in pages[at : at + size]])
                _, grads = self.gradients(x, mask, y)
                step += 1
                for k, grad in grads.items():
                    grad = np.clip(grad, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: Sequence[Sequence[Block]]) -> list[np.ndarray]:
        """True for main text, per block of every page; pages of like length are run together, in at most ``CELLS`` padded blocks."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 32 and len(pages[order[to]]) * (to + 1 - at) <= CELLS:
                to += 1
            part, at = order[at:to], to
            if len(pages[part[0]]) > CELLS:
                out[part[0]] = self.long_scores(pages[part[0]]) > 0
                continue
            x, mask, _ = padded([vectors(pages[k]) for k in part], None)
            scores = self.scores(x, mask)
            for column, k in enumerate(part):
                out[k] = scores[: len(pages[k]), column] > 0
        return out


def padded(xs: Sequence[np.ndarray], ys: Sequence[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x = np.zeros((steps, len(xs), xs[0].shape[1]), np.float32)
    mask, y = np.zeros((steps, len(xs)), np.float32), np.zeros((steps, len(xs)), np.float32)
    for k, page in enumerate(xs):
        x[: len(page), k] = page
        mask[: len(page), k] = 1
        if ys is not None:
            y[: len(page), k] = ys[k]
    return x, mask, y


def variant(page: Sequence[Block], rng: np.random.Generator) -> list[Block]:
    """The page with furniture that its site lacks, made of its own words, inside and around the article."""
    words = " ".join(t for t, _, _ in page).split() or ["text"]
    share = rng.random() if rng.random() < 0.6 else 1.0  # shorter pages, with shorter blocks
    out = [(" ".join(t.split()[: int(rng.integers(1, 30))]) if share < 0.5 else t, p, n) for t, p, n in page if rng.random() < share] or list(page)
    top = () if rng.random() < 0.15 else ("html",)
    out = [(t, (*top, *p[1:]), n) for t, p, n in out]
    page = [(t, (*top, *p[1:]), n) for t, p, n in page]
    roots: list[tuple[str, ...]] = [(*top, "body")]
    inner = next((p for _, p, _ in page if any(w in MAIN_TAGS for w in p)), None)
    if inner:
        at = next(k for k, w in enumerate(inner) if w in MAIN_TAGS)
        roots.append(tuple(inner[: at + 1]))
        if rng.random() < 0.5:  # some sites mark the text by main, or wrap it further
            other = [("main",), ("main", "article"), ("article", "div", "@content"), ("main", "@main", "section"), ("div", "@wrapper", "article", "section")][rng.integers(5)]
            out = [(t, (*p[:at], *other, *p[at + 1 :]) if len(p) > at and p[at] == inner[at] else p, n) for t, p, n in out]
            roots[-1] = (*inner[:at], *other)
        elif rng.random() < 0.3:  # and some have no such element at all
            other = ("div", "@content")
            out = [(t, tuple(v for w in p for v in (other if w in MAIN_TAGS else (w,))), n) for t, p, n in out]
            roots[-1] = tuple(v for w in roots[-1] for v in (other if w in MAIN_TAGS else (w,)))
    tags = [w for w in sorted(FURNITURE_TAGS) if w not in ("head", "title")]
    names = sorted(FURNITURE_WORDS)
    for _ in range(int(rng.integers(2, 9))):
        root = roots[int(rng.integers(len(roots)))]
        if rng.random() < 0.45:
            path = (*root, tags[rng.integers(len(tags))])
        else:
            path = (*root, ("div", "section", "ul", "p", "span")[rng.integers(5)], f"@{names[rng.integers(len(names))]}")
        leaf = ("p", "li", "div", "h3", "")[rng.integers(5)]
        path = (*path, leaf) if leaf else path
        place = int(rng.integers(len(out) + 1))
        for _ in range(int(rng.integers(1, 4))):
            start = int(rng.integers(len(words)))
            text = " ".join(words[start : start + int(rng.integers(1, 25))])
            out.insert(place, (text, path, len(text) if rng.random() < 0.3 else 0))
    def plain_name() -> str:
        """A name that holds a furniture word and does not name furniture, or one without any."""
        word, other = names[rng.integers(len(names))], PLAIN_WORDS[rng.integers(len(PLAIN_WORDS))]
        return "@" + (f"no-{word}", f"with-{word}", f"has-{word}", f"{word}-{other}", f"{other}-{word}", f"{other}-with-{word}", other, f"{other}-{int(rng.integers(1000))}")[rng.integers(8)]

    for _ in range(int(rng.integers(0, 6))):  # and main text in other elements
        root = roots[-1]
        path = (*root, *(("ul", "li"), ("blockquote",), ("h2",), ("table", "tr", "td"), ("pre",), ("div", "@text", "p"), ("section", "p"), ("figure", "figcaption"))[rng.integers(8)])
        if rng.random() < 0.5:
            path = (*root, ("div", "section")[rng.integers(2)], *(plain_name() for _ in range(int(rng.integers(1, 4)))), *path[len(root) :])
        start = int(rng.integers(len(words)))
        inside = [k for k, (_, p, _) in enumerate(out) if p[: len(root)] == root] or [len(out)]
        out.insert(inside[int(rng.integers(len(inside)))], (" ".join(words[start : start + int(rng.integers(3, 40))]), path, 0))
    if rng.random() < 0.5:  # names of the page's state on the elements around the article and on the article
        for root in sorted({*roots, roots[0][:-1]} - {()}, key=len, reverse=True):
            said = tuple(plain_name() if rng.random() < 0.7 else f"@{names[rng.integers(len(names))]}" for _ in range(int(rng.integers(0, 4))))
            out = [(t, (*root, *said, *p[len(root) :]) if p[: len(root)] == root else p, n) for t, p, n in out]
    if inner and rng.random() < 0.5:
        wrap = ("div", *(plain_name() for _ in range(int(rng.integers(1, 3)))))
        held = [k for k, w in enumerate(roots[0]) if w == "body"][0] + 1
        ends = {p: next((k for k in range(held, len(p)) if p[k][0] != "@"), len(p)) for _, p, _ in out if p[: held] == roots[0]}
        out = [(t, (*p[: ends[p]], *wrap, *p[ends[p] :]) if p in ends else p, n) for t, p, n in out]
    return out


def train(pages: Sequence[str], variants: int = VARIANTS, seed: int = 11) -> BlockLabeller:
    """A labeller from html pages; without any page it is trained on furniture alone."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks, pages) if b] or [[("text", ("html", "body", "article", "p"), 0)]]
    sets = []
    for page in parsed:
        for version in [page, *(variant(page, rng) for _ in range(variants))]:
            paths = [p for _, p, _ in version]
            labels = np.array(labels_of(paths), np.float32)
            rows = vectors(version)
            sets += [(rows[k : k + TRAIN_BLOCKS], labels[k : k + TRAIN_BLOCKS]) for k in range(0, len(labels), TRAIN_BLOCKS)]
    model = BlockLabeller(PATH_BITS + WORD_BITS + 5)
    model.fit(sets)
    return model


def _extract(model: BlockLabeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # slices of few pages and bytes; a longer page is a slice of its own
                limit = (sizes[at - 1] if at else 0) + BATCH_BYTES
                to = max(at + 1, min(at + BATCH_PAGES, int(np.searchsorted(sizes, limit, side="right"))))
                part, at = batch.slice(at, to - at), to
                parsed = [blocks(page or "") for page in part.column("html").to_pylist()]
                labels = model.label(parsed)
                texts = [" ".join(b[0] for b, main in zip(page, keep, strict=True) if main) for page, keep in zip(parsed, labels, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def _sample(rows: DataFrame, count: int) -> DataFrame:
    """One html of each of ``count`` pages: those whose identifiers have the smallest hashes."""
    ids = rows.filter("html is not null and page_id is not null").select("page_id")
    place = F.xxhash64("page_id") / F.lit(2.0**64) + 0.5
    share = 4.0 * count / max(1, ids.count())  # far more than needed, yet few rows reach the sort
    chosen = ids.filter(place < share).distinct().orderBy(place, "page_id").limit(count)
    return rows.filter("html is not null").join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.max("html").alias("html")).orderBy("page_id")


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null, empty and textless html gives an empty text; a null url or page_id is kept; repeated rows are
    repeated; other columns are ignored; an empty table gives no rows. n_chars counts code points.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = train([r.html for r in _sample(rows, train_pages).collect()])
    return rows.mapInArrow(releasing(_extract(model)), "page_id long, url string, text string, n_chars long")
