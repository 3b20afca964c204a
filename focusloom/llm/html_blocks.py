"""Main-text extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between block-level tags, with
its tag path. Each block is a vector of hashed tag-path parts, hashed words and a
few figures; a bidirectional LSTM in numpy reads the whole page's sequence in
both directions and a logistic layer says which blocks are main text. The
weights in ``html_blocks.npz`` come from ``train_html_blocks.py`` in this
package, which trains on pages that it makes up.

Defined cases: null and empty html and pages without text give an empty text;
unclosed and stray tags are closed as browsers do; repeated rows give repeated
results; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import bounded_batches, lean_worker

PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 64, 32, 10, 20
INPUT = PATH_DIM + WORD_DIM + FIGURES
#: Blocks read at once: pages of like lengths together.
BATCH_BLOCKS = 20_000

# Tags that don't part blocks, tags without content, tags whose content isn't text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What an opening tag closes if it is open within the nearest of the others' parents.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

# A quote opens a value only after "="; what isn't closed goes on to the page's end, so no part is read twice.
_ATTRIBUTES = r"(?>=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)(?![a-z0-9:-]){_ATTRIBUTES}(?:>|\Z).*?(?:</\1(?![a-z0-9:-])[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def parse(source: str | None) -> list[Block]:
    """Leaf blocks in page order: white space is one space, character references are decoded."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = in_link = 0
    path: tuple = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(path, text, linked))
            parts.clear()
            linked = 0

    for m in _TOKEN.finditer(source or ""):
        text = m[5]
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[2] else 1
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    in_link = 0
                    break
        elif tag not in VOID:
            closing = CLOSES.get(tag, ()) or (("p",) if tag in _P_CLOSERS else ())
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closing:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div", "article", "section", "body"):
                        break
            attributes = m[4]
            names: tuple = ()
            if attributes and "=" in attributes:
                names = tuple(x for a in _NAMES.finditer(attributes) for x in _SPLIT.split((a[1] or a[2] or a[3] or "").lower()) if x)
            stack.append((tag, names))
        path = tuple(stack)
    flush()
    return [b for b in blocks if not any(t in ("head", "title", "select", "button", "option") for t, _ in b.path)]


_path_cache: dict[tuple, np.ndarray] = {}


def _path_vector(path: tuple) -> np.ndarray:
    v = _path_cache.get(path)
    if v is None:
        v = np.zeros(PATH_DIM, np.float32)
        depth = len(path)
        for i, (tag, names) in enumerate(path):
            near = 1.0 if i == depth - 1 else 0.6
            v[zlib.crc32(f"t{tag}".encode()) % PATH_DIM] = max(near, v[zlib.crc32(f"t{tag}".encode()) % PATH_DIM])
            for n in names:
                v[zlib.crc32(f"n{n}".encode()) % PATH_DIM] = 1.0
        if len(_path_cache) > 50_000:
            _path_cache.clear()
        _path_cache[path] = v
    return v


class _Words(dict):
    """Hash bucket by word, worked out when first asked for."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = k = zlib.crc32(w.lower().strip(".,:;!?()").encode()) % WORD_DIM
        return k


_words = _Words()


def features(blocks: list[Block]) -> np.ndarray:
    """blocks x INPUT. Word hashes of long blocks saturate; all words count."""
    n = len(blocks)
    x = np.zeros((n, INPUT), np.float32)
    for i, b in enumerate(blocks):
        x[i, :PATH_DIM] = _path_vector(b.path)
        words = b.text.split(" ")
        m = len(words)
        counts = np.bincount(np.fromiter(map(_words.__getitem__, words), np.int64, m), minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = counts / (m**0.5 + 1)
        k = PATH_DIM + WORD_DIM
        chars = len(b.text)
        x[i, k] = np.log1p(chars) / 7
        x[i, k + 1] = np.log1p(m) / 5
        x[i, k + 2] = min(1.0, b.linked / max(chars, 1))
        x[i, k + 3] = b.text[-1] in ".!?…"
        x[i, k + 4] = b.text.count(",") / m
        x[i, k + 5] = i / max(n - 1, 1)
        x[i, k + 6] = min(len(b.path), 12) / 12
        x[i, k + 7] = "©" in b.text or "|" in b.text
        x[i, k + 8] = m < 4
        x[i, k + 9] = b.text[0].isdigit() or b.text[-1].isdigit()
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, state: list | None = None) -> np.ndarray:
    """time x batch x INPUT -> time x batch x HIDDEN; keeps what training needs in ``state``."""
    t, n, _ = x.shape
    z_in = x @ w + b
    h = np.zeros((n, HIDDEN), x.dtype)
    c = np.zeros((n, HIDDEN), x.dtype)
    out = np.empty((t, n, HIDDEN), x.dtype)
    for k in range(t):
        z = z_in[k] + h @ u
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        if state is not None:
            state.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[k] = h
    return out


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def load(cls, path: str | None = None) -> "Labeller":
        with np.load(path or os.path.join(os.path.dirname(__file__), "html_blocks.npz")) as f:
            return cls({k: f[k] for k in f.files})

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's feature rows: how likely each block is main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest, end = len(pages[order[at]]), at + 1
            while end < len(order) and len(pages[order[end]]) <= 1.25 * longest + 2 and (end - at + 1) * len(pages[order[end]]) <= BATCH_BLOCKS:
                end += 1
            mine = order[at:end]
            sizes = np.array([len(pages[i]) for i in mine])
            x = np.zeros((sizes.max(), len(mine), INPUT), np.float32)
            back = np.zeros_like(x)
            for j, i in enumerate(mine):
                x[: sizes[j], j] = pages[i]
                back[: sizes[j], j] = pages[i][::-1]
            w = self.w
            forward = lstm(x, w["wf"], w["uf"], w["bf"])
            backward = lstm(back, w["wb"], w["ub"], w["bb"])
            for j, i in enumerate(mine):
                n = sizes[j]
                both = np.concatenate([forward[:n, j], backward[:n, j][::-1], pages[i]], axis=1)
                out[i] = _sigmoid(both @ w["v"] + w["a"])
            at = end
        return out


_labeller: Labeller | None = None


def extract(sources: list[str | None], labeller: Labeller | None = None) -> list[str]:
    """The main text of each page: its blocks joined by one space."""
    global _labeller
    if labeller is None:
        labeller = _labeller = _labeller or Labeller.load()
    parsed = [parse(s) for s in sources]
    chances = labeller.chances([features(b) for b in parsed])
    return [" ".join(b.text for b, p in zip(blocks, c) if p >= 0.5) for blocks, c in zip(parsed, chances)]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: one narrow pass."""

    def run(batches):
        lean_worker()
        for batch in batches:
            texts: list[str] = []
            sources = batch.column(2)
            for at in range(0, batch.num_rows, 500):
                texts += extract(sources.slice(at, 500).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return bounded_batches(source).mapInArrow(run, "page_id long, url string, text string, n_chars long")
