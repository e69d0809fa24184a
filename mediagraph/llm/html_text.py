"""Main-text extraction (operator 7): a recurrent labeller over the leaf blocks of a page.

A page is read into leaf blocks: runs of text between block-level tags, each with the path of open tags (names, classes, ids). A block is
a vector of three parts: the mean of hashed path vectors, the mean of hashed word vectors, and a few numbers (length, share of links,
place, punctuation). A bidirectional LSTM in numpy reads the blocks in page order, so each is classed with the whole page in view; the
text is the blocks classed as article, joined by one space.

It learns from a bounded sample of the pages themselves. Blocks in containers that leave no doubt are labelled (article or main against
nav, header, footer, aside, form, advert and the like); copies of the sampled pages are dressed anew, with other containers for the
same blocks, article paragraphs turned into sidebars, notices or reader comments, and path words left out at random, so that words,
length and neighbours come to count as well.

Defined cases: a null or empty html, or one without article blocks, gives an empty text; unclosed and wrongly nested tags are closed as
a browser would in plain cases; a tag that is cut off at the end is dropped; without labelled blocks of both kinds all blocks are taken;
pages are judged one by one, so repeated rows get equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from mediagraph.llm import words

#: Bound of the sample that the labeller learns from: pages, and blocks of each (longer pages are left out of it).
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_CHARS = 240, 120, 200_000
PATHS, WORDS, WIDTH, HIDDEN, NUMBERS = 2048, 4096, 12, 20, 8
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("script style template svg math iframe object noscript title head select textarea".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript xmp".split())
ENDS_P = BLOCK_TAGS - frozenset("body button caption head html legend optgroup option summary tbody td template tfoot th thead title tr".split())
SCOPE = frozenset("article aside body div footer form header li main nav section table td th".split())
CONTENT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog fieldset".split())
OTHER_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer form menu nav navbar navigation newsletter notice popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe widget".split())
#: Containers that pages are dressed in for learning: for article blocks, and for all others.
CONTENT_DRESS = ("article", "main", "div content", "div post", "div entry content", "div article body", "div story", "section text", "div main", "article post", "div", "section", "")
OTHER_DRESS = ("nav", "ul menu", "header", "footer", "aside", "div sidebar", "div ad", "div advert", "div banner", "div cookie notice", "div notice", "form", "form newsletter", "section comments", "div comment", "ul comments", "ol comment list", "div related", "div share", "div promo", "div widget", "div footer", "div header", "div disclaimer")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW_TAGS}
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def element_words(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag's name, and the words of its class, id and role."""
    if not attributes.strip():
        return (tag,)
    return (tag, *(f".{w}" for m in NAMES.finditer(attributes) for w in PART.findall((m[1] or m[2] or m[3] or "").lower())))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, hidden, linked, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(w for _, ws in stack for w in ws), linked))
        parts, linked = [], 0

    def close(depth: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[depth:]:
            links -= tag == "a"
            hidden -= tag in UNSEEN_TAGS
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)

    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag or (m[4] or m[8] or ">") != ">":
            continue
        block = tag in BLOCK_TAGS
        if m[1] or m[5]:  # end tag
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if block:
                flush()
            if depth is not None and (block or not any(t in SCOPE for t, _ in stack[depth:])):
                close(depth)
            continue
        if tag == "br":
            parts.append(" ")
        if block:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i][0]
                if (open_ == "p" and tag in ENDS_P) or (open_ == tag and tag in ("li", "dd", "dt", "option", "tr", "td", "th")):
                    close(i)
                    break
                if open_ in SCOPE or open_ in ("ul", "ol", "dl"):
                    break
        if tag in VOID_TAGS:
            continue
        attributes = m[3] or m[7] or ""
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        stack.append((tag, element_words(tag, attributes)))
        links += tag == "a"
        hidden += tag in UNSEEN_TAGS
        if tag in RAW_TAGS:  # nothing in it is markup
            end = RAW_ENDS[tag].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def sure_label(path: tuple[str, ...]) -> int:
    """1 for article, 0 for anything else, -1 where the containers don't say."""
    if any(w in OTHER_TAGS or w[1:] in OTHER_NAMES for w in path):
        return 0
    return 1 if any(w in CONTENT_TAGS for w in path) else -1


def word_bucket(word: str, size: int) -> int:
    h = 1469598103934665603
    for b in word.encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 32)) % size


def described(pages: list[list[Block]], buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets and word buckets of all blocks (each flat, with offsets), and their numbers."""
    blocks = [b for p in pages for b in p]
    for b in blocks:
        for w in b.path:
            if w not in buckets:
                buckets[w] = word_bucket(w, PATHS)
    path = np.array([buckets[w] for b in blocks for w in b.path], np.int64)
    path_at = np.concatenate(([0], np.cumsum([len(b.path) for b in blocks]))).astype(np.int64)
    buf, offsets = words.text_buffer(pa.array([b.text for b in blocks], pa.large_string()))
    hashes, counts = [], [np.zeros(1, np.int64)]
    for i, j in words.pieces(offsets):
        starts, ends, word_at = words.word_spans(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append((words.hash_spans(buf[offsets[i] : offsets[j]], starts, ends) % np.uint64(WORDS)).astype(np.int64))
        counts.append(np.diff(word_at))
    word_at = np.cumsum(np.concatenate(counts))
    chars, n = np.diff(offsets), np.diff(word_at)
    place = np.concatenate([np.arange(len(p)) / max(len(p) - 1, 1) for p in pages]) if blocks else np.zeros(0)
    numbers = np.stack([
        np.log1p(n) / 4, np.log1p(chars) / 6, np.array([min(1.0, b.linked / max(len(b.text), 1)) for b in blocks], float), place,
        np.array([b.text[-1] in ".!?…:" for b in blocks], float), np.array([b.text.count(",") + b.text.count(".") for b in blocks], float) / np.maximum(n, 1),
        chars / np.maximum(n, 1) / 10, np.array([len(b.path) for b in blocks], float) / 10], axis=1) if blocks else np.zeros((0, NUMBERS))
    return path, path_at, np.concatenate(hashes) if hashes else np.zeros(0, np.int64), word_at, numbers


def means(table: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean vector of each run of buckets."""
    out = np.zeros((len(at) - 1, table.shape[1]))
    for i in range(0, len(out), 4096):  # bounded scratch
        lo, hi = at[:-1][i : i + 4096], at[1:][i : i + 4096]
        sums = np.zeros((int(hi[-1] - lo[0]) + 1, table.shape[1]))
        np.cumsum(table[flat[lo[0] : hi[-1]]], axis=0, out=sums[1:])
        out[i : i + 4096] = (sums[hi - lo[0]] - sums[lo - lo[0]]) / np.maximum(hi - lo, 1)[:, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States over x (steps, pages, width); past a page's end the state stays as it is. `tape` collects what learning needs."""
    steps, pages, _ = x.shape
    size = len(b) // 4
    h, c = np.zeros((pages, size)), np.zeros((pages, size))
    out = np.zeros((steps, pages, size))
    inner = x @ w[: x.shape[2]] + b
    for t in range(steps):
        z = inner[t] + h @ w[x.shape[2] :]
        i, f, o, g = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size] + 1), sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if tape is not None:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * new_c + (1 - m) * c
        out[t] = h
    return out


def lstm_back(x: np.ndarray, w: np.ndarray, tape: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, pages, width = x.shape
    size = dout.shape[2]
    dw, db, dx = np.zeros_like(w), np.zeros(4 * size), np.zeros_like(x)
    dh, dc = np.zeros((pages, size)), np.zeros((pages, size))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + dout[t]
        own, dcell = m * dh, m * dc
        dnew = dcell + own * o * (1 - tc**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), own * tc * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        dw[:width] += x[t].T @ dz
        dw[width:] += h.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w[:width].T
        dh, dc = dz @ w[width:].T + (1 - m) * dh, dnew * f + (1 - m) * dc
    return dw, db, dx


def fresh_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    width = 2 * WIDTH + NUMBERS
    init = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    return {
        "path": 0.3 * rng.standard_normal((PATHS, WIDTH)), "word": 0.3 * rng.standard_normal((WORDS, WIDTH)),
        "fw": init(width + HIDDEN, 4 * HIDDEN), "fb": np.zeros(4 * HIDDEN), "bw": init(width + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN),
        "out": init(2 * HIDDEN + width, 1)[:, 0], "bias": np.zeros(1),
    }


def laid_out(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of pages as (steps, pages, width), forward; the mask; and each block's place in it."""
    steps = int(counts.max())
    page, step = np.repeat(np.arange(len(counts)), counts), words.ragged(np.zeros(len(counts), np.int64), counts)
    grid, mask = np.zeros((steps, len(counts), x.shape[1])), np.zeros((steps, len(counts)))
    grid[step, page], mask[step, page] = x, 1.0
    return grid, mask, np.stack([step, page])


def turned(place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places with each page's blocks in reverse order."""
    return np.stack([counts[place[1]] - 1 - place[0], place[1]])


def scores(weights: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of each block being article."""
    grid, mask, place = laid_out(x, counts)
    back = turned(place, counts)
    mirrored = np.zeros_like(grid)
    mirrored[back[0], back[1]] = x
    forward = lstm(grid, mask, weights["fw"], weights["fb"])[place[0], place[1]]
    backward = lstm(mirrored, mask, weights["bw"], weights["bb"])[back[0], back[1]]
    return np.concatenate([forward, backward, x], axis=1) @ weights["out"] + weights["bias"][0]


def learning_step(weights: dict[str, np.ndarray], data: tuple, labels: np.ndarray, counts: np.ndarray, heard: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss over labelled blocks, and its gradients. `heard`: blocks whose words are let in."""
    path, path_at, word, word_at, numbers = data
    x = np.concatenate([means(weights["path"], path, path_at), means(weights["word"], word, word_at) * heard[:, None], numbers], axis=1)
    grid, mask, place = laid_out(x, counts)
    back = turned(place, counts)
    mirrored = np.zeros_like(grid)
    mirrored[back[0], back[1]] = x
    tapes: tuple[list, list] = ([], [])
    forward, backward = lstm(grid, mask, weights["fw"], weights["fb"], tapes[0]), lstm(mirrored, mask, weights["bw"], weights["bb"], tapes[1])
    state = np.concatenate([forward[place[0], place[1]], backward[back[0], back[1]], x], axis=1)
    p = sigmoid(state @ weights["out"] + weights["bias"][0])
    told = labels >= 0
    n = max(int(told.sum()), 1)
    loss = -np.log(np.clip(np.where(labels == 1, p, 1 - p), 1e-9, 1))[told].sum() / n
    dlogit = np.where(told, p - labels, 0.0) / n
    dstate = dlogit[:, None] * weights["out"][None, :]
    dforward, dbackward = np.zeros_like(forward), np.zeros_like(backward)
    dforward[place[0], place[1]], dbackward[back[0], back[1]] = dstate[:, :HIDDEN], dstate[:, HIDDEN : 2 * HIDDEN]
    grads = {"out": state.T @ dlogit, "bias": np.array([dlogit.sum()])}
    grads["fw"], grads["fb"], dx = lstm_back(grid, weights["fw"], tapes[0], dforward)
    grads["bw"], grads["bb"], dy = lstm_back(mirrored, weights["bw"], tapes[1], dbackward)
    dx = dx[place[0], place[1]] + dy[back[0], back[1]] + dstate[:, 2 * HIDDEN :]
    dx[:, WIDTH : 2 * WIDTH] *= heard[:, None]
    for name, flat, at, lo in (("path", path, path_at, 0), ("word", word, word_at, WIDTH)):
        n_each = np.diff(at)
        grads[name] = np.zeros_like(weights[name])
        np.add.at(grads[name], flat, np.repeat(dx[:, lo : lo + WIDTH] / np.maximum(n_each, 1)[:, None], n_each, axis=0))
    return float(loss), grads


def dressed(page: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A copy of a page in other containers: some paragraphs become comments, notices or sidebars, path words go missing."""
    labels = [sure_label(b.path) for b in page]
    content, around = CONTENT_DRESS[rng.integers(len(CONTENT_DRESS))].split(), {}
    body = [b for b, y in zip(page, labels, strict=True) if y == 1]
    rows: list[tuple[Block, int]] = []
    style = lambda names, tail: (*names[:1], *(f".{w}" for w in names[1:]), *tail)
    for b, y in zip(page, labels, strict=True):
        tail = tuple(b.path[-1:]) if b.path and b.path[-1] in ("p", "h1", "h2", "h3", "li", "b", "a", "blockquote", "td") else ("p",)
        if y == 1:
            rows.append((Block(b.text, ("html", "body", *style(content, tail)), b.linked), 1))
        elif y == 0:
            key = b.path[:3]
            around.setdefault(key, OTHER_DRESS[rng.integers(len(OTHER_DRESS))].split())
            rows.append((Block(b.text, ("html", "body", *style(around[key], tail)), b.linked), 0))
        else:
            rows.append((b, -1))
    if body:
        for _ in range(int(rng.integers(0, 4))):  # running text that isn't the article's
            b, dress = body[rng.integers(len(body))], OTHER_DRESS[rng.integers(len(OTHER_DRESS))].split()
            cut = b.text.split()
            a = int(rng.integers(0, max(1, len(cut) - 5)))
            text = " ".join(cut[a : a + int(rng.integers(1, 60))]) or b.text
            inside = ("article",) if content[:1] != ["article"] and rng.random() < 0.2 else ()
            extra = (Block(text, ("html", "body", *inside, *style(dress, ("p",))), 0), 0)
            rows.insert(len(rows) if rng.random() < 0.6 else int(rng.integers(0, len(rows) + 1)), extra)
    return [r[0] for r in rows], [r[1] for r in rows]


def learn(pages: list[list[Block]], steps: int = 420, batch: int = 16, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray] | None:
    """Adam over pages as they are and dressed anew; None where the sample has no sure blocks of both kinds."""
    pages = [p for p in pages if p]
    kinds = {sure_label(b.path) for p in pages for b in p}
    if not {0, 1} <= kinds:
        return None
    rng, weights, buckets = np.random.default_rng(seed), fresh_weights(seed), {}
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen, labels = [], []
        for k in rng.integers(len(pages), size=batch):
            page, own = (pages[k], [sure_label(b.path) for b in pages[k]]) if rng.random() < 0.5 else dressed(pages[k], rng)
            if rng.random() < 0.2:  # some words are missing from all paths of a page
                lost = {w for b in page for w in b.path if rng.random() < 0.02}
                page = [Block(b.text, tuple(w for w in b.path if w not in lost), b.linked) for b in page]
            chosen.append(page)
            labels += own
        counts = np.array([len(p) for p in chosen])
        _, grads = learning_step(weights, described(chosen, buckets), np.array(labels), counts, (rng.random(len(labels)) > 0.5).astype(float))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] = weights[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, np.ndarray] | None:
    """Learn from at most `sample` pages, those with the smallest text hashes among pages of ordinary length."""
    rows = pages.select(F.col(html).alias("html")).where((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS)).withColumn("mark", F.xxhash64("html"))
    marks = rows.select("mark").distinct().orderBy("mark").limit(sample)  # short rows: whole pages are not sorted
    last = marks.agg(F.max("mark").alias("last")).first()["last"]
    picked = rows.where(F.col("mark") <= F.lit(last)).groupBy("mark").agg(F.min("html").alias("html"))
    texts = [r["html"] for r in picked.orderBy("mark").collect()] if last is not None else []  # bounded
    return learn([b for t in texts if len(b := blocks_of(t)) <= SAMPLE_BLOCKS])


def texts_of(weights: dict[str, np.ndarray] | None, pages: list[str | None], together: int = 128) -> list[str]:
    """Main text of each page."""
    read = [blocks_of(p) if p else [] for p in pages]
    out = [""] * len(pages)
    if weights is None:
        return [" ".join(b.text for b in p) for p in read]
    buckets: dict[str, int] = {}
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    for k in range(0, len(order), together):
        own = order[k : k + together]
        path, path_at, word, word_at, numbers = described([read[i] for i in own], buckets)
        x = np.concatenate([means(weights["path"], path, path_at), means(weights["word"], word, word_at), numbers], axis=1)
        counts = np.array([len(read[i]) for i in own])
        odds, at = scores(weights, x, counts), np.concatenate(([0], np.cumsum(counts)))
        for i, a, z in zip(own, at[:-1], at[1:], strict=True):
            out[i] = " ".join(b.text for b, y in zip(read[i], odds[a:z], strict=True) if y > 0)
    return out


def with_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, weights: dict[str, np.ndarray] | None | str = "fit") -> DataFrame:
    """`pages` (or its columns `keep`) with text and n_chars."""
    keep = pages.columns if keep is None else keep
    text, chars = words.free_name(keep, "text"), words.free_name(keep, "n_chars")
    shipped = pages.sparkSession.sparkContext.broadcast(fit(pages, html) if isinstance(weights, str) else weights)  # of fixed size
    given = pages.select(*keep, F.col(html).alias(words.free_name(keep, "page_html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = texts_of(shipped.value, part.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [*keep, text, chars])

    return given.mapInArrow(run, pages.select(*keep).schema.add(text, StringType()).add(chars, LongType()))
