"""Main text of web pages: a recurrent network labels every block of a page.

A page is read into its leaf blocks in order: text between block-level tags, with the path
of tags, classes and ids above it. A bidirectional LSTM in numpy reads for each block hashed
path vectors, hashed word vectors and a few measures (length, links, punctuation, place),
and so labels a block by all of its document. Blocks labelled as article make the text.

The network is trained on the driver, from pages of our own making that put sampled text
into many layouts (named by tags, by classes or by ids, with menus, headers, footers,
sidebars, notices, adverts, forms and comments around and inside the article), and from
the sampled pages themselves where their tags tell the parts. The sample is
``train_pages`` pages by the hash of their id (a documented bound); every page is labelled.

Defined cases: null and empty html give an empty text; a page without article blocks too;
unclosed and misnested tags end where the next block does; scripts, styles, comments and
what else is never shown have no blocks; character references are decoded, white space
becomes one space; rows repeat as they are; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import words

# Elements that start a block, that are never shown, and that close themselves.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("script style noscript template iframe object svg math textarea title noframes canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element of the first kind ends open ones of the second.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+))")
_DECLARED = re.compile(r"<[!?]")
_MARKS = re.compile(r"[\"'>]")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PATH_ROWS, WORD_ROWS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 4096, 4096, 24, 8, 10, 24


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int


def _named(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's features: its tag, and the words in its class, id and role."""
    found = [tag]
    if attributes:
        for _, *value in _NAMES.findall(attributes):
            for part in _NAME_PARTS.findall("".join(value)):
                found.append("." + part.lower())
    return tuple(found)


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """Places of quotes and ``>``, and for each where a tag that reaches it outside quotes ends (-1: nowhere).

    One pass from the right for the whole page: a tag that never ends costs no scan of its own.
    """
    marks = [m.start() for m in _MARKS.finditer(html)]
    ends = [-1] * (len(marks) + 1)
    later: dict[str, int] = {}
    for i in range(len(marks) - 1, -1, -1):
        mark = html[marks[i]]
        if mark == ">":
            ends[i] = marks[i]
            continue
        if mark in later:
            ends[i] = ends[later[mark] + 1]
        later[mark] = i
    return marks, ends


def blocks_of(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked, in_link
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(tuple(x for _, names in stack for x in names), text, linked))
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = references.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    marks, ends = _tag_ends(html)
    at, size, last = 0, len(html), html.rfind(">")
    while at < size:
        tag = _OPEN.search(html, at)
        if not tag:
            add(html[at:])
            break
        if tag[2] and tag.start() > last:
            # No tag ends from here on; a comment or a declaration takes the rest.
            rest = _DECLARED.search(html, tag.start())
            add(html[at : rest.start() if rest else size])
            break
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        if not tag[2]:
            until = "-->" if tag[0] == "<!--" else ">"
            end = html.find(until, at)
            at = end + len(until) if end >= 0 else size
            continue
        end = ends[bisect_left(marks, at)]
        if end < 0:
            end = html.find(">", at)  # its quotes are not closed
        closing, name, attributes = tag[1], tag[2].lower(), html[at:end]
        at = end + 1
        if name in HIDDEN_TAGS:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name not in BLOCK_TAGS:
            if name == "br":
                pieces.append(" ")
            continue
        flush()
        in_link = 0
        if closing:
            while opened[name] and leave() != name:
                pass
            continue
        if stack and stack[-1][0] == "p":
            leave()
        over = ENDS.get(name)
        while over and stack and stack[-1][0] in over:
            leave()
        if name not in VOID_TAGS:
            stack.append((name, _named(name, attributes)))
            opened[name] += 1
    flush()
    return found


class Features(NamedTuple):
    """Blocks of several pages, page after page. path, word: table rows; *_of: their block."""

    page: np.ndarray
    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray


def features(pages: list[list[Block]]) -> Features:
    flat = [b for page in pages for b in page]
    n = len(flat)
    lengths = np.array([len(p) for p in pages], dtype=np.int64)
    page = np.repeat(np.arange(len(pages)), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    names = sorted({x for b in flat for x in b.path})
    row = dict(zip(names, (words.of_texts(pa.array(names, pa.string())).hash % np.uint64(PATH_ROWS)).astype(np.int64).tolist()))
    paths = [sorted({row[x] for x in b.path}) for b in flat]
    path = np.array([x for p in paths for x in p], dtype=np.int64)
    path_of = np.repeat(np.arange(n), [len(p) for p in paths]) if n else np.zeros(0, dtype=np.int64)
    w = words.of_texts(pa.array([b.text for b in flat], pa.string()), lower=True)
    n_words = np.bincount(w.row, minlength=n)
    chars = np.array([len(b.text) for b in flat], dtype=float)
    ends = np.array([b.text[-1:] in ".!?:;\"'”»)" for b in flat], dtype=float)
    marks = np.array([b.text.count(".") + b.text.count(",") for b in flat], dtype=float)
    linked = np.array([min(b.linked, len(b.text)) for b in flat], dtype=float)
    last = np.repeat(np.maximum(lengths - 1, 1), lengths)
    depth = np.array([len(b.path) for b in flat], dtype=float)
    leaf = [next((x for x in reversed(b.path) if x[0] != "."), "") for b in flat]
    heading = np.array([len(x) == 2 and x[0] == "h" and x[1].isdigit() for x in leaf], dtype=float)
    measures = np.stack(
        [
            np.log1p(chars) / 5, np.log1p(n_words) / 4, linked / np.maximum(chars, 1), ends, marks / np.maximum(n_words, 1),
            place / last, np.minimum(place, 10) / 10, np.minimum(depth, 20) / 20, heading, np.ones(n),
        ],
        axis=1,
    ) if n else np.zeros((0, MEASURES))
    return Features(page, path, path_of, (w.hash % np.uint64(WORD_ROWS)).astype(np.int64), w.row, measures)


def _new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    inputs = PATH_SIZE + WORD_SIZE + MEASURES
    weights = {"path": rng.normal(0, 0.1, (PATH_ROWS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORD_ROWS, WORD_SIZE))}
    for side in ("f", "b"):
        weights[f"{side}x"] = rng.normal(0, inputs**-0.5, (inputs, 4 * HIDDEN))
        weights[f"{side}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        weights[f"{side}c"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    weights["out"] = rng.normal(0, 0.1, (2 * HIDDEN + inputs,))
    weights["bias"] = np.zeros(1)
    return weights


def _inputs(weights: dict[str, np.ndarray], x: Features) -> np.ndarray:
    n = len(x.measures)
    out = np.zeros((n, PATH_SIZE + WORD_SIZE + MEASURES))
    for table, rows, of, at, size in (("path", x.path, x.path_of, 0, PATH_SIZE), ("word", x.word, x.word_of, PATH_SIZE, WORD_SIZE)):
        if len(rows):
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            count = np.diff(np.append(begin, len(of)))[:, None]
            out[of[begin], at : at + size] = np.add.reduceat(weights[table][rows], begin, axis=0) / np.sqrt(count)
    out[:, PATH_SIZE + WORD_SIZE :] = x.measures
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grid(page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row (step) and column (page) of each block, and pages' lengths, for padded steps."""
    lengths = np.bincount(page) if len(page) else np.zeros(0, dtype=np.int64)
    return np.arange(len(page)) - (np.cumsum(lengths) - lengths)[page], page, lengths


def _run(weights: dict[str, np.ndarray], side: str, x: np.ndarray, lengths: np.ndarray) -> list[tuple]:
    """States of one direction; x: steps x pages x inputs, already in reading order."""
    n = len(lengths)
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    projected = x @ weights[f"{side}x"] + weights[f"{side}c"]
    states = []
    for t in range(len(x)):
        gates = projected[t] + h @ weights[f"{side}h"]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        new = f * c + i * g
        squashed = np.tanh(new)
        states.append((h, c, i, f, o, g, squashed))
        h, c = o * squashed, new
    return states


def _reading(step: np.ndarray, column: np.ndarray, lengths: np.ndarray, backwards: bool) -> np.ndarray:
    return lengths[column] - 1 - step if backwards else step


def probabilities(weights: dict[str, np.ndarray], x: Features, keep: bool = False):
    """Probability that each block is article; keep: also what learning needs."""
    inputs = _inputs(weights, x)
    step, column, lengths = _grid(x.page)
    hidden, kept = [], []
    for side in ("f", "b"):
        at = _reading(step, column, lengths, side == "b")
        steps = np.zeros((int(lengths.max()) if len(lengths) else 0, len(lengths), inputs.shape[1]))
        steps[at, column] = inputs
        states = _run(weights, side, steps, lengths)
        outs = np.stack([s[4] * s[6] for s in states]) if states else np.zeros((0, len(lengths), HIDDEN))
        hidden.append(outs[at, column])
        kept.append((at, steps, states))
    together = np.concatenate([*hidden, inputs], axis=1)
    p = _sigmoid(together @ weights["out"] + weights["bias"])
    return (p, inputs, together, kept, column, lengths) if keep else p


def _gradients(weights: dict[str, np.ndarray], x: Features, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss, by going through the steps backwards."""
    p, inputs, together, kept, column, lengths = probabilities(weights, x, keep=True)
    error = (p - target) / max(len(target), 1)
    gradient = {"out": together.T @ error, "bias": np.array([error.sum()])}
    back = error[:, None] * weights["out"]
    d_inputs = back[:, 2 * HIDDEN :].copy()
    for number, side in enumerate(("f", "b")):
        at, steps, states = kept[number]
        outer = np.zeros((len(states), len(lengths), HIDDEN))
        outer[at, column] = back[:, number * HIDDEN : (number + 1) * HIDDEN]
        d_gates = np.zeros((len(states), len(lengths), 4 * HIDDEN))
        dh, dc = np.zeros((len(lengths), HIDDEN)), np.zeros((len(lengths), HIDDEN))
        for t in range(len(states) - 1, -1, -1):
            h, c, i, f, o, g, squashed = states[t]
            dh = dh + outer[t]
            dc = dc + dh * o * (1 - squashed**2)
            d_gates[t] = np.concatenate(
                (dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)), axis=1
            )
            dh, dc = d_gates[t] @ weights[f"{side}h"].T, dc * f
        earlier = np.stack([s[0] for s in states])
        gradient[f"{side}x"] = np.einsum("tni,tng->ig", steps, d_gates)
        gradient[f"{side}h"] = np.einsum("tnh,tng->hg", earlier, d_gates)
        gradient[f"{side}c"] = d_gates.sum(axis=(0, 1))
        d_inputs += (d_gates @ weights[f"{side}x"].T)[at, column]
    for table, rows, of, start, size in (("path", x.path, x.path_of, 0, PATH_SIZE), ("word", x.word, x.word_of, PATH_SIZE, WORD_SIZE)):
        gradient[table] = np.zeros_like(weights[table])
        if len(rows):
            count = np.sqrt(np.bincount(of, minlength=len(target)))[of][:, None]
            np.add.at(gradient[table], rows, d_inputs[of, start : start + size] / count)
    return gradient


def train(pages: list[list[Block]], targets: list[np.ndarray], rounds: int = 12, batch: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after some rounds of Adam over the pages, in batches of pages of like length."""
    rng = np.random.default_rng(seed)
    weights = _new_weights(rng)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    by_length = np.argsort([len(p) for p in pages], kind="stable")
    groups = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
    made = [(features([pages[i] for i in g]), np.concatenate([targets[i] for i in g])) for g in groups]
    step = 0
    for _ in range(rounds):
        for number in rng.permutation(len(made)):
            x, target = made[number]
            if not len(target):
                continue
            step += 1
            for name, g in _gradients(weights, x, target).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[name] = weights[name] - rate * first[name] / (np.sqrt(second[name]) + 1e-8)
    return {k: v.astype(np.float32) for k, v in weights.items()}


# Common names of page parts, for the layouts that the network learns from.
ARTICLE_NAMES = (
    "content", "main-content", "article", "article-body", "post", "post-content", "entry-content", "entry", "story", "story-body",
    "text", "body-text", "blog-post", "page-content", "maincontent", "primary", "articleBody", "post-text", "copy", "prose",
)
OTHER_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "site-nav", "toc", "pager", "pagination", "tabs"),
    "header": ("header", "masthead", "site-header", "top-bar", "branding", "logo", "banner-top"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "colophon", "legal", "footer-links"),
    "aside": ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "tags", "share", "social", "author-box", "right-column"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adsbox", "sponsor", "commercial"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "disclaimer"),
    "comments": ("comments", "comment", "comment-list", "respond", "reviews", "discussion", "replies", "disqus", "reader-comments"),
    "form": ("search", "search-form", "login", "signup", "contact-form", "feedback"),
}
OTHER_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
_MARK = ""


def made_page(rng: np.random.Generator, lines: list[str]) -> str:
    """A page of some layout around sampled lines; a private character marks article text."""
    pick = lambda some: some[int(rng.integers(len(some)))]
    line = lambda: references.escape(pick(lines))
    few = lambda: " ".join(line().split()[: int(rng.integers(1, 8))])

    def named(tag: str, names: tuple[str, ...], inner: str, sure: bool = True) -> str:
        label = f' {pick(("class", "class", "id"))}="{pick(names)}"' if sure or rng.random() < 0.5 else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def other(kind: str) -> str:
        if kind in ("menu", "footer") and rng.random() < 0.8 or rng.random() < 0.2:
            items = [f'<a href="/{i}">{few()}</a>' for i in range(int(rng.integers(1, 8)))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)
        elif kind == "form":
            inner = f"<label>{few()}</label><input><button>{few()}</button>"
        else:
            inner = "".join(pick(("<p>{}</p>", "<div>{}</div>", "{}<br>")).format(pick((line, few))()) for _ in range(int(rng.integers(1, 4))))
            if rng.random() < 0.3:
                inner = f"<h3>{few()}</h3>" + inner
        if kind == "footer" and rng.random() < 0.5:
            inner += f"&copy; {few()}"
        tag = OTHER_TAGS.get(kind)
        if tag and rng.random() < 0.6:
            return named(tag, OTHER_NAMES[kind], inner, sure=False)
        return named(pick(("div", "div", "section")), OTHER_NAMES[kind], inner)

    def body() -> str:
        parts = [f"<h1>{_MARK}{few()}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 25))):
            text = _MARK + (line() if rng.random() < 0.8 else few())
            form = rng.random()
            if form < 0.6:
                parts.append(f"<p>{text}</p>")
            elif form < 0.7:
                parts.append(f"<p><b>{text}<br>")
            elif form < 0.78:
                parts.append(f"<h2>{text}</h2>")
            elif form < 0.86:
                parts.append("<ul>" + "".join(f"<li>{_MARK}{few()}</li>" for _ in range(3)) + "</ul>")
            elif form < 0.9:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif form < 0.94:
                parts.append(f'<p>{text} <a href="/x">{few()}</a></p>')
            elif form < 0.97:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(other(pick(("ad", "aside", "notice", "form", "menu"))))
        return "".join(parts)

    around = ["menu", "header", "ad", "notice", "aside", "form", "menu"]
    before = "".join(other(k) for k in around if rng.random() < 0.4)
    after = "".join(other(k) for k in ("aside", "comments", "ad", "menu", "footer", "notice", "form") if rng.random() < 0.45)
    kind = rng.random()
    if kind < 0.45:
        article = named("article", ARTICLE_NAMES, body(), sure=False)
    elif kind < 0.6:
        article = named("main", ARTICLE_NAMES, body(), sure=False)
    elif kind < 0.95:
        article = named(pick(("div", "section", "td")), ARTICLE_NAMES, body())
    else:
        article = body()
    if rng.random() < 0.3:
        article = named(pick(("div", "main", "section")), ("wrapper", "container", "page", "layout", "content-area"), article + (other("comments") if rng.random() < 0.5 else ""))
    return f"<html><head><title>{few()}</title></head><body>{before}{article}{after}</body></html>"


def labelled_by_mark(html: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made page and whether they are article."""
    found = blocks_of(html)
    target = np.array([_MARK in b.text for b in found], dtype=float)
    return [b._replace(text=b.text.replace(_MARK, "").strip() or "x") for b in found], target


def labelled_by_tags(html: str) -> tuple[list[Block], np.ndarray] | None:
    """Blocks of a page whose tags tell its parts; None where they do not."""
    found = blocks_of(html)
    inside = np.array(["article" in b.path or "main" in b.path for b in found])
    if not inside.any():
        return None
    other = {"nav", "aside", "footer", "form", "header"} | {"." + part for names in OTHER_NAMES.values() for n in names for part in n.split("-")[:1]}
    below = lambda path: set(path[max(i for i, x in enumerate(path) if x in ("article", "main")) :])
    clear = np.array([i and not (below(b.path) & other) for i, b in zip(inside, found)])
    return found, clear.astype(float)


def sampled(pages: DataFrame, most: int, most_chars: int) -> list[str]:
    """``most`` pages of 1 to ``most_chars`` characters, picked by the hash of their id.

    The ids are picked first, each page and id once, so the html of no other page is sent.
    """
    usable = pages.where(F.length("html").between(1, most_chars)).select("page_id", "html", F.xxhash64("html").alias("page_hash"))
    order = [F.xxhash64("page_id"), "page_id", "page_hash"]
    picked = usable.select("page_id", "page_hash").distinct().orderBy(*order).limit(most)
    same = F.col("page_id").eqNullSafe(F.col("picked_id")) & (F.col("page_hash") == F.col("picked_hash"))
    found = usable.join(F.broadcast(picked.toDF("picked_id", "picked_hash")), same, "left_semi")  # at most ``most`` pairs of numbers
    return [r["html"] for r in found.dropDuplicates(["page_id", "page_hash"]).orderBy(*order).collect()]


def learn(pages: DataFrame, train_pages: int = 200, made_pages: int = 1200, seed: int = 7, train_chars: int = 100_000) -> dict[str, np.ndarray]:
    """Weights of a network trained for the pages at hand.

    train_pages: bound of the sample; train_chars: longer pages are labelled like all, but not
    trained on, so that the sample's size has a bound.
    """
    sample = sampled(pages, train_pages, train_chars)
    rng = np.random.default_rng(seed)
    lines = [b.text for html in sample for b in blocks_of(html)] or ["Some text, as an example.", "More of it"]
    made = [labelled_by_mark(made_page(rng, lines)) for _ in range(made_pages)]
    made += [x for html in sample if (x := labelled_by_tags(html)) is not None]
    return train([m[0] for m in made], [m[1] for m in made], seed=seed)


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of pages (``page_id, url, html``)."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    model = pages.sparkSession.sparkContext.broadcast(weights or learn(pages))  # about 1 MB

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "html", 1 << 19):
            found = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
            texts = [""] * len(found)
            # Pages of like length go through the network together.
            order = sorted(range(len(found)), key=lambda i: len(found[i]))
            for start in range(0, len(order), 64):
                some = [i for i in order[start : start + 64] if found[i]]
                if not some:
                    continue
                article = probabilities(model.value, features([found[i] for i in some])) > 0.5
                at = 0
                for i in some:
                    own = article[at : at + len(found[i])].tolist()
                    at += len(found[i])
                    texts[i] = "\n".join(b.text for b, yes in zip(found[i], own) if yes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.mapInArrow(label, "page_id long, url string, text string, n_chars long")
