"""Main body of web pages: a bidirectional LSTM over the page's lines, in numpy.

A page's lines (leaf blocks) are read in order; each comes as hashed words, the hashed tag path of the markup it stands in, and
dense features of the line, its container and its place. Lines are tied to the markup through the page's character stream, so
unclosed or upper-case tags and inline markup don't matter; a page without markup is read by its lines alone.

The network is fitted on at most FIT_PAGES pages (least hash of the id). Nobody labelled those: pages whose markup says what a
block is (navigation, comments, article) teach, and because the naming tokens, words and container features are withheld at random
while it learns, what it learns carries over to pages whose markup says nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import least_hashed, stored

FIT_PAGES = 1_500
WORDS, PATHS = 1 << 13, 1 << 10
EMBED, HIDDEN = 16, 32
CELLS = 16_384
#: Pages with more lines or characters don't teach.
FIT_LINES, FIT_CHARACTERS = 400, 60_000

#: Naming tokens of markup that holds the main body, and of markup that doesn't.
BODY = frozenset("article main content entry story post".split())
OTHER = frozenset("nav navigation menu footer aside sidebar consent cookie dialog banner breadcrumb breadcrumbs crumb crumbs promo promotion teaser share social comment comments related newsletter letter signup form meta byline advert ad ads header".split())
SKIPPED = frozenset("script style title noscript template head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
GROUPS = frozenset("nav aside article main footer form header section div table td dialog".split())

KEY = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+|[©|>%+:·(]")
NAME = re.compile(r"[a-zA-Z]+")


#: Bits of the tags that an element stands in.
BITS = {tag: 1 << n for n, tags in enumerate((("a",), ("li",), ("p",), ("h1",), ("h2", "h3", "h4"), ("pre", "code"), ("td",))) for tag in tags}
SHOWN = frozenset("h1 h2 h3 h4 pre li table tr td th code div".split())


class Element:
    """An open tag with what its path says, each worked out from its parent's."""

    __slots__ = ("bad", "bits", "body", "depth", "entry", "group", "ids", "inside", "kids", "parent", "skipped", "tag", "title")

    def __init__(self, parent: Element | None, tag: str, named: str) -> None:
        names = tuple(t.lower() for t in NAME.findall(named.replace("-", " ")))
        tokens = {tag, *names}
        self.parent, self.tag = parent, tag
        self.kids: dict[tuple[str, str], Element] = {}
        self.bits = (parent.bits if parent else 0) | BITS.get(tag, 0)
        self.depth = (parent.depth if parent else 0) + 1
        self.skipped = tag in SKIPPED or bool(parent and parent.skipped)
        self.title = tag == "title" or bool(parent and parent.title)
        self.ids = (parent.ids if parent else ()) + tuple(xxhash.xxh32_intdigest("/" + t) % PATHS for t in (tag, *names))
        # what the markup teaches: 0 for what lies in another part, 1 for what lies in the main body
        self.bad = bool(tokens & (OTHER - {"header", "meta"}) or {"header", "meta"} & set(names)) or bool(parent and parent.bad)
        self.entry = bool({"content", "entry"} & tokens) or bool(parent and parent.entry)
        own = bool(BODY & tokens)
        self.body = own or bool(parent and parent.body)
        self.inside = not own and bool(parent and parent.body) and (parent.inside or tag in SHOWN)
        # the outermost named or sectioning element, or the outermost tags where there is none
        if parent and parent.group[0] == ".":
            self.group = parent.group
        elif tag not in ("html", "body") and (named or tag in ("nav", "aside", "article", "main", "footer", "form", "header")):
            self.group = f".{tag}.{named}"
        elif self.depth <= 4:
            self.group = f"{parent.group if parent else ''}/{tag}"
        else:
            self.group = parent.group


TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
REOPENED = frozenset("p li td tr h1 h2 h3".split())
NAMING = re.compile(r"class|role|data-", re.I)
RAW = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("script", "style")}


def named(attributes: str) -> str:
    """What class, role and data attributes say, in their order."""
    if not NAMING.search(attributes):
        return ""
    found = ((k.lower(), html.unescape(x or y or z)) for k, x, y, z in ATTRIBUTE.findall(attributes))
    return " ".join(v for k, v in found if k in ("class", "role") or k.startswith("data-"))


def leaves(page: str | None) -> tuple[list[tuple[str, Element | None]], str]:
    """(text nodes of a page in order, each with the element it stands in; the page's title).

    Elements of one path and naming are one object. An end tag closes the last open element of its name, and with it all that were
    left open inside; one without such an element is passed over.
    """
    page = page or ""
    top: dict[tuple[str, str], Element] = {}
    here: Element | None = None
    nodes: list[tuple[str, Element | None]] = []
    title: list[str] = []
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        data = page[at : m.start() if m else len(page)]
        if data and not data.isspace():
            data = html.unescape(data)
            if here and here.skipped:
                if here.title:
                    title.append(data)
            elif not data.isspace():
                nodes.append((data, here))
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag or tag in VOID:
            continue
        if m[1]:
            e = here
            while e and e.tag != tag:
                e = e.parent
            here = e.parent if e else here
            continue
        if here and here.tag == tag and tag in REOPENED:
            here = here.parent  # left open before
        kids = here.kids if here else top
        given = (tag, named(m[3]))
        e = kids.get(given)
        if e is None:
            e = kids[given] = Element(here, *given)
        if m[3].endswith("/"):
            continue
        here = e
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.start() if end else len(page)
    return nodes, "".join(title)


def key(text: str) -> str:
    return KEY.sub("", text.lower())


#: A line found further ahead than so many key characters is only taken if the line after it isn't found before it.
NEAR = 400


def align(keys: list[str], nodes: list[tuple[str, Element | None]]) -> list[Element | None]:
    """The element of each line's first text node, by the lines' keys; none where the markup doesn't hold the line."""
    parts = [key(t) for t, _ in nodes]
    stream = "".join(parts)
    ends = np.cumsum([len(p) for p in parts]) if parts else np.empty(0, int)
    out: list[Element | None] = []
    at = 0
    for i, k in enumerate(keys):
        found = stream.find(k, at) if k else -1
        if found - at > NEAR:
            after = next((x for x in keys[i + 1 : i + 40] if len(x) >= 8 and x != k), "")
            sooner = stream.find(after, at, found) if after else -1
            if sooner >= 0:
                found = -1
        if found < 0:
            out.append(None)
            continue
        out.append(nodes[int(np.searchsorted(ends, found, "right"))][1])
        at = found + len(k)
    return out


def teach(e: Element | None, line: str, words: int) -> float:
    """1 main body, 0 not, nan where the markup doesn't say."""
    if e is None:
        return np.nan
    if e.bad:
        return 0.0
    if e.entry:
        return 1.0
    if e.body:
        return 1.0 if e.inside or words >= 9 and not SPEAKER.match(line) else np.nan
    return np.nan


DENSE = 42
HTML_PART = slice(0, 18)
SPEAKER = re.compile(r"[\w-]+: ")
SIGNS = re.compile(r"[=({]")


class Lines:
    """What a line says by itself; lines seen before are remembered, as menus and footers come again on every page of a site."""

    REMEMBERED = 100_000

    def __init__(self) -> None:
        self.known: dict[str, tuple] = {}
        self.words: dict[str, int] = {}

    def __call__(self, line: str) -> tuple[str, int, np.ndarray, list[int]]:
        """(key, number of words, dense features, word ids)"""
        got = self.known.get(line)
        if got is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            if len(self.words) >= 10 * self.REMEMBERED:
                self.words.clear()
            got = self.known[line] = self._look(line)
        return got

    def _look(self, line: str) -> tuple[str, int, np.ndarray, list[int]]:
        strip = line.strip()
        ws = WORD.findall(line.lower())
        plain = WORD.findall(strip)
        letters = max(1, sum(map(str.isalpha, strip)))
        x = np.zeros(24, np.float32)
        x[:12] = (
            np.log1p(len(ws)) / 4, np.log1p(len(strip)) / 6, strip[-1] in ".!?。！？", strip[-1] == ":", "|" in strip, ">" in strip, "©" in strip, "%" in strip, sum(map(str.isdigit, strip)) / len(strip),
            strip[0].isupper(), sum(map(str.isupper, strip)) / letters, strip.count(",") / 4,
        )
        x[18], x[19], x[20], x[23] = line[0] in " \t", ": " in strip[:30], bool(SIGNS.search(strip)), sum(w[0].isupper() for w in plain[1:]) / max(1, len(ws))
        ids = []
        for w in ws:
            n = self.words.get(w)
            if n is None:
                n = self.words[w] = xxhash.xxh32_intdigest(w if not w.isdigit() else "0") % WORDS
            ids.append(n)
        return key(line), len(ws), x, ids or [0]


def features(text: str | None, markup: str | None, title: str | None, look: Lines | None = None) -> tuple[list[int], np.ndarray, list[list[int]], list[list[int]], np.ndarray]:
    """(line numbers, dense features, word ids, path ids, teaching) of a page's non-blank lines."""
    look = look or Lines()
    rows = [(n, s) for n, s in enumerate((text or "").split("\n")) if s.strip()]
    if not rows:
        return [], np.zeros((0, DENSE), np.float32), [], [], np.zeros(0)
    seen = [look(s) for _, s in rows]
    keys, counts = [g[0] for g in seen], np.array([g[1] for g in seen])
    nodes, inner = leaves(markup)
    held = align(keys, nodes)
    there = np.array([e is not None for e in held])
    heads = [key(t) for t in (inner, title or "") if t and key(t)]
    head = next((i for i, (k, e) in enumerate(zip(keys, held)) if e and e.bits & BITS["h1"]), None)
    if head is None:
        head = next((i for i, k in enumerate(keys) if k and any(h == k or h.startswith(k) and len(k) >= 0.5 * len(h) for h in heads)), None)
    n = len(rows)
    groups = [e.group if e else "" for e in held]
    number = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    group = np.array([number[g] for g in groups])
    lengths = np.array([len(s) for _, s in rows], float)
    most = np.zeros(len(number))
    np.maximum.at(most, group, counts)
    repeated = Counter(keys)
    place = np.arange(n)
    x = np.zeros((n, DENSE), np.float32)
    x[:, 18:] = [g[2] for g in seen]
    if there.any():
        bits = np.array([e.bits if e else 0 for e in held])
        home = groups[head] if head is not None and held[head] else None
        at_home = np.array([home is not None and g == home for g in groups])
        same = np.r_[False, group[1:] == group[:-1]]
        x[:, HTML_PART] = np.stack(
            [
                *(np.ones(n), *(bits >> k & 1 for k in range(7))), np.array([bool(e) and e.tag == "div" for e in held]), np.array([e.depth if e else 0 for e in held]) / 10,
                at_home, np.full(n, home is not None), np.bincount(group, lengths)[group] / lengths.sum(), np.log1p(np.bincount(group)[group]) / 4, np.minimum(most[group], 60) / 30,
                same, np.r_[same[1:], False], np.full(n, len(number) / 10),
            ],
            1,
        ) * there[:, None]
    x[:, 30], x[:, 34], x[:, 39] = place / n, [repeated[k] > 1 for k in keys], n / 60
    if head is not None:
        x[:, 31], x[:, 32], x[:, 33], x[:, 40] = place == head, place > head, np.clip((place - head) / 30, -1, 1), place == head + 1
    x[:, 35] = np.diff([-1, *(r for r, _ in rows)]) > 1
    truth = np.array([teach(e, s.strip(), c) for e, (_, s), c in zip(held, rows, counts)])
    return [r for r, _ in rows], x, [g[3] for g in seen], [list(e.ids) if e else [0] for e in held], truth


class Network:
    """Embeddings -> bidirectional LSTM -> logistic output per line."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = DENSE + 2 * EMBED
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"words": 0.3 * rng.standard_normal((WORDS, EMBED)).astype(np.float32), "paths": 0.3 * rng.standard_normal((PATHS, EMBED)).astype(np.float32), "out": scale(2 * HIDDEN + size, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"{d}x"], self.p[f"{d}h"], self.p[f"{d}b"] = scale(size, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            self.p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1

    def embed(self, name: str, ids: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(i) for i in ids])
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        return np.add.reduceat(self.p[name][flat], starts) / np.array([[len(i)] for i in ids], np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n, steps, _ = x.shape
        gates = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        trace = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates[:, t] + h @ self.p[f"{d}h"]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = f * c + i * u
            th = np.tanh(c2)
            if keep:
                trace.append((t, h, c, i, f, o, u, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c2, c)
            out[:, t] = h
        return out, trace

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._run("f", x, mask, keep)
        b, tb = self._run("b", x, mask, keep)
        z = np.concatenate([f, b, x], 2)
        logit = (z @ self.p["out"])[..., 0] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (z, tf, tb)

    def backward(self, x: np.ndarray, delta: np.ndarray, state) -> tuple[dict[str, np.ndarray], np.ndarray]:
        z, tf, tb = state
        grad = {"out": np.einsum("nts,nt->s", z, delta)[:, None], "bias": np.array([delta.sum()])}
        dz = delta[..., None] * self.p["out"][:, 0]
        dx = dz[..., 2 * HIDDEN :].copy()
        for d, trace, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, 2 * HIDDEN))):
            wx, wh = self.p[f"{d}x"], self.p[f"{d}h"]
            gh = np.zeros_like(wh)
            dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
            for t, h, c, i, f, o, u, th, m in reversed(trace):
                dh = dh + dz[:, t, part]
                do, dc2 = dh * th * m, (dh * o * (1 - th * th) + dc) * m
                dg = np.concatenate([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - u * u)], 1)
                dg_all[:, t] = dg
                gh += h.T @ dg
                dh, dc = dg @ wh.T + dh * ~m, dc2 * f + dc * ~m
            grad[f"{d}h"], grad[f"{d}b"] = gh, dg_all.sum((0, 1))
            grad[f"{d}x"] = np.einsum("nts,ntg->sg", x, dg_all)
            dx += dg_all @ wx.T
        return grad, dx

    def probabilities(self, pages: list[tuple]) -> list[np.ndarray]:
        """Of every page's lines. Pages of like length go together, as many as keep the padded batch within CELLS lines."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        parts: list[list[int]] = []
        for i in order:
            if parts and len(parts[-1]) < 128 and (len(parts[-1]) + 1) * len(pages[i][0]) <= CELLS:
                parts[-1].append(i)
            else:
                parts.append([i])
        for part in parts:
            x, mask = self.stack([pages[i] for i in part])
            p, _ = self.forward(x, mask)
            for row, i in enumerate(part):
                out[i] = p[row, : len(pages[i][0])]
        return out

    def stack(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(len(p[0]) for p in pages)
        x = np.zeros((len(pages), longest, DENSE + 2 * EMBED), np.float32)
        mask = np.zeros((len(pages), longest), bool)
        for r, (numbers, dense, words, paths, _) in enumerate(pages):
            x[r, : len(numbers)] = np.concatenate([dense, self.embed("words", words), self.embed("paths", paths)], 1)
            mask[r, : len(numbers)] = True
        return x, mask


def fit(pages: list[tuple], epochs: int = 16, rate: float = 0.004, seed: int = 11, hide: float = 0.3) -> Network:
    """Adam on the taught lines; per page and epoch the naming tokens, the words or all markup may be withheld."""
    net, rng = Network(), np.random.default_rng(seed)
    pages = [p for p in pages if len(p[0]) and np.isfinite(p[4]).mean() > 0.3 and len(p[0]) <= FIT_LINES]
    if not pages:
        return net
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]) + 6 * rng.random())
        batches = [order[at : at + 32] for at in range(0, len(order), 32)]
        rng.shuffle(batches)
        for part in batches:
            shown = []
            for i in part:
                numbers, dense, words, paths, truth = pages[i]
                draw = rng.random()
                if draw < 0.75:
                    paths = [[0]] * len(paths)
                if draw < 0.12:
                    dense = dense.copy()
                    dense[:, HTML_PART] = 0
                elif draw < 0.12 + hide:  # all markup of one container, as on pages laid out with tables
                    dense = dense.copy()
                    dense[:, 10:17] = 0
                words = [[w for w in ws if rng.random() > 0.15] or [0] for ws in words]
                shown.append((numbers, dense, words, paths, truth))
            x, mask = net.stack(shown)
            truth = np.full(mask.shape, np.nan)
            for r, p in enumerate(shown):
                truth[r, : len(p[0])] = p[4]
            known = np.isfinite(truth)
            prob, state = net.forward(x, mask, True)
            delta = (np.where(known, prob - np.where(known, truth, 0), 0) / max(1, known.sum())).astype(np.float32)
            grad, dx = net.backward(x, delta, state)
            for name, lo, at in (("words", DENSE, 2), ("paths", DENSE + EMBED, 3)):
                g = np.zeros_like(net.p[name])
                for r, p in enumerate(shown):
                    lens = np.array([len(i) for i in p[at]])
                    np.add.at(g, np.concatenate([np.asarray(i) for i in p[at]]), np.repeat(dx[r, : len(p[0]), lo : lo + EMBED] / lens[:, None], lens, 0))
                grad[name] = g
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def withheld(page: tuple) -> tuple:
    """The page without naming tokens and container features."""
    dense = page[1].copy()
    dense[:, 10:17] = 0
    return page[0], dense, page[2], [[0]] * len(page[3]), page[4]


def fit_twice(pages: list[tuple], hide: float = 0.15) -> Network:
    """Pages whose markup says everything teach first; by wording and place alone that network then judges the lines on which
    other pages' markup is silent, and where it is sure that they aren't main body, those lines teach too."""
    whole = [p for p in pages if len(p[0]) and np.isfinite(p[4]).mean() > 0.9 and np.nansum(p[4]) > 0]
    clear = [p for p in whole if np.isfinite(p[4]).all()] or whole
    first = fit(clear, epochs=20, hide=0.6)
    silent = [withheld(p) for p in pages]
    taught = []
    for page, prob in zip(pages, first.probabilities(silent)):
        truth = page[4].copy()
        if len(truth) and np.isfinite(truth).mean() > 0.3 and clear:
            open_ = ~np.isfinite(truth) & (page[1][:, 0] > 0)
            sentence = (page[1][:, 20] > 0) & (page[1][:, 37] == 0)  # ends like one, and names no speaker first
            truth[open_ & ~sentence & (prob < 0.35)] = 0
        taught.append((*page[:4], truth))
    return fit(taught, epochs=22, hide=hide)


def fit_on(pages: DataFrame, bound: int = FIT_PAGES, id_col: str = "page_id") -> Network:
    """The network fitted on the pages, at most `bound` of at most FIT_CHARACTERS characters of text and markup; fitted once for the same pages, then read from the shared folder."""
    usable = pages.where(f"html IS NOT NULL AND text IS NOT NULL AND length(html) + length(text) <= {FIT_CHARACTERS}").select(id_col, "text", "html", "title")
    rows = sorted((tuple(r)[1:] for r in least_hashed(usable, id_col, bound).collect()), key=repr)  # titles may be null
    look = Lines()
    return stored(pages.sparkSession, "mainbody", rows, lambda: fit_twice([features(*r, look) for r in rows]))


def main_lines(pages: DataFrame, net: Network, id_col: str = "page_id", cut: float = 0.5, with_line: bool = True) -> DataFrame:
    """(page_id, line_no, line, probability) of the lines of the main body; without the line itself if not with_line.

    Lines are numbered from 0 at LF, blank ones counted. Null ids and null or blank texts give no row; a null html or title is fine.
    Columns other than text, html and title are not read.
    """
    source = pages.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).alias("page_id"), F.col("text").cast("string"), F.col("html").cast("string"), F.col("title").cast("string"))
    kind = source.schema["page_id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(net.p)  # fixed size, under 1 MB

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, look = Network(), Lines()
        mine.p = shared.value
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                ids, texts, htmls, titles = (c.slice(at, 256).to_pylist() for c in batch.columns)
                got = [features(*r, look) for r in zip(texts, htmls, titles)]
                numbers, owners, sure, lines = [], [], [], []
                for i, text, page, prob in zip(ids, texts, got, mine.probabilities(got)):
                    keep = np.flatnonzero(prob >= cut).tolist()
                    numbers += [page[0][k] for k in keep]
                    owners += [i] * len(keep)
                    sure.append(prob[keep])
                    if with_line:
                        parts = text.split("\n")
                        lines += [parts[page[0][k]] for k in keep]
                columns = {"page_id": pa.array(owners, batch.schema.field(0).type), "line_no": pa.array(numbers, pa.int64())}
                if with_line:
                    columns["line"] = pa.array(lines, pa.string())
                columns["probability"] = pa.array(np.round(np.concatenate([*sure, np.zeros(0)]), 4), pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(batches, f"page_id {kind}, line_no bigint, " + "line string, " * with_line + "probability double")
