"""Main text of web pages by a maximum-scoring subsequence over words and tags.

A page is read as a sequence of items, words and tags, each inside the elements that are open there. The names of those
elements and the words of their class, id and role are evidence: a logistic model over labelled pages gives every piece of
evidence a weight, and an item's log-odds of belonging to the main text are the sum over what it stands in, of which what
speaks for the text counts up to `CAP`. Words score by their log-odds, tags a little below zero. One linear scan finds the
contiguous run of items with the largest sum; its words with positive log-odds are the main text, one line per block, so
that an advert or a form inside an article goes by its own evidence; it costs the run little, as it does not end an
article. The labelled pages are layouts drawn from a seeded generator."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z:_-]+)")
_HIDES = re.compile(r"display:\s*none|visibility:\s*hidden")

#: Elements whose content is no markup, to be skipped up to their end tag.
RAW = frozenset("script style template iframe noembed noframes textarea title".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
#: Elements that end and begin a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are looked for in the stack of open ones, and say something about what they hold.
CONTAINERS = frozenset("article aside blockquote button center details dialog div dl fieldset figure footer form head header main menu nav ol section select table tbody td tfoot th thead tr ul".split())
#: Containers that tell nothing by themselves.
GENERIC = frozenset("center dd div dl dt ol section table tbody td tfoot th thead tr ul".split())
#: What a main element or an article cannot stand in, and therefore closes where an end tag is missing.
CLOSED_BY = {"main": frozenset("nav aside header footer menu form head ul ol".split()), "article": frozenset("nav menu head".split()), "body": frozenset(["head"])}
#: Log-odds up to which what an element stands in speaks for it.
CAP = 1.0
#: Sectioning elements that have headers of their own.
SECTIONS = frozenset(["article", "main", "section"])


def evidence(name: str, rest: str, sectioned: bool) -> set[str]:
    """What an element tells about its content. sectioned: whether it stands in an element that has headers of its own."""
    own = name
    if name == "header" and sectioned:
        own = "own header"  # of an article or section
    out = set() if name in GENERIC else {f"<{own}>"}
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDES.search(value):
                out.add("hidden")
            elif key in ("class", "id", "role"):
                out.update(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()))
    return out


class Open:
    """Open elements, outermost first: (name, evidence, log-odds, whether main text is marked). Each step takes a time of its own, however deep they stand."""

    def __init__(self, seen: frozenset[str], odds: float):
        self.stack: list[tuple[str, frozenset[str], float, bool]] = [("", seen, odds, False)]
        self.places: dict[str, list[int]] = {}  # of each name in the stack

    def push(self, name: str, seen: frozenset[str], odds: float, marked: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, seen, odds, marked))

    def cut(self, at: int) -> None:
        for name, *_ in reversed(self.stack[at:]):
            self.places[name].pop()
        del self.stack[at:]

    def first(self, names: frozenset[str]) -> int | None:
        return min((p[0] for n in names if (p := self.places.get(n))), default=None)

    def last(self, name: str) -> int | None:
        found = self.places.get(name)
        return found[-1] if found else None


def items(page: str, weights: Mapping[str, float], outside: bool = False, by_name: bool = True) -> Iterator[tuple[str, frozenset[str], float, bool, str]]:
    """(tag name or "", evidence, log-odds, whether an element that holds main text is open, text) in page order, without scripts, styles and comments.

    outside: whether the page marks its main text by an article or a main element, so that what lies outside is less likely to be it.
    by_name: whether the classes and ids of articles and main elements count.

    An end tag without its start is passed over; a start without an end holds up to the end of what it stands in. The time is in
    proportion to the page, however many elements are left open."""
    base = frozenset(["@outside"] if outside else ["@page"])
    lift, own = weights.get("@outside", 0.0), weights.get("@bias", 0.0) + sum(weights.get(e, 0.0) for e in base)
    opened = Open(base, own)
    stack, at = opened.stack, 0
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            yield "", *stack[-1][1:], page[at : m.start()]
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in CONTAINERS and (k := opened.last(name)) is not None:
                opened.cut(k)
        elif name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        else:
            if (k := opened.first(CLOSED_BY.get(name, frozenset()))) is not None:
                opened.cut(k)
            if name in CONTAINERS:
                _, seen, odds, marked = stack[-1]
                holds = name in ("article", "main")
                if holds and "@outside" in seen:
                    seen, odds = seen - {"@outside"}, odds - lift
                new = evidence(name, m["rest"] or m["rest2"] or "" if by_name or not holds else "", opened.first(SECTIONS) is not None) - seen
                if weights:  # what has no weight need not be carried along
                    new = {e for e in new if e in weights}
                odds = min(odds, CAP) + sum(weights.get(e, 0.0) for e in new)
                opened.push(name, seen | new if new else seen, odds, marked or odds > 0)
        yield name, *stack[-1][1:], ""
    if at < len(page):
        yield "", *stack[-1][1:], page[at:]


# Labelled pages. ON and OFF mark the main text and are taken out before a page is read.
ON, OFF = "\x01", "\x02"
#: Names that authors give to parts of a page (fixed values); the layouts draw from them.
NAMES = {
    "main": "article content entry post story main body text page single prose markdown",
    "ad": "ad ads adv advert advertisement adsense banner promo promotion promoted sponsor sponsored",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip toc",
    "header": "header masthead topbar branding logo",
    "footer": "footer bottom copyright contentinfo colophon legal",
    "aside": "sidebar aside complementary widget widgets related recommended recommendations trending popular teaser",
    "form": "login signup signin register newsletter subscribe subscription search searchbox",
    "comments": "comment comments commentlist disqus respond reply replies discussion",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay notification dialog",
    "share": "share sharing social follow byline tags",
}
TAGS = {"ad": ["div", "aside", "section"], "nav": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "notice": ["div", "dialog", "aside"], "share": ["div", "ul"]}


def labelled_pages(n: int = 2000, seed: int = 17) -> list[tuple[str, bool]]:
    """n pages with their main text between ON and OFF, and whether an article or a main element holds it."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=rng.randint(a, b)))

    def named(kind: str) -> str:
        w = rng.choice(NAMES[kind].split())
        value = rng.choice([w, *[w] * (kind != "main"), f"{w}-{rng.choice(['box', 'wrap', 'area', 'block', 'inner', 'list', 'top'])}", f"site-{w}", f"{w}{rng.randint(1, 9)}"])
        if kind == "main" and rng.random() < 0.25:
            value += f" has-{rng.choice(['sidebar', 'banner', 'comments', 'header', 'ads'])}"
        if kind == "main" and rng.random() < 0.25:
            value += f' {rng.choice(NAMES["main"].split())}'
        return f'{rng.choice(["class", "class", "id", "role"])}="{value}"'

    def boiler(kind: str) -> str:
        tag, plain = rng.choice(TAGS[kind]), rng.choice([f"<p>{words(3, 40)}</p>", f"<ul><li><a>{words(1, 3)}</a></li><li><a>{words(1, 3)}</a></li></ul>", words(2, 20), f"<div><p>{words(3, 30)}</p><p>{words(3, 30)}</p></div>"])
        if kind == "form":
            plain = f"<label>{words(1, 3)}</label><select><option>{words(1, 2)}</option></select><button>{words(1, 2)}</button>" + plain
        if kind == "comments" and rng.random() < 0.3:
            plain = f"<article {named('comments')}>{plain}</article>"
        known = tag in ("nav", "header", "footer", "aside", "form")
        hidden = " hidden" if kind == "notice" and rng.random() < 0.2 else ""
        return f"<{tag}{'' if known and rng.random() < 0.5 else ' ' + named(kind)}{hidden}>{plain}</{tag}>"

    def inner(marks: bool) -> str:
        p = lambda: f"<p>{words(5, 60)}</p>"
        kinds = [p, p, p, lambda: f"<h2>{words(1, 6)}</h2>", lambda: f"<ul><li>{words(2, 9)}</li><li>{words(2, 9)}</li></ul>", lambda: f"<blockquote>{p()}</blockquote>",
                 lambda: f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 3)}</td></tr></table>", lambda: f"<figure><img><figcaption>{words(2, 9)}</figcaption></figure>", lambda: f"<div>{p()}{p()}</div>",
                 lambda: f"<section>{p()}</section>", lambda: f"<ol><li>{words(2, 9)}</li></ol>", lambda: f"<p>{words(2, 9)} <a>{words(1, 3)}</a> <b>{words(1, 3)}</b></p>", lambda: f"<details>{words(2, 9)}</details><dl><dt>{words(1, 2)}</dt><dd>{words(2, 9)}</dd></dl>"]
        parts = [rng.choice(kinds)() for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), OFF + boiler(rng.choice(["ad", "aside", "share", "form", "notice", "nav", "comments"])) + ON)
        return rng.choice([f"<header><h1>{words(2, 8)}</h1></header>" if marks else "", f"<h1>{words(2, 8)}</h1>", ""]) + "".join(parts)

    out = []
    for _ in range(n):
        style = rng.choice(["article", "article", "main", "both", "div", "div", "plain", "bare"])
        marks = style in ("article", "main", "both")
        body = f"{ON}{inner(marks)}{OFF}"
        attr = f" {named('main')}" if style == "div" or style not in ("plain", "bare") and rng.random() < 0.4 else ""
        body = {"article": f"<article{attr}>{body}</article>", "main": f"<main{attr}>{body}</main>", "both": f"<main{attr}><article>{body}</article></main>", "div": f"<div{attr}>{body}</div>", "plain": f"<div>{body}</div>", "bare": body}[style]
        before = [boiler(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.45]
        after = [boiler(k) for k in ("share", "aside", "comments", "form", "ad", "footer") if rng.random() < 0.45]
        if marks:
            before += [f"<div><p>{words(2, 15)}</p></div>"] * (rng.random() < 0.3)
            after += [f"<p>{words(2, 15)}</p>"] * (rng.random() < 0.3)
        out.append((f"<html><head>{words(2, 8)}</head><body>{''.join(before)}{body}{''.join(after)}</body></html>", marks))
    return out


@lru_cache(maxsize=2)
def weights(n: int = 2000, steps: int = 400, penalty: float = 1e-4) -> dict[str, float]:
    """Weight of every piece of evidence, by logistic regression on the words of n labelled pages.

    Words of a page that stand in the same evidence count together, and pages weigh the same."""
    rows: Counter[tuple[frozenset[str], bool]] = Counter()
    for page, marks in labelled_pages(n):
        own: Counter[tuple[frozenset[str], bool]] = Counter()
        main = False
        for _, seen, _, _, text in items(page, {}, marks):
            for part in re.split(f"([{ON}{OFF}])", text):
                if part in (ON, OFF):
                    main = part == ON
                elif part.strip():
                    own[seen, main] += len(part.split())
        for k, v in own.items():
            rows[k] += math.sqrt(v)
    names = sorted(set().union(*(seen for seen, _ in rows)))
    x = np.array([[name in seen for name in names] + [True] for seen, _ in rows], float)
    y, w = np.array([main for _, main in rows], float), np.array(list(rows.values()))
    w /= w.sum()
    theta, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        speed = 0.9 * speed + x.T @ (w * (p - y)) + penalty * np.r_[theta[:-1], 0]
        theta = theta - 1.0 * speed
    return dict(zip([*names, "@bias"], theta.tolist(), strict=True))


def word_score(odds: float, marked: bool) -> float:
    """A word's log-odds between -1 and 1; one against the text costs little where it stands in marked main text."""
    return max(-0.02 if marked else -1.0, min(1.0, odds))


def tag_score(odds: float, marked: bool) -> float:
    """Tags cost a little: 0.005 within main text, up to 0.1 within boilerplate."""
    return -0.005 if marked else -0.005 - 0.095 * max(0.0, min(1.0, -odds))


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the largest sum; the first of equal ones, empty if no sum is positive."""
    best, total, first, out = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += s
        if total > best:
            best, out = total, (first, k + 1)
    return out


def _text(found: list[tuple[str, frozenset[str], float, bool, str]]) -> str:
    scores = [tag_score(odds, marked) if name else word_score(odds, marked) * len(text.split()) for name, _, odds, marked, text in found]
    first, end = best_run(scores)
    blocks, own = [], []
    for name, _, odds, _, text in found[first:end]:
        if name:
            if name in BLOCKS:
                blocks.append(own)
                own = []
            elif name == "br":
                own.append(" ")
        elif odds > 0:
            own.append(html.unescape(text))
    blocks.append(own)
    return "\n".join(b for own in blocks if (b := " ".join("".join(own).split())))


def main_text(page: str | None, learnt: Mapping[str, float] | None = None) -> str:
    """Main text of a whole page: blocks joined by line feeds, white space in a block as one space.

    A page with an article or a main element, of which nothing would be left, is read again without what these are called:
    one word of a class (comments-open, related) does not empty a page."""
    learnt, page = weights() if learnt is None else learnt, page or ""
    found = list(items(page, learnt))
    if any(name in ("article", "main") and odds > 0 for name, _, odds, _, _ in found):
        found = list(items(page, learnt, outside=True))
    text = _text(found)
    if not text and any(name in ("article", "main") for name, *_ in found):
        text = _text(list(items(page, learnt, outside=True, by_name=False)))
    return text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row. Null and empty pages have an empty text; a page is read whole, however long.

    Repeated rows are extracted again, of runs with equal sums the first is taken, null ids and urls stay null, an empty table
    gives none. Other columns are not read. Weights are learnt once, before tasks start."""
    learnt = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h, learnt) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    """Per page: the main text and its length."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
