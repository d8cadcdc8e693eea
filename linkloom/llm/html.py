"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A tolerant scanner walks a page's tags once and cuts it into leaf blocks, each with the
kinds of its ancestors (from tag names, roles, class and id words) and features of its
text. Two labels, main and other, are chained with transition weights; the weights are
fitted on labelled pages by gradient ascent on the conditional likelihood (forward and
backward sums), and a page is decoded by Viterbi. The fitted weights are a few hundred
numbers; extraction is one map over pages, linear in the page.

Defined results: null and empty pages give the empty string; a page without blocks too;
unclosed and misnested tags, comments and raw-text elements are scanned as browsers do in
the common cases, except that the page goes on after a raw-text element without an end tag; repeated rows are extracted alike.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import mapped, table

#: Labelled pages that are made, rounds and step of training, weight of the prior.
TRAIN_PAGES, ROUNDS, STEP, PRIOR = 240, 150, 0.1, 1e-3

# Element names by role in the scan.
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_BOUNDARY = frozenset("table ul ol dl div section article body html".split())

# Words in class, id and role that tell what an element is for.
_PURPOSES = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense adslot outbrain taboola",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc sitemap topbar",
    "header": "header masthead branding logo",
    "footer": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more trending popular complementary",
    "comment": "comment comments reply replies discussion disqus respond commentlist responses thread",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall signup dialog",
    "share": "share sharing social follow tags tag tagline byline author meta metadata toolbox",
    "form": "form search login signin input contact",
    "content": "content article post entry story main body text prose page articlebody",
}
_PURPOSE_OF = {w: k for k, ws in _PURPOSES.items() for w in ws.split()}
# Words of boilerplate texts.
_PHRASES = ("©", "copyright", "all rights reserved", "cookie", "subscribe", "newsletter", "sign in", "log in", "sign up", "privacy policy", "terms of", "read more", "share this", "follow us", "advertis", "sponsored", "powered by", "leave a reply", "leave a comment", "related", "menu", "search", "contact us", "click here")

_RAW_ENDS = {tag: re.compile("</" + tag, re.I) for tag in _RAW}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(maxsize=65536)
def _kinds(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is, from its tag name and attributes."""
    out = {tag}
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            out.add("~hidden")
        elif name in ("class", "id", "role"):
            words = [w.lower() for w in _PARTS.findall(value)]
            out.update("." + _PURPOSE_OF[w] for w in words if w in _PURPOSE_OF)
    return tuple(sorted(out))


@dataclass
class Block:
    text: str
    kinds: tuple[str, ...]
    own: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; white space is collapsed and references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    counts: dict[str, int] = {}
    pieces: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(page)

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(raw.strip())

    def cut() -> None:
        nonlocal linked
        if pieces:
            said = " ".join("".join(pieces).split())
            pieces.clear()
            if said:
                out.append(Block(said, tuple(counts), stack[-1][0] if stack else "", linked))
            linked = 0

    def pop() -> None:
        for k in stack.pop()[1]:
            if counts[k] == 1:
                del counts[k]
            else:
                counts[k] -= 1

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in _RAW and not m[3].endswith("/"):
            if tag == "title":
                cut()
            end = _RAW_ENDS[tag].search(page, at)
            if end is None:
                continue  # unclosed: what follows is scanned as elements
            close = page.find(">", end.end())
            at = close + 1 if close >= 0 else size
        elif tag in ("br", "wbr"):
            pieces.append(" " if tag == "br" else "")
        elif tag == "a":
            in_link = not closing
        elif tag in ("hr", "option", "button", "select"):
            cut()
        elif tag in _BLOCK:
            cut()
            in_link = False
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in ("table", "article") and tag in ("p", "li", "td", "tr"):
                        break
            else:
                ends = _SELF_CLOSING.get(tag) or ({"p"} if stack and stack[-1][0] == "p" else None)
                while ends and stack and stack[-1][0] in ends and stack[-1][0] not in _BOUNDARY:
                    pop()
                if tag != "hr":
                    kinds = _kinds(tag, m[3].strip())
                    stack.append((tag, kinds))
                    for k in kinds:
                        counts[k] = counts.get(k, 0) + 1
    cut()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of every block: ancestors, text, and kinds of the neighbours."""
    out = []
    for b in page:
        n = len(b.text)
        words = b.text.count(" ") + 1
        dense = b.linked / n
        f = ["bias", f"own={b.own}", f"long={min(9, n.bit_length())}", f"words={min(7, words.bit_length())}", f"links={int(4 * min(1.0, dense))}"]
        f += ["in=" + k for k in b.kinds]
        if b.text[-1] in ".!?…\"»”":
            f.append("ends")
        said = (b.text if n < 400 else b.text[:200] + " " + b.text[-200:]).lower()
        if any(x in said for x in _PHRASES):
            f.append("phrase" if n >= 200 else "phrase-short")
        if "content" not in " ".join(b.kinds) and not {"article", "main"} & set(b.kinds):
            f.append(f"plain-long={min(9, n.bit_length())}")
        if len(b.kinds) <= 3:
            f.append("shallow")
        out.append(f)
    inner = [[x for x in f if x.startswith(("own=", "links=", "long="))] for f in out]
    for i, f in enumerate(out):
        f += ["before:" + x for x in (inner[i - 1] if i else ["start"])] + ["after:" + x for x in (inner[i + 1] if i + 1 < len(inner) else ["end"])]
    return out


@dataclass
class Field:
    """Weights of the label main against other, and of label changes."""

    weights: dict[str, float]
    moves: np.ndarray  # log-weights of (label before, label)

    def decode(self, page: list[list[str]]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        get, ((a, b), (c, d)) = self.weights.get, self.moves.tolist()
        back, off, on = [], 0.0, 0.0
        for t, f in enumerate(page):
            e = sum(get(x, 0.0) for x in f)
            if t:
                from_off, from_on = (off + a >= on + c), (on + d >= off + b)
                back.append((0 if from_off else 1, 1 if from_on else 0))
                off, on = max(off + a, on + c), max(off + b, on + d) + e
            else:
                on = e
        label = int(on > off)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return [x == 1 for x in reversed(labels)]


def fit(pages: list[list[list[str]]], labels: list[list[bool]], rounds: int = ROUNDS, step: float = STEP, prior: float = PRIOR) -> Field:
    """Maximum conditional likelihood with a Gaussian prior, by Adam on exact gradients."""
    names = sorted({x for p in pages for f in p for x in f})
    place = {x: i for i, x in enumerate(names)}
    n, longest = len(pages), max(map(len, pages))
    at = [(p, t, place[x]) for p, page in enumerate(pages) for t, f in enumerate(page) for x in f]
    page_, time_, feat = (np.array(x) for x in zip(*at, strict=True))
    cell = page_ * longest + time_
    sizes = np.array([len(p) for p in pages])
    real = np.arange(longest)[None, :] < sizes[:, None]
    gold = np.zeros((n, longest))
    for i, y in enumerate(labels):
        gold[i, : len(y)] = y
    both = real[:, 1:] & real[:, :-1]
    gold_moves = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    theta, m1, m2 = np.zeros(len(names) + 4), np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for r in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(cell, w[feat], n * longest).reshape(n, longest)
        e[~real] = 0
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            x = alpha[:, t - 1, :, None] + moves[None]
            new = np.logaddexp(x[:, 0], x[:, 1]) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.where(real, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
        joint = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        g = np.append(np.bincount(feat, (gold - p1).ravel()[cell], len(names)), (gold_moves - joint.sum((0, 1))).ravel()) / n - prior * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + step * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return Field({x: float(v) for x, v in zip(names, theta[:-4], strict=True)}, theta[-4:].reshape(2, 2))


_MAIN, _OTHER = "\ue000", "\ue001"  # marks at the head of labelled texts


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[str]:
    """Pages of many layouts whose texts start with a mark of their label."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda x: x[int(rng.integers(len(x)))]
    syllables = "ka lo mi ter san ve ro der ing al est con pra le un sti mar ion".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))).capitalize()
    prose = lambda a, b: ". ".join(words(3, 16) for _ in range(int(rng.integers(a, b)))) + "."
    maybe = lambda p: rng.random() < p
    main, other = (lambda t: _MAIN + t), (lambda t: _OTHER + t)

    def items(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{word()}">{other(words(1, 4))}</a></li>' for _ in range(int(rng.integers(a, b))))

    def advert() -> str:
        return f'<div class="{pick(["ad", "ads", "advert", "sponsored", "ad-slot top", "promo", "banner"])}">{other(pick([words(2, 9), prose(1, 3), "Advertisement"]))}</div>'

    def notice() -> str:
        return f'<div {pick(["class", "id"])}="{pick(["cookie-notice", "notice", "consent", "gdpr-banner", "alert", "newsletter", "subscribe-box", "popup"])}">{pick(["<p>", ""])}{other(pick(["We use cookies. " + words(3, 9), prose(1, 4), "Subscribe to our newsletter"]))}</div>'

    def form() -> str:
        return f'<form action="/{word()}"{pick(["", " class=search", " id=login"])}><label>{other(words(1, 3))}</label><input name=q>{pick(["", f"<p>{other(prose(1, 2))}</p>"])}<button>{words(1, 2)}</button></form>'

    def side() -> str:
        body = pick([f"<h3>{other(words(1, 4))}</h3><ul>{items(2, 7)}</ul>", f"<p>{other(prose(1, 4))}</p>", f"<h4>{other(words(1, 3))}</h4><p>{other(prose(1, 3))}</p>"])
        return pick([f"<aside>{body}</aside>", f'<div class="{pick(["sidebar", "related", "widget", "right-rail", "more-stories"])}">{body}</div>', f'<section id="{pick(["related", "sidebar", "popular"])}">{body}</section>'])

    def comments() -> str:
        one = lambda: pick([f'<div class="comment"><p>{other(prose(1, 5))}</p></div>', f"<li><b>{other(word())}</b><p>{other(prose(1, 4))}</p></li>", f"<p>{other(prose(1, 4))}</p>"])
        body = f"<h{pick([2, 3])}>{other(pick(['Comments', words(1, 3)]))}</h{3}>" + "".join(one() for _ in range(int(rng.integers(1, 6))))
        return f'<{(t := pick(["div", "section", "ol"]))} {pick(["id", "class"])}="{pick(["comments", "comment-list", "discussion", "replies"])}">{body}</{t}>'

    def share() -> str:
        return f'<div class="{pick(["share", "social", "tags", "sharing"])}"><a href=#>{other(pick(["Share this", words(1, 2)]))}</a> <a href=#>{words(1, 2)}</a></div>'

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{main(prose(1, 8))}</p>" if maybe(0.8) else f"<p><b>{main(prose(1, 4))}<br>"
        if kind < 0.8:
            return f"<h{pick([2, 3])}>{main(words(2, 8))}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{main(words(3, 12))}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{main(prose(1, 4))}</p></blockquote>"
        if kind < 0.94:
            return f"<p>{main(words(1, 3))}.</p>"
        if kind < 0.97:
            return f"<pre>{main(words(4, 30))}</pre>"
        return f'<p>{main(words(4, 20))} <a href="/{word()}">{words(1, 4)}</a> {words(2, 8)}.</p>'

    pages = []
    for _ in range(n):
        nav = pick([f"<nav><ul>{items(2, 9)}</ul></nav>", f'<div class="{pick(["menu", "nav", "navbar"])}"><ul>{items(2, 8)}</ul></div>', f'<div id="{pick(["topmenu", "nav"])}">' + " | ".join(f"<a href=#>{other(words(1, 2)) if i == 0 else words(1, 2)}</a>" for i in range(5)) + "</div>"])
        header = pick(["", f"<header><a href=/>{other(words(1, 3))}</a></header>", f"<header><h1>{other(words(1, 4))}</h1><p>{other(words(3, 9))}</p></header>", f'<div class="masthead">{other(words(1, 4))}</div>'])
        footer = pick([f"<footer>{other('© ' + words(1, 5) + ' · ' + prose(1, 2))}</footer>", f"<footer><p>{other(prose(1, 3))}</p><ul>{items(1, 5)}</ul></footer>", f'<div class="footer">{other("Copyright " + words(2, 6))}</div>', f"<footer>{other(words(2, 12))}.</footer>"])
        title = pick([f"<h1>{main(words(2, 10))}</h1>", f"<h1>{main(words(1, 3))}</h1>", f"<header><h1>{main(words(2, 10))}</h1></header>"]) if maybe(0.9) else ""
        inner = [paragraph() for _ in range(int(rng.integers(0 if title else 1, 12)))]
        for extra, p in ((advert, 0.3), (share, 0.2), (notice, 0.1), (form, 0.1), (side, 0.12)):
            if maybe(p):
                inner.insert(int(rng.integers(len(inner) + 1)), extra())
        if maybe(0.15):
            inner.append(comments())
        body = title + "".join(inner)
        body = pick([f"<article>{body}</article>"] * 4 + [f"<main><article>{body}</article></main>", f'<div class="{pick(["content", "post", "entry-content", "article-body"])}">{body}</div>', f"<main>{body}</main>", f'<div id="{pick(["content", "story", "main"])}"><article class=post>{body}</article></div>', f"<div><div>{body}</div></div>"])
        parts = [header, nav] if maybe(0.5) else [nav, header]
        parts += [advert() if maybe(0.6) else "", notice() if maybe(0.3) else "", form() if maybe(0.2) else "", side() if maybe(0.2) else "", body]
        parts += [side() if maybe(0.3) else "", comments() if maybe(0.35) else "", form() if maybe(0.15) else "", advert() if maybe(0.25) else "", notice() if maybe(0.15) else "", footer]
        pages.append("<!DOCTYPE html><html><head><title>" + words(2, 6) + "</title><style>p{margin:0}</style></head><body>" + "".join(parts) + pick(["</body></html>", ""]))
    return pages


def train(pages: list[str] | None = None) -> Field:
    """A field from labelled pages (those made here unless others are given)."""
    seen, gold = [], []
    for page in labelled_pages() if pages is None else pages:
        found = blocks(page)
        labels = [_MAIN in b.text for b in found]
        for b in found:
            b.text = b.text.replace(_MAIN, "").replace(_OTHER, "") or "."
        if found:
            seen.append(features(found))
            gold.append(labels)
    return fit(seen, gold)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, keep in zip(found, field.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, field: Field, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py(), field) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    columns = [F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html")]
    return mapped(pages.select(*columns), run, f"page_id {kind}, url string, text string, n_chars long")


def op3_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train())
