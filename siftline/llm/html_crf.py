"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Each has
features of its ancestors (tags, words of class, id and role) and of its text
(length, links, punctuation, cues). A two-label chain over the blocks, trained
by maximum likelihood on labelled pages, is decoded by Viterbi; the blocks
labelled as content, in page order, are the main text.

The labelled pages are made by the rules in labelled_pages(): sites of several
layouts, with every block's label known by construction; PAGES bounds them. Their
words are random, so only structure and shape can be learned. Training is a few
seconds on the driver, once per process; the weights go out with the task.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, without

PAGES, EPOCHS, SEED = 700, 150, 7

# HTML's element classes. RAW elements show no text of their own in the page: code, fields, and what
# stands in for media or scripts that a browser plays; formulas and drawings do, so their text stays.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe audio video canvas select annotation annotation-xml desc metadata".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button label".split())
CLOSES_P = BLOCK - frozenset("button label option optgroup legend".split())
#: A start tag ends these open elements, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Where a raw element ends; searched in the page itself, as lower() can change its length.
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
#: Words of boilerplate texts that a class name may not give away.
CUES = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|newsletter|sign in|log in|advert|sponsored|privacy policy|terms of", re.I)

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?]))")
#: A comment that ends where it begins ("<!-->", "<!--->"), and the end of others.
_COMMENT_END, _COMMENT_LAST = re.compile("-?>"), re.compile("--!?>")
_REST = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    """What an element adds to the path: its tag, words of its names, whether it is hidden."""
    out = [tag]
    for m in _ATTR.finditer(attrs) if attrs and not attrs.isspace() else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out += [f".{w.lower()}" for w in _NAMES.findall(html.unescape(value))]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            out.append(".hidden")
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; linear in its length, whatever is left open."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = at = 0
    path: tuple[str, ...] = ()
    known: dict[tuple, tuple[str, ...]] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path, linked))
            parts.clear()
        linked = 0

    def repath() -> None:
        nonlocal path
        key = tuple(m for _, m in stack)
        if key not in known:
            known[key] = tuple(x for m in key for x in m)
        path = known[key]

    def close_to(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            parts.append(page[a:b])
            if links:
                linked += b - a

    def implied(tag: str) -> None:
        """End open elements that this start tag ends."""
        ends, stops = IMPLIED.get(tag, ((), ()))
        for k in range(len(stack) - 1, -1, -1):
            t = stack[k][0]
            if t in ends:
                close_to(k)
                return
            if t in stops or (t == "p" and tag in CLOSES_P):
                break
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p":
                    close_to(k)
                    return
                if t in BLOCK and t != "p":
                    return

    while (m := _TAG.search(page, at)) is not None:
        text(at, m.start())
        if m[1]:
            end = _COMMENT_END.match(page, m.end()) or _COMMENT_LAST.search(page, m.end())
            at = end.end() if end else len(page)
            continue
        rest = _REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1 or len(page)
        at = end
        if m[4]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK:
                        flush()
                    close_to(k)
                    if tag in BLOCK:
                        repath()
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag does not end blocks
            continue
        if tag in RAW:
            k = _RAW_END[tag].search(page, end)
            at = page.find(">", k.start()) + 1 or len(page) if k else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            implied(tag)
        if tag in VOID or page[end - 2] == "/":
            if tag in BLOCK:
                repath()
            continue
        stack.append((tag, _marks(tag, page[m.end() : end - 1])))
        links += tag == "a"
        if tag in BLOCK:
            repath()
    text(at, len(page))
    flush()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    """Ancestors as a set, and the innermost three marks by place."""
    return [*{f"in:{x}" for x in path}, *(f"{k}:{x}" for k, x in enumerate(path[:-4:-1]))]


def text_features(text: str, linked: int) -> list[str]:
    n, words = len(text), text.count(" ") + 1
    out = [f"len:{min(8, n.bit_length())}", f"words:{min(6, words.bit_length())}", f"link:{min(4, 5 * linked // max(n, 1))}", f"end:{'.' if text[-1] in '.!?…。:»”' else 'x'}", f"stops:{min(4, text.count('. ') + text.count(', '))}"]
    if CUES.search(text):
        out.append("cue")
    return out


@dataclass(frozen=True)
class Field:
    """Weights for the label content against boilerplate: by feature, for steps between labels, for the start."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    start: float

    def decode(self, found: list[Block], memo: dict[tuple[str, ...], float]) -> list[bool]:
        """Viterbi: which blocks are content."""
        if not found:
            return []
        get, (same0, to1), (to0, same1) = self.weights.get, *self.steps
        back: list[tuple[bool, bool]] = []
        zero = one = 0.0
        for k, b in enumerate(found):
            e = memo.get(b.path)
            if e is None:
                e = memo[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            e += sum(get(f, 0.0) for f in text_features(b.text, b.linked))
            if k == 0:
                one = e + self.start
                continue
            z, o = one + to0 > zero + same0, one + same1 >= zero + to1
            back.append((z, o))
            zero, one = (one + to0 if z else zero + same0), (one + same1 if o else zero + to1) + e
        label = one > zero
        out = [label]
        for z, o in reversed(back):
            label = o if label else z
            out.append(label)
        return out[::-1]


def train(pages: list[list[tuple[Block, int]]], epochs: int = EPOCHS, ridge: float = 0.3, rate: float = 0.15) -> Field:
    """Maximum likelihood with a ridge by Adam; all pages at once, forward and backward over padded chains."""
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    rows, feats = [], []
    t_max = max(map(len, pages))
    y, mask = np.zeros((len(pages), t_max), int), np.zeros((len(pages), t_max), bool)
    for i, p in enumerate(pages):
        for t, (b, label) in enumerate(p):
            y[i, t], mask[i, t] = label, True
            for f in (*path_features(b.path), *text_features(b.text, b.linked)):
                rows.append(i * t_max + t)
                feats.append(names.setdefault(f, len(names)))
    rows, feats = np.array(rows), np.array(feats)
    k = len(names)
    theta, m1, m2 = np.zeros(k + 5), np.zeros(k + 5), np.zeros(k + 5)
    at, last = np.arange(len(pages)), mask.sum(1) - 1
    gold = np.bincount(feats, y.ravel()[rows], k)
    both = mask[:, 1:]
    gold_steps = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4)
    for epoch in range(1, epochs + 1):
        e = np.zeros((len(pages), t_max, 2))
        e[:, :, 1] = np.bincount(rows, theta[feats], len(pages) * t_max).reshape(len(pages), t_max)
        e[:, 0, 1] += theta[-1]
        step = theta[k : k + 4].reshape(2, 2)
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, t_max):
            s = f[:, t - 1, :, None] + step
            top = s.max(1)
            f[:, t] = np.where(mask[:, t, None], top + np.log(np.exp(s - top[:, None]).sum(1)) + e[:, t], f[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            s = step + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            top = s.max(2)
            b[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(s - top[:, :, None]).sum(2)), 0)
        end = f[at, last]
        z = end.max(1) + np.log(np.exp(end - end.max(1, keepdims=True)).sum(1))
        p1 = np.where(mask, np.exp(f[:, :, 1] + b[:, :, 1] - z[:, None]), 0)
        pairs = np.exp(f[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad = np.r_[np.bincount(feats, p1.ravel()[rows], k) - gold, pairs[both].sum(0).ravel() - gold_steps, (p1[:, 0] - y[:, 0]).sum()] + ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-8)
    s = theta[k : k + 4]
    return Field({f: float(theta[i]) for f, i in names.items()}, ((float(s[0]), float(s[1])), (float(s[2]), float(s[3]))), float(theta[-1]))


# Names that sites give to their parts.
BOILER = {
    "nav": "nav navbar menu navigation main-menu topnav breadcrumb breadcrumbs pagination pager toc skip-link tabs",
    "header": "header masthead site-header topbar banner branding logo site-title tagline",
    "footer": "footer site-footer bottom colophon copyright legal credits",
    "aside": "sidebar aside widget related recommended more-stories trending popular side rail widgets also-like teaser",
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adsbox banner-ad promoted ad-container",
    "notice": "cookie cookie-banner notice consent gdpr alert popup modal overlay paywall toast cookie-notice warning-bar announcement",
    "form": "form newsletter subscribe signup login search search-form contact-form poll",
    "comments": "comments comment comment-list replies reply disqus discussion responses user-comments reader-comments comment-body",
    "share": "share social social-links share-buttons tags tag-list meta post-meta author-box byline toolbar",
}
CONTENT = "article content post entry story main article-body post-content entry-content body-text page-content text article-content single-post story-body main-content"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[int]]]:
    """Pages and the label of each of their leaf blocks (1: content)."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 3, b: int = 18) -> str:
        s = words(a, b).capitalize()
        return (s.replace(" ", ", ", 1) if r.random() < 0.4 else s) + r.choice("....?!")

    def prose() -> str:
        return " ".join(sentence() for _ in range(1 if r.random() < 0.25 else r.randint(2, 8))) if r.random() < 0.93 else r.choice([words(1, 2).capitalize() + ".", words(1, 6)])

    def attr(names: str) -> str:
        name = r.choice(names.split())
        return r.choice([f' class="{name}"', f' id="{name}"', f" class='{name} {words(1, 1)}'", f' class="{words(1, 1)}-{name}"'])

    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def put(tag: str, text: str, label: int, extra: str = "") -> None:
            if r.random() < 0.3 and " " in text:
                a, b = text.split(" ", 1)
                text = r.choice([f"<b>{a}</b> {b}", f'<a href="/x">{a}</a> {b}', f"<em>{a} {b}</em>", f"{a}<br>{b}"])
            out.append(f"<{tag}{extra}>{text}" + ("" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"))
            labels.append(label)

        def wrap(tag: str, extra: str, inner) -> None:
            out.append(f"<{tag}{extra}>")
            inner()
            out.append(f"</{tag}>")

        def links(k: int) -> None:
            out.append("<ul>")
            for _ in range(k):
                put("li", f'<a href="/{words(1, 1)}">{words(1, 3)}</a>', 0)
            out.append("</ul>")

        def boiler(kind: str, bare: bool) -> None:
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
            tag = tag if r.random() < 0.6 or bare else r.choice(["div", "div", "section"])
            extra = attr(BOILER[kind]) if not bare and (tag in ("div", "section") or r.random() < 0.5) else ""
            if bare and tag in ("div", "section"):
                kind, tag = "footer", "footer"

            def inside() -> None:
                if kind == "nav":
                    links(r.randint(2, 8))
                elif kind == "header":
                    put(r.choice(["h1", "div", "p", "span", "h2"]) if r.random() < 0.999 else "p", words(1, 5), 0) if r.random() < 0.8 else links(3)
                elif kind == "footer":
                    put("p", r.choice(["&copy; ", "&copy; 2024 ", "Copyright ", ""]) + words(1, 3) + " &middot; " + sentence(), 0)
                elif kind == "aside":
                    if r.random() < 0.8:
                        put("h3", words(1, 3), 0)
                    if r.random() < 0.6:
                        links(r.randint(2, 6))
                    else:
                        put("p", sentence(), 0)
                elif kind == "ad":
                    put(r.choice(["p", "div"]), r.choice([sentence(), words(1, 4) + "."]), 0)
                elif kind == "notice":
                    put("p", r.choice(["We use cookies. ", "", ""]) + sentence(), 0)
                    if r.random() < 0.5:
                        put("button", words(1, 2), 0)
                elif kind == "form":
                    put("label", words(1, 3), 0)
                    out.append('<input type="text" name="q">')
                    put("button", words(1, 2), 0)
                elif kind == "comments":
                    put(r.choice(["h2", "h3", "h4"]), words(1, 2), 0)
                    named = r.random() < 0.6
                    for _ in range(r.randint(1, 5)):
                        if not named:
                            put(r.choice(["p", "p", "li"]), prose(), 0)
                            continue
                        one = r.choice(["div", "li", "article"])
                        wrap(one, attr("comment reply comment-body"), lambda: (put("p", words(1, 2), 0, attr("author user")), put("p", prose(), 0)))
                else:
                    put("p", words(1, 5), 0)

            if kind in ("ad", "notice", "footer") and r.random() < 0.4:  # text right in the element
                out.append(f"<{tag}{extra}>{r.choice([sentence(), words(1, 4) + '.']) if kind != 'footer' else '&copy; ' + words(1, 3) + ' &middot; ' + sentence()}</{tag}>")
                labels.append(0)
            else:
                wrap(tag, extra, inside)

        def article() -> None:
            if r.random() < 0.85:
                put("h1", words(2, 9).capitalize(), 1)
            for _ in range(r.randint(1, 14)):
                x = r.random()
                if x < 0.74:
                    put("p", prose(), 1)
                elif x < 0.8:
                    put(r.choice(["h2", "h3"]), words(1, 6).capitalize(), 1)
                elif x < 0.84:
                    out.append("<ul>")
                    for _ in range(r.randint(2, 4)):
                        put("li", sentence(), 1)
                    out.append("</ul>")
                elif x < 0.87:
                    wrap("blockquote", "", lambda: put("p", prose(), 1))
                elif x < 0.89:
                    put("div", prose(), 1)
                elif x < 0.96:
                    boiler(r.choice(["ad", "ad", "form", "share", "aside", "notice"]), False)
                elif x < 0.975:
                    put("p", prose(), 0, r.choice([" hidden", ' style="display:none"', ' aria-hidden="true"']))
                else:
                    out.append("<script>var x = '<p>no</p>';</script><!-- <p>no</p> -->")
            if r.random() < 0.15:
                boiler("comments", False)

        bare = r.random() < 0.15
        kinds = ["nav", "header", "ad", "notice", "form", "aside"]
        out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x y</title><style>p{margin:0}</style></head><body' + (attr("page home single") if r.random() < 0.2 else "") + ">")
        outer = r.random() < 0.3
        if outer:
            out.append(r.choice(["<div id=wrapper>", '<div class="container">', "<div>", '<div id="page">']))
        for kind in r.sample(kinds, r.randint(1, 4)):
            boiler(kind, bare)
        x = r.random()
        if x < 0.4:
            wrap("article", attr(CONTENT) if r.random() < 0.3 else "", article)
        elif x < 0.55:
            wrap("main", attr(CONTENT) if r.random() < 0.5 else "", lambda: wrap(*r.choice([("article", ""), ("div", attr(CONTENT)), ("section", "")]), article))
        elif x < 0.85:
            wrap("div", attr(CONTENT), article)
        elif x < 0.95:
            wrap("div", f' class="{words(1, 1)}"', article)
        else:
            article()
        for kind in r.sample(["comments", "aside", "ad", "share", "form", "nav", "notice"], r.randint(0, 3)):
            boiler(kind, bare)
        if r.random() < 0.85:
            boiler("footer", bare)
        out.append("</div>" * outer + ("</body></html>" if r.random() < 0.9 else ""))
        yield "".join(out), labels


@lru_cache(1)
def learned() -> Field:
    """The field of the labelled pages; a page whose blocks and labels differ in number would be a mistake in the rules."""
    pages = []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise AssertionError("labelled page and its blocks differ")
        pages.append(list(zip(found, labels, strict=True)))
    return train(pages)


def main_text(page: str | None, field: Field, memo: dict[tuple[str, ...], float] | None = None) -> str:
    """The main text of a page: its content blocks joined by one space."""
    found = blocks(page)
    return " ".join(b.text for b, ok in zip(found, field.decode(found, {} if memo is None else memo), strict=True) if ok)


def extract(df: DataFrame, page: str = "html", field: Field | None = None) -> DataFrame:
    """Add text and n_chars to every row; columns of these names are replaced.

    Null and empty pages, and pages without content, get an empty text. Whole
    pages are read, however long, and repeated rows stay. A text without any tag
    is one block. Other columns stay as they are; an empty table gives an empty one.
    """
    df = without(df, ("text", "n_chars"))
    schema = df.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")}).schema
    field = field or learned()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, ...], float] = {}
        for batch in batches:
            texts = []
            for p in batch.column(batch.schema.names.index(page)).to_pylist():
                if len(memo) > 50_000:
                    memo.clear()
                texts.append(main_text(p, field, memo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return df.mapInArrow(lean(run), schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
