"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

A page is a sequence of tags and text runs. Words score positive, tags negative; the weights are
log-odds of lying inside the article, learned from labelled pages: pages of a bounded sample whose
markup says where the article is (`article`, `main`, role=main). A linear scan finds the contiguous
region of the highest score. Tags between the tags of a marked article cost nothing, so a region holds
a marked article whole; where marked articles hold a tenth of the page's words, words outside score
nothing. Inside a region everything is kept but boilerplate: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. Words of boilerplate score
nothing, so regions do not stretch to them.

What boilerplate is:

* by tag, role or being hidden; a header only outside a marked article;
* by a whole class of a container (not of a heading or an inline element): one that the labelled pages
  have outside the article, or, if they do not know it, one made of words for boilerplate and of
  neutral ones only (`sidebar-left`, `post-comments`, not `no-sidebar`, `share-price`, `search-story`);
  by the same words in an id, inside a marked article those for reader comments only;
* never an element that holds `main` or all marked articles of the page, and, unless it is a menu or a
  footer by its tag or role, none that holds most words of a page while no article is marked outside it
  (reader comments go as long as other words are left).

Character references are decoded; white space of a block becomes one space; blocks are joined in
page order by one space. Null html counts as empty; a page without words has an empty text. Of the
elements whose content browsers do not show as markup (scripts, styles, text areas, templates, frames)
nothing is kept; text in `math`, `svg`, `object` and `noscript` is text. Columns other than id, url and
html are not read. Without labelled pages the weights are the starting ones. Time is linear in a page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import map_batches
from scriptorium.llm._labelled import within_bytes

#: Pages that learning may look at, and their bytes: pages that would go beyond are passed over.
SAMPLE, SAMPLE_BYTES = 400, 64 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_RAW = {"script", "style", "textarea", "template", "iframe", "title", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags and roles of boilerplate; those of the first sets are never spared for the words they hold.
_FRAME, _FRAME_ROLES = {"head", "nav", "footer", "menu", "button", "select"}, {"navigation", "contentinfo", "menu", "menubar", "toolbar"}
_PART, _PART_ROLES = {"aside", "form", "dialog", "fieldset"}, {"banner", "complementary", "search", "form", "dialog", "alertdialog", "alert"}
_HOME = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of classes and ids: for reader comments, for other boilerplate, and neutral ones beside them.
_COMMENT_WORDS = set("comment comments commentlist disqus respond reply replies".split())
_BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices banner popup modal overlay sidebar sidebars menu submenu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget widgets pagination pager toolbar skip alert alerts disclaimer".split()
)
_NEUTRAL_WORDS = set("site page post posts entry article articles blog global main left right top bottom first second primary secondary box bar area list lists section container wrapper wrap block slot unit form links link buttons button icons icon inner outer group item items js col column panel strip row region zone header head thread mobile desktop sticky fixed floating toggle".split())
_WHOLE_NAMES = set("site-header page-header side-bar top-bar sign-up log-in".split())
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'>]+/$""")  # a value without quotes that ends in a slash
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS_SCOPE = {"td", "th", "li", "blockquote", "div", "section", "table", "object", *_HOME}

#: Weights to start from; learning moves them.
WORD, TAG = {"home": 4.0, "p": 2.0, "link": 0.1, "": 0.5}, {"": -1.5}
#: Of the words in elements of a class: from which part inside it is the article's, up to which it is boilerplate; pages that must have it.
INSIDE, OUTSIDE, CLASS_PAGES = 0.5, 0.05, 5
#: The part of a page's plain words from which marked articles are all that counts.
MARKED = 0.1


@dataclass
class Weights:
    word: dict[str, float] = field(default_factory=lambda: dict(WORD))
    tag: dict[str, float] = field(default_factory=lambda: dict(TAG))
    #: What labelled pages say of a class: True for boilerplate, False for the article.
    classes: dict[str, bool] = field(default_factory=dict)


#: Kinds of suspicion, by what may still clear an element of it.
_SURE, _MOSTLY, _COMMENTS, _NAMED = "sure", "mostly", "comments", "named"


def named(token: str) -> str | None:
    """What the words of a class or id say: _COMMENTS, _NAMED or nothing."""
    token = token.lower()
    if token in _WHOLE_NAMES:
        return _NAMED
    parts = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", token) if w and not w.isdigit()]
    if not all(w in _COMMENT_WORDS or w in _BOILER_WORDS or w in _NEUTRAL_WORDS for w in parts):
        return None
    return _COMMENTS if any(w in _COMMENT_WORDS for w in parts) else _NAMED if any(w in _BOILER_WORDS for w in parts) else None


@dataclass
class Element:
    tag: str
    parent: int
    first: int  # its place in the sequence
    end: int = -1
    suspect: str | None = None  # by tag, role or being hidden
    classes: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    marks: bool = False  # article, main or role=main
    main: bool = False


def _element(tag: str, attributes: str, parent: int, first: int) -> Element:
    out = Element(tag, parent, first, marks=tag in _HOME, main=tag == "main")
    if tag in _FRAME:
        out.suspect = _SURE
    elif tag in _PART:
        out.suspect = _MOSTLY
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "role":
            role = value.strip().lower()
            if role == "main":
                out.marks = out.main = True
            elif role in _FRAME_ROLES or role in _PART_ROLES:
                out.suspect = out.suspect or (_SURE if role in _FRAME_ROLES else _MOSTLY)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            out.suspect = out.suspect or _MOSTLY
        elif name == "class":
            out.classes = tuple(value.split())
        elif name == "id":
            out.ids = tuple(value.split())
    return out


@dataclass
class Page:
    """Tags (0, name, element, is block) and text runs (1, text, element, words, in a link, in a paragraph), in page order."""

    parts: list[tuple]
    elements: list[Element]  # parents first; the first stands for the page


def parse(page: str) -> Page:
    parts: list[tuple] = []
    elements = [Element("", -1, 0)]
    stack: list[tuple[int, str, int]] = [(0, "", -1)]  # element, tag, where in the stack the paragraph is that a block would close
    opened: Counter = Counter()
    place, size = 0, len(page)

    def pop() -> None:
        i, tag, _ = stack.pop()
        opened[tag] -= 1
        elements[i].end = len(parts)

    def text(run: str) -> None:
        if run:
            said = html.unescape(run)
            parts.append((1, said, stack[-1][0], len(said.split()), opened["a"] > 0, opened["p"] > 0))

    while place < size:
        m = _TOKEN.search(page, place)
        if m is None:
            text(page[place:])
            break
        text(page[place : m.start()])
        place = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened[tag] > 0:
                while stack[-1][1] != tag:
                    pop()
                own = stack[-1][0]
                pop()
            else:
                own = stack[-1][0]
            parts.append((0, "/" + tag, own, tag not in _INLINE))
            continue
        attributes = m[3] or m[6] or ""
        if tag in _CLOSES_P and stack[-1][2] >= 0:
            at = stack[-1][2]
            while len(stack) > at:
                pop()
        if tag == "li" and stack[-1][1] == "li":
            pop()
        alone = attributes.endswith("/") and not _OPEN_VALUE.search(attributes)
        if tag in _VOID or alone or tag in _RAW:
            parts.append((0, tag, stack[-1][0], tag not in _INLINE))
            if tag in _RAW and not alone:
                end = re.compile("</" + re.escape(tag), re.I | re.A).search(page, place)
                place = end.start() if end else size
            continue
        elements.append(_element(tag, attributes, stack[-1][0], len(parts)))
        paragraph = len(stack) if tag == "p" else -1 if tag in _ENDS_SCOPE else stack[-1][2]
        stack.append((len(elements) - 1, tag, paragraph))
        opened[tag] += 1
        parts.append((0, tag, len(elements) - 1, tag not in _INLINE))
    while stack:
        pop()
    return Page(parts, elements)


def judged(page: Page, classes: dict[str, bool]) -> tuple[list[bool], list[bool]]:
    """Of each element: whether it is or lies in boilerplate, and whether it is or lies in a marked article."""
    elements = page.elements
    words = [0]
    for t in page.parts:
        words.append(words[-1] + (t[3] if t[0] else 0))
    head = sum(words[e.end] - words[e.first] for e in elements if e.tag == "head")
    total = words[-1] - head
    # articles inside reader comments mark none
    among = [False] * len(elements)
    why: list[str | None] = [None] * len(elements)
    for i, e in enumerate(elements):
        why[i] = _suspicion(e, classes)
        among[i] = i > 0 and (among[e.parent] or why[i] == _COMMENTS and not e.main)
    marks = [i for i, e in enumerate(elements) if e.marks and (e.main or not among[i])]
    mains = [i for i in marks if elements[i].main]
    home, boiler = [False] * len(elements), [False] * len(elements)
    marked = set(marks)
    spans = [(elements[i].first, elements[i].end) for i in marks]
    # outermost articles, and sums of their words, so that what lies outside an element is two lookups
    outer: list[tuple[int, int]] = []
    for a, b in spans:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    article_words = [0] * (len(page.parts) + 1)
    at = 0
    for k in range(len(page.parts)):
        while at < len(outer) and outer[at][1] <= k:
            at += 1
        inside = at < len(outer) and outer[at][0] <= k
        article_words[k + 1] = article_words[k] + (words[k + 1] - words[k] if inside else 0)
    holds_main = [False] * len(elements)
    for i in mains:
        while i >= 0 and not holds_main[i]:
            holds_main[i] = True
            i = elements[i].parent
    first_mark = min((a for a, _ in spans), default=0)
    last_mark = max((b for _, b in spans), default=0)
    for i, e in enumerate(elements):
        if i == 0:
            continue
        up = e.parent
        home[i] = home[up] or i in marked
        boiler[i] = boiler[up]
        reason = why[i]
        if e.tag == "header" and not home[up]:
            reason = reason or _MOSTLY
        if boiler[i] or reason is None or e.tag in ("html", "body") or i in marked:
            continue
        if e.ids and reason != _COMMENTS and home[up] and _suspicion(Element(e.tag, 0, 0, suspect=e.suspect, classes=e.classes), classes) is None and e.tag != "header":
            continue  # an anchor of a part of the article
        if holds_main[i] or marks and e.first <= first_mark and last_mark <= e.end:
            continue
        mine = words[e.end] - words[e.first]
        marked_outside = article_words[-1] - (article_words[e.end] - article_words[e.first])
        if reason == _COMMENTS:
            if mine == total:
                continue
        elif reason != _SURE and 2 * mine > total and not marked_outside:
            continue
        boiler[i] = True
    return boiler, home


def _suspicion(e: Element, classes: dict[str, bool]) -> str | None:
    if e.suspect:
        return e.suspect
    if e.tag in _HEADINGS or e.tag in _INLINE and e.tag != "a":
        return None
    out = None
    for token in e.classes:
        known = classes.get(token)
        kind = named(token)
        if known is False:
            continue
        kind = kind or (_NAMED if known else None)
        out = kind if out is None or kind == _COMMENTS else out
    for token in e.ids:
        kind = named(token)
        out = kind if out is None or kind == _COMMENTS else out
    return out


def learn(pages: list[str]) -> Weights:
    """Weights of words by kind and of tags by name, and what classes are, from pages with a marked article."""
    parsed = [parse(page) for page in pages]
    # classes first: of the words in elements of a class, how many are the article's
    inside_class, words_class, pages_class = Counter(), Counter(), Counter()
    for page in parsed:
        boiler, home = judged(page, {})
        words, own = [0], [0]
        for t in page.parts:
            n = t[3] if t[0] else 0
            words.append(words[-1] + n)
            own.append(own[-1] + (n if n and home[t[2]] and not boiler[t[2]] else 0))
        seen = set()
        for e in page.elements:
            for token in set(e.classes):
                words_class[token] += words[e.end] - words[e.first]
                inside_class[token] += own[e.end] - own[e.first]
                seen.add(token)
        pages_class.update(seen)
    classes = {}
    for token, n in words_class.items():
        if n and pages_class[token] >= CLASS_PAGES:
            share = inside_class[token] / n
            if share >= INSIDE or share <= OUTSIDE:
                classes[token] = share <= OUTSIDE
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    for page in parsed:
        boiler, home = judged(page, classes)
        for t in page.parts:
            kept, at_home = not boiler[t[2]], home[t[2]]
            if t[0] == 0:
                (tags_in if at_home and t[1].removeprefix("/") not in _HOME else tags_out)[t[1]] += 1
            elif t[3]:
                kind = "link" if t[4] else "p" if t[5] else ""
                (inside if at_home and kept else outside)[kind] += t[3]
                if at_home and not t[4]:  # what a marked article is worth does not come from what its words stand in
                    (inside if kept else outside)["home"] += t[3]
    if not inside:
        return Weights(classes=classes)

    def odds(a: int, b: int, prior: float) -> float:
        return math.log((a + 1) / (b + 1)) + prior

    word = {k: min(5.0, max(0.05, odds(inside[k], outside[k], WORD.get(k, 0.5)) / 2)) for k in {*WORD, *inside, *outside}}
    tag = {k: -min(2.0, max(0.05, odds(tags_out[k], tags_in[k], 1.5))) for k in {*tags_in, *tags_out}}
    return Weights(word, tag | {"": TAG[""]}, classes)


def scored(page: Page, weights: Weights) -> tuple[list[float], list[bool]]:
    """The score of each part, and whether it is kept."""
    boiler, home = judged(page, weights.classes)
    word, tag = weights.word, weights.tag
    scores, kept = [], []
    plain = [t for t in page.parts if t[0] and not t[4] and not boiler[t[2]]]
    marked = sum(t[3] for t in plain if home[t[2]])
    decided = marked and marked >= MARKED * sum(t[3] for t in plain)
    for t in page.parts:
        e = t[2]
        kept.append(not boiler[e])
        if t[0] == 0:
            free = home[e] and t[1].removeprefix("/") not in _HOME or boiler[e] and boiler[page.elements[e].parent]
            scores.append(0.0 if free else tag.get(t[1], tag[""]))
        else:
            kind = "link" if t[4] else "home" if home[e] else "p" if t[5] else ""
            scores.append(0.0 if boiler[e] or decided and not home[e] else word.get(kind, word[""]) * t[3])
    return scores, kept


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The text of the best region."""
    seen = parse(page or "")
    scores, kept = scored(seen, weights or Weights())
    best, best_range = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    out = []
    for i in range(*best_range):
        t = seen.parts[i]
        if t[0] == 1:
            if kept[i]:
                out.append(t[1])
        elif t[3]:
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars for each row of df."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    # ids and lengths alone are ordered: whole pages of every task never meet in one place
    marked = pages.where(F.lower("html").rlike(r"""<(article|main)[\s>]|\srole\s*=\s*["']?main\b""") & F.col("page_id").isNotNull())
    order = marked.groupBy("page_id").agg(F.max(F.octet_length("html")).alias("size")).orderBy(F.xxhash64("page_id"), "page_id").limit(2 * sample).collect()  # at most 2 * sample numbers
    ids = within_bytes([(r.page_id, r.size) for r in order], sample, SAMPLE_BYTES)
    picked = df.sparkSession.createDataFrame([(i,) for i in ids], "page_id long")
    seen = pages.join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect() if ids else []  # at most `sample` pages and SAMPLE_BYTES
    weights = learn([r.html for r in seen])
    source = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(x, weights) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": pa.array(map(len, texts), pa.int64())}

    return map_batches(source, run, "page_id long, url string, text string, n_chars long")
