"""HTML extraction by the maximum-scoring subsequence.

A page is read as a run of tokens: tags and words.  Words score positive and tags negative; the weights are log odds
of standing inside the article of labelled pages (those with exactly one article element, or none and exactly one main
element; a bounded sample of ``most_pages``, the label being that element).  One linear scan finds the contiguous run
with the largest sum, the main text.  Where a page itself is labelled, what is known outside scores nothing, and the
run holds all of the element.

Zones give no text and score 0, wherever they stand, and nothing is learned in them: menus, site headers, footers,
sidebars, notices, adverts, forms, reader comments, hidden elements.  An element is one by its name, or by the words of
its role, class and id: some decide alone, others only where nothing but words of layout stands beside them
("share-buttons", not "share-price-analysis").  An element that holds the labelled article is none, nor is one that
holds more than half of the page's words, unless it is a menu, footer, sidebar or comments.  Scripts, styles and other
raw elements are single tags.

Elements end as in HTML: a paragraph where a block begins, an item where the next one does, anything where its parent
ends.  A zone that nothing ends holds what stands before the next paragraph, heading, section or article.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one space in page order; inline elements join without a space.

Defined results: null, empty and wordless pages give the empty string and n_chars 0; equal pages (and repeated rows)
give equal texts; pages are read whole, in time in proportion to their length however broken they are: a quote that
is never closed is no quote from there on, and a tag that is never closed ends the page; without labelled pages fixed
weights hold; null page_id and url pass through; an empty table gives an empty one; extra columns are not looked at.
"""
from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

MOST_PAGES = 2_000
#: Elements whose content is no text of the page; the first four are read as raw text by browsers, too.
RAW = frozenset("script style textarea title noscript template svg iframe object select button canvas math audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks; each ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What a tag ends, up to an element that holds such items.
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KNOWN = INLINE | VOID | BLOCKS | RAW | frozenset("html head body li dt dd tr td th thead tbody tfoot caption colgroup summary optgroup option legend progress meter output picture map ruby rt rp data frame frameset noframes search slot".split())
ZONES = frozenset("nav footer aside form dialog menu head fieldset header search".split())
STOPS = frozenset("p h1 h2 h3 h4 h5 h6 section article main".split())
NAMES = re.compile(r"""(?<![^\s"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
HIDDEN = re.compile(r"""(?<![^\s"'])(?:hidden(?=[\s/=]|$)|aria-hidden\s*+=\s*+["']?true|style\s*+=\s*+["'][^"']*?display\s*+:\s*+none)""", re.I)
#: Words of names that make a zone alone.
ALONE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr sidebar comments commentlist disqus nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer masthead newsletter subscribe subscription signup login popup modal pagination toolbar copyright complementary contentinfo".split())
#: Words that make one where nothing but these, those above and words of layout stand in the name.
WITH_LAYOUT = frozenset("notice notices alert alerts banner widget widgets comment reply replies respond share sharing social related recommended header search feedback overlay pager skip".split())
LAYOUT = frozenset(
    "a an and the of in on to by for js wp td btn fb box bar block area wrap wrapper container content inner outer section list item items link links button buttons icon icons post posts page site main "
    "article articles story stories news more read reader readers user form field input top bottom left right center first last fixed sticky small large big mini full wide row col column grid card panel "
    "group region slot text title body info global primary secondary mobile desktop module component view media print email legal policy bar message".split())
DENIES = frozenset("has with without no not".split())
#: Zones that may hold more than half of a page.
LARGE = frozenset("nav navbar navigation menu menubar footer contentinfo sidebar aside complementary comments commentlist disqus head".split())
NAME_SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: After "<" or "</": a tag's name; then its attributes, in which a value in quotes may hold ">".
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"""((?:[^>=]++|=(?!\s*+["'])|=\s*+(?:"[^"]*+"|'[^']*+'))*+)>""")
FIXED = {"": 1.0}


class Token(NamedTuple):
    name: str  #: of a tag, "/p" for one that closes; empty for text
    text: str  #: of a tag: its attributes
    raw: bool = False


def tokens(page: str) -> list[Token]:
    """Tags and the text between them; a raw element is one tag, comments and declarations are nothing."""
    out: list[Token] = []
    at, quotes, unclosed = 0, True, set()
    end = len(page)
    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            tag = end
        if tag > at:
            out.append(Token("", page[at:tag]))
        if tag == end:
            break
        m = TAG.match(page, tag + 1)
        if m is None:
            if page.startswith("<!--", tag):
                stop = page.find("-->", tag + 2)
                at = stop + 3 if stop >= 0 else end
            elif page[tag + 1: tag + 2] in ("!", "?", "/"):
                stop = page.find(">", tag)
                at = stop + 1 if stop >= 0 else end
            else:  # a mere "less than"
                out.append(Token("", "<"))
                at = tag + 1
            continue
        rest = ATTRIBUTES.match(page, m.end()) if quotes else None
        if rest is None:
            quotes = False
            stop = page.find(">", m.end())
            if stop < 0:
                break
            attributes, at = page[m.end(): stop], stop + 1
        else:
            attributes, at = rest[1], rest.end()
        name = m[2].lower()
        if m[1]:
            out.append(Token("/" + name, ""))
        elif name not in RAW or attributes.endswith("/"):
            out.append(Token(name, attributes, name in RAW))
        else:
            close = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(name)
                if name in ("script", "style", "textarea", "title"):
                    at = end
            out.append(Token(name, attributes, True))
    return out


def _extents(run: list[Token]) -> list[int]:
    """For each tag that opens, the token that ends its element; len(run) where nothing does."""
    ends = [len(run)] * len(run)
    stack: list[int] = []
    count: Counter = Counter()

    def pop(at: int) -> str:
        opened = stack.pop()
        ends[opened] = at
        count[run[opened].name] -= 1
        return run[opened].name

    for i, (name, text, raw) in enumerate(run):
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if count[name]:
                while pop(i) != name:
                    pass
            continue
        if name in BLOCKS:
            while stack and run[stack[-1]].name == "p":
                pop(i)
        elif name in ITEMS:
            ended, holders = ITEMS[name]
            if any(count[x] for x in ended):
                # an item is open; it ends unless a list, table or the like was opened inside it
                depth = len(stack)
                while depth and run[stack[depth - 1]].name not in holders and run[stack[depth - 1]].name not in ended and len(stack) - depth < 64:
                    depth -= 1
                while depth and run[stack[depth - 1]].name in ended:
                    depth -= 1
                    while len(stack) > depth:
                        pop(i)
        if raw or name in VOID or text.endswith("/") and name not in KNOWN:
            ends[i] = i
        else:
            stack.append(i)
            count[name] += 1
    return ends


def _named_zone(attributes: str) -> set[str] | None:
    """The words that make a zone of an element with these attributes."""
    for _, *value in NAMES.findall(attributes):
        for part in "".join(value).split():
            words = set(NAME_SPLIT.split(CAMEL.sub("-", part).lower())) - {""}
            if words & DENIES:
                continue
            if found := words & ALONE:
                return found
        words = set(NAME_SPLIT.split(CAMEL.sub("-", "".join(value)).lower())) - {""}
        if (found := words & WITH_LAYOUT) and not words & DENIES and words <= WITH_LAYOUT | ALONE | LAYOUT:
            return found
    return {"hidden"} if attributes and HIDDEN.search(attributes) else None


def read(page: str) -> tuple[list[Token], list[bool], tuple[int, int] | None]:
    """Tokens, whether each stands in a zone, and the extent of the element that labels the page (None if none does)."""
    run = tokens(page)
    ends = _extents(run)
    label = None
    for name in ("article", "main"):
        opened = [i for i, t in enumerate(run) if t.name == name]
        if len(opened) == 1:
            label = opened[0], ends[opened[0]]
        if opened and (name == "article" or label):
            break
    words, total = [0], 0
    for t in run:
        total += 0 if t.name else len(t.text.split())
        words.append(total)
    stops = [len(run)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        stops[i] = i if run[i].name in STOPS else stops[i + 1]
    inner = [(i, ends[i]) for i, t in enumerate(run) if t.name in ("article", "main")]
    zone, until, core, open_core = [False] * len(run), -1, 0, -1
    for i, (name, attributes, raw) in enumerate(run):
        while core < len(inner) and inner[core][0] <= i:
            open_core = max(open_core, inner[core][1])
            core += 1
        if name and name[0] != "/" and not raw and name not in VOID and i >= until and name not in ("html", "body", "article", "main"):
            found = {name} if name in ZONES and not (name == "header" and i < open_core) else _named_zone(attributes) if attributes else None
            if found:
                end = ends[i] if ends[i] < len(run) else stops[i + 1]
                holds_label = label is not None and i < label[0] and label[0] < end
                large = 2 * (words[min(end, len(run))] - words[i]) > total and not found & LARGE
                if not holds_label and not large:
                    until = end + (end < len(run) and run[end].name == f"/{name}")
        zone[i] = i < until
    return run, zone, label


def _words(text: str) -> int:
    return len(text.split())


def _kind(name: str) -> str:
    """A tag's name for the weights; all names that HTML does not know are one."""
    return name if name.lstrip("/") in KNOWN else "?"


def observe(page: str | None) -> Counter | None:
    """Counts of (tag or "" for words, inside the article) outside zones of a labelled page; None if it is no label."""
    run, zone, label = read(page or "")
    if label is None:
        return None
    found: Counter = Counter()
    for i, (token, skip) in enumerate(zip(run, zone)):
        if not skip:
            inside = label[0] < i < label[1]
            found[_kind(token.name) if token.name else "", inside] += 1 if token.name else _words(token.text)
    return found


def weigh(counts: Counter) -> dict[str, float]:
    """Weights from the counts: words between 0.5 and 2, tags between -3 and -0.2; -1 for a tag that was never seen."""
    out = dict(FIXED)
    for name in {n for n, _ in counts}:
        odds = math.log((counts[name, True] + 1) / (counts[name, False] + (math.e if name else 1)))
        out[name] = min(2.0, max(0.5, odds)) if not name else max(-3.0, min(-0.2, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; the first of equals; (0, 0) if none is positive."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def extract(page: str | None, weights: dict[str, float]) -> str:
    run, zone, label = read(page or "")
    word, other = weights[""], -1.0
    scores = [0.0 if skip else weights.get(_kind(t.name), other) if t.name else word * _words(t.text) for t, skip in zip(run, zone)]
    if label is not None and any(not t.name and not skip and t.text.strip() for t, skip in zip(run[label[0]: label[1]], zone[label[0]: label[1]])):
        # known: nothing outside is gained, and nothing inside is lost
        scores = [s if label[0] <= i <= label[1] else min(s, 0.0) for i, s in enumerate(scores)]
        begin, end = best_run(scores)
        begin, end = min(begin, label[0]), max(end, label[1])
    else:
        begin, end = best_run(scores)
    parts = []
    for token, skip in zip(run[begin:end], zone[begin:end]):
        if token.name:
            if token.name.lstrip("/") not in INLINE:
                parts.append(" ")
        elif not skip:
            parts.append(html.unescape(token.text) if "&" in token.text else token.text)
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, most_pages: int = MOST_PAGES) -> dict[str, float]:
    """Weights from a bounded sample of labelled pages, taken in the order of a hash of page_id; the counts alone meet,
    two for each name that HTML has, both opened and closed."""
    ids = pages.filter("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most_pages)
    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi")  # most_pages ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                total.update(observe(page) or {})
        if total:
            names, inside, counts = zip(*[(n, i, c) for (n, i), c in total.items()])
            yield pa.record_batch({"name": pa.array(names), "inside": pa.array(inside), "n": pa.array(counts, pa.int64())})

    rows = sample.select("html").mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    counts: Counter = Counter({(r.name, r.inside): r.n for r in rows.collect()})
    return weigh(counts)


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages))


QUERIES = {"op2_html": op2_html}
ORACLE: dict[str, str] = {}
