"""Main text of pages by a site style tree.

The pages of a host are merged: an element of the tree is a path of block elements (tag, class, id), its *presentations*
are the sequences of child elements it has been seen with, and its *contents* are the texts it holds itself. Both are
scored by entropy over the pages, to the base of the number of pages: 0 if every page has the same, 1 if no two agree.
A path is unimportant when ``GAMMA * contents + (1 - GAMMA) * presentations of its parent`` is below the threshold; the
pages are then read again without those branches. A path seen on fewer than ``min_pages`` pages of its host is never
judged, and a text repeated within a varied path stays. Copies of a page count as one page of their host, and what is
inside an article element is never removed by entropy: near copies would make an article look like a frame.

Entropy cannot tell an advert that differs on every page from an article. Elements whose tag, or a whole word of whose
class, id or role, names them as menu, header, footer, sidebar, notice, advert, script, style or comments are therefore
cut beforehand; words never cut html, body, main, article or, outside an article, an element that contains main or
article, and header words cut nothing inside them. Forms, and elements named by the first or last part of a hyphenated
word of a short list (``comment-list``, ``ad-slot``), are cut unless they hold main, article or at least half of the page's
text: a page may be wrapped in one form. The text is that of the main element or of the article elements, the largest and
those at least half as large; where the rest of the page holds more than twice as much, articles are teasers and the
rest is taken.

Tags are read once from left to right. A quoted value in which ``>`` comes before ``<`` is one whose quote was never closed: its
tag ends at that ``>``.

Statistics are counts per (host, path, content): they are combined before the shuffle and keyed finely, so a host with
a third of all pages is no hot key. Low paths go back to the pages by host: broadcast when counted small, else joined.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.cascade import host_and_path
from lotwise.llm.common import broadcast_if_small, stage

GAMMA = 0.9
THRESHOLD = 0.2
MIN_PAGES = 8

# Elements by how they are treated
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var".split()
)
CUT = frozenset(
    "head nav footer aside select button svg math canvas audio video object applet map dialog menu datalist fieldset".split()
)
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice"
    " popup modal overlay comment comments disqus respond reply replies share sharing social related recommended newsletter"
    " subscribe signup login search pagination pager skip toolbar widget".split()
)
# Names that cut nothing inside an article or main element, and elements that no name cuts
HEADERS = frozenset("header masthead".split())
KEPT = frozenset("html body main article".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

OPENING = re.compile(r"<(?:(?P<note>!--)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)|(?P<other>[!?/]))")
# A name by its parts, and what may stand before a part without naming it
PARTS = frozenset("ad ads advert adverts advertisement comment comments sponsor sponsored".split())
JOINED = frozenset("side-bar sidebar-left sidebar-right cookie-notice cookie-banner".split())
WITHOUT = frozenset("has with no without".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


# Where a block is: an article element may be inside a main one, not only the other way round.
OUTSIDE, MAIN, ARTICLE = 0, 1, 2


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag in lower case, whether it closes, attributes) of markup in order; comments and the like have no tag.

    Raw elements such as script come as one piece of markup without a tag. Each character is looked at a bounded number of
    times: what a search has not found further on is not searched again.
    """
    size, at = len(page), 0
    last_close = page.rfind(">")
    spent = {'"': False, "'": False}  # no such quote further on
    quotes = True  # until a tag's quotes run past the end of the page
    raw_end = {t: 0 for t in RAW}  # below zero: no closing tag further on
    while m := OPENING.search(page, at):
        start, at = m.start(), m.end()
        if m["note"]:
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        if at > last_close + 1:
            return  # no tag can end any more: the rest is text
        first = page.find(">", at)
        if m["other"]:
            if first < 0:
                return
            at = first + 1
            yield start, at, None, False, ""
            continue
        end, place = -1, at
        while quotes and 0 <= first:
            found = [(page.find(q, place, first), q) for q in "\"'" if not spent[q]]
            found = [f for f in found if f[0] >= 0]
            if not found:
                end = first
                break
            opened, q = min(found)
            closed = page.find(q, opened + 1)
            if closed < 0:
                spent[q], place = True, opened + 1
                continue
            if closed < first:
                place = closed + 1
                continue
            less = page.find("<", opened + 1, closed)
            if less < 0 or less < first:  # ``>`` alone, or markup within the value
                place, first = closed + 1, page.find(">", closed + 1)
                continue
            end = first
            break
        if end < 0:
            quotes, end = False, page.find(">", at)
        tag, attrs = m["tag"].lower(), page[at:end]
        at = end + 1
        if tag in raw_end and not m["end"]:
            stop = None if raw_end[tag] < 0 else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if stop is None:
                raw_end[tag] = -1
            at = size if stop is None else stop.end()
            yield start, at, None, False, ""
            continue
        yield start, at, tag, bool(m["end"]), attrs


def weakly_named(names: set[str]) -> bool:
    """Whether a hyphenated word names an advert, comments or a sidebar by its first or last part."""
    for name in names:
        parts = re.split("[-_]+", name)
        if name in JOINED or len(parts) > 1 and parts[0] not in WITHOUT and (parts[0] in PARTS or parts[-1] in PARTS):
            return True
    return False


def read_page(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str]]]:
    """Blocks (path, text, where) in page order, and (path, children) of every block element; what is cut is left out.

    ``where`` is OUTSIDE for blocks that are not of the main text's elements, and for all when no element is.
    """
    blocks: list[tuple[str, str, int, int, int]] = []  # path, text, inside, heart, doubtful region
    shapes: list[tuple[str, str]] = []
    # tag, path, cut, inside, children, sizes, heart, doubtful region
    stack: list[list] = [["", "", False, OUTSIDE, [], None, 0, 0]]
    named: list[list] = []  # open elements to be cut by their name unless main or article comes within
    text: list[str] = []
    hearts: list[str] = [""]
    doubtful: list[bool] = [False]  # regions to cut unless they hold main, article or half of the text
    opened: Counter = Counter()

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole and not stack[-1][2]:
                blocks.append((stack[-1][1], whole, stack[-1][3], stack[-1][6], stack[-1][7]))

    def pop() -> None:
        flush()
        tag, path, cut, _, children, sizes, _, _ = stack.pop()
        opened[tag] -= 1
        if sizes is not None:  # cut by name: what came since it was opened
            named.pop()
            del blocks[sizes[0] :], shapes[sizes[1] :]
        elif not cut:
            shapes.append((path, " ".join(children)))

    at = 0
    for start, after, tag, closes, attrs in tokens(page):
        if start > at:
            text.append(entities.unescape(page[at:start]))
        at = after
        if tag is None or tag in INLINE:
            continue
        if tag in VOID:
            text.append(" ")
            if tag == "hr":
                flush()
            continue
        if closes:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            else:
                flush()
            continue
        flush()
        if tag in CLOSES_P and stack[-1][0] == "p" or stack[-1][0] in SAME.get(tag, ()):
            pop()
        _, path, cut, inside, children, _, heart_of, region = stack[-1]
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
        names = {x for v in found.values() for x in v.lower().split()}
        sign = tag + "".join(f".{found[k]}" for k in ("class", "id") if k in found)
        children.append(sign)
        heart = tag in ("article", "main") or "main" in found.get("role", "").lower().split()
        own = tag in CUT or tag == "header" and not inside
        called = tag not in KEPT and not heart and bool(names & (NAMED - HEADERS if inside else NAMED))
        weak = tag == "form" or tag not in KEPT and not heart and not called and weakly_named(names)
        if called and inside == ARTICLE:
            own = True
        if heart and not cut and not own:
            for element in named:
                element[5] = None
            named.clear()
            for element in stack:
                doubtful[element[7]] = False
            if not heart_of:
                hearts.append(tag if tag == "article" else "main")
                heart_of = len(hearts) - 1
        if weak and not cut and not own and not doubtful[region]:
            doubtful.append(True)
            region = len(doubtful) - 1
        inside = max(inside, ARTICLE if tag == "article" else MAIN if heart else OUTSIDE)
        stack.append([tag, f"{path}>{sign}", cut or own, inside, [], None, heart_of, region])
        opened[tag] += 1
        if called and not cut and not own:
            stack[-1][5] = (len(blocks), len(shapes))
            named.append(stack[-1])
    if at < len(page):
        text.append(entities.unescape(page[at:]))
    while len(stack) > 1:
        pop()
    flush()
    return _main_text(blocks, hearts, doubtful), shapes


def _main_text(blocks: list[tuple[str, str, int, int, int]], hearts: list[str], doubtful: list[bool]) -> list[tuple[str, str, int]]:
    sizes = [0] * len(doubtful)
    for b in blocks:
        sizes[b[4]] += len(b[1])
    total = sum(sizes)
    kept = [b for b in blocks if not doubtful[b[4]] or 2 * sizes[b[4]] >= total]
    inner = [0] * len(hearts)
    for b in kept:
        inner[b[3]] += len(b[1])
    largest = max(inner[1:], default=0)
    if not largest or inner[0] > 2 * sum(inner[1:]):
        return [(p, t, OUTSIDE) for p, t, _, h, _ in kept if not h]
    mains = {i for i in range(1, len(hearts)) if hearts[i] == "main" and 2 * inner[i] >= largest}
    chosen = mains or {i for i in range(1, len(hearts)) if 2 * inner[i] >= largest}
    return [(p, t, where if h in chosen else OUTSIDE) for p, t, where, h, _ in kept]


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path, kind, value, n, pages): how often a value was seen; a row with a null value counts pages of the path."""
    for batch in batches:
        seen: Counter = Counter()
        for host, page in zip(batch["host"], batch["html"]):
            blocks, shapes = read_page(page)
            seen.update({(host, p, "content", hash_text(t)) for p, t, _ in blocks})
            seen.update({(host, p, "shape", hash_text(c)) for p, c in shapes})
            seen.update({(host, p, "page", 0) for p, _ in shapes} | {(host, p, "page", 0) for p, _, _ in blocks})
        rows = [(*k, n) for k, n in seen.items()]
        yield pd.DataFrame(rows, columns=["host", "path", "kind", "value", "n"])


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, pages, content, shape): the merged tree with both normalised entropies; paths on few pages have null ones.

    Equal pages of a host count once.
    """
    seen = pages.select("host", "html").distinct().mapInPandas(_observe, "host string, path string, kind string, value long, n long")
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    # sum(n ln n) and sum(n) give the entropy without a second pass over the values.
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlog"))

    def entropy(kind: str):
        n = F.max(F.when(F.col("kind") == kind, F.col("n")))
        nlog = F.max(F.when(F.col("kind") == kind, F.col("nlog")))
        return F.when(n > 1, (F.log(n) - nlog / n) / F.log(n))

    rows = sums.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "page", F.col("n"))).alias("pages"), entropy("content").alias("content"), entropy("shape").alias("shape")
    )
    enough = F.col("pages") >= min_pages
    return rows.select("host", "path", "pages", F.when(enough, F.col("content")).alias("content"), F.when(enough, F.col("shape")).alias("shape"))


def low_paths(tree: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """(host, low): the paths of a host whose importance is below the threshold."""
    up = tree.select("host", F.col("path").alias("_up"), F.col("shape").alias("around"))
    leaves = tree.where("content IS NOT NULL").withColumn("_up", F.regexp_replace("path", ">[^>]*$", ""))
    scored = leaves.join(up, ["host", "_up"], "left")
    score = gamma * F.col("content") + (1 - gamma) * F.coalesce("around", F.lit(0.0))
    return scored.where(score < threshold).groupBy("host").agg(F.collect_list("path").alias("low"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for page, low in zip(batch["html"], batch["low"]):
            low = frozenset(low) if low is not None else frozenset()
            blocks, _ = read_page(page)
            inner = [b for b in blocks if b[2]]
            texts.append(" ".join(t for p, t, where in inner or blocks if where == ARTICLE or p not in low))
        yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])


def extract(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html; other columns are ignored).

    A null html is empty and has the text ''; a null URL belongs to the host ''. Repeated rows are read each, but
    pages of a host with one html count once. Hosts with few pages keep all that their element names don't rule out. An empty table gives no rows.
    """
    host = host_and_path(F.col("url"))[0]
    page = F.coalesce("html", F.lit(""))
    tree = stage(style_tree(pages.select(host.alias("host"), page.alias("html")), min_pages))
    low = stage(low_paths(tree, threshold))
    low = broadcast_if_small(low.withColumnRenamed("host", "_host"), 100_000)
    rows = pages.select("page_id", "url", host.alias("host"), page.alias("html")).join(low, F.col("host") == F.col("_host"), "left")
    return rows.select("page_id", "url", "html", "low").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
