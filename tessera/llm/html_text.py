"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each source block, each with the length of its text outside of
links. Lengths are summed over a sliding window of lines; text surges where the sums rise to a share
of the page's own typical line and dives where they fall below it for good. Tags are a prior: what
the standard itself calls a menu, form or footer never counts, an article's ends are surge and dive
points, its lines surge at a lower level, and text outside of articles must outweigh them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by their role here.
RAW = "script style title noscript template iframe object svg canvas select textarea datalist audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("nav footer aside form button dialog menu".split())
MAIN = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = set("p blockquote pre dd dt li figcaption caption td th".split())  # what text is written in, beside plain divs
ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
# Start tags that end an open element of the same parent, as the standard implies.
ENDS_P = BLOCKS - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "option", "legend", "body", "html", "head"}
SIBLINGS = {  # inner ones first
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["td", "th", "tr"], "option": ["option"],
    "tbody": ["td", "th", "tr", "thead", "tbody"], "thead": ["td", "th", "tr", "tbody"], "tfoot": ["td", "th", "tr", "thead", "tbody"],
}
FENCES = set("ul ol menu dl table article section main aside nav div body td th blockquote form".split())  # implied ends stay within these
ROW_FENCES = FENCES - {"td", "th"}

# Class names of adverts, notices and reader comments, which count as whole names wherever they stand,
# and words that mark page furniture where no article says what the text is.
NEVER = set(
    "ad ads advert adverts advertisement advertising sponsored promo cookie-notice cookie-banner newsletter newsletter-signup comment comments comment-list comment-section "
    "comments-area disqus_thread respond sidebar related-posts related-articles share-buttons social-share share sharing".split()
)
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar header "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup popups modal overlay share sharing social related recommended widget widgets toolbar "
    "pagination pager copyright disclaimer skip".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*(?:>|\Z))",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
FIRST_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_END = tuple(".!?…。！？:;\"”»")


@dataclass
class Line:
    """One source block: its text, how much of it isn't in links, its element, and what the markup around it says."""

    text: str
    length: int
    tag: str
    article: int  # number of the outermost article or main element, or 0
    hinted: bool  # an element around it has a class or id that names furniture


def is_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is by its name, role or whole class name a menu, footer, sidebar, form, advert, notice or comments."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main", "article") or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and not NEVER.isdisjoint(value.lower().split()):
            return True
    return False


def is_hinted(tag: str, attributes: str) -> bool:
    """Whether a class or id begins with a word of FURNITURE; only a hint, which outside of articles counts unless all text has it."""
    if "=" not in attributes or tag in ("html", "body") or tag in MAIN:
        return False
    names = [n for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for n in "".join(values).split()]
    first = [m[0].lower() for n in names if (m := FIRST_WORD.search(n))]
    return not FURNITURE.isdisjoint(first) and "content" not in first


def lines_of(page: str) -> list[Line]:
    """The blocks of a page that have text and aren't dropped by their markup, in page order."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = articles = 0
    stack: list[tuple[str, bool, int, bool, bool]] = []  # name, dropped, article, hinted, in a link
    standing: Counter = Counter()  # how many elements of a name are open

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                block = next((x[0] for x in reversed(stack) if x[0] in BLOCKS), "")
                _, _, article, hinted, _ = stack[-1] if stack else ("", False, 0, False, False)
                lines.append(Line(text, max(0, len(text) - linked), block, article, hinted))
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][1]):
            parts.append(text)
            if stack and stack[-1][4]:
                linked += len(" ".join(entities.unescape(text).split()))

    def close(names: set[str] | frozenset[str], fences: set[str]) -> None:
        """End the innermost open element of one of these names, and all within it, unless a fence is in between."""
        if not any(standing[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                standing.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in fences:
                return

    at = 0
    for m in TOKEN.finditer(page):
        put(page[at : m.start()])
        at, tag = m.end(), (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS and not (stack and stack[-1][1]):
            flush()
        if m[2]:
            close({tag}, set())
            continue
        if tag in ENDS_P:
            close({"p"}, FENCES)
        if tag in SIBLINGS:
            for name in SIBLINGS[tag]:
                close({name}, ROW_FENCES)
        if tag not in VOID and not m[4].rstrip(">").endswith("/"):
            _, dropped, article, hinted, link = stack[-1] if stack else ("", False, 0, False, False)
            dropped = dropped or is_dropped(tag, m[4], bool(article))
            if tag in MAIN and not dropped and not article:
                articles += 1
                article = articles
            standing[tag] += 1
            stack.append((tag, dropped, article, not article and (hinted or is_hinted(tag, m[4])), link or tag == "a"))
    put(page[at:])
    flush()
    return lines


def window_sums(lengths: list[int], window: int) -> list[int]:
    """The sum of lengths over the window of lines around each line."""
    back = window // 2
    total, out = [0], []
    for n in lengths:
        total.append(total[-1] + n)
    for i in range(len(lengths)):
        lo = max(0, i - back)
        out.append(total[min(len(lengths), i - back + window)] - total[lo])
    return out


def typical_length(lengths: list[int]) -> float:
    """Length of the line that a page's characters lie in, on average: long lines count most, however many short ones there are."""
    return sum(n * n for n in lengths) / max(1, sum(lengths))


def runs_of(lines: list[Line], window: int, surge: float, least: float, prior: float) -> list[tuple[int, int]]:
    """Runs (first line, line after the last) between surge and dive points.

    A window sum of at least surge times the typical length is a surge, of prior times that within an
    article; text dives where sums stay below it for `window` lines, or where an article begins or ends. At its
    ends a run begins and closes with a line that is itself long enough, or that reads as text: a heading before it, a
    paragraph or a sentence next to it; and with one of an element that text is written in there, so that a
    lone line in a plain box isn't taken for a paragraph. Runs with less than `least` of the longest one's
    text are left out, outside of articles those with less than all articles together; an article's runs
    stay unless text outside of it is longer.
    """
    lengths = [x.length for x in lines]
    level = surge * typical_length(lengths)
    levels = [level * (prior if x.article else 1) for x in lines]
    sums = window_sums(lengths, window)
    spans: list[list[int]] = []
    for i in (i for i, s in enumerate(sums) if s >= levels[i] and s > 0):
        if spans and i - spans[-1][1] <= window and lines[i].article == lines[spans[-1][1]].article:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    reads = [x.length > 0 and (x.length >= levels[i] / window or x.tag in ("p", "blockquote", "pre") or x.text.endswith(SENTENCE_END)) for i, x in enumerate(lines)]
    out: list[tuple[int, int]] = []
    for a, z in spans:
        own = [i for i in range(a, z + 1) if reads[i]]
        if not own:
            continue
        a, z, inside = own[0], own[-1], lines[a].article
        beside = lambda i, inside=inside: 0 <= i < len(lines) and lines[i].article == inside and lines[i].length > 0
        while beside(a - 1) and (inside or reads[a - 1] and lines[a - 1].tag in PROSE or lines[a - 1].tag in HEADINGS):
            a -= 1
        while beside(z + 1) and (inside or reads[z + 1] and lines[z + 1].tag in PROSE):
            z += 1
        if not inside:
            a, z = _in_written_elements(lines, a, z)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z + 1, out[-1][1]))
        else:
            out.append((a, z + 1))
    size = lambda run: sum(lengths[run[0] : run[1]])
    articles = sum(size(x) for x in out if lines[x[0]].article)
    outside = max((size(x) for x in out if not lines[x[0]].article), default=0)
    longest = max(map(size, out), default=0)
    kept = lambda x: outside <= articles or size(x) >= least * longest if lines[x[0]].article else size(x) >= max(least * longest, articles)
    return [x for x in out if kept(x)]


def _in_written_elements(lines: list[Line], a: int, z: int, share: float = 0.5) -> tuple[int, int]:
    """A run without lines at its ends in plain boxes, unless these hold a share of the run's text; a heading may begin it."""
    held: Counter = Counter()
    for x in lines[a : z + 1]:
        held[x.tag] += x.length
    own = lambda i: lines[i].tag in PROSE or held[lines[i].tag] >= share * held.total()
    while a < z and not own(a) and not (lines[a].tag in HEADINGS and lines[a + 1].tag not in HEADINGS and own(a + 1)):
        a += 1
    while a < z and not own(z):
        z -= 1
    return a, z


def main_text(page: str | None, window: int = 3, surge: float = 0.5, least: float = 0.25, prior: float = 0.1) -> str:
    """The text of the runs that the distribution of a page's lines shows; hints in classes and ids count unless all text has them."""
    lines = lines_of(page or "")
    for own in ([x for x in lines if not x.hinted], lines):
        if found := runs_of(own, window, surge, least, prior):
            return " ".join(x.text for a, z in found for x in own[a:z])
    return ""


def extract_text(pages: DataFrame, window: int = 3, surge: float = 0.5, least: float = 0.25, prior: float = 0.1) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; other columns are ignored.

    Null or empty html, and pages of furniture only, give an empty text; a null page_id or url stays.
    Rows are independent, so repeats each get the same text. All runs that outweigh the others as runs_of
    says are kept, so ties need no rule.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, surge, least, prior) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
