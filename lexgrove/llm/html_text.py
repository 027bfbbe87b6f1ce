"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
#: Elements that hold other things than the article.
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "head", "object", "video", "audio", "canvas"}
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that need no end tag, and the starts that end them if they are asides.
_ENDED = {
    "p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "span": set(),
}
#: Elements that never hold others, or that need no end tag: they are tracked only as asides and within them.
_LOOSE = set("area b base big br caption cite code col dd dt em embed font hr i img input label li link mark meta option p q s small source span strong sub sup td th tr track tt u wbr".split())
_ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead"
    " menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related share sharing sidebar sidenav signup"
    " skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that may stand beside these in a whole name; with any other word ("has-sidebar", "ad-free", "entry-header") a name says nothing.
_ASIDE_PLACES = set(
    "area articles bar block bottom box column container content fixed form global group inner item items left links list main mobile outer page panel post posts"
    " primary right row secondary section site slot sticky top unit wrap wrapper".split()
)
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(?P<raw>" + "|".join(sorted(_RAW)) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*+>|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.I | re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s/>=]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_HREF = re.compile(r"(?:^|\s|[\"'])href\s*=", re.I)
#: Lines in a block, and the characters in a block from which text surges.
BLOCK_LINES, SURGE_CHARS = 3, 80
#: Characters in an article or main element count so many times.
MARKED_WEIGHT = 2


def _is_aside(name: str, rest: str, within: bool, by_name: bool = True) -> bool:
    if name in _ASIDE or name == "header" and not within:
        return True
    if rest and name not in ("html", "body", "article", "main") or "comment" in rest:
        for kind, value in _NAMES.findall(rest) if by_name else ():
            for one in value.strip("\"'").split():
                names = {x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if x}
                if kind.lower() == "role":
                    if names & _ASIDE_ROLES:
                        return True
                elif names & _ASIDE_NAMES and names <= _ASIDE_NAMES | _ASIDE_PLACES and not (within and names <= {"header"} | _ASIDE_PLACES):
                    return True
        return bool(_HIDDEN.search(rest))
    return False


def lines(page: str, by_name: bool = True) -> Iterator[tuple[str, int, int]]:
    """The page's blocks without markup: (text, characters that are no link's, number of the innermost article or main element or 0).

    What menus, forms and other asides hold is no text, those that only class, id or role tell if by_name; asides in a row leave one empty line, which alone is no dive.
    """
    at, text, linked, links, marked = 0, [], 0, 0, 0
    within = [0]
    open_: list[tuple[str, bool]] = []
    aside, gap = 0, False

    def flush():
        nonlocal text, linked, gap
        block = " ".join(html.unescape("".join(text)).split())
        out = (block, max(0, len(block) - linked), within[-1])
        text, linked, gap = [], 0, gap and not block
        return out

    for m in _TOKEN.finditer(page):
        if m.start() > at and not aside:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK and not aside and text:
            if "".join(text).strip():
                yield flush()
            else:
                text, linked = [], 0
        if name == "a":
            links = 0 if m["end"] or not _HREF.search(m["rest"]) else 1
        while not m["end"] and open_ and open_[-1][1] and name in _ENDED.get(open_[-1][0], ()):
            aside -= open_.pop()[1]
        if name == "a" or name in _LOOSE and not (name in _ENDED and (aside or not m["end"] and m["rest"] and _is_aside(name, m["rest"], within[-1] > 0, by_name))):
            continue
        if m["end"]:
            if any(n == name for n, _ in open_):
                while True:
                    n, was_aside = open_.pop()
                    aside -= was_aside
                    if n in ("article", "main"):
                        within.pop()
                    if was_aside and not aside:
                        links = 0
                        if not gap and n not in _ENDED:
                            yield "", 0, within[-1]
                        gap = gap or n not in _ENDED
                    if n == name:
                        break
        elif not m["rest"].endswith("/"):
            is_aside = _is_aside(name, m["rest"], within[-1] > 0, by_name)
            if is_aside and not aside and name != "span" and text and "".join(text).strip():
                yield flush()
            open_.append((name, is_aside))
            aside += is_aside
            if name in ("article", "main"):
                marked += 1
                within.append(marked)
    if at < len(page) and not aside:
        text.append(page[at:])
    if text:
        yield flush()


def stretches(lengths: list[int], width: int = BLOCK_LINES, surge: int = SURGE_CHARS) -> list[tuple[int, int]]:
    """First and last+1 lines between a surge of the sums over sliding blocks and the dive after it.

    Text surges where a block reaches `surge` characters, or where the largest does if none reaches that, and dives where a block has none.
    """
    n = len(lengths)
    sums = [sum(lengths[i : i + width]) for i in range(n)]
    if not any(sums):
        return []
    least, found, i = min(surge, max(sums)), [], 0
    while i < n:
        if sums[i] >= least and lengths[i]:
            end = i
            while end < n and sums[end]:
                end += 1
            while end > i and not lengths[end - 1]:
                end -= 1
            start = i
            while start and lengths[start - 1]:
                start -= 1
            found.append((start, end))
            i = end
        i += 1
    return found


def region(lengths: list[int], width: int = BLOCK_LINES, surge: int = SURGE_CHARS) -> tuple[int, int]:
    """Of the stretches the one with the most characters, the first of equal ones."""
    return max(stretches(lengths, width, surge), key=lambda x: (sum(lengths[x[0] : x[1]]), -x[0]), default=(0, 0))


def joined(found: list[tuple[int, int]], sizes: list[int]) -> list[tuple[int, int]]:
    """Stretches, those as one between which lie fewer characters than the smaller has, links' too; sizes: all characters of the lines."""
    out: list[tuple[int, int]] = []
    for start, end in found:
        while out and sum(sizes[out[-1][1] : start]) < min(sum(sizes[out[-1][0] : out[-1][1]]), sum(sizes[start:end])) and all(sizes[out[-1][1] : start]):
            start = out.pop()[0]
        out.append((start, end))
    return out


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block; empty if there is none.

    The page's stretches of text are cut where an article or main element begins or ends. The part with the most characters counts, those
    in such an element MARKED_WEIGHT times; of its element all lines are text, as nothing else in an article goes. Lines that are mostly
    links count as empty for surge and dive only; on a page of nothing else they count in full.
    """
    if not page:
        return ""
    found = list(lines(page))
    lengths = [own if 2 * own >= len(text) else 0 for text, own, _ in found]
    if not any(lengths):  # all text is in what the names call asides: they are wrong, however long it is
        whole = list(lines(page, by_name=False))
        sizes = [own if 2 * own >= len(text) else 0 for text, own, _ in whole]
        if any(sizes):
            found, lengths = whole, sizes
    if not any(lengths):
        lengths = [len(text) for text, _, _ in found]
    weight: dict[tuple[int, int], int] = {}
    parts: dict[tuple[int, int], tuple[int, int]] = {}
    for k, (first, last) in enumerate(joined(stretches(lengths), [len(text) for text, _, _ in found])):
        for i in range(first, last):
            element = found[i][2]
            # an element is one part, also where other elements or dives lie between its lines
            key = (element, 0) if element else (0, k)
            weight[key] = weight.get(key, 0) + lengths[i] * (MARKED_WEIGHT if element else 1)
            parts[key] = (min(i, parts.get(key, (i, 0))[0]), i + 1)
    if not weight:
        return ""
    key = max(weight, key=lambda k: (weight[k], -parts[k][0]))
    first, last = parts[key] if not key[0] else (0, len(found))
    return "\n".join(text for text, _, element in found[first:last] if text and element == key[0])


def main_text(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), a row for each row. Null and empty html: empty text, 0 characters."""

    @F.arrow_udf("string")
    def text(htmls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in htmls:
            yield pa.array([extract(h.as_py()) for h in batch], pa.string())

    out = pages.select(pages["page_id"], pages["url"], text(pages["html"]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
