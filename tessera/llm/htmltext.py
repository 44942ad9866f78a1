"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by link density, by length and by the
density of stop words; short and unclear blocks stay open. In the second pass an open block inherits the label of its
nearest decided neighbours. Where a block stands is a hint: an element for menus, headers, footers, sidebars, notices,
adverts, forms or comments makes its blocks boilerplate, and inside an article open blocks ask its own blocks alone.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of several languages, in lower case.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    just like more most my no not of on one only or other our out over she so some such than that the their them then there these they this those to up
    was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für haben hat ich ihr im ist ja kann man mehr
    mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ont ou où par pas plus pour qu que qui
    sa sans se ses son sont sur un une vous
    al como con cuando del desde donde el ella ellos era es esta este fue ha hay las lo los más me mi muy ni nos o para pero por porque ser si sin sobre
    son su sus también te tiene todo un una unos y ya
    che di e gli i il in non per più questo si sono da do dos em não o os uma een het van niet op te zijn""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul""".split()
)
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title xmp noembed noframes".split())
#: Those that take all that follows, up to the end of the page, if they aren't closed.
SWALLOWS = frozenset("script style iframe textarea title xmp noembed noframes".split())
NEVER = frozenset("nav footer aside menu dialog button select datalist search".split())
HELD = BLOCK_TAGS - frozenset("p hr li dt dd h1 h2 h3 h4 h5 h6 option optgroup legend".split()) | frozenset(["a", "span", "button", "select", "datalist"])
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_KIND = (
    "nav|navbar|navigation|navi|menu|menubar|breadcrumb|breadcrumbs|header|masthead|topbar|footer|foot|colophon|copyright|sidebar|side|rail|widget|widgets"
    "|ad|ads|adv|advert|adverts|advertisement|advertising|adbox|sponsor|sponsored|promo|promotion|promoted|banner|cookie|cookies|cookiebar|consent|gdpr"
    "|notice|notices|notification|notifications|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|searchbox"
    "|comment|comments|commentlist|respond|responses|reply|replies|disqus|share|sharing|social|related|recommended|recommendations|pagination|pager|toolbar|skip|form"
)
#: The last word of a name says what it is, but for words that say only that it is a box: cookie-notice and comment-list
#: are hints, sidebar-layout and promotion-history aren't.
_BOXES = "list|box|bar|area|section|wrapper|wrap|container|inner|outer|block|item|items|panel|links|link|body|text|title|top|bottom|left|right|unit|slot|holder|content|main"
_BOILER = re.compile(rf"(?:[a-z0-9]+[-_]+)*?(?:{_KIND})\d*(?:[-_]+(?:{_BOXES}|\d+x?\d*))*", re.I)
_NOT = re.compile(r"(?:has|with|without|no|not|is)[-_]", re.I)
_READERS = re.compile(r"comment|respon|repl|disqus", re.I)
_FORM = re.compile(r"(?:(?:main|page|site|aspnet)[-_]?)?form\d*", re.I)
_TITLE = re.compile(r"(?:[\w-]+[-_])?header(?:[-_][\w-]*)?", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_PLAIN = re.compile(r"[^>]*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _boilerplate(tag: str, attributes: str) -> tuple[str, str]:
    """What an element says of its blocks, and what says it: '' for nothing; 'all' for boilerplate; 'titles' where
    headings aren't, if they are within an article. It is said by the 'tag' (or a role), or by a 'name' in class or id."""
    if tag in NEVER:
        return "all", "tag"
    kind = "titles" if tag == "header" else ""
    if not attributes.strip():
        return kind, "tag"
    values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
        return "all", "tag"
    if values.get("role", "").lower() in (ROLES - {"form"} if tag == "form" else ROLES):
        return "all", "tag"
    if tag in ("html", "body", "main"):
        return kind, "tag"
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        if len(name) > 80 or tag == "article" and not re.match(r"comment|repl|respon", name, re.I):
            continue
        if tag == "form" and _FORM.fullmatch(name):
            continue
        if _TITLE.fullmatch(name):
            kind = "titles"
        elif _BOILER.fullmatch(name) and not _NOT.match(name):
            return "all", "tag" if _READERS.search(name) else "name"
    return kind, "tag"


def pieces(html: str):
    """(text before a tag, closing slash, tag, attributes, place after it), tag by tag; comments and declarations are
    tags ''. Scans on and never back: where no > follows, the rest is text, with tag None. Send a place to go on there."""
    at, n, begin = 0, len(html), 0
    while at < n:
        begin = html.find("<", begin)
        if begin < 0:
            yield html[at:], "", None, "", n
            return
        name = None
        if html.startswith(("<!--", "<![CDATA["), begin):
            close = "-->" if html[begin + 2] == "-" else "]]>"
            end = html.find(close, begin + 4)
            end = n if end < 0 else end + 3
        elif html[begin + 1 : begin + 2] in ("!", "?") or (name := _NAME.match(html, begin + 1)):
            m = (name and _REST.match(html, name.end())) or _PLAIN.match(html, begin)
            if not m:
                yield html[at:], "", None, "", n
                return
            end = m.end()
        else:
            begin += 1
            continue
        if name:
            jump = yield html[at:begin], name[1], name[2].lower(), html[name.end() : end - 1], end
        else:
            jump = yield html[at:begin], "", "", "", end
        if jump is not None:
            yield  # the answer to send()
        at = begin = end if jump is None else jump


class _Block:
    __slots__ = ("heading", "linked", "text", "where")

    def __init__(self, text: str, linked: int, where: str, heading: bool):
        self.text, self.linked, self.where, self.heading = text, linked, where, heading

    def prose(self) -> bool:
        return len(self.text) >= 200 and self.linked < 0.1 * len(self.text)


def page_blocks(html: str) -> list[_Block]:
    """The blocks of a page in order: text, characters in links, and where it stands ('in', 'out' or ''). What stands in a
    form is 'out', unless the form holds an article, a main or a long block of few links. What stands under a name of
    boilerplate is 'out', unless that element holds an article, a main or all such blocks of the page."""
    out: list[_Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, str, bool, int, int]] = []  # tag, boilerplate kind in force, within an article, numbers of the form and of the named element
    opened: Counter = Counter()
    holds: list[bool] = []  # by form, whether it holds main text
    named: list[bool] = []  # by element that is boilerplate by its name, whether it holds main text
    origin: list[tuple[int, int]] = []  # by block: form, named element
    absent: set[str] = set()  # elements of RAW that aren't closed any more
    heading, links, breaks = "", 0, 0

    def end_block():
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = len(" ".join("".join(p for p, a in parts if a).split()))
                _, kind, inside, form, name = stack[-1] if stack else ("", "", False, -1, -1)
                bad = kind == "all" or kind == "titles" and not (inside and heading)
                out.append(_Block(text, linked, "out" if bad else "in" if inside else "", bool(heading)))
                origin.append((form, name))
                if form >= 0 and not bad and out[-1].prose():
                    holds[form] = True
            parts = []

    scan = pieces(html)
    for text, closing, tag, attributes, at in scan:
        if text:
            parts.append((unescape(text), links > 0))
            if not text.isspace():
                breaks = 0
        if not tag:
            continue
        if closing:
            if tag in BLOCK_TAGS:
                end_block()
                if heading and tag == heading:
                    heading = ""
            if tag == "a":
                links = max(0, links - 1)
            if opened[tag] and (tag not in ("a", "span") or stack[-1][0] == tag):
                if stack[-1][0] in ("a", "span") and tag not in ("a", "span"):
                    links = 0
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == tag:
                        break
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math", "canvas"):
                continue
            close = None if tag in absent else re.compile(rf"</{tag}", re.I | re.A).search(html, at)
            if close is None:
                absent.add(tag)
                if tag in SWALLOWS:
                    break
                continue
            scan.send(html.find(">", close.end()) + 1 or len(html))
            continue
        if tag == "br":
            breaks += 1
            parts.append((" ", links > 0))
            if breaks > 1:
                end_block()
            continue
        if tag in ("td", "th", "img", "input"):
            parts.append((" ", links > 0))
            continue
        if tag in BLOCK_TAGS:
            end_block()
            heading = tag if re.fullmatch("h[1-6]", tag) else heading if tag not in ("p", "div", "ul", "section", "article") else ""
        if tag == "a":
            links += 1
        if tag in HELD and not attributes.endswith("/"):
            if tag in ("button", "select", "datalist"):
                end_block()
            _, kind, inside, form, name = stack[-1] if stack else ("", "", False, -1, -1)
            own, by = _boilerplate(tag, attributes) if tag not in ("html", "head") else ("", "")
            if own == "all" and by == "name":
                own = ""
                if name < 0:
                    name = len(named)
                    named.append(inside and tag == "a")
            if tag in ("article", "main") and own != "all":
                inside = True
                if kind != "all":
                    holds[form:] = [True] * len(holds[form:]) if form >= 0 else holds[form:]
                    if name >= 0:
                        named[name] = True
            if tag == "form" and form < 0:
                form = len(holds)
                holds.append(False)
            stack.append((tag, "all" if "all" in (kind, own) else own or kind, inside, form, name))
            opened[tag] += 1
    end_block()
    prose = Counter(name for b, (_, name) in zip(out, origin) if b.where != "out" and b.prose())
    for b, (form, name) in zip(out, origin):
        if form >= 0 and not holds[form] or name >= 0 and not named[name] and (b.where == "in" or not prose[name] or prose[name] < prose.total()):
            b.where = "out"
    return out


def decided(found: list[_Block], long: int = 200, short: int = 70, most_links: float = 0.33, least_stops: float = 0.25) -> list[tuple[bool, str]]:
    """For each block whether it is main text, and the rule that says so: 'links', 'stops' and 'length' of the first pass,
    'place', or 'neighbours' of the second."""
    labels: list[tuple[bool, str] | None] = []
    for b in found:
        links = b.linked / len(b.text)
        if b.where == "out":
            labels.append((False, "place"))
        elif links > most_links and (b.where != "in" or links > 0.66 and len(b.text) < short):
            labels.append((False, "links"))
        elif len(b.text) < short or b.heading or links > most_links:
            labels.append(None)
        else:
            words = _WORD.findall(b.text.lower())
            stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            labels.append((True, "stops") if stops >= least_stops else (True, "length") if len(b.text) >= long and links < 0.1 else None)

    def nearest(order, inside: bool) -> list:
        """For each block the last decided one before it in this order, among those of an article or among all."""
        last, out = None, [None] * len(found)
        for i in order:
            out[i] = last
            if labels[i] is not None and (not inside or found[i].where == "in"):
                last = (i, labels[i][0])
        return out

    sides = {inside: (nearest(range(len(found)), inside), nearest(range(len(found) - 1, -1, -1), inside)) for inside in (False, True)}
    out = []
    for i, (b, x) in enumerate(zip(found, labels)):
        if x is None:
            left, right = (s[i] for s in sides[b.where == "in"])
            if b.where == "in":  # what is around an article doesn't count, and its edges are text
                keep = right is None or right[1] if b.heading else left is None or right is None or left[1] or right[1]
            elif left is None or right is None:
                keep = (left or right or (0, True))[1]
            elif left[1] == right[1]:
                keep = left[1]
            elif b.heading:
                keep = right[1]
            else:
                keep = left[1] if i - left[0] < right[0] - i else right[1] if right[0] - i < i - left[0] else True
            x = (keep, "neighbours")
        out.append(x)
    return out


def main_text(html: str) -> str:
    found = page_blocks(html)
    return "\n".join(b.text for b, (x, _) in zip(found, decided(found)) if x)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages; a null or empty html has an empty text. Pages are whole,
    rows stay rows, other columns aren't looked at."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) if (h := x.as_py()) else "" for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
