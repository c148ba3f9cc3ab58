"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: start and end tags, each told apart by its path of tags and classes, texts, and places, the first,
second and so on of a kind of element in its parent, so that elements that no name tells apart have roles of their own.  A token's
occurrence vector says how often it stands on each page of its host; tokens with equal vectors form an equivalence class.
Vectors are compared by page count, occurrences and two sums of hashes of (page, count) over the host's different pages, so one
partial aggregation over (host, token) finds the classes of a host of any size, and no host is ever gathered.  Classes of at
least ``MIN_SIZE`` tokens on at least ``MIN_SHARE`` of the host's pages (and ``MIN_PAGES`` pages) that are ordered and nest
without crossing make the template.  Order and nesting are judged by the mean places, and again on each page: a class whose
tokens stand in another order there, or that crosses a larger one there, is no template of that page.

What stands between template tokens are slots; a text that belongs to a class is template, not content.  The main slot of a host
is the innermost container of its template that holds at least ``MAIN_SHARE`` of the text that isn't set aside and all headings of
it, on all its pages together, be it called article, main or div, and none inside an article: the main text of a page is that of the main slot, and of all slots of the body where
the page has no such element.

Set aside are menus, page headers, footers, sidebars, notices, adverts, forms and reader comments, which their tags, roles or whole
class names name.  No such name sets aside html, body, main or a page's first article; an element that holds a page's only article
stays too if that article is longer than all else that stays.  Inside an ``article`` or ``main`` element a text counts as template
only if it is of one class with the start tags of its own element and of the article, and only with its whole block, so a
passage that many articles share stays.  A host of fewer than ``MIN_PAGES`` different texts has no template, and a page that its
template would leave without text keeps all that isn't set aside.  Scripts, styles and comments are no tokens.  Character
references are decoded, white space in a block becomes one space, and blocks are joined by one space in page order.

A null or empty html gives an empty text; a null or odd url is a host of its own kind; rows that repeat a page (its id and html)
change no vector's equality; extra columns do no harm; an empty table gives no rows.  A page is scanned in linear time: a tag whose
quotes never end makes quotes count for nothing in the rest of the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.common import written

MIN_PAGES = 3
MIN_SHARE = 0.5
MIN_SIZE = 3
MAIN_SHARE = 0.9
#: Parts of a page by which places are told, more than a page has tokens.
PARTS = 1_000_000_000
#: Elements that never hold main text, elements that end a block, elements without an end tag.
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template head select button iframe svg object audio video canvas dialog menu".split())
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul caption".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role attributes that name what isn't main text.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies share sharing social related newsletter subscribe subscription popup modal login signup search toolbar contentinfo complementary".split())
#: What may stand before and after such words in a name, as in site-footer and comment-list.
BEFORE = frozenset("site main primary secondary top bottom global".split())
AFTER = frozenset("area list section box block bar links item form slot unit widget".split())
#: Elements that close an open one of the same kind.
#: Elements that may be a main slot.
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK_TAGS - {"br", "body", "html", "head", "title", "option"}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Elements whose content is no markup, and their ends.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
START, NAMED = re.compile(r"<[a-zA-Z/!?]"), re.compile(r"</?[a-zA-Z]")
COMMENT_END = re.compile(r"--!?>")
NAMES = re.compile(r"(?<![\w\-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hash(*parts) -> int:
    x = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return x - 2**64 if x >= 2**63 else x


@lru_cache(100_000)
def names_aside(name: str) -> bool:
    """The whole name says that it isn't main text; has-sidebar, comment-open and notice-12 don't."""
    words = [w for w in re.split(r"[_\-]+", name) if w]
    while len(words) > 1 and words[0] in BEFORE:
        del words[0]
    while len(words) > 1 and words[-1] in AFTER:
        del words[-1]
    return bool(words) and ASIDE_WORDS.issuperset(words)


def scan(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of each tag; the name is empty for what is no token."""
    tag, at, size = TAG, 0, len(source)
    while m := START.search(source, at):
        start = m.start()
        if source.startswith("<!--", start):
            m = COMMENT_END.search(source, start + 4)
            at = m.end() if m else size
            yield start, at, "", "", ""
            continue
        if source.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            if end < 0:
                return
            at = end + 1
            yield start, at, "", "", ""
            continue
        m = tag.match(source, start)
        if m is None and tag is TAG and NAMED.match(source, start):
            tag = UNQUOTED  # some quote never ends
            m = tag.match(source, start)
        if m is None:
            if source.find(">", start) < 0:
                return
            at = start + 1
            continue
        at, name = m.end(), m[2].lower()
        if not m[1] and (ends := RAW.get(name)):
            found = ends.search(source, at)
            at = found.end() if found else size
            yield start, at, "", "", ""
        else:
            yield start, at, m[1], name, m[3]


class Page:
    """``items``: (token, text or None, ends a block, set aside, article, element, around, heading) in page order; article and element are
    start tags' tokens, 0 for none, around has the places of the containers around it, a start tag's own included, but for
    those inside an article, and the last tells texts of headings.

    What is set aside has the numbers of the elements that do so by name, and 0 where a tag does.
    """

    def __init__(self, source: str):
        self.items: list[tuple[int, str | None, bool, tuple[int, ...], int, int, tuple[int, ...], bool]] = []
        self.stack: list[tuple[str, int, tuple[int, ...], int, tuple[int, ...], bool]] = []  # name, path, set aside, article, around, heading
        self.children: dict[tuple[int, str], int] = defaultdict(int)  # by the parent's place and the tag
        self.has_article = False
        self.chars: dict[tuple[tuple[int, ...], bool], int] = defaultdict(int)  # by set aside, inside an article
        at = 0
        for start, end, slash, name, attributes in scan(source):
            if start > at:
                self._text(source[at:start])
            at = end
            if name:
                (self._end if slash else self._start)(name, attributes)
        if at < len(source):
            self._text(source[at:])
        self._lift()

    def _lift(self) -> None:
        """An element that holds the page's only article isn't set aside by its name."""
        held = {aside: n for (aside, article), n in self.chars.items() if article and aside and 0 not in aside}
        if held and ((), True) not in self.chars:
            most = max(held, key=held.get)
            if held[most] > self.chars[(), False]:
                self.items = [(*i[:3], tuple(k for k in i[3] if k not in most), *i[4:]) for i in self.items]

    def _top(self) -> tuple[str, int, tuple[int, ...], int, tuple[int, ...], bool]:
        return self.stack[-1] if self.stack else ("", 0, (), 0, (), False)

    def _text(self, raw: str) -> None:
        _, path, aside, article, around, heading = self._top()
        if not raw.isspace():
            self.chars[aside, article != 0] += len(raw)
        self.items.append((0 if raw.isspace() else _hash(path, "text", " ".join(raw.split())), raw, False, aside, article, path, around, heading))

    def _start(self, name: str, attributes: str) -> None:
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if closes:
            for k in range(len(self.stack) - 1, -1, -1):
                own = self.stack[k][0]
                if own in closes:
                    del self.stack[k:]
                    break
                if own in BLOCK_TAGS and own != "p" and not (own in ("td", "th") and name == "tr"):
                    break
        _, path, aside, article, around, heading = self._top()
        names = [(m[1].lower(), n) for m in NAMES.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()] if attributes else []
        words = sorted({w for a, n in names for w in re.split(r"[_\-]+", n) if w and not (a == "id" and any(map(str.isdigit, w)))}) if names else []
        is_main = name == "main" or ("role", "main") in names
        is_article = is_main or name == "article"
        if name in ASIDE_TAGS or name == "header" and not article:
            aside = (*aside, 0)
        elif not (is_main or name in ("html", "body") or name == "article" and not self.has_article) and any(names_aside(n) for _, n in names):
            aside = (*aside, len(self.items) + 1)
        self.has_article = self.has_article or is_article and not aside
        path = _hash(path, name, *words)
        outer, article = article, article or (path if is_article else 0)
        if name in CONTAINERS and (not outer or is_article and article == path):
            parent = around[-1] if around else 0
            self.children[parent, name] += 1
            around = (*around, _hash(parent, name, self.children[parent, name]))
        heading = heading or name in HEADINGS
        self.items.append((path, None, name in BLOCK_TAGS, aside, article, path, around, heading))
        if name not in VOID_TAGS and not attributes.endswith("/"):
            self.stack.append((name, path, aside, article, around, heading))

    def _end(self, name: str, _: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                _, path, aside, article, around, heading = self.stack[k]
                self.items.append((_hash(path, "end"), None, name in BLOCK_TAGS, aside, article, path, around, heading))
                del self.stack[k:]
                return
        if name in BLOCK_TAGS:
            _, _, aside, article, around, heading = self._top()
            self.items.append((0, None, True, aside, article, 0, around, heading))

    def kind(self) -> int:
        """Hash of the texts that aren't set aside: pages that differ in nothing else are copies."""
        return _hash(*(token for token, text, _, aside, *_ in self.items if token and text is not None and not aside))

    def masses(self) -> dict[int, list[int]]:
        """Characters of the texts that aren't set aside, and of headings among them, by the container that holds them; of all, by 0."""
        out: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for _, text, _, aside, _, _, around, heading in self.items:
            if text is not None and not aside and not text.isspace():
                for place in (0, *around):
                    out[place][0] += len(text)
                    out[place][1] += len(text) * heading
        return out

    def standing(self, template: Mapping[int, int]) -> Mapping[int, int]:
        """The template without the classes that stand in another order here, or cross a larger class here."""
        places: dict[int, list[int]] = {}
        first: dict[int, int] = {}
        for k, (token, text, *_, around, _) in enumerate(self.items):
            if token in template and token not in first:
                first[token] = k
            if text is None and around and around[-1] in template and around[-1] not in first:
                first[around[-1]] = k
        for token, number in template.items():  # in the order of the classes' members
            if token in first:
                places.setdefault(number, []).append(first[token])
        spans, good = [], set()
        for number, own in sorted(places.items()):
            low, high = own[0], own[-1]
            if all(a <= b for a, b in zip(own, own[1:], strict=False)) and all(h <= low or high <= l or (l <= low and high <= h) or (low <= l and h <= high) for l, h in spans):
                spans.append((low, high))
                good.add(number)
        return template if len(good) == len(places) else {t: n for t, n in template.items() if n in good}

    def main_text(self, template: Mapping[int, int] = MappingProxyType({}), main: int = 0) -> str:
        """Text of the slots in the main slot; ``template`` maps a token to the number of its class."""
        here = self.standing(template) if template else template
        return (self._slots(here, main) if main in here else "") or self._slots(here) or (self._slots({}) if here else "")

    def _slots(self, template: Mapping[int, int], main: int = 0) -> str:
        blocks, inline, is_slot = [], [], False
        for token, text, block, aside, article, element, around, _ in self.items:
            if text is None:
                if block and inline:
                    blocks += inline if is_slot else []
                    blocks.append(" ")
                    inline, is_slot = [], False
            elif not aside and (not main or main in around):
                number = template.get(token)
                if article:
                    is_slot = is_slot or token != 0 and (number is None or number != template.get(element) or number != template.get(article))
                elif number is None:
                    is_slot = is_slot or token != 0
                else:
                    continue
                inline.append(html.unescape(text))
        blocks += inline if is_slot else []
        return " ".join("".join(blocks).split())


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """Rows (host, token, pages, times, v1, v2, place, chars, heads): the sums of each token's occurrences on the host's pages.

    place: the sum of the places of its first occurrence, in parts of the page.  chars and heads: those of texts
    and of headings in the container that aren't set aside.  Token 0 stands on every page.  A text in an article is left out of a page where it can't be of
    its element's and article's class.  Rows of times 0 are the host's different texts.
    """
    kinds = (pa.string(), *[pa.int64()] * 8)
    names = ["host", "token", "pages", "times", "v1", "v2", "place", "chars", "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0] * 7)
            for page_id, host, source in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found: dict[int, list[int]] = {0: [1, 0]}
                page = Page(source or "")
                items = page.items
                for k, (token, text, *_, around, _) in enumerate(items):
                    if token:
                        found.setdefault(token, [0, PARTS * k // len(items)])[0] += 1
                    if text is None and around and around[-1] not in found:
                        found[around[-1]] = [1, PARTS * k // len(items)]
                for token, text, _, _, article, element, *_ in items:
                    if text is not None and article and token in found and not found[token][0] == found[element][0] == found[article][0]:
                        del found[token]
                sums[host, page.kind()][0] += 1
                own, masses = _hash(page_id, source), page.masses()
                for token, (n, place) in found.items():
                    s, h = sums[host, token], _hash(own, n)
                    for k, x in enumerate((1, n, h & 2**31 - 1, h >> 32 & 2**31 - 1, place, *masses.get(token, (0, 0)))):
                        s[k] += x
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    counted = pages.mapInArrow(run, ", ".join(["host string", *(f"{n} long" for n in names[1:])]))
    return counted.groupBy("host", "token").agg(*[F.sum(n).alias(n) for n in names[2:]])


def templates(pages: DataFrame) -> DataFrame:
    """Rows (host, chars, heads, classes): the host's text and equivalence classes, each an array of (place, token, chars, heads) in order.

    A class's tokens stand on at least half of the host's pages, so a host has no more of them than twice a page has.
    """
    counted = written(occurrences(pages), "occurrences")
    whole = [F.sum(F.when(F.col("token") == 0, F.col(c))).alias(n) for c, n in (("pages", "of"), ("chars", "text_chars"), ("heads", "text_heads"))]
    sizes = counted.where("token = 0 or times = 0").groupBy("host").agg(*whole, F.count_if(F.col("times") == 0).alias("kinds")).where(F.col("kinds") >= MIN_PAGES).drop("kinds")
    often = counted.where(f"token <> 0 and times <> 0 and pages >= {MIN_PAGES}").join(sizes, "host").where(F.col("pages") >= MIN_SHARE * F.col("of"))
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "chars", "heads")
    classes = often.groupBy("host", "text_chars", "text_heads", "pages", "times", "v1", "v2").agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") >= MIN_SIZE)
    return classes.groupBy("host", F.col("text_chars").alias("chars"), F.col("text_heads").alias("heads")).agg(F.sort_array(F.collect_list(F.struct("pages", "times", "members")), asc=False).alias("classes"))


def numbered(classes: list[dict]) -> dict[int, int]:
    """Class numbers of the tokens of the classes that nest: a class that crosses a larger one is no part of the template."""
    spans, tokens = [], {}
    for number, c in enumerate(classes):  # of the most pages first
        places = [m["place"] for m in c["members"]]
        low, high = places[0], places[-1]
        if all(h <= low or high <= l or (l <= low and high <= h) or (low <= l and h <= high) for l, h in spans):
            spans.append((low, high))
            tokens.update((m["token"], number) for m in c["members"])
    return tokens


def nested(classes: list[dict]) -> frozenset[int]:
    """Tokens of the template."""
    return frozenset(numbered(classes))


def main_slot(classes: list[dict], template: Mapping[int, int], chars: int, heads: int) -> int:
    """Of the template's containers of ``MAIN_SHARE`` of the host's text and all its headings, the one of the least text, then the last; else 0."""
    members = (m for c in classes for m in c["members"] if m["token"] in template)
    held = [(m["chars"], -m["place"], m["token"]) for m in members if m["chars"] and m["chars"] >= MAIN_SHARE * chars and m["heads"] >= heads]
    return min(held)[2] if held else 0


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), "html", "url")
    known = written(templates(hosted.select("page_id", "host", "html")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[dict[int, int], int]] = {}
        for b in batches:
            texts = []
            for source, host, chars, heads, classes in zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True):
                if host not in made:
                    if len(made) > 10_000:
                        made.clear()
                    template = numbered(classes or [])
                    made[host] = template, main_slot(classes or [], template, chars or 0, heads or 0)
                texts.append(Page(source or "").main_text(*made[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = hosted.join(known, "host", "left").select("page_id", "url", "html", "host", "chars", "heads", "classes")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
