"""Main text of web pages, by removal of what a site repeats.

A page is parsed into elements and blocks of text. Element subtrees are hashed (name and texts), and
Spark counts, for each host, in how many different articles a subtree stands. What recurs in a large
share of them is the site's template and is deleted. Elements whose name, role, class or id says that
they are no article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are
deleted at once, on any page; a class counts only for elements that hold no article of their own.

An article that a host prints many times must not count as a template. So a subtree is not counted by
pages but by what stands beside it: the three longest other blocks of the page, hashed. Copies of one
article agree in them and count once. A subtree is deleted if it stands in at least ``pages`` different
articles and in ``share`` of the host's (``article_share`` inside of an element ``article`` or ``main``).

Where a page has ``main`` or ``article`` elements, its text is theirs: the articles with the first-level
headings of their ``main``, or ``main`` without articles. A page without them has all that is not
deleted, less lists whose text is links.

How it scales: the counts aggregate on (host, subtree, articles beside), so no task receives a host as
a whole. The templates of a host are at most 1 / share times the subtrees of a mean page; they reach
the pages by a join on the host, which Spark broadcasts if small and splits where a host is hot.

Defined cases: null or empty html has an empty text, as has a page whose text is all deleted. Unclosed
elements end where their parent does, a cut-off tag at the end is no text. A page without a host (no or
odd url) takes no part in counting. Repeated rows are returned each. All columns but the html are kept;
``text``, ``n_chars`` and ``n_templates`` (subtrees deleted as template) replace columns of these names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from quillmend.llm.common import stored

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SILENT = RAW | frozenset("head template button select option datalist input label legend svg math canvas object audio video map dialog menu".split())
APART = frozenset("nav aside footer form".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th".split())
# An open element that a new one of the given name ends, and the elements that keep it open.
ENDS = {"li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
        "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), frozenset(["table"])),
        "td": (CELLS, frozenset("tr table".split())), "th": (CELLS, frozenset("tr table".split()))}
WALLS = frozenset("table td th caption button object template".split())

# Roles, and words of classes and ids, of what is no article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
WORDS = frozenset(
    "nav navigation navbar navmenu menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer colophon sidebar aside "
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit sponsor sponsored sponsors promo promos "
    "promoted banner cookie cookies cookiebar consent gdpr ccpa notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "signin search searchbox searchform share sharing sharebar social related recommended recommendations trending comment comments "
    "commentlist disqus reply replies respond pagination pager toolbar skip copyright paywall".split())
HEADS = frozenset("header masthead topbar banner".split())
LISTS = frozenset("comment comments commentlist disqus reply replies respond related recommended recommendations trending".split())
OWN = frozenset("article post entry story content title".split())

TAG = re.compile(
    r"""<(?:!--(?s:.*?)(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
READ = frozenset("class id role hidden style aria-hidden itemprop".split())
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
DEEPEST = 400
PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME

OPEN, DROPPED = "open", "dropped"
# Hints, and the elements inside that speak against them.
GUARDS = {"hinted": frozenset("article main h1".split()), "head": frozenset("article main".split()), "list": frozenset("main h1".split())}


class Element:
    """``kind`` is "article" or "main" for such an element, ``inner`` tells whether it is or lies in one."""

    __slots__ = ("name", "parent", "state", "first", "last", "kind", "inner", "templated")

    def __init__(self, name: str, parent: int, state: str, first: int, kind: str, inner: bool):
        self.name, self.parent, self.state, self.first, self.last = name, parent, state, first, first
        self.kind, self.inner, self.templated = kind, inner, False


class Page:
    """Elements in page order, and blocks (text, element, characters in links)."""

    def __init__(self):
        self.elements = [Element("", -1, OPEN, 0, "", False)]
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.links: list[int] = []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        if name.lower() in READ:
            found.setdefault(name.lower(), a or b or c)
    return found


def _judged(name: str, source: str, inner: bool) -> tuple[str, str]:
    """State and kind of a new element; ``inner``: it lies in an article."""
    if name in SILENT:
        return DROPPED, ""
    given = _attributes(source) if source.strip(" /\n\t") else {}
    role = given.get("role", "").strip().lower()
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return DROPPED, ""
    kind = "main" if name == "main" or role == "main" else ""
    if name == "article" or role == "article" or "articlebody" in given.get("itemprop", "").lower():
        kind = "article"
    if name == "form" or role == "form":
        return "hinted", ""
    if name in APART or role in ROLES:
        return DROPPED, ""
    if name in ("html", "body") or kind == "main":
        return OPEN, kind
    hints = {w.lower() for w in PIECE.findall(given.get("class", "") + " " + given.get("id", ""))}
    own = bool(hints & OWN)
    hints &= WORDS
    if name == "article":
        hints = set() if own else hints & (LISTS | {"ad", "ads", "advert", "advertisement", "sponsored", "promo"})
    if hints & HEADS and (inner or own):
        hints -= HEADS
    if name == "header" and not inner:
        hints.add("header")
    if hints & LISTS:
        return "list", kind
    if hints:
        return ("head" if hints <= HEADS else "hinted"), kind
    return OPEN, kind


def parse(source: str) -> Page:
    """The elements and blocks of a page."""
    page = Page()
    elements, stack, names = page.elements, [0], {}
    run: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.texts.append(text)
                page.owners.append(stack[-1])
                page.links.append(linked)
            run.clear()
        linked = 0

    def pop_to(depth: int):
        """Close the elements of the stack from ``depth`` on."""
        nonlocal links
        if any(elements[i].name in BLOCKS for i in stack[depth:]):
            flush()
        for i in reversed(stack[depth:]):
            elements[i].last = len(page.texts)
            names[elements[i].name] -= 1
            links -= elements[i].name == "a"
        del stack[depth:]

    def depth_of(wanted: frozenset, walls: frozenset) -> int:
        """Place in the stack of the innermost wanted element within the walls, 0 for none."""
        if not any(names.get(n) for n in wanted):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            name = elements[stack[k]].name
            if name in wanted:
                return k
            if name in walls:
                return 0
        return 0

    def text(piece: str):
        nonlocal linked
        if elements[stack[-1]].state != DROPPED:
            plain = entities.unescape(piece) if "&" in piece else piece
            run.append(plain)
            if links:
                linked += len(plain.strip())

    at = 0
    while True:
        match = TAG.search(source, at)
        if match is None:
            text(source[at:])
            break
        if match.start() > at:
            text(source[at:match.start()])
        at = match.end()
        name = match.group(2)
        if name is None or source[at - 1] != ">":
            continue
        name = name.lower()
        if match.group(1):
            if name in BLOCKS or name in CELLS:
                k = depth_of(frozenset([name]), WALLS - {name})
            else:
                k = depth_of(frozenset([name]), BLOCKS | CELLS)
            if k:
                pop_to(k)
            if name in CELLS:
                run.append(" ")
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            k = depth_of(frozenset(["p"]), WALLS)
            if k:
                pop_to(k)
            flush()
        if name in ENDS:
            wanted, walls = ENDS[name]
            while k := depth_of(wanted, walls):
                pop_to(k)
                if name in CELLS or name == "tr":
                    run.append(" ")
            if name == "tr":
                flush()
        if name in VOID:
            run.append(" " if name == "br" else "")
            continue
        if name in RAW:
            end = RAW_END[name].search(source, at)
            if end is None:
                break
            at = end.start()
            close = source.find(">", at)
            at = len(source) if close < 0 else close + 1
            continue
        if len(stack) >= DEEPEST:
            continue
        above = elements[stack[-1]]
        state, kind = _judged(name, match.group(3), above.inner)
        if above.state == DROPPED:
            state = DROPPED
        if state == OPEN and (guard := kind or name) in ("article", "main", "h1"):
            for i in stack:
                if guard in GUARDS.get(elements[i].state, ()):
                    elements[i].state = OPEN
        elements.append(Element(name, stack[-1], state, len(page.texts), kind, bool(kind) or above.inner))
        stack.append(len(elements) - 1)
        names[name] = names.get(name, 0) + 1
        links += name == "a"
    flush()
    for i in stack:
        elements[i].last = len(page.texts)
    for e in elements[1:]:
        if e.state != OPEN or elements[e.parent].state == DROPPED:
            e.state = DROPPED
    return page


def kept_blocks(page: Page) -> list[bool]:
    """Which blocks names, roles and classes leave, by the rule for articles."""
    elements = page.elements
    open_ = [elements[o].state == OPEN for o in page.owners]

    def inside(wanted) -> list[bool]:
        marks = [False] * len(elements)
        for i, e in enumerate(elements):
            marks[i] = e.state == OPEN and (wanted(e) or (e.parent >= 0 and marks[e.parent]))
        return marks

    articles = inside(lambda e: e.kind == "article")
    mains = inside(lambda e: e.kind == "main")
    if any(ok and articles[o] for ok, o in zip(open_, page.owners)):
        heads = inside(lambda e: e.name == "h1")
        return [ok and (articles[o] or (mains[o] and heads[o])) for ok, o in zip(open_, page.owners)]
    by_main = [ok and mains[o] for ok, o in zip(open_, page.owners)]
    if any(by_main):
        return by_main
    lists = [False] * len(elements)
    for i, e in enumerate(elements):
        if e.name in ("ul", "ol", "dl", "table"):
            size = sum(map(len, page.texts[e.first:e.last]))
            lists[i] = e.last - e.first >= 3 and sum(page.links[e.first:e.last]) >= 0.9 * size
        lists[i] = lists[i] or (e.parent >= 0 and lists[e.parent])
    return [ok and not lists[o] for ok, o in zip(open_, page.owners)]


def subtrees(page: Page, kept: list[bool]) -> Iterator[tuple[int, int]]:
    """(element, hash) of every block element with kept text. Hashes of runs of blocks come from
    running sums, so that nested elements cost no more than flat ones."""
    codes = [xxh3_64_intdigest(t) % PRIME if k else 0 for t, k in zip(page.texts, kept)]
    sums, powers, count = [0], [1], [0]
    for c, k in zip(codes, kept):
        sums.append((sums[-1] * BASE + c + 1) % PRIME if k else sums[-1])
        powers.append(powers[-1] * BASE % PRIME)
        count.append(count[-1] + k)
    for i, e in enumerate(page.elements):
        n = count[e.last] - count[e.first]
        if n and e.state == OPEN and e.name in BLOCKS and e.name not in ("html", "body"):
            value = (sums[e.last] - sums[e.first] * powers[n]) % PRIME
            yield i, xxh3_64_intdigest(f"{e.name} {n} {value}") - (1 << 63)


def beside(page: Page, kept: list[bool], skip: range | None, longest: list[int]) -> int:
    """Hash of the three longest kept blocks that are not in ``skip``; ``longest`` has all kept ones in order."""
    found = []
    for b in longest:
        if skip is None or b not in skip:
            found.append(page.texts[b])
            if len(found) == 3:
                break
    return xxh3_64_intdigest("\n".join(found)) - (1 << 63)


def facts(source: str) -> list[tuple[int | None, int, bool]]:
    """(subtree, what stands beside it, inside an article) of a page, and (None, all of it, False)."""
    page = parse(source)
    kept = kept_blocks(page)
    longest = sorted((b for b, k in enumerate(kept) if k), key=lambda b: (-len(page.texts[b]), b))
    if not longest:
        return []
    rows = {(None, beside(page, kept, None, longest), False)}
    for i, code in subtrees(page, kept):
        e = page.elements[i]
        if e.last - e.first < len(kept):
            rows.add((code, beside(page, kept, range(e.first, e.last), longest), e.inner))
    return list(rows)


def main_text(source: str, templates: dict[int, bool]) -> tuple[str, int]:
    """The text of a page without the host's templates, and how many subtrees were deleted.
    ``templates``: code to whether it also counts inside articles."""
    page = parse(source)
    kept = kept_blocks(page)
    removed = 0
    if templates:
        for i, code in subtrees(page, kept):
            e = page.elements[i]
            e.templated = e.parent >= 0 and page.elements[e.parent].templated
            if not e.templated and code in templates and (templates[code] or not e.inner):
                e.templated, removed = True, removed + 1
        gone = [False] * len(page.elements)
        for i, e in enumerate(page.elements):
            gone[i] = e.templated or (e.parent >= 0 and gone[e.parent])
        kept = [k and not gone[o] for k, o in zip(kept, page.owners)]
    return "\n".join(t for t, k in zip(page.texts, kept) if k), removed


def host(url: Column) -> Column:
    """Host of a url in lower case, null if there is none."""
    name = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(name, F.lit(""))


def host_templates(pages: DataFrame, *, html: str = "html", url: str = "url", pages_at_least: int = 5, share: float = 0.3,
                   article_share: float = 0.5) -> DataFrame:
    """(host, templates): the codes of a host's templates, and whether they also count inside articles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, codes, sides, inner = [], [], [], []
            for name, source in zip(batch.column(0), batch.column(1)):
                for code, side, inside in facts(source.as_py() or ""):
                    hosts.append(name.as_py())
                    codes.append(code)
                    sides.append(side)
                    inner.append(inside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(codes, pa.int64()), pa.array(sides, pa.int64()), pa.array(inner, pa.bool_())],
                names=["host", "code", "side", "inner"])

    read = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).where("host is not null")
    seen = read.mapInArrow(run, "host string, code long, side long, inner boolean").groupBy("host", "code", "side").agg(F.bool_and("inner").alias("inner"))
    counted = stored(seen.groupBy("host", "code").agg(F.count("*").alias("n"), F.bool_and("inner").alias("inner")))
    articles = counted.where("code is null").select("host", F.col("n").alias("articles"))
    least = F.when(F.col("inner"), article_share).otherwise(share) * F.col("articles")
    found = counted.where(F.col("code").isNotNull() & (F.col("n") >= pages_at_least)).join(articles, "host").where(F.col("n") >= least)
    return found.groupBy("host").agg(F.collect_list(
        F.struct("code", (F.col("n") >= article_share * F.col("articles")).alias("inner"))).alias("templates"))


def extract_pages(pages: DataFrame, *, html: str = "html", url: str = "url", pages_at_least: int = 5, share: float = 0.3,
                  article_share: float = 0.5) -> DataFrame:
    """``pages`` without the html, with ``text``, ``n_chars`` and ``n_templates``."""
    added = ("text", "n_chars", "n_templates")
    kept = [c for c in pages.columns if c not in added and c != html]
    # Names of our own, so that columns may be called anything.
    plain = pages.select(*[pages[c].alias(f"c{k}") for k, c in enumerate(kept)], pages[html].alias("html"), pages[url].alias("url"))
    templates = stored(host_templates(plain, pages_at_least=pages_at_least, share=share, article_share=article_share))
    # Pages without a host find nothing; they are spread, as one key would send them all to one task.
    keyed = plain.withColumn("host", F.coalesce(host(F.col("url")), F.concat(F.lit("?"), F.xxhash64("html").cast("string"))))
    joined = keyed.join(templates, "host", "left")
    columns = [f"c{k}" for k in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, bool]] = {}
        for batch in batches:
            texts, removed = [], []
            for name, source, found in zip(batch.column("host"), batch.column("html"), batch.column("templates")):
                name = name.as_py()
                if name not in known:
                    if len(known) > 256:
                        known.clear()
                    known[name] = {t["code"]: t["inner"] for t in found.as_py() or ()}
                text, n = main_text(source.as_py() or "", known[name])
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                 pa.array(removed, pa.int64())], names=[*columns, *added])

    schema = T.StructType([*(T.StructField(c, pages.schema[name].dataType) for c, name in zip(columns, kept)),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_templates", T.LongType())])
    out = joined.select(*columns, "host", "html", "templates").mapInArrow(run, schema)
    return out.select(*[F.col(c).alias(name) for c, name in zip(columns, kept)], *added)
