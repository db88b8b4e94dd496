"""HTML main-text extraction by template deduction over the pages of a host.

A token is the k-th begin of an element of one role (its path of structural elements with class and id
words) or the k-th block of one text inside one role.  Its occurrence vector says on which distinct pages of the host it is,
kept as a sum of random numbers, one for each page.  Tokens of one host and one vector form an equivalence class.
A class of two tokens or more that is on nearly all pages is a part of the template; on a page it is valid if its
tokens stand there in the class's order and lie inside one slot of every valid class of more pages, so that classes nest.

Blocks of valid classes are the template's own text, and go.  What is left fills the slots.  The template's element that
holds most of it leads to the article: to the outermost element around it that is named as one, or else to all
slots.  Text in elements whose tag or words say menu, form, comment and the like goes too.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, utf8

# Element and class vocabularies.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template textarea iframe svg math object xmp title".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button select head".split()) | RAW
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner nav navbar navigation navigator menu menus topbar toolbar breadcrumb breadcrumbs "
    "sidebar aside complementary footer foot colophon contentinfo masthead header siteheader comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register social share sharing related recommended recommendations pagination pager "
    "widget widgets search searchform copyright legal skip tagcloud trending".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("main article articlebody entrycontent postcontent".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags before which an open p, li and the like end.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.S)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
#: Attributes that say what an element is.
TELLING = re.compile(r"class|id|role|itemprop|hidden|style", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: The least share of the text outside boilerplate and template that the article's slot holds.
MAIN_SHARE = 0.6
#: Distinct pages that a template needs, tokens that a class needs, and the least share of the pages that hold a class with text.
LEAST_PAGES, LEAST_TOKENS, TEXT_SHARE = 4, 2, 0.9
#: Pages of a host that would lose more of their text than this to the template are copies of each other, and keep it.
MOST_LOST = 0.75
#: Templates of all hosts are broadcast up to so many tokens (some 40 bytes each).
BROADCAST_TOKENS = 500_000


class Element:
    """``worded``: the elements around it that class or id words call boilerplate; ``in_header``: those around the article's own header."""

    __slots__ = ("boiler", "in_header", "in_main", "name", "role", "worded")

    def __init__(self, name: str, role: str, boiler: bool, in_main: bool, in_header: tuple[int, ...] | None, worded: tuple[int, ...]) -> None:
        self.name, self.role, self.boiler, self.in_main, self.in_header, self.worded = name, role, boiler, in_main, in_header, worded


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): htmllib.unescape((m[2] or "").strip("\"'")) for m in ATTR.finditer(text)} if text else {}


@lru_cache(maxsize=4096)
def nature(name: str, attr_text: str) -> tuple[frozenset[str], bool, bool, bool]:
    """(class and id words, says it is the article?, boilerplate by its tag or hidden?, boilerplate by its words?) of a start tag."""
    attr = attributes(attr_text)
    named = [attr.get(k, "").lower() for k in ("class", "id", "role", "itemprop")]
    words = frozenset(w for v in named for w in re.split(r"[^a-z]+", re.sub(r"[-_]?\d+", "", v)) if w)
    whole = frozenset(re.sub(r"[^a-z]", "", x) for v in named for x in v.split())
    main = name in MAIN_TAGS or bool(MAIN_WORDS & whole)
    hidden = "hidden" in attr or attr.get("aria-hidden") == "true" or bool(HIDDEN.search(attr.get("style", "")))
    return words, main, name in BOILER_TAGS or hidden, not main and name != "body" and bool(BOILER_WORDS & (words | whole))


def segments(page: str) -> list[tuple[str, tuple[str, ...], bool, bool, int]]:
    """(text, roles of the structural elements around it, boilerplate?, in a named article?, number of its block) in page order.

    Block elements and br end a block: they come as a segment of one space.  Where no article or main
    with text stands outside all elements that words call boilerplate, the words of an element that encloses one do not
    count, nor do those of an element with most of the text unless all of them are boilerplate words.
    """
    out: list[tuple[str, tuple[str, ...], bool, bool, int, tuple[int, ...]]] = []
    stack = [Element("", "", False, False, None, ())]
    pure: list[bool] = []
    encloses: set[int] = set()
    free = False
    number = 0
    roles: tuple[str, ...] = ()
    at, n = 0, len(page)

    def pop(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        nonlocal roles
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in stop:
                return
            if stack[k].name in names:
                del stack[k:]
                roles = tuple(e.role for e in stack[1:] if e.role)
                return

    def emit(text: str) -> None:
        nonlocal free
        e = stack[-1]
        out.append((text, roles, e.boiler, e.in_main, number, e.worded))
        if not free and not e.boiler and not e.worded and text.strip():
            free = any(x.name in MAIN_TAGS for x in stack)

    while at < n:
        lt = page.find("<", at)
        m = TOKEN.match(page, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a bare "<" is text
            lt = page.find("<", lt + 1)
            m = TOKEN.match(page, lt) if lt >= 0 else None
        if m is None:
            emit(htmllib.unescape(page[at:]))
            break
        if lt > at:
            emit(htmllib.unescape(page[at:lt]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name not in INLINE
        if block:
            emit(" ")
            number += 1
        if m[1]:
            pop({name})
            continue
        if name in VOID:
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in ENDS_P:
            pop({"p"}, frozenset(("table", "button")))
        if name in CLOSES:
            pop(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        top = stack[-1]
        words, main, boiler, worded = nature(name, m[3] if TELLING.search(m[3]) else "")
        header = top.in_header
        if header is None and name == "header" and top.in_main and not top.boiler:
            header = top.worded
        hidden, around = top.boiler or boiler, top.worded
        if name in MAIN_TAGS and not hidden:
            encloses.update(around)
        if name in HEADINGS and not boiler and not worded and top.in_header is not None:
            hidden, around = False, top.in_header  # the title in an article's own header
        if worded and not hidden:
            around = (*around, len(pure))
            pure.append(words <= BOILER_WORDS)
        role = "" if not block or name in ("p", "br") else f"{roles[-1] if roles else ''}/{name}{'.' if words else ''}{'.'.join(sorted(words))}"
        stack.append(Element(name, role, hidden, top.in_main or main, header, around))
        if role:
            roles = (*roles, role)
    stands = set(range(len(pure)))
    if pure and not free:
        total, held = 0, [0] * len(pure)
        for text, _, boiler, _, _, around in out:
            if not boiler:
                k = len(text) - text.count(" ")
                total += k
                for i in around:
                    held[i] += k
        stands = {i for i in stands if i not in encloses and (pure[i] or 2 * held[i] <= total)}
    return [(text, where, boiler or not stands.isdisjoint(around), in_main, k) for text, where, boiler, in_main, k, around in out]


def role_stats(parts: list) -> tuple[dict[str, int], int]:
    """Characters of text outside boilerplate inside each role, and on the page."""
    chars: dict[str, int] = {}
    total = 0
    for text, roles, boiler, _, _ in parts:
        if not boiler and roles:
            k = len(text) - text.count(" ")
            total += k
            for r in set(roles):
                chars[r] = chars.get(r, 0) + k
        elif not boiler:
            total += len(text) - text.count(" ")
    return chars, total


def is_named(role: str) -> bool:
    """Whether the role's own element says that it is the article."""
    name, _, words = role.rpartition("/")[2].partition(".")
    return name in MAIN_TAGS or bool(MAIN_WORDS & set(words.split(".")))


def own_role(parts: list) -> str | None:
    """A page's slot by its own text alone: the deepest role, a named one first, that holds the share."""
    chars, total = role_stats(parts)
    fit = [(is_named(r), r.count("/"), c, r) for r, c in chars.items() if total and c >= MAIN_SHARE * total]
    return max(fit)[3] if fit else None


def article_role(role: str | None) -> str | None:
    """The outermost named element around the slot; None, for all text outside boilerplate, if there is none."""
    steps = role.split("/") if role else []
    return next((r for k in range(2, len(steps) + 1) if is_named(r := "/".join(steps[:k]))), None)


def page_tokens(parts: list) -> list[tuple[int, str, int, int]]:
    """(token, role, characters, block) in page order; an element's begin has no characters and block -1."""
    out: list[tuple[int, str, int, int]] = []
    times: dict[tuple[str, str], int] = {}
    before: tuple[str, ...] = ()

    def add(role: str, text: str, block: int) -> None:
        k = times[role, text] = times.get((role, text), 0) + 1
        out.append((xxhash.xxh64_intdigest(f"{role}\0{text}\0{k}", 6) >> 1, role, len(text) - text.count(" "), block))

    held: list[str] = []
    for i, (text, roles, boiler, _, block) in enumerate(parts):
        if roles is not before:
            for k, r in enumerate(roles):
                if k >= len(before) or before[k] != r:
                    add(r, "", -1)
            before = roles
        if not boiler:
            held.append(text)
        if held and (i + 1 == len(parts) or parts[i + 1][4] != block):
            if whole := " ".join("".join(held).split()):
                add(roles[-1] if roles else "", whole, block)
            held = []
    return out


def template_blocks(parts: list, template: list[dict]) -> set[int]:
    """The blocks of the page that its host's template holds, class by class.

    ``template``: class, pages (that hold it), place (mean position) and token.  None if nothing else would be left.
    """
    tokens = page_tokens(parts)
    at = {t: k for k, (t, _, _, _) in enumerate(tokens)}
    classes: dict[int, list[dict]] = {}
    for t in template:
        classes.setdefault(t["class"], []).append(t)
    valid: list[list[int]] = []
    for some in sorted(classes.values(), key=lambda c: (-c[0]["pages"], c[0]["class"])):
        found = [at.get(t["token"], -1) for t in sorted(some, key=lambda t: (t["place"], t["token"]))]
        if found[0] < 0 or any(a >= b for a, b in zip(found, found[1:])):
            continue
        if all(bisect(other, found[0]) == bisect(other, found[-1]) for other in valid):
            valid.append(found)
    blocks = {tokens[k][3] for found in valid for k in found} - {-1}
    return blocks if any(c and b not in blocks for _, _, c, b in tokens) else set()


def main_text(page: str, role: str | None, template: list[dict] | None = None) -> str:
    """The article's text by the slot ``role``, or by the page's own slot where it lacks that, without the template's; white space becomes one space."""
    parts = segments(page)
    if template and (gone := template_blocks(parts, template)):
        parts = [p for p in parts if p[4] not in gone or p[0] == " "]
    if role is None or not any(role in p[1] and not p[2] and p[0].strip() for p in parts):
        role = own_role(parts)
    role = article_role(role)
    inside = [p[0] for p in parts if not p[2] and (role is None or role in p[1])]
    return " ".join("".join(inside).split())


def _token_sums(pages: DataFrame, host: str, raw: str) -> DataFrame:
    """host, token, role, chars, text?, once, seen, place, v0, v1 of every token; token -1 counts the pages.

    The vector's number of a page comes from its bytes.  All columns add up, so a host with a
    third of all pages is summed before the shuffle.
    """
    names = ("host", "token", "role", "chars", "text", "once", "seen", "place", "vector")
    schema = "host string, token long, role string, chars long, text boolean, once long, seen long, place long, vector long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = page.as_py()
                mark = xxhash.xxh64_intdigest(page, 5)
                found = page_tokens(segments(page.decode("utf-8", "replace")))
                times = Counter(r for _, r, _, block in found if block < 0)
                for k, (token, role, chars, block) in enumerate([*found, (-1, "", 0, -1)]):
                    s = sums.setdefault((h, token), [role, chars, block >= 0, 0, 0, 0, 0])
                    s[3] += block < 0 and times[role] == 1
                    s[4] += 1
                    s[5] += k
                    s[6] = (s[6] + mark) & (2**64 - 1)
            cols = [*zip(*sums), *zip(*sums.values(), strict=True)] if sums else [()] * len(names)
            cols[-1] = np.array(cols[-1], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4], strict=True)], names=list(names))

    found = pages.select(host, raw).mapInArrow(run, schema).groupBy("host", "token")
    # the hash wraps around, so it is added in two halves
    lo, hi = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("vector", 32)
    return found.agg(*(F.min(c).alias(c) for c in ("role", "chars", "text")), *(F.sum(c).alias(c) for c in ("once", "seen", "place")), (F.sum(lo) % (1 << 31)).alias("v0"), (F.sum(hi) % (1 << 31)).alias("v1"))


def template_slots(pages: DataFrame, host: str = "host", raw: str = "raw") -> DataFrame:
    """(host, role, template): the slot of the article in every host's template, and the tokens of its classes with text.

    A host has at most 1 / TEXT_SHARE times as many of those as a page has on average.  Hosts whose pages are nearly all template have
    copies, and get no template.  The slot is the deepest
    element, a named one first, that is once on every page it is on, on half of the pages at least, and that holds the share of the text
    outside boilerplate and template.
    """
    tokens = stage(_token_sums(pages, host, raw), "tokens")
    hosts = tokens.where("token = -1").select("host", F.col("seen").alias("n"))
    known = tokens.where("token >= 0").join(hosts, "host")
    common = known.where((F.col("n") >= LEAST_PAGES) & (F.col("seen") >= TEXT_SHARE * F.col("n")))
    of = common.select("host", F.struct(F.xxhash64("v0", "v1").alias("class"), F.col("seen").alias("pages"), (F.col("place") / F.col("seen")).alias("place"), "token").alias("t"), "text", "v0", "v1")
    classes = of.groupBy("host", "v0", "v1").agg(F.collect_list("t").alias("ts"), F.max("text").alias("text")).where(F.col("text") & (F.size("ts") >= LEAST_TOKENS))
    template = classes.select("host", F.explode("ts").alias("t"))
    size = lambda df: df.groupBy("host").agg(F.sum(F.col("chars") * F.col("seen")).alias("c"))
    lost = size(known.where("text").join(template.select("host", F.col("t.token").alias("token")), ["host", "token"], "left_semi"))
    kept = lost.join(size(known).select("host", F.col("c").alias("all")), "host").where(F.col("c") <= MOST_LOST * F.col("all"))
    template = stage(template.join(kept.select("host"), "host"), "template")
    # text that varies, by the roles around it
    varying = known.where("text").join(template.select("host", F.col("t.token").alias("token")), ["host", "token"], "left_anti").groupBy("host", "role").agg(F.sum(F.col("chars") * F.col("seen")).alias("chars"))
    totals = varying.groupBy("host").agg(F.sum("chars").alias("whole"))
    steps = F.split(F.substring("role", 2, 1 << 30), "/")
    around = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))
    held = varying.where("role != ''").select("host", F.explode(around).alias("role"), "chars").groupBy("host", "role").agg(F.sum("chars").alias("chars"))
    begins = known.where("not text").groupBy("host", "role", "n").agg(F.sum("once").alias("once"), F.max("seen").alias("seen"))
    fit = begins.where((F.col("once") == F.col("seen")) & (2 * F.col("seen") >= F.col("n"))).join(held, ["host", "role"]).join(totals, "host").where(F.col("chars") >= MAIN_SHARE * F.col("whole"))
    last = F.split(F.element_at(F.split("role", "/"), -1), "[.]")
    named = F.arrays_overlap(last, F.array(*map(F.lit, sorted(MAIN_WORDS)))) | F.element_at(last, 1).isin(*MAIN_TAGS)
    slots = fit.groupBy("host").agg(F.max_by("role", F.struct(named, F.size(F.split("role", "/")), "chars", "role")).alias("role"))
    return slots.join(template.groupBy("host").agg(F.collect_list("t").alias("template")), "host", "full")


def _distinct_pages(pages: DataFrame) -> DataFrame:
    """One row of each page that a host has more than once (that of the least id; rows with that id again count again)."""
    marked = pages.withColumn("mark", F.xxhash64("raw"))
    copies = marked.groupBy("host", "mark").agg(F.min("page_id").alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = stage(copies, "copies")  # so that its size is known, and few copies do not move the pages
    return marked.join(copies, ["host", "mark"], "left").where("least is null or page_id = least").select("host", "raw")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page.

    A null html is empty, with an empty text.  Pages without a host in their url (null, relative) and pages
    without their host's slot use their own slot.  Repeated pages and ids are kept; an empty
    table gives no rows; other columns are not read.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), utf8(html_col).alias("raw"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST.pattern, 1)).alias("host"))
    slots = stage(template_slots(_distinct_pages(pages.where("host != ''"))), "slots")
    size = slots.agg(F.count("*") + F.sum(F.greatest(F.size("template"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_TOKENS:  # else by host, where the optimiser splits a host that has too many pages
        slots = F.broadcast(slots)
    schema = T.StructType([T.StructField("page_id", df.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[dict] | None] = {}

        def template(host: str, t: pa.Scalar) -> list[dict] | None:
            if host not in known:  # made into Python objects once for a host, while there are not too many
                if len(known) > 256:
                    known.clear()
                known[host] = t.as_py()
            return known[host]

        for b in batches:
            texts = [main_text(p.as_py().decode("utf-8", "replace"), r, template(h, t)) for p, r, t, h in zip(b.column(2), b.column(3).to_pylist(), b.column(4), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.fieldNames())

    return pages.join(slots, "host", "left").select("page_id", "url", "raw", "role", "template", "host").mapInArrow(run, schema)
