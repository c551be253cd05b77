"""Main-text extraction with templates deduced from equivalence classes of tokens.

Pages of one host share a template.  Tokens (places in the markup, and blocks of text at a place) that occur equally
often on every page of a host form an equivalence class; here a class is the tokens with one occurrence signature, a
hash of their counts over the host's distinct pages that needs no vector in memory.  The class of what stands on all
pages is the template's frame; tokens that nearly all pages have, equally often, belong to it.  A class is valid if it
has more than one token, places among them, if its tokens keep one order on the pages (those that don't leave it), and
if it nests: its occurrences lie in one slot of the frame, the same on nearly all pages.  Valid classes are the
template.  Their fixed texts are dropped (inside articles only those of classes on nearly all pages), and the slots
between them are extracted where they lie in the article: not in menus, headers, footers, sidebars, notices, adverts,
forms or comments, which markup and names mark.

Scale: signatures, orders and slots combine before the shuffle, so a host with a third of all pages is no hot group.  A
host's template has at most twice as many tokens as its pages have on average; templates are broadcast only where they
are few.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import col, saved

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?<![-\w])(class|id|role|hidden|style|aria-hidden)(?![-\w])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas select noembed noframes xmp annotation annotation-xml".split())
#: Elements of formulas: inline, their parts are words.
MATH = frozenset(
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd maction".split()
)
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold article text.
DROPPED = frozenset("nav footer aside form button menu dialog head fieldset datalist".split())
CLOSED_BY = {
    "p": frozenset(
        "p div ul ol dl table section article main aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre figure hr address details fieldset li".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
}
#: Words in class, id and role values that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert sidebar sidebars menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply "
    "replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay pagination pager "
    "widget toolbar login search skip contentinfo complementary form hidden".split()
)
#: The share of a host's pages that counts as nearly all.
ALL = 0.95
#: Words that beside a mark leave the name of an article's part a mark: "related-posts", but not "related-work".
BESIDE = frozenset(
    "area article articles bar block blocks bottom box btn button buttons card container content form icon icons inline item items left link links list "
    "post posts right section site slot story stories top unit widgets wrap wrapper".split()
)
#: Elements whose ids in an article are anchors of its text.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
HEADERS = frozenset(["header", "head", "topbar", "site-header"])
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)")


class Block(NamedTuple):
    path: str
    text: str
    inside: bool  # in an article or main element
    dropped: bool
    at: int  # the places before it


def _named(value: str, inside: bool) -> bool:
    """Whether a class, id or role value marks what is not the article; inside an article a whole name must."""
    if not inside:
        return any(w.lower() in MARKS for w in WORDS.findall(value))
    names = ([w.lower() for w in WORDS.findall(name)] for name in value.split())
    return any(MARKS.intersection(words) and all(w in MARKS or w in BESIDE for w in words) for words in names)


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    for m in NAMES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            return True
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if name == "aria-hidden" and value.lower() == "true" and tag not in MATH:
            return True
        if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
            if not (inside and name == "id" and tag in ANCHORS) and _named(value, inside):
                return True
        if name == "class" and tag == "article" and any(w in ("comment", "reply") for w in WORDS.findall(value.lower())):
            return True
    return False


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """Text blocks in page order, and the places of all elements.  Unclosed and stray tags are put up with."""
    out: list[Block] = []
    places: list[str] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, inside, dropped
    text: list[str] = []
    held: list[tuple[int, list[str]]] = []  # text around dropped inline elements, with their depth

    def flush() -> None:
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                _, path, inside, dropped = stack[-1] if stack else ("", "", False, False)
                out.append(Block(path, body, inside, dropped, len(places)))
            text.clear()

    def close(k: int, whole: bool) -> None:
        """The elements from the kth on end; text around a dropped inline element goes on after it."""
        while held and held[-1][0] >= k:
            flush()
            depth, around = held.pop()
            del stack[depth:]
            text[:] = around
        if whole:
            flush()
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and any(t[0] not in INLINE for t in stack[k:]):
                        break  # a stray inline end doesn't close blocks
                    close(k, tag not in INLINE)
                    break
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            while stack and (stack[-1][0] in INLINE or tag in CLOSED_BY.get(stack[-1][0], ())):
                if stack[-1][0] in INLINE and not any(tag in CLOSED_BY.get(t[0], ()) for t in stack):
                    break
                close(len(stack) - 1, True)
        if tag in VOID:
            continue
        _, path, inside, dropped = stack[-1] if stack else ("", "", False, False)
        if tag not in INLINE:
            path = f"{path}/{tag}"
            places.append(path)
        inside = inside or tag in ("article", "main") or 'role="main"' in m[3]
        dropped = dropped or tag in DROPPED or tag in HEADERS and not inside or _marked(tag, m[3], stack[-1][2] if stack else False)
        if tag in MATH:
            text.append(" ")
        if tag in INLINE and dropped != (stack[-1][3] if stack else False):
            held.append((len(stack), [*text, " "]))
            text.clear()
            path = f"{path}/{tag}"
        if not m[0].endswith("/>") or tag not in VOID:
            stack.append((tag, path, inside, dropped))
    close(0, True)
    return out, places


def _token(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def page_tokens(page: str) -> Counter:
    """The page's tokens with their counts: places, and texts at places."""
    found, places = blocks(page)
    return Counter([_token(p) for p in places] + [_token(b.path, b.text) for b in found])


def _sequence(found: list[Block], places: list[str]) -> list[int]:
    """A page's tokens in page order."""
    keyed = [(2 * n + 1, _token(p)) for n, p in enumerate(places)] + [(2 * b.at, _token(b.path, b.text)) for b in found]
    return [t for _, t in sorted(keyed, key=lambda x: x[0])]


def main_text(page: str, often: frozenset[int], always: frozenset[int]) -> str:
    """The article's blocks, joined by an empty line.

    Inside an article element only the template's texts that nearly all pages have go (``always``); where a page marks
    no article, all of the template's fixed texts go (``often``).
    """
    found = [b for b in blocks(page)[0] if not b.dropped]
    article = [b for b in found if b.inside]
    fixed = always if article else often
    return "\n\n".join(b.text for b in article or found if _token(b.path, b.text) not in fixed)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(col(url_col), F.lit("")), HOST.pattern, 1))
    return pages.select(col(id_col).alias("id"), col(url_col).alias("url"), host.alias("host"), F.coalesce(col(html_col), F.lit("")).alias("html"))


def _map_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"host": pa.string(), "token": pa.int64(), "mark": pa.int64(), "n": pa.int64(), "first": pa.int64(), "place": pa.bool_()}
    for b in batches:
        rows: list[tuple] = []
        for row, host, body in zip(*(b.column(c).to_pylist() for c in ("row", "host", "html")), strict=True):
            parsed = blocks(body)
            places = {_token(p) for p in parsed[1]}
            tokens = _sequence(*parsed)
            first: dict[int, int] = {0: 0}  # zero stands for the page itself
            for k, token in enumerate(tokens):
                first.setdefault(token, k)
            counts = Counter(tokens) + Counter([0])
            rows += [(host, t, xxhash.xxh3_64_intdigest(f"{row}:{counts[t]}") - (1 << 63), counts[t], k, t in places) for t, k in first.items()]
        cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds.values(), strict=True)], list(kinds))


def _distinct(pages: DataFrame) -> DataFrame:
    """Each content of a host's pages once: copies of a page share its article, which is no template.  Only copies move."""
    rows = pages.select("host", "html", F.xxhash64("host", "html").alias("row"))
    copied = saved(rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("_row"), F.lit(True).alias("copied")), "copied")
    right = F.broadcast(copied) if copied.limit(100_001).count() <= 100_000 else copied
    flagged = rows.join(right, F.col("row") == F.col("_row"), "left")
    once = flagged.where("copied").groupBy("row").agg(F.first("host").alias("host"), F.first("html").alias("html"))
    return flagged.where("copied is null").select("host", "html", "row").unionAll(once.select("host", "html", "row"))


def classes(pages: DataFrame) -> DataFrame:
    """The classes of ``_classes`` for pages that may have copies."""
    return _classes(_distinct(pages))


def _classes(pages: DataFrame, share: float = 0.5, least: int = 4) -> DataFrame:
    """(``host``, ``pages``, ``signature``, ``support``, ``tokens``, ``members``): the equivalence classes of each host.

    Those on at least ``share`` of the host's distinct pages, of which there are ``least`` or more.  A signature is the
    XOR over the pages of a hash of the page and the token's count there, so equal signatures are equal occurrence
    vectors.  ``members`` are the tokens with their order (the sum of their positions), whether they are places, and
    whether they occur equally often on all pages that have them.
    """
    tokens = pages.mapInArrow(_map_tokens, "host string, token long, mark long, n long, first long, place boolean")
    level = (F.min("n") == F.max("n")).alias("level")
    counted = tokens.groupBy("host", "token").agg(F.count("*").alias("support"), F.bit_xor("mark").alias("signature"), F.sum("first").alias("order"), F.bool_or("place").alias("place"), level)
    seen = saved(counted.where(F.col("support") >= least / 2), "tokens")
    hosts = seen.where("token = 0").select(F.col("host").alias("_h"), F.col("support").alias("pages"))
    often = seen.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).where((F.col("pages") >= least) & (F.col("support") >= F.col("pages") * share) & (F.col("token") != 0))
    members = F.array_sort(F.collect_list(F.struct("order", "token", "place", "level")))
    return often.groupBy("host", "pages", "signature", "support").agg(members.alias("members")).withColumn("tokens", F.col("members.token"))


def increasing(found: list[int]) -> set[int]:
    """A longest increasing part of distinct numbers."""
    tails: list[int] = []
    at: list[int] = []
    back: dict[int, int | None] = {}
    for x in found:
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
        at[k : k + 1] = [x]
        back[x] = at[k - 1] if k else None
    out, x = set(), at[-1] if at else None
    while x is not None:
        out.add(x)
        x = back[x]
    return out


def _layout(tokens: list[int], groups: list[tuple[bool, list[int]]]) -> Iterator[tuple[int, int | None, int]]:
    """What one page says of its host's classes: (class, token, 0) of tokens out of order, (class, None, slot) of classes.

    The frame comes first in ``groups``.  Its slots are numbered by the frame's token before them; -1: several slots.
    """
    known = {t: (g, k) for g, (_, members) in enumerate(groups) for k, t in enumerate(members)}
    first: dict[int, int] = {}
    spots = [(p, *known[t], t) for p, t in enumerate(tokens) if t in known]
    for p, _, _, t in spots:
        first.setdefault(t, p)
    by_class: dict[int, list[int]] = {}
    for p, g, k, t in spots:
        if first[t] == p:
            by_class.setdefault(g, []).append(k)
    straight = {g: increasing(ks) for g, ks in by_class.items()}
    for g, ks in by_class.items():
        yield from ((g, groups[g][1][k], 0) for k in ks if k not in straight[g])
    slots: dict[int, set[int]] = {}
    now = 0
    for p, g, k, t in spots:
        if groups[g][0]:
            now = k + 1 if first[t] == p and k in straight[g] else now
        else:
            slots.setdefault(g, set()).add(now)
    yield from ((g, None, min(s) if len(s) == 1 else -1) for g, s in slots.items())


def templates(pages: DataFrame) -> DataFrame:
    """(``host``, ``often``, ``always``): the tokens of each host's valid classes, and of those on nearly all pages."""
    single = _distinct(pages)
    found = _classes(single)
    near = F.col("support") >= ALL * F.col("pages")
    whole = F.col("support") == F.col("pages")
    each = found.select("host", "pages", "signature", near.alias("near"), whole.alias("whole"), F.explode("members").alias("m"))
    frame = F.col("near") & F.col("m.level")
    core = frame & F.col("whole")
    # tokens of the frame that some pages lack, or that stand there more often than once, have own slots: only what is nested in one stays
    group = F.when(core, F.lit(0)).otherwise(F.xxhash64("signature", "near"))
    parts = each.select("host", "pages", "near", "m", group.alias("group"), core.alias("core"), frame.alias("frame"))
    listed = parts.groupBy("host", "pages", "group", "core").agg(F.array_sort(F.collect_list("m")).alias("m"), F.bool_or("near").alias("near"), F.bool_and("frame").alias("frame"))
    groups = saved(listed.select("host", "pages", "group", "core", "near", "frame", F.col("m.token").alias("tokens"), F.col("m.place").alias("places")), "classes")
    by_host = groups.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((~F.col("core")).alias("later"), "group", "tokens"))).alias("groups"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for host, body, known in zip(*(b.column(c).to_pylist() for c in ("host", "html", "groups")), strict=True):
                for g, token, slot in _layout(_sequence(*blocks(body)), [(not x["later"], x["tokens"]) for x in known]):
                    rows.append((host, known[g]["group"], token, slot))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["host", "group", "token", "slot"])

    told = _by_host(single, by_host, "groups").where(F.col("groups").isNotNull()).mapInArrow(run, "host string, group long, token long, slot long")
    told = saved(told.groupBy("host", "group", "token", "slot").agg(F.count("*").alias("n")), "layout")
    loose = told.where("token is not null").select("host", "group", "token", "n")
    most = told.where("token is null").groupBy("host", "group").agg(F.max_by("slot", "n").alias("slot"), F.max("n").alias("same"), F.sum("n").alias("all"))
    nested = most.where((F.col("slot") >= 0) & (F.col("same") >= ALL * F.col("all"))).select("host", "group", F.lit(True).alias("nested"))
    tokens = groups.select("host", "pages", "group", "core", "near", "frame", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    tokens = tokens.select("host", "pages", "group", "core", "near", "frame", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    kept = tokens.join(loose, ["host", "group", "token"], "left").where(F.coalesce("n", F.lit(0)) <= (1 - ALL) * F.col("pages"))
    kept = kept.join(nested, ["host", "group"], "left").where(F.col("core") | F.col("nested"))
    # tokens that nearly all pages have join the frame, others need a place in their own class
    kept = kept.withColumn("group", F.when(F.col("frame"), F.lit(0)).otherwise(F.col("group")))
    sets = kept.groupBy("host", "group").agg(F.collect_list("token").alias("tokens"), F.bool_or("place").alias("marked"), F.bool_and("near").alias("near"))
    valid = sets.where(F.col("marked") & (F.size("tokens") > 1))
    return valid.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("often"), F.flatten(F.collect_list(F.when(F.col("near"), F.col("tokens")))).alias("always"))


def _by_host(rows: DataFrame, found: DataFrame, name: str, tokens: str = "groups.tokens") -> DataFrame:
    """Rows with their host's template; broadcast only where the templates are few."""
    found = saved(found, "templates")
    size = F.sum(F.size(F.flatten(tokens)) if tokens == "groups.tokens" else F.size(tokens))
    few = (found.agg(size).first()[0] or 0) <= 1_000_000
    right = found.select(F.col("host").alias("_h"), name if name in found.columns else F.struct(*(c for c in found.columns if c != "host")).alias(name))
    return rows.join(F.broadcast(right) if few else right, F.col("host") == F.col("_h"), "left").drop("_h")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` (main text, empty if none) and ``n_chars`` (its code points) of every page.

    A null html is an empty page; pages with null or unreadable urls share one host without a name; repeated rows are
    extracted each, but count once for the template; a host with fewer than four distinct pages has no template, its
    pages are read by their markup alone; very long pages are read whole, in time that grows with their length; an empty
    table gives an empty one; other columns are not read.
    """
    rows = _pages(pages, id_col, url_col, html_col)
    joined = _by_host(rows, templates(rows), "template", "often").select("id", "url", "host", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for b in batches:
            texts = []
            template = b.column("template")
            for n, (host, body) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    own = template[n].as_py() or {"often": (), "always": ()}
                    known[host] = frozenset(own["often"]), frozenset(own["always"])
                texts.append(main_text(body, *known[host]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    kinds = pages.schema
    schema = f"`{id_col}` {kinds[id_col].dataType.simpleString()}, `{url_col}` {kinds[url_col].dataType.simpleString()}, text string"
    return joined.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
