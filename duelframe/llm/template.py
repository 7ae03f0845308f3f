"""Main text of web pages by deducing the template of their host.

Tokens are start tags (with their path of elements and classes) and blocks of text (with their
path). Tokens of a host that occur equally often in every page share an occurrence vector and form
an equivalence class; the vectors are compared by sums of hashes of (page, count), so a host of any
size is pre-aggregated where its pages are read and never gathered. A class of two or more tokens
that occur in most pages of the host is kept; in a page it is valid if its tokens stand there in the class's order
and nest: no class lies across the gap between two tokens of another. The class of the most pages
is the root; its tokens cut the page into slots, and texts that are tokens of valid classes are
template. Tags of all hosts together give a template for hosts of few pages.

Of the slots' texts that are not template, those are extracted that lie in an article (or main) element, if there is one, else in the
element that holds most of the text of the host's pages, and in no element
that by its name, role or class is a menu, header, footer, sidebar, notice, advert, form or comment
area (marks of html and body, and those such as has-sidebar, don't count; where marks leave no text, names alone decide); scripts, styles and other markup hold no text. Blocks are the texts between block-level tags:
character references decoded, white space turned to single spaces, trimmed, one to a line.

Cases: a page whose every text is template (most pages of its host are copies of it) keeps the texts that
the tag rules choose; null or empty html gives an empty text; html cut short is read up to its end (a tag cut
short is dropped); elements left open end with their parent; a null url is a host of its own; rows
are never merged; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole, workers_can_import, written

#: A host's own template needs this many pages; texts count as template from TEXT_PAGES pages on,
#: where nearly all pages (ALL) have them once.
PAGES = 4
TEXT_PAGES = 8
MOST = 0.5
ALL = 0.95
#: Templates (tokens) up to which they are broadcast, about 30 bytes each; beyond, a join.
FEW_TOKENS = 400_000
#: Elements on top of each other of which the path is told apart, and searched for one that a tag closes.
MOST_DEEP = 256
#: Of pages without an article, the deepest element with this share of a host's text (outside of menus and
#: such) holds the main text.
HOLDS = 0.8

_MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose start tag ends one of these.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that hold a main text with its heading.
HOLDERS = frozenset("body center details div html section table tbody td tr".split())
#: Elements without text of the page; left open, the first two go on to the end, the others hold nothing.
RAW = frozenset("script style".split())
SKIPPED = frozenset("noscript template svg iframe object textarea title select button".split())
_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*RAW, *SKIPPED)}
OUTSIDE = frozenset("aside dialog fieldset footer form head menu nav".split())
#: Words of a class, id or role that mark an element as no main text.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus footer gdpr "
    "login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: In an article, an id of one of these is an anchor by the words of its heading, no mark.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: These count only outside an article.
OUTER_MARKS = frozenset("header masthead topbar".split())
#: Names that begin so tell of other elements, as has-sidebar does.
_ABOUT = re.compile(r"(?:has|with|without|no|is|not)[_\-]", re.I)
_SPLIT = re.compile(r"[\s_\-:/]+|(?<=[a-z])(?=[A-Z])")


class Block:
    """A text between block-level tags. outside: its element is no main text by a mark (1) or by its name (2)."""

    __slots__ = ("text", "token", "article", "outside", "at", "within")

    def __init__(self, text: str, token: int, article: bool, outside: int, at: int, within: list[str]):
        self.text, self.token, self.article, self.outside, self.at, self.within = text, token, article, outside, at, within


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) >> 1


def read(page: str) -> tuple[list[int], list[Block]]:
    """(tokens in page order, blocks of text). A block's `at` is its place among the tokens."""
    tokens: list[int] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]  # name, path, article, outside
    parts: list[str] = []
    at, left_open = 0, set()

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, article, outside = stack[-1]
            blocks.append(Block(text, _hash(path, text), article, outside, len(tokens), [] if article else [x[1] for x in stack[:MOST_DEEP] if x[0] in HOLDERS]))
            tokens.append(blocks[-1].token)

    while m := _MARK.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closes = m[1] or m[4]
        if name in _END_OF and not closes and name not in left_open:
            end = _END_OF[name].search(page, at)
            if end or name in RAW:
                parts.append(" ")
                at = end.end() if end else len(page)
                continue
            left_open.add(name)  # none is closed after this one, so none need be looked for again
        block = name in BLOCKS
        if name == "br":
            parts.append(" ")
        elif block:
            flush()
        if closes:
            for i in range(len(stack) - 1, max(0, len(stack) - MOST_DEEP), -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in left_open:
            continue
        for i in range(len(stack) - 1, max(0, len(stack) - MOST_DEEP), -1) if name in CLOSES else ():
            # One that the last such element was not closed for stands beside it, not in it.
            if stack[i][0] in CLOSES[name]:
                del stack[i:]
                break
            if stack[i][0] in BLOCKS:
                break
        _, path, article, outside = stack[-1]
        marks = ""
        attributes = m[3] or m[6]
        if attributes and "=" in attributes:
            found = {k.lower(): a or b or c for k, a, b, c in _NAMED.findall(attributes)}
            marks = found.get("class", "")
            if name not in ("html", "body"):
                telling = [v for k, v in found.items() if k != "id" or not article or name not in ANCHORED]
                words = {w.lower() for v in telling for one in v.split() if not _ABOUT.match(one) for w in _SPLIT.split(one)}
                if not words.isdisjoint(MARKS) or not article and not words.isdisjoint(OUTER_MARKS):
                    outside = outside or 1
        if name in VOID:
            tokens.append(_hash(path, name))
            continue
        article = article or name in ("article", "main")
        if name in OUTSIDE or name == "header" and not article:
            outside = 2
        if len(stack) > MOST_DEEP:  # elements left open by the thousand: they stand beside each other
            path = stack[MOST_DEEP][1]
        else:
            path = f"{path}/{name}.{marks}" if marks else f"{path}/{name}"
        stack.append((name, path, article, outside))
        tokens.append(_hash(path))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return tokens, blocks


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.\-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


_SEEN = "host long, token long, is_text boolean, pages long, times long, one long, two long, place double"


def _learn_batches(batches):
    for batch in batches:
        seen: dict[tuple[int, int, bool | None], list] = {}
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens, blocks = read(page)
            texts = {b.token for b in blocks}
            first: dict[int, int] = {}
            for i, t in enumerate(tokens):
                first.setdefault(t, i)
            own = xxhash.xxh64_intdigest(page)
            if not any(b.article for b in blocks):
                held: Counter = Counter()
                for b in blocks:
                    if not b.outside:
                        for depth, path in enumerate(dict.fromkeys(b.within)):
                            held[path, depth] += len(b.text)
                for (path, depth), chars in held.items():
                    x = seen.setdefault((_hash("host", host_of(url)), _hash("in", path), None), [0, 0, 0, 0, 0.0])
                    x[0] += 1
                    x[1] += chars
                    x[4] += depth
            for group in (_hash("host", host_of(url)), 0):
                for t, n in (*Counter(tokens).items(), (0, 1)):
                    if t in texts and not group:
                        continue
                    mark = xxhash.xxh64_intdigest(b"%d,%d" % (own, n))
                    x = seen.setdefault((group, t, t in texts), [0, 0, 0, 0, 0.0])
                    x[0] += 1
                    x[1] += n
                    x[2] += mark & 0x7FFFFFFF
                    x[3] += mark >> 33
                    x[4] += first.get(t, 0) / (len(tokens) or 1)
        rows = [(*k, *v) for k, v in seen.items()]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = [x.split()[0] for x in _SEEN.split(", ")]
        for lo in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 50_000]), kinds)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """host (0: all hosts), classes (tokens in order, the root class first), texts (tokens of text in
    classes), container (the element with most of the text, where pages have no article)."""
    workers_can_import(pages.sparkSession)
    seen = pages.select(F.col("url").cast("string"), whole("html").alias("html")).mapInArrow(_learn_batches, _SEEN)
    sums = seen.groupBy("host", "token", "is_text").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "one", "two", "place")]).where(f"pages >= {PAGES}")
    sums = written(sums, "template-tokens")
    hosts = sums.where("token = 0 AND is_text IS NOT NULL").select("host", F.col("pages").alias("of"))
    held = sums.where("is_text IS NULL")
    most = held.groupBy("host").agg(F.max("times").alias("all"))
    containers = held.join(most, "host").where(F.col("times") >= HOLDS * F.col("all")).groupBy("host").agg(F.max_by("token", F.struct(F.col("place") / F.col("pages"), "times", "token")).alias("container"))
    kept = sums.where("token <> 0 AND is_text IS NOT NULL").join(hosts, "host").where(F.col("pages") >= MOST * F.col("of"))
    text_fits = ~F.col("is_text") | ((F.col("of") >= TEXT_PAGES) & (F.col("pages") >= ALL * F.col("of")) & (F.col("times") == F.col("pages")))
    classes = kept.where(text_fits).groupBy("host", "of", "pages", "times", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "is_text"))).alias("tokens"))
    valid = classes.where("n >= 2")
    rank = F.struct((F.col("pages") == F.col("times")).alias("once"), "pages", "n", "one")
    by_host = valid.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col("tokens"))), asc=False).alias("all"))
    tokens = lambda x: F.transform(x["tokens"], lambda t: t["token"])
    found = by_host.select("host", F.transform("all", tokens).alias("classes"), F.transform(F.filter(F.flatten(F.transform("all", lambda x: x["tokens"])), lambda t: t["is_text"]), lambda t: t["token"]).alias("texts"))
    return found.join(containers, "host", "full_outer")


def in_order(order: list[int], places: dict[int, list[int]]) -> bool:
    """Whether the tokens of a class stand in a page in the class's order, round after round."""
    found = [places[t] for t in order if t in places]
    if not found or len({len(x) for x in found}) > 1:
        return False
    flat = [x[i] for i in range(len(found[0])) for x in found]
    return all(a < b for a, b in zip(flat, flat[1:]))


def extract(page: str, classes: list[list[int]], texts: list[int], container: int | None = None) -> str:
    """The main text, given the template's classes (the root first), its tokens of text, and the element that
    holds the main text where there is no article."""
    tokens, blocks = read(page)
    wanted = {t for c in classes for t in c}
    places: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        if t in wanted:
            places.setdefault(t, []).append(i)
    valid: list[list[int]] = []
    cuts: list[int] = []
    for order in classes:
        if not in_order(order, places):
            continue
        at = sorted(i for t in order for i in places.get(t, ()))
        if not cuts:
            cuts = at
        elif len(places[next(t for t in order if t in places)]) == 1:
            gaps = {sum(c < i for c in cuts) for i in at}
            if len(gaps) > 1 and max(gaps) - min(gaps) == len(cuts):
                continue  # around the whole root: no nesting
        valid.append(order)
    fixed = {t for order in valid for t in order} & set(texts)
    # Slots are the gaps between the root's tokens that hold text the template doesn't have; what the
    # template has is dropped in them too. Tag rules, then the container, choose among the texts of slots.
    able = [b for b in blocks if not b.outside] or [b for b in blocks if b.outside < 2]  # marks that leave nothing tell nothing
    free = [b for b in able if b.token not in fixed]
    chosen = free or able  # all of it is template: a page that most of its host's pages are copies of it
    if any(b.article for b in chosen):
        chosen = [b for b in chosen if b.article]
    elif container is not None:
        known: dict[str, int] = {}
        place = lambda p: known[p] if p in known else known.setdefault(p, _hash("in", p))
        chosen = [b for b in chosen if any(place(p) == container for p in b.within)] or chosen
    return "\n".join(b.text for b in chosen)


def _extract_batches(batches):
    for batch in batches:
        rows = [extract(page, classes or general or [], texts or [], container) for page, classes, texts, container, general in zip(*(c.to_pylist() for c in batch.columns[2:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of pages(page_id, url, html)."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole("html").alias("html"))
    found = written(templates(pages), "templates")
    general = found.where("host = 0").select("classes").collect()  # tags of most pages: one row
    own = found.where("host <> 0")
    size = own.agg(F.sum(F.size(F.flatten("classes")).cast("long"))).first()[0] or 0
    keyed = pages.mapInArrow(_host_batches, "page_id long, url string, html string, host long")
    joined = keyed.join(F.broadcast(own) if size <= FEW_TOKENS else own, "host", "left")
    pooled = F.from_json(F.lit(str([list(x) for x in general[0]["classes"]] if general else [])), "array<array<bigint>>")
    return joined.select("page_id", "url", "html", "classes", "texts", "container", pooled.alias("general")).mapInArrow(_extract_batches, "page_id long, url string, text string")


def _host_batches(batches):
    for batch in batches:
        host = [_hash("host", host_of(u)) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(host, pa.int64())], names=["page_id", "url", "html", "host"])


def op5_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
