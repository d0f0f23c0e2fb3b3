"""Main text of web pages by equivalence-class template deduction.

First pass: each page becomes tokens, which are block elements by their path (tags, classes and ids from the root) and the
texts of blocks, those inside articles as a kind of their own. A token's occurrence vector over its host's pages is summed
up as an order-free hash of (page, count), so vectors of any length are aggregated without gathering a host's pages
anywhere. Tokens of one host with equal vectors form an equivalence class, which is valid if it has at least two tokens and
occurs on enough of the host's pages. Within a class tokens are ordered by where they stand on average; classes nest by their
elements. A text inside an article needs more pages, and equal pages count once for it: what few pages or copies share
there may be content. Elements also carry how much text, and how much of it in links, they hold on all pages.

Second pass: the valid classes are the host's template, and what they don't fix are its slots. A class whose tokens aren't all
there in the template's order is passed over on that page. The template's content region is the innermost element that
holds most of the text that varies and isn't in links; of the elements around it, one marked as an article or main breaks the
tie, and without such a mark it is widened as long as no slot that is constant, linked or marked as something else would
come in. The texts of a page under that element are its content; texts that belong to the template are none, unless the
region holds nothing else, nor are elements that tags, roles or whole class names mark as menus, footers, sidebars, notices,
adverts, forms or reader comments. Such marks never drop an element that holds most of a page's text outside links and
around which no article stands elsewhere, as wrappers have such names too. Pages without the region, such as those of a host
with too few pages for a template, have their marked articles, and without any the blocks that aren't marked as something
else and aren't mostly links.

Templates go to the executors whole while they are under ``TEMPLATE_BYTES``, and beyond that by a join on the host, whose
pages are salted. A host's template holds tokens that half of its pages have, so its size is that of a page.

Defined results: null and empty pages give an empty text; a null or malformed address is a host of its own; pages of any
length are read whole; unclosed and misnested elements are closed as browsers do; a page that is cut off gives what it has;
of elements with equal text the first in order of their paths' hashes is the region; repeated rows are extracted each for
itself; no rows give no rows; other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune, written

#: A template's classes occur on at least so many pages, and on this share of the host's pages.
LEAST_PAGES, LEAST_SHARE = 4, 0.5
#: A text inside an article is the template's from so many different pages on.
LEAST_INSIDE = 8
TEMPLATE_BYTES = 32 << 20
#: Tasks that a host's pages go to in a join, at most, and tokens of templates that a task remembers.
SALTS, KEPT_TOKENS = 64, 200_000
MOST_LINKS = 0.5

# HTML's element kinds.
RAW = frozenset("script style textarea title noscript iframe template svg object select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr rp rt".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
OUTER = frozenset("nav aside form footer dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead
cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist replies disqus""".split())
#: Names that count where neither template nor marks tell what the content is.
OUTSIDE = frozenset("header banner topbar alert subscribe subscription newsletter signup social share sharing related recommended recommendations reply respond widget toolbar pagination pager login search form".split())
#: A class that begins or ends with one of these tells of another element, or of a state.
BEFORE = frozenset("has no not with without is non hide show js can".split())
AFTER = frozenset("open opened closed active inactive enabled disabled visible hidden shown on off expanded collapsed free less aware left-open".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


class Node:
    """An element: its path's hash, its parent, what its own marks say, and what holds for its texts in the end."""

    __slots__ = ("tag", "path", "parent", "bad", "begins", "outer", "text", "marked", "dropped", "article", "above", "seen")

    def __init__(self, tag: str, path: int, parent: Node | None, bad: bool, begins: bool, outer: bool) -> None:
        self.tag, self.path, self.parent, self.bad, self.begins, self.outer = tag, path, parent, bad, begins, outer
        self.text = self.marked = 0  # characters that aren't in links, and those of them in articles
        self.dropped = self.article = self.above = self.seen = False


def _named(label: str, names: frozenset) -> bool:
    """Whether a class or id is one of the names, or has one of them among its words."""
    for own in label.lower().split():
        words = re.split(r"[_-]+", own)
        if not names.isdisjoint(words) and words[0] not in BEFORE and (len(words) == 1 or words[-1] not in AFTER):
            return True
    return False


def parse(page: str) -> tuple[list[tuple[str, Node, bool, bool]], list[Node]]:
    """The pieces of text of a page in order (text, innermost element, whether in a link, whether a new block begins), and
    its elements, parents first. Time and memory grow with the page, however deep it nests."""
    root = Node("", 0, None, False, False, False)
    stack, solid, counts = [root], [0], Counter()  # open elements, places of those that aren't inline, how often each tag
    pieces, nodes = [], [root]
    at, fresh = 0, True

    def pop(n: int) -> None:
        for node in stack[n:]:
            counts[node.tag] -= 1
        del stack[n:]
        while solid[-1] >= n:
            solid.pop()

    size, match = len(page), _TOKEN.search
    while at < size:
        m = match(page, at)
        start = m.start() if m else size
        if start > at:
            pieces.append((page[at:start], stack[-1], counts["a"] > 0, fresh))
            fresh = False
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, close, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            if counts[tag] > 0:
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                pop(n)
            fresh = fresh or tag not in INLINE
            continue
        if tag not in INLINE:
            fresh = True
            shut = CLOSES.get(tag, ())
            while solid[-1] and (stack[solid[-1]].tag == "p" or stack[solid[-1]].tag in shut):
                pop(solid[-1])
        if tag in VOID:
            continue
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if rest.endswith("/") and tag in RAW:
            continue
        top = stack[-1]
        attributes = {}
        if rest and "=" in rest:
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        role = attributes.get("role", "").lower()
        bad = tag not in ("body", "html") and (tag in OUTER or role in ROLES or bool(label and _named(label, NAMES)))
        outer = top.outer or tag == "header" or bool(label and _named(label, OUTSIDE))
        path = top.path if tag in INLINE else xxhash.xxh64_intdigest(f"{top.path} {tag} {label}") >> 1
        node = Node(tag, path, top, bad, tag in ("article", "main") or role in ("main", "article"), outer)
        stack.append(node)
        nodes.append(node)
        counts[tag] += 1
        if tag not in INLINE:
            solid.append(len(stack) - 1)
    return pieces, nodes


def _judge(pieces: list, nodes: list[Node]) -> None:
    """What holds for each element. Marks don't drop an element with most of the page's text outside links, unless an
    article stands elsewhere: that one is a wrapper."""
    for text, node, link, _ in pieces:
        if not link:
            node.text += len(text.strip())
    for node in nodes:  # parents first: from here on, whether in an article that isn't marked as something else
        node.article = node.begins or (node.parent is not None and node.parent.article)
        node.marked = node.text if node.article else 0
    for node in reversed(nodes[1:]):
        if node.bad and node.begins and not node.parent.article:
            node.marked = 0  # a comment or an advert that is an article
        node.parent.text += node.text
        node.parent.marked += node.marked
    total, articles = nodes[0].text, nodes[0].marked
    for node in nodes[1:]:
        if node.bad and 2 * node.text > total and (node.marked or not articles):
            node.bad = False
        # what an article drops is counted from the article on; what lies above it is kept apart
        node.dropped = node.bad or (node.parent.dropped and not node.begins)
        node.above = node.parent.above or (node.begins and node.parent.dropped)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def text_token(container: int, text: str, inside: bool) -> int:
    """A block text's token; under -1 for texts inside articles."""
    own = xxhash.xxh64_intdigest(f"{container} {text}", seed=1) >> 1
    return -2 - (own >> 1) if inside else own


@dataclass
class Block:
    """A block of text: its element, and whether it is in a link."""

    text: str
    node: Node
    link: bool

    @property
    def path(self) -> int:
        return self.node.path


@dataclass
class Page:
    """A page's blocks of text, its elements (path: times, place, parent, dropped, marked) and the length of texts in links."""

    found: list[Block]
    elements: dict[int, list]
    linked: Counter
    nodes: list[Node]


def read_page(page: str) -> Page:
    pieces, nodes = parse(page)
    _judge(pieces, nodes)
    out, held, state = Page([], {}, Counter(), nodes), [], None

    def flush() -> None:
        if held and (own := _clean("".join(held))):
            out.found.append(Block(own, *state))
        held.clear()

    for piece, node, link, fresh in pieces:
        if fresh or (state and (state[0].dropped, state[0].article) != (node.dropped, node.article)):
            flush()
        if not held:
            state = (node, link)
        held.append(piece)
        if link:
            out.linked[node.path] += len(piece.strip())
        new = []
        while node is not None and not node.seen:
            node.seen = True
            new.append(node)
            node = node.parent
        for node in reversed(new):
            if node.tag and node.tag not in INLINE:
                up = node.parent
                out.elements.setdefault(node.path, [0, len(out.elements), up.path, node.dropped, node.begins and not node.bad])[0] += 1
    flush()
    return out


def page_tokens(page: Page) -> list[tuple]:
    """token, parent, times, place, characters, those in links, whether dropped, whether a text, whether marked as an article."""
    chars: Counter[int] = Counter()
    texts: dict[int, list] = {}
    for i, f in enumerate(page.found):
        chars[f.path] += len(f.text)
        own = texts.setdefault(text_token(f.path, f.text, f.node.article), [f.path, 0, i, 0])
        own[1] += 1
        own[3] += len(f.text)
    out = [(path, up, n, place, chars[path], min(page.linked[path], chars[path]), dropped, False, marked) for path, (n, place, up, dropped, marked) in page.elements.items()]
    return out + [(token, path, n, place, size, 0, False, True, False) for token, (path, n, place, size) in texts.items()]


class Template:
    """A host's valid classes: tokens in order, and the content region that their slots give."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r["place"], r["token"]))
        self.size = len(rows)
        self.classes: dict[tuple, list[int]] = {}  # texts and elements are ordered apart
        for r in rows:
            self.classes.setdefault((r["class"], r["text"]), []).append(r["token"])
        self.texts = {r["token"] for r in rows if r["text"]}
        self.region = self._region([r for r in rows if not r["text"]], [r for r in rows if r["text"]])

    def _region(self, elements: list, texts: list) -> int | None:
        up = {r["token"]: r["up"] for r in elements}
        fixed: Counter[int] = Counter()
        for r in texts:
            fixed[r["up"]] += r["chars"]
        own = {r["token"]: max(r["chars"] - r["links"] - fixed[r["token"]], 0) for r in elements}
        poor = {r["token"] for r in elements if r["dropped"] or 2 * own[r["token"]] < r["chars"]}
        marked = {r["token"] for r in elements if r["marked"]}
        under: dict[int, list[int]] = {}
        order = []  # elements, parents first
        for token in up:
            if up[token] in up and up[token] != token:
                under.setdefault(up[token], []).append(token)
            else:
                order.append(token)
        for token in order:
            order.extend(under.get(token, ()))
        mass = {t: 0 if t in poor else own[t] for t in order}
        size, bad = dict.fromkeys(order, 1), {t: int(t in poor) for t in order}
        for token in reversed(order):  # all that is under an element, itself too
            for child in under.get(token, ()):
                mass[token] += mass[child]
                size[token] += size[child]
                bad[token] += bad[child]
        total = sum(own[t] for t in order if t not in poor)
        heavy = [t for t in order if (t not in poor or size[t] > 1) and 2 * mass[t] > total]
        if not total or not heavy:
            return None
        region = min(heavy, key=lambda t: (size[t], t))
        at = region
        while at not in marked and up[at] in size and up[at] != at:
            at = up[at]
        if at in marked:  # of the elements around the text, a marked one breaks the tie
            return at
        while up[region] in size and up[region] != region and bad[up[region]] == bad[region]:
            region = up[region]
        return region

    def on(self, page: Page) -> tuple[set[int], int | None]:
        """The texts of the template and its region, of the classes that the page follows."""
        place = {path: e[1] for path, e in page.elements.items()}
        words: dict[int, int] = {}
        for i, f in enumerate(page.found):
            words.setdefault(text_token(f.path, f.text, f.node.article), i)
        valid: set[int] = set()
        for (_, text), tokens in self.classes.items():
            at = [(words if text else place).get(t) for t in tokens]
            if None not in at and at == sorted(at):
                valid.update(tokens)
        return self.texts & valid, self.region if self.region in valid else None


def main_text(page: str | Page, template: Template | None = None) -> str:
    """The text of a page's content slots."""
    page = read_page(page) if isinstance(page, str) else page
    fixed, region = template.on(page) if template else (set(), None)

    def content(found: list[Block]) -> list[Block]:
        return [f for f in found if text_token(f.path, f.text, f.node.article) not in fixed] or found

    inside: set[int] = set()
    if region is not None:
        for node in page.nodes:  # parents first
            if node.path == region or id(node.parent) in inside:
                inside.add(id(node))
    slot = [f for f in page.found if id(f.node) in inside and not f.node.dropped]
    if slot:
        return " ".join(f.text for f in content(slot))
    for above in (False, True):  # articles under dropped elements count only if there are no others
        marked = [f for f in page.found if f.node.article and not f.node.dropped and (above or not f.node.above)]
        if marked:
            return " ".join(f.text for f in content(marked))
    rest = [f for f in page.found if not (f.node.dropped or f.node.outer or f.node.article) and text_token(f.path, f.text, False) not in fixed]
    mass: Counter[int] = Counter()
    links: Counter[int] = Counter()
    for f in rest:
        mass[f.path] += len(f.text)
        links[f.path] += len(f.text) * f.link
    return " ".join(f.text for f in rest if links[f.path] <= MOST_LINKS * mass[f.path])


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def templates(hosted: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_inside: int = LEAST_INSIDE) -> DataFrame:
    """host, tokens (array of structs): the tokens of each host's valid equivalence classes."""
    names = ["host", "token", "up", "vector", "place", "chars", "links", "dropped", "text", "marked"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page_hash = xxhash.xxh64_intdigest(page)
                for token, up, n, place, chars, links, dropped, text, marked in [*page_tokens(read_page(page)), (-1, 0, 1, 0, 0, 0, False, False, False)]:
                    rows.append((host, token, up, xxhash.xxh64_intdigest(f"{page_hash} {n}") >> 1, place, chars, links, dropped, text, marked))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)

    rows = hosted.select("host", "html").mapInArrow(run, "host string, token long, up long, vector long, place long, chars long, links long, dropped boolean, text boolean, marked boolean")
    # equal pages have equal vectors
    of = [F.sum(c).alias(c) for c in ("place", "chars", "links")] + [F.min("up").alias("up"), F.max("dropped").alias("dropped"), F.max("text").alias("text"), F.max("marked").alias("marked")]
    same = rows.groupBy("host", "token", "vector").agg(F.count("*").alias("n"), *of)
    sums = same.groupBy("host", "token").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.bit_xor("vector").alias("x"), F.sum(F.shiftright("vector", 31) * F.col("n")).alias("y"), *of)
    sums = written(sums.where(F.col("pages") >= F.when(F.col("token") == -1, 0).otherwise(least_pages)).where((F.col("token") >= -1) | (F.col("kinds") >= least_inside)), "tokens")
    sizes = sums.where("token = -1").select("host", F.col("pages").alias("of"), F.col("kinds").alias("kinds_of"))
    often = sums.where("token <> -1").join(sizes, "host")
    often = often.where(F.when(F.col("token") < -1, F.col("kinds") >= least_share * F.col("kinds_of")).otherwise(F.col("pages") >= least_share * F.col("of")))
    row = F.struct("token", "up", (F.col("place") / F.col("pages")).alias("place"), "chars", "links", "dropped", "text", "marked", F.xxhash64("pages", "x", "y").alias("class"))
    classes = often.select("host", "pages", "x", "y", row.alias("row")).groupBy("host", "pages", "x", "y").agg(F.collect_list("row").alias("rows")).where(F.size("rows") >= 2)
    return classes.groupBy("host").agg(F.flatten(F.collect_list("rows")).alias("tokens"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    tune(pages.sparkSession)
    hosted = _hosted(pages, id_col, url_col, html_col)
    found = written(templates(hosted), "templates")
    size = found.agg(F.sum(F.size("tokens") * 64 + F.length("host") + 32)).first()[0] or 0
    if size <= template_bytes:
        joined = hosted.join(F.broadcast(found), "host", "left")
    else:  # a host with many pages goes to many tasks
        salted = hosted.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "tokens", "host")
    kind = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Template | None] = {}
        held = 0
        for batch in batches:
            out = []
            tokens = batch.column(3)
            for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                if host not in kept:
                    rows = tokens[i].as_py()
                    kept[host] = Template(rows) if rows else None
                    held += len(rows or ()) + 1
                out.append(main_text(page, kept[host]))
                if held > KEPT_TOKENS:
                    kept.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
