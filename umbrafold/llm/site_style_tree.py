"""Main text of web pages by a site style tree.

The pages of a host are merged by the paths of their elements (names with class, id and role, digits left out). For an element,
its presentations are the sequences of its children; for a block of text, its contents. Over a host of m pages
a node's presentation importance is the entropy of its presentations to the base m, and a text node's content importance is 1 less the
mean of log n / log m, n being the number of pages that have a content: what all pages share says little. A
branch's importance is the mix of both. On a page with an article a weight is added inside it and taken off outside it. Each page then
loses the branches that stay below the threshold. Branches that are named as menus, comments and the like go whatever their importance, since comments differ from
page to page as articles do; where such a word only qualifies another one (share-price), it is a prior: NAMED_ONLY is taken off and the importance
decides. Equal pages of a host count once; a host of one page tells nothing, so each branch's importance is the threshold there and the names decide.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import staged

LEAST = 0.5
CONTENT_SHARE = 0.75
INSIDE, OUTSIDE = 0.2, -0.2  # what an article adds to the importance of its blocks and of the page's other blocks
NAMED_ONLY = 0.2

# What HTML's element names and common class names mean.
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe noscript noembed xmp svg math".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
MAIN = frozenset("article main".split())
NOISE = frozenset("aside button dialog footer head label menu nav object select".split())
NOISE_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification "
    "pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# words that say where or of what form a part is: in a class name a word of NOISE_NAMES stays its meaning beside them
FORM_NAMES = frozenset("area articles bar block bottom box button col column container content first fixed float form global group holder inline inner item items last left link links list main mobile module outer page panel post posts primary right row secondary section site small stories text title top unit wrap wrapper".split())
MAIN_NAMES = frozenset("article articlebody entry post story".split())
NAMED = frozenset("blockquote dd details div dl li main ol section table tbody td tr ul".split())  # elements that such a name can make an article
NEARLY_ALL = 0.8
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*+)[^<>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("children", "form", "main", "name", "noise", "path", "weak")

    def __init__(self, name: str, path: int, noise: bool = False, main: bool = False, weak: bool = False, form: int = 0):
        self.name, self.path, self.noise, self.main, self.weak, self.form, self.children = name, path, noise, main, weak, form, xxhash.xxh64()


def named(attributes: str) -> tuple[list[str], int]:
    """The words of class, id and role, and what they say: 3 that the element is noise, 2 that it is a header, 1 that a word of noise qualifies another, 0 none of these.

    A name counts as noise if its last word that isn't one of form or place is a word of noise.
    """
    words, says = set(), 0
    for _, value in ATTRIBUTE.findall(attributes):
        for token in value.strip("\"'").split():
            own = [w.lower() for w in NAME.findall(token)]
            words.update(own)
            if not NOISE_NAMES.isdisjoint(own) or "header" in own:
                head = next((w for w in reversed(own) if w not in FORM_NAMES), "")
                says = max(says, 3 if head in NOISE_NAMES else 2 if head == "header" else 0 if NOISE_NAMES.isdisjoint(own) else 1)
    return sorted(words), says


def _child(parent: Element, name: str, attributes: str, at: int = 0) -> Element:
    words, says = named(attributes) if attributes else ([], 0)
    sign = f"{name} {' '.join(words)}"
    parent.children.update(sign.encode())
    main = parent.main or name in MAIN or (name in NAMED and not MAIN_NAMES.isdisjoint(words))
    noise = parent.noise or name in NOISE or says == 3 or ((name == "header" or says == 2) and not main)
    weak = parent.weak or says == 1
    if name in ("body", "html"):
        noise, weak = parent.noise, parent.weak
    form = parent.form or (at if name == "form" else 0)
    return Element(name, xxhash.xxh64_intdigest(sign.encode(), parent.path), noise, main, weak, form)


Block = tuple[int, int, str, bool, bool, bool]


def parse(source: str, root: int = 0) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks (path, parent's path, text, noise, main, weak) in page order, and presentations (path, children) of the elements.

    A form is noise unless it stands around nearly all text that is not noise otherwise.
    Paths are 64-bit hashes that start from root, the host's hash. Elements that are never closed end with their parents; a paragraph ends where a block begins.
    """
    stack = [Element("", root)]
    blocks: list[Block] = []
    forms: list[int] = []
    styles: list[tuple[int, int]] = []
    piece: list[str] = []
    raw, at = "", 0

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in BLOCKS), 0)
                blocks.append((stack[k].path, stack[max(0, k - 1)].path, text, stack[-1].noise, stack[-1].main, stack[-1].weak))
                forms.append(stack[-1].form)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            gone = stack.pop()
            styles.append((gone.path, gone.children.intdigest()))

    for m in TOKEN.finditer(source):
        name = (m[2] or m[5] or "").lower()
        if raw:
            if name == raw and (m[1] or m[4]):
                raw, at = "", m.end()
            continue
        piece.append(source[at : m.start()])
        at = m.end()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br":
                piece.append(" ")
            if name in BLOCKS:
                flush()
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k and (name in BLOCKS or not any(e.name in BLOCKS for e in stack[k:])):
                close(k)
            continue
        if name in RAW:
            raw = "" if m[0].endswith("/>") and name in ("svg", "math") else name
            stack[-1].children.update(name.encode())
            continue
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph, or item of the same kind, ends here
                if stack[k].name == "p" or (name in CLOSED_BY_SAME and stack[k].name in ((name, "dt", "dd") if name in ("dt", "dd") else (name, "td", "th") if name in ("td", "th") else (name,))):
                    close(k)
                    break
                if stack[k].name in BLOCKS and not (name in CLOSED_BY_SAME and stack[k].name not in CLOSED_BY_SAME[name] and name == "tr"):
                    break
        if name in VOID:
            if name == "br":
                piece.append(" ")
            stack[-1].children.update(name.encode())
            continue
        stack.append(_child(stack[-1], name, m[3] or "", m.end()))
    if not raw:
        piece.append(source[at:])
    flush()
    close(1)
    if any(forms):
        held: dict[int, int] = {}
        for b, f in zip(blocks, forms, strict=True):
            held[f] = held.get(f, 0) + (0 if b[3] else len(b[2]))
        whole = NEARLY_ALL * sum(held.values())
        blocks = [(p, q, t, n or (f > 0 and held[f] < whole), k, w) for (p, q, t, n, k, w), f in zip(blocks, forms, strict=True)]
    return blocks, styles


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _host(url: str | None) -> int:
    m = HOST.match(url or "")
    return xxhash.xxh64_intdigest((m[1].lower() if m else "").encode("utf-8", "surrogatepass"))


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


PARSED = "key long, host long, page long, blocks array<struct<path:long,parent:long,content:long,open:boolean,weak:boolean>>, styles array<struct<path:long,style:long>>"


def _parse(batches):
    block = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("content", pa.int64()), ("open", pa.bool_()), ("weak", pa.bool_())])
    style = pa.struct([("path", pa.int64()), ("style", pa.int64())])
    for batch in batches:
        hosts, pages, blocks, styles = [], [], [], []
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            root = _host(url)
            own, shown = parse(source or "", root)
            hosts.append(_signed(root))
            pages.append(_hash(source or ""))
            blocks.append([{"path": _signed(p), "parent": _signed(q), "content": _hash(t), "open": not n, "weak": w} for p, q, t, n, _, w in own])
            styles.append([{"path": _signed(p), "style": _signed(x)} for p, x in shown])
        yield pa.record_batch([batch.column("key"), pa.array(hosts), pa.array(pages), pa.array(blocks, pa.list_(block)), pa.array(styles, pa.list_(style))], ["key", "host", "page", "blocks", "styles"])


def _entropy(parsed: DataFrame, kind: str, value: str) -> DataFrame:
    """(host, path, total, weighted): over the values of a path, the sums of n and of n log n, n being the number of different pages with the value."""
    each = parsed.select("host", "page", F.explode(kind).alias("x")).select("host", "page", "x.path", F.col(f"x.{value}").alias("value")).distinct()
    n = each.groupBy("host", "path", "value").agg(F.count("*").alias("n"))
    return n.groupBy("host", "path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("weighted"))


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hosts' merged trees: (path, content) importance of text nodes and (path, presentation) importance of elements, 0 to 1."""
    pages = parsed.groupBy("host", "page").agg(F.count("*").alias("copies")).groupBy("host").agg(F.log(F.count("*")).alias("log_m"))
    contents = _entropy(parsed, "blocks", "content").join(pages, "host")
    content = F.when(F.col("log_m") > 0, 1 - F.col("weighted") / F.col("total") / F.col("log_m")).otherwise(1.0)
    styles = _entropy(parsed, "styles", "style").join(pages, "host")
    presentation = F.when(F.col("log_m") > 0, (F.log("total") - F.col("weighted") / F.col("total")) / F.col("log_m")).otherwise(1.0)
    return contents.select("path", content.alias("content")), styles.select("path", presentation.alias("presentation"))


def low_branches(parsed: DataFrame, least: float = LEAST) -> DataFrame:
    """(path, importance) of the text nodes that may be too low on some page, menus and the like left out. A host of one page has one row instead, of path ~host and importance least."""
    contents, styles = style_tree(parsed)
    open_nodes = parsed.select("host", F.explode("blocks").alias("b")).where("b.open").select("host", "b.path", "b.parent", "b.weak").distinct()
    alone = parsed.groupBy("host").agg((F.min("page") == F.max("page")).alias("alone"))
    several = open_nodes.join(alone.where("NOT alone"), "host", "left_semi")
    weighed = several.join(contents, "path").join(styles.withColumnRenamed("path", "parent"), "parent", "left")
    importance = CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.coalesce("presentation", F.lit(1.0))
    low = weighed.groupBy("path").agg(F.min(importance).alias("importance"), F.max("weak").alias("weak"))
    low = low.where(F.col("importance") < least - OUTSIDE + F.when(F.col("weak"), NAMED_ONLY).otherwise(0.0)).select("path", "importance")
    return low.union(alone.where("alone").select(F.bitwise_not("host"), F.lit(least)))


def weighed(source: str, root: int, low: np.ndarray, importance: np.ndarray | None = None) -> tuple[list[Block], np.ndarray]:
    """The page's blocks that names leave open, and the importance of each; low: sorted paths, of importance 0 if that is not given.

    Branches with an article's name are the page's article only if they hold the larger share of its important text.
    """
    blocks = [b for b in parse(source, root)[0] if not b[3]]
    weight = np.ones(len(blocks))
    if len(low) and blocks:
        paths = np.array([_signed(b[0]) for b in blocks] + [~_signed(root)])
        at = np.minimum(np.searchsorted(low, paths), len(low) - 1)
        told = np.where(low[at] == paths, 0.0 if importance is None else importance[at], 1.0)
        weight = told[:-1] if told[-1] == 1 else np.full(len(blocks), told[-1])
    weight = weight - NAMED_ONLY * np.array([b[5] for b in blocks], bool)
    inside = np.array([b[4] for b in blocks], bool)
    important = weight * np.array([len(b[2]) for b in blocks])
    if 2 * important[inside].sum() > important.sum():
        weight = weight + np.where(inside, INSIDE, OUTSIDE)
    return blocks, weight


def kept_text(source: str, root: int, low: np.ndarray, importance: np.ndarray | None = None, least: float = LEAST) -> str:
    """The page's text without the branches whose names or importance are low."""
    blocks, weight = weighed(source, root, low, importance)
    return "\n".join(b[2] for b, w in zip(blocks, weight.tolist(), strict=True) if w >= least - 1e-9)


def main_texts(pages: DataFrame, least: float = LEAST, at_once: int = 4_000_000) -> DataFrame:
    """pages(page_id, url, html, ...) to (page_id, url, text, n_chars).

    Blocks stand in page order, joined by line feeds; white space inside a block is one space. A null or empty page, and one without a block that is
    kept, has an empty text. Rows with null or repeated ids are each extracted; a null url makes the host "". Other columns are ignored.
    The low branches, 16 bytes each, go to every task if they are at most `at_once`; else they are joined with the pages that have them.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))
    parsed = staged(own.select("key", "url", "html").mapInArrow(_parse, PARSED), "parsed")
    low = staged(low_branches(parsed, least), "low")
    empty = np.zeros(0, np.int64), np.zeros(0)
    if low.count() <= at_once:
        table = low.toArrow().sort_by("path")
        shared = pages.sparkSession.sparkContext.broadcast((table["path"].to_numpy(), table["importance"].to_numpy()))
        ready = own.withColumn("low", F.lit(None).cast("array<struct<path:long,importance:double>>"))
    else:
        shared = None
        paths = F.concat(F.transform("blocks", lambda b: b["path"]), F.array(F.bitwise_not("host")))
        each = parsed.select("key", F.explode(F.array_distinct(paths)).alias("path")).distinct().join(low, "path")
        each = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("path", "importance"))).alias("low"))  # as many as fit one page
        ready = own.join(each, "key", "left")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("url", "html", "low")), strict=True)
            texts = []
            for url, source, own_low in rows:
                told = shared.value if shared else (np.array([x["path"] for x in own_low], np.int64), np.array([x["importance"] for x in own_low])) if own_low else empty
                texts.append(kept_text(source or "", _host(url), *told, least))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ready.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
