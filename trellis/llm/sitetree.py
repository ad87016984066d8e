"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element is known by its path of
labels (tag, class and id, digits replaced), and holds the styles its pages give
it (the sequence of its children's labels) and the texts they put there. An
element's presentation matters as much as its styles vary, its content as much as
its texts do: both are entropies over the host's pages, taken relative to the
largest possible one. An element's importance mixes its own presentation with the
content below it, which counts less the deeper it lies. A branch in which nothing
reaches ``threshold`` says the same on page after page and is removed from each.

A host with few pages says little, so known boilerplate goes by tag, role and
class first, and a page that marks its article keeps to it. A class, id or role is
only a hint: an article below such an element is read all the same, and where the
host has enough pages an important branch stays whatever its name. On a page with
an article that no name marks, only a marked branch with most of its text does.

On Spark the tree is never built: one pass emits (host, path, feature) counts,
summed map-side and then by key, so a host with a third of all pages is as many
keys as any other; entropies are sums over those counts. The removed paths of a
host are bounded by its templates; they go to the pages by a join on the host,
broadcast when counted to be few. A second pass cuts each page's text.

Defined results: a null or empty html and a page without article text give an
empty text; a null url is a host of its own; repeated rows and copies of a page
each get a row and count as one page of their host; an empty table gives an empty table; extra columns are kept in
``row`` and ignored by the query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import join_checked, map_arrow, shared_table, with_row

#: Importance below which a branch goes, and the least pages that can tell.
THRESHOLD = 0.5
LEAST_PAGES = 8
#: Weight of what lies one level deeper.
DECAY = 0.9
#: Labels and characters of a label that a path spells out: a longer label ends in a
#: hash of the whole, and what lies deeper is one more label, a hash of the rest of its
#: path. Different branches have different paths, whatever their labels and depth.
DEPTH, LABEL = 64, 80
#: Distinct (host, path, feature) that a task gathers before it passes them on.
GATHER = 300_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript noframes iframe template xmp svg math canvas object audio video select datalist".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
_NOISE = frozenset("head nav footer aside form menu dialog button fieldset".split())
_ROOT = frozenset(("article", "main"))
#: Words of class, id and role names that mark what is not the article.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notification alert popup modal overlay comment "
    "comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login widget toolbar pagination pager search complementary contentinfo skip".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
          "option": ("select",), "p": ("table", "td", "th", "button", "object")}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """(label part of class and id, whether names mark boilerplate, whether hidden)."""
    label, noise, hidden = [], False, False
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            label += [name[0] + "." + re.sub(r"\d+", "0", x) for x in sorted(value.split())]
        if name in ("class", "id", "role"):
            noise |= any(w.lower() in _HINTS for w in _WORD.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return "".join(label), noise, hidden


def _hashed(text: str) -> str:
    from xxhash import xxh64_hexdigest

    return "~" + xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _below(path: str, label: str, depth: int) -> str:
    """The path of the element ``label`` in the one at ``path``, which is ``depth`` deep."""
    if depth < DEPTH:
        return f"{path}/{label}"
    if depth == DEPTH:
        return f"{path}/{_hashed(label)}"
    spelled, _, rest = path.rpartition("/")
    return f"{spelled}/{_hashed(f'{rest}/{label}')}"


class Page:
    """The blocks of one page in order, and the labels of each path's children."""

    def __init__(self, html: str):
        #: (path, text, boilerplate by tag or hidden, inside the article, characters in
        #: links, paths marked by name, and those above the article)
        self.blocks: list[tuple[str, str, bool, bool, int, tuple[str, ...], tuple[str, ...]]] = []
        self.children: dict[str, list[str]] = {"": []}
        #: Paths that a name marks.
        self.marked: set[str] = set()
        self._parse(html)

    def _parse(self, html: str) -> None:
        # open elements: tag, path, boilerplate, inside the article, path of its block, depth,
        # marked paths, those above the article, inside more than <main>
        stack: list[tuple] = [("", "", False, False, "", 0, (), (), False)]
        opened: Counter[str] = Counter()
        text: list[str] = []
        links = linked = 0
        at, size = 0, len(html)

        def flush() -> None:
            nonlocal linked
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                self.blocks.append((stack[-1][4], line, stack[-1][2], stack[-1][3], linked, stack[-1][6], stack[-1][7]))
            linked = 0

        def add(piece: str) -> None:
            nonlocal linked
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece)

        def pop_to(k: int) -> None:
            nonlocal links
            if any(e[0] in _BLOCK for e in stack[k:]):
                flush()
            links -= sum(e[0] == "a" for e in stack[k:])
            opened.subtract(e[0] for e in stack[k:])
            del stack[k:]

        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "br":
                    flush()
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if stack[k][0] in ("table", "td") and tag not in ("table", "tbody", "tr", "body", "html"):
                        break
                continue
            raw = m[3] if m[2] else m[6]
            if tag in _BLOCK:
                flush()
                closes = _CLOSES.get(tag, ()) + (() if tag in ("br", "td", "th", "tr", "option") else ("p",))
                for name in closes:
                    for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                        if stack[k][0] == name:
                            pop_to(k)
                            break
                        if stack[k][0] in _SCOPE.get(name, ()):
                            break
            _, path, noise, inside, holder, depth, marks, above, deep = stack[-1]
            label, marked, hidden = _attributes(raw) if raw and not raw.isspace() else ("", False, False)
            label = (tag + label).replace("/", "")
            if len(label) > LABEL:
                label = label[:LABEL] + _hashed(label)
            self.children.setdefault(path, []).append(label)
            if tag in _VOID or raw.endswith("/") and tag not in _BLOCK:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
                continue
            marked &= tag not in ("html", "body")
            root = tag in _ROOT or "itemprop" in raw and "articleBody" in raw
            noise = noise or (hidden and tag not in ("html", "body") and not (root and not inside)) or tag in _NOISE or tag == "header" and not inside
            links += tag == "a"
            path = _below(path, label, depth)
            self.children.setdefault(path, [])
            if root and not deep and not noise and not (marked and (marks or inside)):
                above, marks = above + marks, ()  # an article below marked elements
                inside, deep = True, tag != "main"
            elif marked:
                self.marked.add(path)
                marks = marks if path in marks else marks + (path,)
            opened[tag] += 1
            stack.append((tag, path, noise, inside, path if tag in _BLOCK else holder, depth + 1, marks, above, deep))
        flush()

    def text(self, removed: frozenset[str] | set[str] = frozenset(), important: frozenset[str] | set[str] = frozenset()) -> str:
        """The main text, without the branches at the paths ``removed``. Names do not
        mark those at the paths ``important``."""
        seen = [b for b in self.blocks if not b[2]]
        article = [b for b in seen if b[3] and not b[6]]
        if any(not b[5] for b in article):
            most = Counter()
            for b in article:
                most.update(dict.fromkeys(b[5], len(b[1])))
            size = sum(len(b[1]) for b in article)
            kept = [b for b in article if all(m in important and 2 * most[m] > size for m in b[5])]
        else:
            kept = [b for b in seen if all(m in important for m in b[5])]
            if any(b[3] for b in kept) and all(b[3] or b[5] for b in kept):
                kept = [b for b in kept if b[3]]
            else:  # no article, or one below a mark: lists of links are menus
                kept = [b for b in kept if b[3] or 2 * b[4] <= len(b[1])] or kept
        if removed:
            kept = [b for b in kept if not any(p in removed for p in branches(b[0]))] or kept
        return " ".join(b[1] for b in kept)


def branches(path: str) -> list[str]:
    """The path and the paths above it."""
    out = []
    while path:
        out.append(path)
        path = path.rpartition("/")[0]
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _weighted(pages: DataFrame) -> DataFrame:
    """(host, html) to (host, html, copies: pages of the host with the same html)."""
    page = [F.xxhash64("html").alias("page"), F.octet_length("html").alias("size")]
    rows = pages.select("host", F.col("html").cast("string").alias("html")).where("html != ''")
    many = shared_table(rows.select("host", *page).groupBy("host", "page", "size").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "page-copies")
    return join_checked(rows.select("host", "html", *page), many, ["host", "page", "size"], "left").select(
        "host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))


def site_features(pages: DataFrame) -> DataFrame:
    """(host, html) to (host, path, feature, is_text, n): on how many of the host's
    distinct pages the path has that style or text; where a name marks it
    (``is_text`` null). Each of a page's copies adds its share to n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def passed(seen: Counter) -> pa.RecordBatch:
            host, path, feature, is_text = zip(*seen) if seen else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(feature, pa.int64()),
                                               pa.array(is_text, pa.bool_()), pa.array([float(n) for n in seen.values()], pa.float64())],
                                              ["host", "path", "feature", "is_text", "n"])

        seen: Counter = Counter()
        for b in batches:
            for host, html, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                page = Page(html)
                found = {(host, path, xxh64_intdigest("|".join(x)) - (1 << 63), False) for path, x in page.children.items()}
                found.update((host, x[0], xxh64_intdigest(x[1]) - (1 << 63), True) for x in page.blocks)
                found.update((host, path, 0, None) for path in page.marked)
                seen.update(found if copies == 1 else dict.fromkeys(found, 1 / copies))
                if len(seen) > GATHER:
                    yield passed(seen)
                    seen = Counter()
        yield passed(seen)

    # the shares of all copies make one, but for rounding
    return _weighted(pages).transform(
        map_arrow, run, "host string, path string, feature long, is_text boolean, n double").groupBy(
        "host", "path", "feature", "is_text").agg(F.round(F.sum("n")).cast("long").alias("n"))


def importance(features: DataFrame) -> DataFrame:
    """(host, path, pages, importance, most: the largest content importance in the
    branch, marked: by name on some page) of every branch that holds text."""
    n_log = F.col("n") * F.log("n")
    at = features.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("is_text"), F.col("n"))).alias("pages"),
        F.sum(F.when(~F.col("is_text"), n_log)).alias("style_log"),
        F.sum(F.when(F.col("is_text"), F.col("n")).otherwise(0)).alias("texts"), F.sum(F.when(F.col("is_text"), n_log)).alias("text_log"),
        F.max(F.col("is_text").isNull()).alias("marked"))
    spread = F.log(F.greatest("pages", F.lit(2)))
    rated = at.select(
        "host", "path", "pages", "texts", "marked", ((F.log("pages") - F.col("style_log") / F.col("pages")) / spread).alias("presentation"),
        (1 - F.col("text_log") / F.col("texts") / spread).alias("content"))
    # content below each branch, by the depth at which it lies
    steps = F.split(F.col("path"), "/")
    above = F.explode(F.sequence(F.lit(2), F.size(steps))).alias("level")
    below = (rated.where("texts > 0").select("host", "content", steps.alias("steps"), above)
             .select("host", F.array_join(F.slice("steps", F.lit(1), F.col("level")), "/").alias("path"), "content",
                     F.pow(F.lit(DECAY), F.size("steps") - F.col("level")).alias("weight"))
             .groupBy("host", "path").agg((F.sum(F.col("content") * F.col("weight")) / F.sum("weight")).alias("content_below"),
                                          F.max("content").alias("most")))
    mixed = (1 - DECAY) * F.col("presentation") + DECAY * F.col("content_below")
    return rated.join(below, ["host", "path"]).select("host", "path", "pages", mixed.alias("importance"), "most", "marked")


def main_texts(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` (url, html, ...) to (row: all other columns and url, text)."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"]).alias("row"),
                        F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    low = F.greatest("importance", "most") < threshold
    told = importance(site_features(rows)).where((F.col("pages") >= least_pages) & (low | F.col("marked")))
    removed = told.groupBy("host").agg(F.collect_set(F.when(low, F.col("path"))).alias("removed"),  # bounded by the host's templates
                                       F.collect_set(F.when(~low, F.col("path"))).alias("important"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, gone, kept = None, frozenset(), frozenset()
        for b in batches:
            texts = []
            for html, *paths in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if paths != last:
                    last, gone, kept = paths, frozenset(paths[0] or ()), frozenset(paths[1] or ())
                texts.append(Page(html).text(gone, kept) if html else "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "text"])

    removed = shared_table(removed, "removed-branches")
    joined = join_checked(rows, removed, "host", "left").select("row", "html", "removed", "important")
    return joined.transform(map_arrow, run, with_row(joined, "text string"))
