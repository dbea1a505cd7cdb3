"""Main text of web pages, with a host suffix array against boilerplate.

Every page is read once into blocks, and each block is one of three kinds. Blocks inside the article that a page marks
(``article``, ``main``; the one with most text) are its text. Elements that by tag or role are menus, headers, footers,
side bars, forms or hidden, and reader comments by their whole label, are furniture and never text. All other blocks are
open, and the host suffix array decides on them.

The token streams of whole pages are concatenated by host. Suffixes that start with ``LONG`` words found on another page
of the host are sorted, range-partitioned over the cluster, into a suffix array, and the common prefix of neighbours from
distinct pages gives the long substrings that pages of the host repeat. An open block whose every word lies in them goes;
blocks with words of their own stay whole.

* A page without a marked article keeps its open blocks that are not covered. A page that would lose all of them is a
  copy rather than boilerplate, and keeps them.
* On a page that marks its article, an open block outside goes unless the array shows its slot (its two innermost
  elements with their classes) to be no template: on hosts of ``HOST_PAGES`` or more, ``SEEN`` or more of its blocks occur
  and a share under ``TEMPLATE`` of them is covered. Then its blocks that are not covered stay. So a line that occurs once
  on its host goes with the slot that elsewhere holds repeats, and where pages are too few to tell, the mark decides.
* Repeats are not held against a marked article, whose passages others may quote; its words do count as another page's.

Defined cases: a null html counts as empty; a page without text gives an empty string; repeated rows give repeated
results; a null url has the empty host; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import bounded, stored, table
from loomframe.session import ship

#: A repeated substring counts from so many words on.
LONG = 8
#: A slot is a template from this share of covered blocks on, judged on hosts of so many pages by so many blocks.
TEMPLATE, HOST_PAGES, SEEN = 0.1, 20, 100
#: Kinds of blocks.
FURNITURE, OPEN, ARTICLE = 0, 1, 2

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video select".split())
DROPPED = frozenset("nav header footer aside form head button menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Whole labels (a class or an identifier) of sections of reader comments.
COMMENTS = frozenset("comment comments commentlist comment-list comments-area comment-section disqus_thread respond".split())
#: Start tags that end an open element of the same kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _labels(attributes: str) -> tuple[bool, str]:
    """Whether an element by its attributes is furniture, and its classes without digits."""
    if not attributes:
        return False, ""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    hidden = found.get("aria-hidden", "").lower() == "true" or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "").lower())
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    furniture = found.get("role", "").lower() in ROLES or bool(hidden) or not COMMENTS.isdisjoint(names)
    return furniture, re.sub(r"\d+", "", ".".join(sorted(found.get("class", "").lower().split())))


def blocks(page: str) -> list[tuple[str, int, str]]:
    """The blocks of a page in order, each with its kind and slot."""
    out: list[tuple[int, str, bool, str]] = []  # article, text, furniture, slot
    stack: list[tuple[str, bool, int, str]] = []  # element, furniture, article, element with its classes
    opened: Counter[str] = Counter()
    text: list[str] = []
    dropped, article, articles, at = 0, 0, 0, 0

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                out.append((article, block, dropped > 0, "/".join(e[3] for e in stack[-2:])))
            text.clear()

    def close(k: int) -> None:
        nonlocal dropped, article
        for name, drop, _, _ in stack[k:]:
            dropped -= drop
            opened[name] -= 1
        article = stack[k][2]
        del stack[k:]

    def find(*names: str) -> int | None:
        """Place of the innermost open element of these names."""
        if any(opened[n] for n in names):
            return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in names)
        return None

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(html.unescape(piece))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            text.append("\n")
        if not closing and name in RAW:
            end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            if end:
                at = page.find(">", end.end() - 1) + 1 or len(page)
            elif name not in ("noscript", "object", "select", "svg", "math", "template"):
                at = len(page)
            if name in BLOCK:
                flush()
            continue
        block = name in BLOCK
        if block:
            flush()
        if name in VOID:
            continue
        if closing:
            k = find(name)
            if k is not None:
                flush()
                close(k)
            continue
        furniture, classes = _labels(attributes)
        drop = name in DROPPED or furniture and name not in ("html", "body", "main")
        main = name in ("article", "main") and not drop
        if not block and not drop:
            continue
        flush()
        if stack and stack[-1][0] == "head" and name != "head":
            close(len(stack) - 1)
        if (name == "body" or main and dropped and not article) and stack:
            close(0)
        if name in ENDS and (k := find(*ENDS[name])) is not None and not any(e[0] in ("ul", "ol", "dl", "table") for e in stack[k:]):
            close(k)
        elif block and name not in ("body", "html") and (k := find("p")) is not None:
            close(k)
        if name == "header" and article and not furniture:
            drop = False  # the title of an article
        stack.append((name, drop, article, f"{name}.{classes}" if classes else name))
        opened[name] += 1
        dropped += drop
        if main and not article:
            articles += 1
            article = articles
    flush()
    size = dict.fromkeys(range(articles + 1), 0)
    for a, block, furniture, _ in out:
        size[a] += 0 if furniture else len(block)
    best = max(range(1, articles + 1), key=lambda a: (size[a], -a), default=0)
    inside = lambda a: ARTICLE if best and size[best] and a == best else OPEN
    return [(block, FURNITURE if furniture else inside(a), slot) for a, block, furniture, slot in out]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, and the blocks of each page with their kinds and slots (empty but for open blocks)."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                said = [blocks(page.as_py()) for page in part.column(2)]
                columns = (
                    pa.array([[b for b, _, _ in page] for page in said], pa.list_(pa.string())),
                    pa.array([[k for _, k, _ in page] for page in said], pa.list_(pa.int8())),
                    pa.array([[s if k == OPEN else "" for _, k, s in page] for page in said], pa.list_(pa.string())),
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["page_id", "url", "blocks", "kinds", "slots"])

    of = dict(pages.dtypes)
    return rows.mapInArrow(run, f"page_id {of['page_id']}, url {of['url']}, blocks array<string>, kinds array<tinyint>, slots array<string>")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def common_prefix(a: Column, b: Column) -> Column:
    """Equal words at the start of two arrays."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _apart(a, b) -> bool:
    """Whether one of two suffixes has a page that the other has not."""
    return a.low != a.high or (a.host, a.low, a.high) != (b.host, b.low, b.high)


def _nearest(rows: DataFrame, edge: Column) -> DataFrame:
    """``rows`` (part, host, suffix, low, high) with ``before`` and ``after``: in its part, the nearest suffixes that have
    a page which the suffix has not."""
    up, down = (Window.partitionBy("part").orderBy(*o) for o in (("host", "suffix"), (F.desc("host"), F.desc("suffix"))))
    for name, order in (("before", up), ("after", down)):
        o = F.col("beside")
        same = (F.col("low") == F.col("high")) & (o["host"] == F.col("host")) & (o["low"] == F.col("low")) & (o["high"] == F.col("high"))
        rows = rows.withColumn("beside", F.lag(edge).over(order)).withColumn(name, F.last(F.when(~F.coalesce(same, F.lit(False)), o), True).over(order)).drop("beside")
    return rows


def suffix_array(rows: DataFrame) -> DataFrame:
    """For each distinct (host, suffix) of ``rows`` (page, host, suffix as words): ``shared``, the longest start it has
    in common with another page of the host.

    Suffixes are sorted by range partitioning. Each is compared with the nearest suffix of another page in each
    direction. Of every range its ends and what is nearest to them are carried on to the others, four rows for each.
    """
    many = F.min("page").alias("low"), F.max("page").alias("high")
    once = rows.groupBy("host", "suffix").agg(*many)
    parts = stored(once.repartitionByRange("host", "suffix").withColumn("part", F.spark_partition_id()), "suffixes")
    edge = F.struct("host", "suffix", "low", "high")
    ends = _nearest(parts, edge).groupBy("part").agg(F.max(F.struct(edge.alias("e"), "before")).alias("last"), F.min(F.struct(edge.alias("e"), "after")).alias("first"))
    ranges = sorted(ends.collect(), key=lambda r: r.part)  # a row for each range
    near = []
    for order, end, other in ((ranges, "last", "before"), (ranges[::-1], "first", "after")):
        carried: list = []
        for r in order:
            near += [(*e, r.part) for e in carried]
            e, beside = r[end].e, r[end][other]
            carried = [e, *([beside] if beside else [c for c in carried if _apart(c, e)][:1])]
    kinds = parts.select("host", "suffix", "low", "high", "part")
    extra = rows.sparkSession.createDataFrame(near, kinds.schema)
    all_ = _nearest(kinds.withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False))), edge)
    best = F.when(F.col("low") != F.col("high"), F.size("suffix")).otherwise(0)
    for name in ("before", "after"):
        o = F.col(name)
        best = F.greatest(best, F.coalesce(F.when(o["host"] == F.col("host"), common_prefix(F.col("suffix"), o["suffix"])), F.lit(0)))
    return all_.where("own").select("host", "suffix", best.alias("shared"))


def _words(text: Column) -> Column:
    return F.split(text, " ")


def _streams(rows: DataFrame, inside: bool, long: int) -> DataFrame:
    """(page, host, words) of what lies in articles, or of all that lies outside.

    Streams break at an article's edge: a block of the other side counts as one empty word, and no window holds one.
    """
    block = lambda b, i: F.when((F.col("kinds")[i] == ARTICLE) == F.lit(inside), b).otherwise("")
    words = _words(F.array_join(F.transform("blocks", block), " "))
    return rows.select("page", host(F.col("url")).alias("host"), words.alias("words")).where(F.size("words") >= long)


def _starts(long: int) -> Column:
    return F.sequence(F.lit(1), F.size("words") - long + 1)


def _named(own: Column, hashes: Column) -> Column:
    """The name of a window from its host and the hashes of its words."""
    return F.xxhash64(own, hashes)


def _outside(rows: DataFrame, long: int) -> DataFrame:
    """(page, host, at, suffix, name) of every ``long`` words in a row outside articles."""
    found = F.transform(_starts(long), lambda i: F.struct(i.alias("at"), F.slice("words", i, long).alias("suffix")))
    each = _streams(rows, False, long).select("page", "host", F.explode(found).alias("w")).select("page", "host", "w.at", "w.suffix")
    return each.where(~F.array_contains("suffix", "")).withColumn("name", _named(F.col("host"), F.transform("suffix", lambda w: F.xxhash64(w))))


def _inside(rows: DataFrame, names: DataFrame, long: int) -> DataFrame:
    """The like of ``_outside`` for the windows of articles that have one of the stored ``names``.

    Words are hashed once each; the words of a window are only cut out where its name is met. Pages by the rows of
    ``names`` met, so most articles go through without a shuffle.
    """
    streams = _streams(rows, True, long)
    hashed = streams.select("page", "host", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    found = F.transform(F.sequence(F.lit(1), F.col("n") - long + 1), lambda i: F.struct(i.alias("at"), _named(F.col("host"), F.slice("hashes", i, long)).alias("name")))
    met = hashed.select("page", F.explode(found).alias("w")).select("page", "w.at", "w.name").join(bounded(names.select("name")), "name")
    met = stored(met.groupBy("page").agg(F.collect_list(F.struct("at", "name")).alias("met")), "names-met")
    cut = streams.join(bounded(met, 1_000_000, "met"), "page").select("page", "host", F.explode(F.transform("met", lambda m: F.struct(m["at"].alias("at"), F.slice("words", m["at"], long).alias("suffix"), m["name"].alias("name")))).alias("w"))
    return cut.select("page", "host", "w.at", "w.suffix", "w.name").where(~F.array_contains("suffix", ""))


def repeated_blocks(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Stored (page, k): the blocks outside articles, of the stored ``rows`` (page, url, blocks, kinds), whose every word
    lies in a long substring that another page of the host repeats.

    A word does so exactly if ``long`` words around it are repeated, so suffixes from every word on, compared to that
    depth, tell it for blocks and passages of any length. Names (hashes) of windows find the suffixes that can have a
    partner; windows of articles only count where a name outside meets them. The array then compares words.
    """
    outside = _outside(rows, long)
    ends = F.min("page").alias("low"), F.max("page").alias("high")
    names = stored(outside.groupBy("name").agg(*ends), "window-names")
    inside = stored(_inside(rows, names, long), "windows-of-articles")
    both = names.unionByName(inside.groupBy("name").agg(*ends)).groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    twice = bounded(stored(both.where("low < high").select("name"), "repeated-names"))
    mark = lambda df, own: df.join(twice, "name").select("page", "host", "at", "suffix", F.lit(own).alias("own"))
    suffixes = stored(mark(outside, True).unionByName(mark(inside, False)), "suffixes-of-pages")
    shared = suffix_array(suffixes).where(F.col("shared") >= long)
    hits = suffixes.where("own").join(shared, ["host", "suffix"]).select("page", "at")
    by_page = Window.partitionBy("page").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(by_page) > long, F.lit(True)).cast("int")
    runs = hits.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_page)).groupBy("page", "run").agg((F.min("at") - 1).alias("start"), (F.max("at") + long - 1).alias("reach"))
    outer = lambda k: F.element_at("kinds", k + 1) != ARTICLE
    sizes = F.transform("blocks", lambda b, k: F.when(outer(k), F.size(_words(b))).otherwise(1))
    placed = rows.select("page", "kinds", F.posexplode(sizes).alias("k", "size")).withColumn("end", F.sum("size").over(Window.partitionBy("page").orderBy("k")))
    placed = placed.where(outer(F.col("k")))
    both = runs.select("page", "start", "reach", F.lit(-1).alias("k"), F.lit(0).cast("long").alias("end")).unionByName(
        placed.select("page", (F.col("end") - F.col("size")).alias("start"), F.lit(None).cast("int").alias("reach"), "k", "end")
    )
    upto = F.last("reach", True).over(Window.partitionBy("page").orderBy("start", "k"))
    return stored(both.withColumn("reach", upto).where("k >= 0 and reach >= end").select("page", "k"), "repeated-blocks")


def _text_blocks(rows: DataFrame, long: int = LONG, host_pages: int = HOST_PAGES, seen: int = SEEN) -> DataFrame:
    """Stored ``rows`` (page, url, blocks, kinds, slots) with ``blocks`` cut down to those of the text.

    Only pages on which the array changes what the markup says (open blocks kept beside an article, or lost without
    one) are joined back, so most text never moves.
    """
    covered = repeated_blocks(rows, long)
    marked = F.array_contains("kinds", F.lit(ARTICLE).cast("tinyint"))
    kind = F.element_at("kinds", F.col("k") + 1)
    with_open = rows.where(F.array_contains("kinds", F.lit(OPEN).cast("tinyint")))
    open_ = with_open.select("page", host(F.col("url")).alias("host"), "kinds", marked.alias("marked"), F.posexplode("slots").alias("k", "slot")).where(kind == OPEN)
    told = stored(open_.drop("kinds").join(covered.withColumn("covered", F.lit(True)), ["page", "k"], "left").fillna(False, "covered"), "open-blocks")
    hosts = stored(rows.groupBy(host(F.col("url")).alias("host")).count().where(F.col("count") >= host_pages).select("host"), "large-hosts")
    slots = told.where("marked").join(bounded(hosts), "host").groupBy("slot").agg(F.avg(F.col("covered").cast("int")).alias("share"), F.count("*").alias("n"))
    content = stored(slots.where((F.col("share") < TEMPLATE) & (F.col("n") >= seen)).select("slot"), "content-slots")
    beside = told.where("marked and not covered").join(bounded(content), "slot", "left_semi").select("page", "k")
    lost = told.where("not marked and covered").select("page", "k")
    changed = stored(beside.unionByName(lost).groupBy("page").agg(F.collect_set("k").alias("changed")), "pages-changed")
    out = rows.join(bounded(changed, 1_000_000, "changed"), "page", "left")
    here = lambda k: F.coalesce(F.array_contains("changed", k), F.lit(False))
    of = lambda k: F.element_at("kinds", k + 1)
    with_article = F.filter("blocks", lambda b, k: (of(k) == ARTICLE) | here(k))
    without = F.filter("blocks", lambda b, k: (of(k) == OPEN) & ~here(k))
    whole = F.filter("blocks", lambda b, k: of(k) == OPEN)
    return out.withColumn("blocks", F.when(marked, with_article).when(F.size(without) > 0, without).otherwise(whole)).drop("changed")


def without_repeats(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Stored ``rows`` (page, url, blocks) of pages without a marked article, without the blocks that pages repeat."""
    kinds = F.transform("blocks", lambda b: F.lit(OPEN).cast("tinyint"))
    told = rows.withColumns({"kinds": kinds, "slots": F.transform("blocks", lambda b: F.lit(""))})
    return _text_blocks(told, long).select(*rows.columns)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    read = parsed(pages).withColumn("page", F.monotonically_increasing_id())
    rows = stored(read, "parsed-pages")
    return _text_blocks(rows).select("page_id", "url", F.array_join("blocks", "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
