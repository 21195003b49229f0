"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one per block, each with a role from its markup:
*noise* (menus, footers, adverts, forms, notices, comments and the like), *text*
(what an ``article`` or ``main`` element holds) or *open*.  Pages are sorted by host
and URL path, and a page's lines, of all roles, are aligned with those of its nearest
neighbours on the host that differ from it, by their longest common subsequence.
Roles break ties: of what the neighbour nearer by path shares, noise and open lines are
deleted; noise that no neighbour has is left out by its role alone.  Lines of an article
stay; with ``within_articles`` those are deleted that the neighbours on both sides have,
if most of the article is not so shared (an article that returns as a whole is a copy).
That is for sites that put their own lines into articles, and off by default: articles
that have a license line or a line of one word in common would lose it.  Two pages that
agree in every line say nothing about each other, so a run of adjacent ones is one
node: nodes are paired, and each page of a node loses the node's lines.

Nodes are dealt by place in the global order, never by host, so a host with a
third of all pages is spread like any other; what a task holds is a block of
``BLOCK`` neighbours, and of each node its first and last page in each range of
the order.  Lines are aligned by 64-bit hashes.

A null html is empty and has an empty text; a null or unreadable URL has an
empty host and path; rows that agree in id, URL and html are one page, whose text each gets.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import bounded, map_batches, written

BLOCK = 64

# Elements by role, and words of class, id and role attributes.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "head", "template", "svg", "math", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "datalist", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "sponsors",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "sidebar", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "masthead", "header", "share", "sharing", "social", "related", "recommended", "recommendations", "toolbar", "pagination", "pager", "login", "search", "copyright", "disclaimer",
    "contentinfo", "complementary", "form",
}
TEXT = {"article", "content", "main", "post", "entry", "story", "body", "text", "page", "title"}
# Words that say how an element is laid out, not what it is; and words after which a name says what is near it.
LAYOUT = {"container", "wrapper", "wrap", "box", "block", "list", "item", "area", "section", "inner", "outer", "content", "body", "text", "main", "holder", "col", "row", "top", "bottom", "left", "right"}
NEAR = {"has", "with", "no", "without", "is", "not", "after", "before", "hide"}

NOISE_LINE, OPEN, MAIN_LINE = 0, 1, 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _noise(attributes: str) -> bool:
    """Whether class, id or role name an element that is no text.

    Each name is judged by itself: it is noise if its first word is, or the last one that does not say how it is laid
    out ("post-comments", "ad-box"); the header of a text is none, nor is what only says that noise is near.  An
    element that has a name of text alone besides ("post", "entry-content") is text.
    """
    noise = False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORD.findall(name)]
            if not words or words[0] in NEAR:
                continue
            if TEXT.issuperset(words):
                return bool(_HIDDEN.search(attributes))
            while len(words) > 1 and words[-1] in LAYOUT:
                words.pop()
            noise = noise or words[0] in NOISE or words[-1] in NOISE and not (words[-1] == "header" and words[0] in TEXT)
    return noise or bool(_HIDDEN.search(attributes))


def lines(page: str) -> list[tuple[str, bool]]:
    """(text, whether an article or main element holds it) of a page's blocks, without noise."""
    return [(text, role == MAIN_LINE) for text, role in blocks(page) if role != NOISE_LINE]


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, role) of a page's blocks."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # block elements that are open: name, dropped, in main
    dropped = main = False

    def end_block() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, NOISE_LINE if dropped else MAIN_LINE if main else OPEN))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            text.append(page[at:upto])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                continue
            end_block()
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                dropped, main = stack[-1][1:] if stack else (False, False)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            continue
        if name in VOID or name in INLINE:
            if name == "br":
                text.append(" ")
            elif name not in INLINE:
                end_block()
            continue
        end_block()
        if name == "p" and any(x[0] == "p" for x in stack[-1:]):
            stack.pop()
            dropped, main = stack[-1][1:] if stack else (False, False)
        if m[3].rstrip().endswith("/") and name in DROPPED:
            continue
        now = name in MAIN and not (name == "article" and _noise(m[3]))
        if not dropped and name not in ("html", "body"):
            # the header of an article is part of it, that of a page is not
            dropped = name in DROPPED or name == "header" and not main or not now and _noise(m[3])
        main = main or now
        stack.append((name, dropped, main))
    end_block()
    return out


def _lcs_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``, bit-parallel."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a.tolist():
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.frombuffer((full & ~v).to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8)
    return np.concatenate(([0], np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))))


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in linear space."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append(j)
        if i == j or k == n:
            continue
        if j - i == 1:
            if (b[k:n] == a[i]).any():
                out.append(i)
            continue
        half = (i + j) // 2
        split = k + int((_lcs_row(a[i:half], b[k:n]) + _lcs_row(a[half:j][::-1], b[k:n][::-1])[::-1]).argmax())
        todo += [(i, half, k, split), (half, j, split, n)]
    return sorted(out)


def _near(a: str, b: str) -> int:
    """Characters that two paths have in common at their start."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range with their place in it, their run of pages that agree, and whether they are its first or last."""
    part = TaskContext.get().partitionId()
    at = run = 0
    before = kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first, runs = [], []
        for host, hashes in zip(batch.column("host").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            first.append((host, hashes) != before)
            run += first[-1]
            runs.append(run)
            before = host, hashes
        n = batch.num_rows
        if kept is not None:
            yield _marked(*kept, first[0])
        kept = batch, part, range(at, at + n), runs, first
        at += n
    if kept is not None:
        yield _marked(*kept, True)


def _marked(batch: pa.RecordBatch, part: int, at: range, runs: list[int], first: list[bool], ends: bool) -> pa.RecordBatch:
    new = [pa.array([part] * len(runs), pa.int64()), pa.array(at, pa.int64()), pa.array(runs, pa.int64()), pa.array(first), pa.array([*first[1:], ends])]
    return pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "part", "at", "run", "first", "last"])


def _shared(block: pd.DataFrame) -> pd.DataFrame:
    """Lines of each own node of a block that its nearest neighbour has too, and those that the neighbours on both sides
    have, for each block of places that the node's pages are in."""
    block = block.sort_values("place", kind="stable").reset_index(drop=True)
    nodes = block.groupby("node", sort=True)
    place, upto = nodes["place"].min().tolist(), nodes["place"].max().tolist()
    node, host, own = list(nodes.groups), nodes["host"].first().tolist(), nodes["own"].first().tolist()
    head, tail = nodes["path"].first().tolist(), nodes["path"].last().tolist()
    hashes = [np.asarray(x, np.int64) for x in nodes["hashes"].first()]
    rows = []
    for i in np.flatnonzero(own).tolist():
        # the last path of the node before and the first of the node after are what stands next to it
        other = [(_near(tail[k], head[i]) if k < i else _near(tail[i], head[k]), -k) for k in (i - 1, i + 1) if 0 <= k < len(host) and host[k] == host[i]]
        if other and len(hashes[i]):
            found = {-k: common(hashes[i], hashes[-k]) for _, k in other}
            nearest = found[-max(other)[1]]
            both = sorted(set(found[i - 1]) & set(found[i + 1])) if len(found) == 2 else []
            if nearest or both:
                rows += [(node[i], k, nearest, both) for k in range(place[i] // BLOCK, upto[i] // BLOCK + 1)]
    kinds = {"node": "int64", "piece": "int64", "shared": "object", "both": "object"}
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate(kinds.items())})


def _closed(page: str, shared: list[int], both: list[int], within: bool) -> tuple[str, int]:
    """A page's text, and how many of its lines differencing has found shared and left out."""
    found, gone = blocks(page), set(shared)
    article = [k for k, (_, role) in enumerate(found) if role == MAIN_LINE]
    site = set(both).intersection(article) if within else set()
    if 2 * len(site) >= len(article):
        site = set()
    keep = [role == MAIN_LINE and k not in site or role == OPEN and k not in gone for k, (_, role) in enumerate(found)]
    return "\n".join(t for (t, _), k in zip(found, keep, strict=True) if k), sum(not keep[k] for k in gone | site)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", within_articles: bool = False) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that differencing found shared and left out) of every row."""
    spark = pages.sparkSession
    bounded(spark)
    pages = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def cut(batch: pa.RecordBatch):
        found = [[_hash(t) for t, _ in blocks(x or "")] for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["page_id", "url", "key", "hashes"])

    pages = pages.withColumn("key", F.xxhash64("html"))
    # only hashes of lines are dealt and sorted; a page is cut up again where its text is made
    cut_up = map_batches(pages, cut, "page_id long, url string, key long, hashes array<long>").dropDuplicates(["page_id", "url", "key"])
    url = F.coalesce("url", F.lit(""))
    keys = cut_up.select(
        "page_id",
        "url",
        "key",
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1).alias("path"),
        "hashes",
    )
    order = ["host", "path", "page_id", "url", "key"]
    # a global order: range partitions, then each row's place in its partition
    marked = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = T.StructType([*keys.schema.fields, *[T.StructField(c, T.LongType()) for c in ("part", "at", "run")], *[T.StructField(c, T.BooleanType()) for c in ("first", "last")]])
    spread = written(marked.mapInArrow(_runs, marks))
    ends = lambda of: of(F.struct("host", F.xxhash64("hashes").alias("lines")), "at")
    ranges = spread.where(F.col("first") | F.col("last")).groupBy("part").agg(F.max("at").alias("at"), F.max("run").alias("run"), ends(F.min_by).alias("head"), ends(F.max_by).alias("tail"))
    starts, total, node, before = [], 0, 0, None
    for r in sorted(ranges.collect(), key=lambda r: r["part"]):
        # a range may begin with copies of the page that the one before ends with
        node -= before == r["head"]
        starts.append((r["part"], total, node))
        total, node, before = total + r["at"] + 1, node + r["run"], r["tail"]
    # as many rows as there are range partitions
    table = spark.createDataFrame(starts, "part long, start long, nodes long")
    placed = spread.join(F.broadcast(table), "part").withColumn("place", F.col("start") + F.col("at")).withColumn("node", F.col("nodes") + F.col("run"))
    near = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: F.floor((F.col("node") + d) / BLOCK)))
    dealt = placed.where(F.col("first") | F.col("last")).select("host", "path", F.when(F.col("first"), F.col("hashes")).alias("hashes"), "place", "node", F.explode(near).alias("block"))
    dealt = dealt.withColumn("own", F.col("block") == F.floor(F.col("node") / BLOCK))
    found = dealt.groupBy("block").applyInPandas(_shared, "node long, piece long, shared array<long>, both array<long>")
    # by node and piece, so that a node with many copies is many keys
    shared = placed.select("page_id", "url", "key", "node", F.floor(F.col("place") / BLOCK).alias("piece")).join(found, ["node", "piece"])
    shared = shared.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("key").alias("_key"), "shared", "both")
    same = pages["page_id"].eqNullSafe(shared["_id"]) & pages["url"].eqNullSafe(shared["_url"]) & (pages["key"] == shared["_key"])
    joined = pages.join(shared, same, "left").select("page_id", "url", "html", "shared", "both")

    def close(batch: pa.RecordBatch):
        columns = [batch.column(c).to_pylist() for c in ("html", "shared", "both")]
        closed = [_closed(page or "", shared or [], both or [], within_articles) for page, shared, both in zip(*columns, strict=True)]
        text, deleted = [c[0] for c in closed], [c[1] for c in closed]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(deleted, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_shared"],
        )

    return map_batches(joined, close, "page_id long, url string, text string, n_chars long, n_shared long")
