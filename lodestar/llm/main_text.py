"""Main text of web pages with a suffix array over each host's pages.

A page is split into blocks of visible text, each with its place in the markup. The token streams of all pages of a host
make one suffix array, with a suffix at every token, so every run of MIN_RUN tokens or more that two pages share is seen, as
are equal blocks of any length. Suffixes are named by prefix doubling up to their first MIN_RUN tokens, with names that are
the same in every task: arrays built apart, each sorted by name, are merged by name over all tasks, however large a host is,
and say which runs stand on distinct pages. Names that no page asks for, as they stand in articles only, are left out first.

Covered boilerplate goes and unique runs stay:

* What markup calls a menu, header, footer, sidebar, notice, advert, form, dialog or comments goes.
* Text in an article element stays, whatever repeats it: articles share passages.
* All other text, in main elements and beside articles too, goes where runs of other pages of the host cover it, and stays
  where it is unique: titles and bylines outside of the article stay, menus inside of main go. Where most of what is open on
  a page without an article is covered, the page is a copy, not boilerplate, and keeps it.
* Blocks of fewer than MIN_RUN tokens are runs as a whole.
* Words inside longer class names ("share" of share-buttons) only break ties: inside an article such a block goes if it is
  covered, outside one if it is covered or short, or if the page has an article elsewhere.

Nothing depends on how pages are dealt over tasks. Equal pages of a host are one page.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, pick, small_batches

#: Tokens by which suffixes are sorted, a power of two: the shortest run that counts as repeated.
MIN_RUN = 8
#: Tokens from one suffix to the next: each begins one.
SPARSE = 1
#: A block goes if at least this share of its tokens is covered.
COVERED_SHARE = 0.8
#: Suffixes that a task gathers before it hands them on; names, asked or repeated, up to so many (8 bytes each) are
#: broadcast, more are met by a shuffle.
FLUSH, BROADCAST_NAMES = 500_000, 4_000_000

#: Quotes count behind an equals sign only; possessive, so that broken markup costs no second look.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*+>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button", "xmp"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "track", "area", "base", "col", "embed", "param"}
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "head"}
ASIDE_NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies copyright disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
HEAD_NAMES = {"header", "masthead", "banner"}
MAIN_NAMES = {"content", "article", "post", "entry", "story", "main"}


def names(attributes: str) -> tuple[set[str], set[str]]:
    """Class names, ids and roles, lower-cased; and the words in them."""
    whole: set[str] = set()
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            whole.update((m[2] or m[3] or m[4] or "").lower().split())
    return whole, {x for w in whole for x in re.split(r"[^a-z0-9]+", w) if x}


def blocks(page: str, lenient: bool = False) -> list[tuple[str, int, bool]]:
    """The page's blocks in order: (text with single blanks, zone, doubtful). Zones: 0 boilerplate by place, 1 body, 2 main,
    3 article; doubtful: a word in a class name speaks of boilerplate.

    lenient: an article or main element ends what boilerplate stands open before it (as if that had not been closed).
    """
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # open elements that change the place: name, zone and doubt inside, depth of that name
    zone, doubt = 1, False
    at = 0

    def flush() -> None:
        if text:
            s = " ".join(html_lib.unescape("".join(text)).split())
            if s:
                out.append((s, zone, doubt))
            text.clear()

    while True:
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if hit is not None:
                n, z, d, depth = stack[hit]
                if depth:
                    stack[hit] = (n, z, d, depth - 1)
                else:
                    del stack[hit:]
                    zone, doubt = stack[-1][1:3] if stack else (1, False)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at) if not m[3].rstrip().endswith("/") else None
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        inside, doubtful = zone, doubt
        if name in ("article", "main"):
            if zone == 0 and lenient and not any(n[0] == "article" for n in stack):
                stack.clear()
                zone, doubt = 1, False
            inside, doubtful = (0, doubt) if zone == 0 else (3 if name == "article" else max(2, zone), False)
        elif name in ASIDE_TAGS:
            inside = 0
        elif zone and name not in ("body", "html"):
            whole, parts = names(m[3]) if m[3] else (set(), set())
            if name == "header" or whole & HEAD_NAMES:
                inside = zone if zone >= 2 else 0
            elif whole & ASIDE_NAMES:
                inside = 0
            elif parts & ASIDE_NAMES or parts & HEAD_NAMES and zone < 2:
                doubtful = True
            elif parts & MAIN_NAMES and zone == 1:
                inside = 2
        if (inside, doubtful) != (zone, doubt):
            stack.append((name, inside, doubtful, 0))
            zone, doubt = inside, doubtful
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    stack[k] = (*stack[k][:3], stack[k][3] + 1)
                    break
    flush()
    return out


def parsed(page: str) -> list[tuple[str, int, bool]]:
    """The blocks outside of known boilerplate; with a second look at pages whose article seems to stand in it."""
    found = blocks(page)
    if all(z < 2 for _, z, _ in found) and re.search(r"<(?:article|main)\b", page, re.I):
        found = blocks(page, lenient=True)
    return [b for b in found if b[1]]


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_key(host: str, page: str) -> int:
    return int.from_bytes(hashlib.blake2b(page.encode(), key=host.encode()[:64], digest_size=8).digest(), "little", signed=True)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


class Codes(dict):
    """token -> its 64-bit code."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        self[token] = code = xxh64_intdigest(token)
        return code


class Suffixes:
    """Names of the suffixes of blocks, by host; tokens met again are not hashed again."""

    def __init__(self):
        self.known = Codes()

    def of(self, host: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """names, the block and the place in it of each suffix of MIN_RUN tokens or more (-1: the block as a whole), and the
        number of tokens of each block."""
        from xxhash import xxh64_intdigest

        words = [t.split(" ") for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        seed = xxh64_intdigest(host)
        whole = np.array([xxh64_intdigest(t, seed) for t in texts], dtype=np.uint64)
        some = np.flatnonzero(sizes >= MIN_RUN)
        if not len(some):
            return whole, np.arange(len(whole)), np.full(len(whole), -1), sizes
        if len(self.known) > 500_000:
            self.known.clear()
        size = sizes[some]
        n = int(size.sum())
        name = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words[b] for b in some.tolist())), dtype=np.uint64, count=n)
        begins = np.cumsum(size) - size
        width = 1
        while width < MIN_RUN:  # prefix doubling; what runs over a block's end is not looked at below
            name[: n - width] = mix(name[: n - width], name[width:])
            width *= 2
        name = mix(name, np.full(n, seed, dtype=np.uint64))
        block = np.repeat(np.arange(len(size)), size)
        keep = np.flatnonzero(np.arange(n) <= (begins + size - MIN_RUN)[block])
        block = block[keep]
        return np.concatenate((whole, name[keep])), np.concatenate((np.arange(len(whole)), some[block])), np.concatenate((np.full(len(whole), -1), keep - begins[block])), sizes


def covered(repeated: np.ndarray, block: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each block that repeated suffixes cover: all where the block is repeated as a whole, else MIN_RUN from each
    suffix. One pass over all blocks does."""
    whole = repeated[: len(sizes)]
    base = np.cumsum(sizes) - sizes
    at = (base[block[len(sizes) :]] + place[len(sizes) :])[repeated[len(sizes) :]]
    n = int(sizes.sum())
    marks = np.bincount(at, minlength=n + 1) - np.bincount(at + MIN_RUN, minlength=n + 1)
    upto = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:n] > 0)))
    return np.where(whole, sizes, upto[base + sizes] - upto[base])


def main_text(found: list[tuple[str, int, bool]], shared: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> str:
    """The blocks that stay, joined. shared: for some of a page's blocks, tokens that other pages cover, and tokens."""
    article = any(z >= 3 and not d for _, z, d in found)
    open_ = [i for i, x in enumerate(found) if undecided(x)]
    if not open_:
        return "\n".join(t for t, _, _ in found)
    n_covered, sizes = shared([found[i][0] for i in open_])
    drop: dict[int, bool] = {}
    evident = 0
    for i, c, n in zip(open_, n_covered.tolist(), sizes.tolist(), strict=True):
        _, z, d = found[i]
        by_runs = c >= COVERED_SHARE * n
        evident += n * by_runs
        by_place = z < 2 and d and (article or n < MIN_RUN)
        drop[i] = by_runs or by_place
    if not article and 2 * evident >= sizes.sum():  # a copy of other pages
        drop = {i: found[i][2] and len(found[i][0].split(" ")) < MIN_RUN for i in open_}
    return "\n".join(t for i, (t, _, _) in enumerate(found) if not drop.get(i, False))


def among(known: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which names are in the ascending array."""
    if not len(known):
        return np.zeros(len(name), dtype=bool)
    return known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name


def known_names(repeated: np.ndarray, suffixes: Suffixes, host: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """What main_text() asks for, given the ascending names of repeated suffixes."""

    def shared(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        name, block, place, sizes = suffixes.of(host, texts)
        return covered(among(repeated, name), block, place, sizes), sizes

    return shared


def main_texts(pages: list[str], host: str = "") -> list[str]:
    """The main text of each of one host's pages, all in one place: what extract_main_text() returns for them."""
    suffixes, where = Suffixes(), {}
    found = [parsed(p) for p in pages]
    for p, b in zip(pages, found, strict=True):
        for x in suffixes.of(host, [t for t, _, _ in b])[0].tolist():
            where.setdefault(x, set()).add(page_key(host, p))
    repeated = np.array(sorted(x for x, on in where.items() if len(on) > 1), dtype=np.uint64)
    return [main_text(b, known_names(repeated, suffixes, host)) for b in found]


def undecided(block: tuple[str, int, bool]) -> bool:
    """Runs decide on this block, neither markup nor place."""
    return block[1] < 3 or block[2]


def named(pages: DataFrame, of: Callable[[tuple[str, int, bool]], bool], known: Broadcast | None = None) -> DataFrame:
    """Rows (name, lo, hi): the suffixes of such blocks, of each the least and the largest key of a task's pages that have it;
    with known, an ascending array, only names in it."""
    schema = pa.schema([("name", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def array() -> pa.RecordBatch:
            name, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, name))  # this task's part of the suffix array
            name, key = name[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            last = np.concatenate((first[1:], [len(name)])) - 1
            return pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)), pa.array(key[first]), pa.array(key[last])], schema=schema)

        for b in batches:
            for url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host, page = host_of(url), page or ""
                texts = [x[0] for x in parsed(page) if of(x)]
                if not texts:
                    continue
                name = np.unique(suffixes.of(host, texts)[0])
                if known is not None:
                    name = name[among(known.value, name)]
                if len(name):
                    held.append((name, np.full(len(name), page_key(host, page), dtype=np.int64)))
                    size += len(name)
                if size > FLUSH:
                    yield array()
                    held, size = [], 0
        if held:
            yield array()

    return pages.select("url", "html").mapInArrow(run, "name bigint, lo bigint, hi bigint")


def sent_names(names: DataFrame) -> Broadcast:
    return names.sparkSession.sparkContext.broadcast(np.sort(names.select("name").toArrow().column(0).to_numpy().view(np.uint64)))


def repeated_names(pages: DataFrame) -> DataFrame:
    """name: the suffixes that some page asks for and that stand on two distinct pages of a host, or more. Of each the least
    and the largest page key is gathered: where these differ, pages do. What is asked on one page only may stand in the
    articles of others."""

    def met(d: DataFrame) -> DataFrame:
        return cut(d.groupBy("name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))

    asked = met(named(pages, undecided))
    once = asked.where("lo = hi")
    n = once.count()
    if not n:
        return asked.select("name")
    rest = met(named(pages, lambda x: not undecided(x), sent_names(once) if n <= BROADCAST_NAMES else None))
    rest = rest.select("name", F.col("lo").alias("least"), F.col("hi").alias("most"))
    if rest.count() <= BROADCAST_NAMES // 4:
        rest = F.broadcast(rest)
    elsewhere = once.join(rest, "name").where("least <> lo or most <> hi")
    return asked.where("lo <> hi").select("name").unionByName(elsewhere.select("name"))


def own_names(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows (key, host, names): the repeated names on each page, for pages that ask for any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for b in batches:
            for url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host, page = host_of(url), page or ""
                name = np.unique(suffixes.of(host, [x[0] for x in parsed(page) if undecided(x)])[0]).view(np.int64)
                if len(name):
                    yield pa.RecordBatch.from_pydict({"key": np.full(len(name), page_key(host, page), dtype=np.int64), "name": name})

    asked = pages.select("url", "html").mapInArrow(run, "key bigint, name bigint").distinct()
    return asked.join(repeated, "name", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("name")).alias("names"))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (blocks joined by newlines; empty if none), n_chars (code points of text).

    Null html is an empty page. Null urls, and urls without a host, form one host. Ids pass through, nulls and repeats
    included, one row out per row in. Empty tables give empty results; further columns are not read. Pages are parsed
    twice, for the runs and for the texts, or three times where one page alone asks for some run, so that none is shuffled
    unless the repeated names are too many to broadcast.
    """
    spark = df.sparkSession
    small_batches(spark)
    d = pick(df, {"page_id": id_col, "url": url_col, "html": html_col})
    repeated = cut(repeated_names(d))
    schema = arrow_schema(d, ["page_id", "url"], [("text", pa.string()), ("n_chars", pa.int64())])
    ddl = f"page_id {d.schema['page_id'].dataType.simpleString()}, url {d.schema['url'].dataType.simpleString()}, text string, n_chars bigint"
    if repeated.count() <= BROADCAST_NAMES:
        sent = sent_names(repeated)
    else:
        sent = None

        @F.pandas_udf("bigint")
        def key(url: pd.Series, page: pd.Series) -> pd.Series:
            return pd.Series([page_key(host_of(u), p or "") for u, p in zip(url, page, strict=True)], dtype="int64")

        d = d.withColumn("key", key("url", "html")).join(own_names(d, repeated), "key", "left").select("page_id", "url", "html", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for b in batches:
            texts = []
            rest = [None] * b.num_rows if sent is not None else b.column(3).to_pylist()
            for url, page, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), rest, strict=True):
                known = sent.value if sent is not None else np.sort(np.array(own or [], dtype=np.int64).view(np.uint64))
                texts.append(main_text(parsed(page or ""), known_names(known, suffixes, host_of(url))))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), b.column(1).cast(schema.field(1).type), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return d.mapInArrow(run, ddl).withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
