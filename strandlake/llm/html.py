"""Main text of web pages: page structure and a suffix array per host.

A page is read once into blocks (paragraphs, headings, list items, cells) with
markup, scripts, styles and comments gone.  Blocks inside menus, headers,
footers, sidebars, forms, adverts, notices or reader comments (by element, role,
or class and id words) are out.  If the page has an article (or main) element,
the blocks in it are left, else all others.

What is left goes to the suffix array: the token streams of some HOST_PAGES
distinct pages of a host are concatenated, and the array, sorted by RUN_TOKENS tokens,
finds every run of so many tokens that occurs on several pages (a shorter block is a run as a whole).  A block
that boilerplate runs cover by more than half goes; the rest, unique to the page, is its main text.
Copies of a page are one page.

* A page without an article: runs on BOILERPLATE_PAGES pages or more are boilerplate.
* Inside an article repetition alone is no evidence, as stock sentences and copied articles are main text, and nothing but
  boilerplate may go: there a run is boilerplate if it is on more than half of the host's distinct pages with an article,
  and on ARTICLE_PAGES at least.  If more than half of these pages would lose three quarters of their tokens, they are
  copies of one another, and nothing goes.

Pages of a host are dealt to groups by a hash of their blocks, so a host with a third of all pages is many groups, and what
groups find is added up over the host; so nothing depends on the number of groups.  A run that is on more than half of all
pages is on more than half of those of some group: only such runs leave an article's group, and they are counted over the host
exactly, in the few hosts that have any.  Pages are read again for that and for the result, which is cheaper than to keep or to move their texts.

Defined results: a null html is an empty one and gives an empty text; an unclosed
element ends with its parent, an unclosed tag or comment at the end of the page is
no text; a null or odd url is the host ''; repeated rows and copied pages each get the
text that one of them would get; an empty table gives no rows; very long pages are read in time linear in their length;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import windows, words_of
from ._work import batched, settled, table

HOST_PAGES, RUN_TOKENS, BOILERPLATE_PAGES, ARTICLE_PAGES = 128, 6, 3, 8
#: The runs of about so many groups of a host are added up in one part.
PART_GROUPS = 8
#: Hosts with at least this share of all pages are dealt to groups before their pages move; so there are few of them, and they go to all tasks.
LARGE_HOSTS = 1 << 16
#: Characters of the pages of a group that are held at once, if there is more than one page.
GROUP_CHARS = 1 << 22
#: Boilerplate runs (bytes) that go to all tasks; more are joined by host.
BROADCAST_BYTES = 1 << 25

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
# Element names and the words of classes, ids and roles.
_RAW = frozenset("script style noscript template iframe object svg canvas math textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_OUT = frozenset("nav footer aside form button select dialog menu head search datalist label input".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog toolbar tablist".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing social comment comments "
    "commentlist respond disqus related recommended pagination pager popup modal overlay widget toolbar skip".split()
)
_MAIN = frozenset(("article", "main"))
# An article of its own that isn't the page's: a reader's comment, a teaser.
_OTHER_ARTICLE = frozenset("comment comments related recommended teaser sidebar ad ads advert advertisement promo sponsored widget".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPH_ENDS = _BREAKS - {"html", "body"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW}


def _traits(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """(whether the element is out, whether it holds the main text)."""
    out, main = name in _OUT or name == "header" and not in_main, name in _MAIN
    if not attributes.strip() or name in ("html", "body"):
        return out, main
    words = _OTHER_ARTICLE if name in _MAIN and not in_main else _OUT_WORDS
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            out = True
        elif key == "role":
            out, main = out or value in _OUT_ROLES, main or value in ("main", "article")
        elif key in ("class", "id"):
            out = out or not words.isdisjoint(_WORD.findall(value))
        elif key == "itemprop":
            main = main or value == "articlebody"
    return out, main


def blocks_of(page: str) -> tuple[list[str], list[str]]:
    """(blocks of the article, all other blocks that structure leaves) in page order.

    An article inside something that is out (an advert that was never closed) counts only if nothing else is left.
    """
    main: list[str] = []
    other: list[str] = []
    shut: list[str] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, int, list[str] | None]] = []  # name, whether it is out and main, and what held around it
    opened: Counter[str] = Counter()  # how often each name is in the stack
    out = depth = 0
    into: list[str] | None = None  # where an article that is inside something out goes

    def target() -> list[str]:
        return into if into is not None else main if depth else other

    def close_block() -> None:
        if text:
            if block := " ".join(_html.unescape("".join(text)).split()):
                target().append(block)
            text.clear()

    def pop() -> None:
        nonlocal out, depth, into
        close_block() if text and stack[-1][2] else None
        name, _, was_main, out, into = stack.pop()
        opened[name] -= 1
        depth -= was_main

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at and not out:
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not out:
                text.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            if name in _BREAKS:
                close_block()
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        attributes = m[3] if m[2] else m[6] or ""
        if name in _BREAKS:
            close_block()
        elif name == "br":
            text.append(" ")
        if name in _RAW:
            closing = _RAW_END[name].search(page, at)
            at = closing.end() if closing else end
            continue
        if name in _VOID:
            continue
        if name in _PARAGRAPH_ENDS and stack and stack[-1][0] in ("p", *_HEADINGS) and (name != stack[-1][0] or name == "p"):
            pop()
        elif name == "li" and stack and stack[-1][0] == "li":
            pop()
        heading = name in _HEADINGS and bool(depth) and out == 1 and bool(stack) and stack[-1][0] == "header" and stack[-1][1]
        is_out, is_main = _traits(name, attributes, bool(depth))
        is_out = is_out or name == "header"
        if heading:
            # A heading in the article's own header stays: it is put in for its own extent.
            closing = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            inner = re.sub(r"<[^>]*>", "", page[at : closing.start() if closing else end])
            if block := " ".join(_html.unescape(inner).split()):
                target().append(block)
            at = closing.end() if closing else end
            continue
        stack.append((name, is_out, is_main, out, into))
        opened[name] += 1
        depth += is_main
        if is_out:
            out += 1
        elif out and name == "article" and into is None and depth == is_main:
            out, into = 0, shut
    close_block()
    return main or ([] if other else shut), other


# ---- suffix array


def suffix_array(values: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of values in order, by prefix doubling; depth: in order of their first so many values at least, ties as they stand."""
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    _, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while rank[order[-1]] < n - 1 and (depth is None or step < depth):
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        step *= 2
    return order


class Streams:
    """The tokens of some pages' blocks, concatenated, and the runs in them. A block of fewer tokens than a run is filled up, so it is a run as a whole."""

    def __init__(self, pages: list[list[str]], run: int = RUN_TOKENS):
        self.pages, self.run = pages, run
        w = words_of([block for page in pages for block in page])
        words = np.diff(w.first)
        self.length = np.maximum(words, run)
        self.first = np.concatenate(([0], np.cumsum(self.length))).astype(np.int64)
        self.tokens = np.zeros(int(self.first[-1]), np.uint64)
        self.tokens[np.arange(len(w.hash)) + np.repeat(self.first[:-1] - w.first[:-1], words)] = w.hash
        self.page = np.repeat(np.arange(len(pages)), [len(page) for page in pages])  # of each block
        # A run lies in one block.
        self.starts = np.flatnonzero(np.arange(len(self.tokens)) + run <= np.repeat(self.first[1:], self.length))
        self.prints = windows(self.tokens, run)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprint of each distinct run, and the pages that it is on."""
        if not len(self.starts):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        inside = np.zeros(len(self.tokens), bool)
        inside[self.starts] = True
        order = suffix_array(self.tokens, self.run)
        order = order[inside[order]]
        # Neighbouring suffixes that share a run's tokens form an interval: one run.
        same = np.ones(len(order) - 1, bool)
        for k in range(self.run):
            same &= self.tokens[order[1:] + k] == self.tokens[order[:-1] + k]
        interval = np.concatenate(([0], np.cumsum(~same)))
        owner = np.repeat(self.page, self.length)[order]
        seen = np.unique(interval * len(self.pages) + owner) // len(self.pages)
        return self.prints[order[np.flatnonzero(np.diff(interval, prepend=-1))]], np.bincount(seen)

    def covered(self, runs: np.ndarray) -> np.ndarray:
        """Of each token, whether a run of these covers it."""
        at = self.starts[np.isin(self.prints[self.starts], runs)]
        delta = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + self.run, -1)
        return np.cumsum(delta)[:-1] > 0

    def without(self, runs: np.ndarray) -> list[list[str]]:
        """Of each page's blocks, those that these runs cover by half at most."""
        mask = self.covered(runs)
        sums = np.concatenate(([0], np.cumsum(mask)))
        keep = iter((2 * (sums[self.first[1:]] - sums[self.first[:-1]]) <= self.length).tolist())
        return [[block for block in page if next(keep)] for page in self.pages]

    def hits(self, runs: np.ndarray) -> list[np.ndarray]:
        """Of each page, the distinct runs of these on it."""
        at = self.starts[np.isin(self.prints[self.starts], runs)]
        page = np.repeat(self.page, self.length)[at]
        return [np.unique(self.prints[at[page == k]]) for k in range(len(self.pages))]

    def losing(self, runs: np.ndarray) -> np.ndarray:
        """Of each page, whether these runs cover three quarters of its tokens or more."""
        size = np.bincount(self.page, self.length, len(self.pages))
        return 4 * np.bincount(np.repeat(self.page, self.length), self.covered(runs), len(self.pages)) >= 3 * size


def content_of(blocks: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(blocks).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _longs(runs: np.ndarray) -> list[int]:
    return runs.view(np.int64).tolist()


def _numbers(runs: list[int] | None) -> np.ndarray:
    return np.array(runs if runs is not None else [], np.int64).view(np.uint64)


def _read(pages: DataFrame, schema: str, make, *more: str) -> DataFrame:
    """make(one batch's (main, other) blocks, its columns) over pages (host, html and more); make gives columns of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = make([blocks_of(h.as_py() or "") for h in part.column(1)], part, state)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names)

    types = [_TYPES[c.split()[1]] for c in schema.split(", ")]
    return batched(pages.select("host", "html", *more), run, schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _held(runs: DataFrame) -> dict[str, np.ndarray] | None:
    """A table of runs (host, runs) as a dictionary; None if it is too large to go to all tasks."""
    size = runs.agg(F.coalesce(F.sum(F.size("runs") * 8 + F.octet_length("host") + 64), F.lit(0))).first()[0]
    return {r.host: _numbers(r.runs) for r in runs.collect()} if size <= BROADCAST_BYTES else None


def _with_runs(pages: DataFrame, runs: DataFrame, schema: str, make, every: bool, *more: str) -> DataFrame:
    """make(found blocks, their hosts' runs, the batch) over pages; every: pages of hosts without runs too."""
    held = _held(runs)
    if held is not None:
        few = pages if every else pages.where(F.col("host").isin(list(held))) if len(held) < 1000 else pages.join(F.broadcast(runs.select("host")), "host", "left_semi")
        return _read(few, schema, lambda found, part, state: make(found, [held.get(h, _NONE) for h in part.column(0).to_pylist()], part), *more)
    joined = pages.join(runs, "host", "left" if every else "inner")
    return _read(joined, schema, lambda found, part, state: make(found, [_numbers(r) for r in part.column(2).to_pylist()], part), "runs", *more)


_NONE = np.empty(0, np.uint64)


# ---- pages with an article


def article_runs(pages: DataFrame) -> tuple[DataFrame, bool]:
    """(host, runs): the boilerplate of articles by host, from pages (host, html); whether there are pages without an article, but with text."""
    sizes = settled(pages.groupBy("host").agg(F.count("*").alias("rows")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    large = sizes.where((F.col("rows") > HOST_PAGES) & (F.col("rows") * LARGE_HOSTS >= total)).select("host", F.ceil(F.col("rows") / HOST_PAGES).cast("long").alias("groups"))
    groups = {r.host: r.groups for r in large.collect()}  # LARGE_HOSTS at most

    def contents(found, part, state):
        """Each content of a task once, so that copies don't meet in one task; pages without an article leave a mark."""
        rows = []
        for host, (main, other) in zip(part.column(0).to_pylist(), found, strict=True):
            mark = content_of(main) if main else b"" if other else None
            if mark is not None and (host, mark) not in state:
                state[host, mark] = True
                rows.append((host, int.from_bytes(mark[:7], "little") % groups.get(host, 1), mark, main))
        return list(zip(*rows, strict=True)) or [[]] * 4

    distinct = _read(pages, "host string, salt long, content binary, blocks array<string>", contents)
    dealt = distinct.repartition("host", "salt").sortWithinPartitions("host", "salt", "content")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(ended: bool) -> pa.RecordBatch:
            runs, counts = (_NONE, np.empty(0, np.int64)) if whole and ended and len(group) < ARTICLE_PAGES else Streams(group).repeated()
            often = 2 * counts > len(group)
            return pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([len(group)], pa.int64()), pa.array([plain]), pa.array([_longs(runs[often])], pa.list_(pa.int64()))], ["host", "pages", "plain", "runs"])

        last, group, chars, plain, whole = None, [], 0, False, True
        for batch in batches:
            for host, salt, mark, blocks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last and (last[:2] != (host, salt) or len(group) >= 2 * HOST_PAGES or chars > GROUP_CHARS):
                    ended = last[:2] != (host, salt)
                    yield closed(ended)
                    whole = ended and groups.get(host, 1) == 1
                    group, chars, plain = [], 0, False
                elif not last:
                    whole = groups.get(host, 1) == 1
                if mark == b"":
                    plain = True
                elif last != (host, salt, mark):
                    group.append(blocks)
                    chars += sum(map(len, blocks))
                last = (host, salt, mark)
        if last:
            yield closed(True)

    found = settled(batched(dealt, grouped, "host string, pages long, plain boolean, runs array<long>"), "groups")
    hosts = found.groupBy("host").agg(F.sum("pages").alias("all")).where(F.col("all") >= ARTICLE_PAGES)
    each = found.select("host", "pages", F.explode("runs").alias("run")).groupBy("host", "run").agg(F.sum("pages").alias("there"))
    # In groups that didn't send it a run is on half of the pages at most.
    likely = each.join(hosts, "host").where(2 * F.col("there") + (F.col("all") - F.col("there")) > F.col("all"))
    likely = settled(likely.groupBy("host", "all").agg(F.collect_set("run").alias("runs")), "likely")

    def hits(found, runs, part):
        rows = [(h, content_of(main), main, r) for h, (main, _), r in zip(part.column(0).to_pylist(), found, runs, strict=True) if main]
        return [[r[0] for r in rows], [r[1] for r in rows], [_longs(Streams([main]).hits(r)[0]) for _, _, main, r in rows]] if rows else [[]] * 3

    on = _with_runs(pages, likely.select("host", "runs"), "host string, content binary, runs array<long>", hits, False)
    on = on.where(F.size("runs") > 0).groupBy("host", "content").agg(F.first("runs").alias("runs"))
    counts = on.select("host", F.explode("runs").alias("run")).groupBy("host", "run").agg(F.count("*").alias("pages"))
    often = counts.join(likely.select("host", "all"), "host").where((2 * F.col("pages") > F.col("all")) & (F.col("pages") >= ARTICLE_PAGES))
    often = settled(often.groupBy("host", "all").agg(F.collect_set("run").alias("runs")), "often")

    def copies(found, runs, part):
        rows = [(h, content_of(main)) for h, (main, _), r in zip(part.column(0).to_pylist(), found, runs, strict=True) if main and Streams([main]).losing(r)[0]]
        return list(zip(*rows, strict=True)) or [[]] * 2

    lost = _with_runs(pages, often.select("host", "runs"), "host string, content binary", copies, False)
    lost = lost.distinct().groupBy("host").agg(F.count("*").alias("lost"))
    kept = often.join(lost, "host", "left").where(2 * F.coalesce("lost", F.lit(0)) <= F.col("all")).select("host", "runs")
    return settled(kept, "article_runs"), not found.where("plain").isEmpty()


# ---- pages without an article


def plain_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of the pages (host, html, page_id, url) without an article, but with text."""

    def plain(found, part, state):
        rows = [(i, u, h, o, content_of(o)) for h, i, u, (m, o) in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), found, strict=True) if o and not m]
        return list(zip(*rows, strict=True)) or [[]] * 5

    rows = settled(_read(pages, "page_id long, url string, host string, blocks array<string>, content binary", plain, "page_id", "url"), "plain")
    # Each content of a host once, so that copies are neither evidence nor one task.
    contents = rows.groupBy("host", "content").agg(F.first("blocks").alias("blocks"))
    groups = rows.groupBy("host").agg(F.ceil(F.count_distinct("content") / HOST_PAGES).alias("groups"))
    dealt = settled(contents.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("content"), F.col("groups"))), "contents")

    def parts_of(rows: pd.DataFrame, runs: np.ndarray) -> pd.DataFrame:
        part = runs % np.uint64(-(-int(rows["groups"].iloc[0]) // PART_GROUPS))
        order = np.argsort(part, kind="stable")
        parts, at = np.unique(part[order], return_index=True)
        held = [r.tobytes() for r in np.split(runs[order], at[1:])] if len(parts) else []
        host = pd.Series([rows["host"].iloc[0]] * len(parts), dtype=object)
        return pd.DataFrame({"host": host, "salt": np.full(len(parts), rows["salt"].iloc[0], np.int64), "part": parts.astype(np.int64), "runs": pd.Series(held, dtype=object)})

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        """Each run as often as pages of the group have it, BOILERPLATE_PAGES times at most."""
        runs, counts = Streams([list(b) for b in rows["blocks"]]).repeated()
        return parts_of(rows, np.repeat(runs, np.minimum(counts, BOILERPLATE_PAGES)))

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(r, np.uint64) for r in rows["runs"]]
        runs, counts = np.unique(np.concatenate(held), return_counts=True)
        often = runs[counts >= BOILERPLATE_PAGES]
        return pd.DataFrame({"host": rows["host"], "salt": rows["salt"], "runs": [np.intersect1d(r, often).tobytes() for r in held]})

    def without(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        kept = Streams([list(b) for b in rows["blocks"]]).without(np.frombuffer(b"".join(marks["runs"]), np.uint64))
        return pd.DataFrame({"host": rows["host"], "content": rows["content"], "text": ["\n\n".join(k) for k in kept]})

    keys = ("host", "salt")
    marks = dealt.groupBy(*keys).applyInPandas(found, "host string, salt long, part long, runs binary").groupBy("host", "part").applyInPandas(repeated, "host string, salt long, runs binary")
    texts = dealt.groupBy(*keys).cogroup(marks.groupBy(*keys)).applyInPandas(without, "host string, content binary, text string")
    return rows.select("page_id", "url", "host", "content").join(texts, ["host", "content"]).select("page_id", "url", "text")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host)
    runs, plain = article_runs(rows)

    def texts(found, runs, part):
        ids, urls = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
        out = [(i, u, "\n\n".join(Streams([main]).without(r)[0] if len(r) else main)) for i, u, (main, other), r in zip(ids, urls, found, runs, strict=True) if main or not other]
        return list(zip(*out, strict=True)) or [[]] * 3

    out = _with_runs(rows, runs, "page_id long, url string, text string", texts, True, "page_id", "url")
    return out.unionByName(plain_texts(rows)) if plain else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
