"""Main text of source pages: landmarks first, what a host repeats on other pages goes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import stage_table

#: Words of the shortest repeated run that counts as boilerplate.
RUN = 4
#: Words of the pages that are put into one suffix array.
ARRAY_WORDS = 500_000

# Elements of HTML whose content is no text of a page, those whose content is read to their
# end tag, those of a head, elements that frame the text, elements without content, and elements inside a
# block of text.
SILENT = frozenset("script style noscript template iframe object svg canvas head select textarea button audio video".split())
RAW = frozenset("script style noscript iframe textarea title".split())
HEAD = frozenset("base link meta noscript script style template title".split())
FRAME = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr").split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
# Words of class names and ids that mark what is not the article.
FRAME_NAMES = frozenset((
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "form header menu nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget").split())
COMMENTS = frozenset(("comment", "comments"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_NAME = re.compile(r"[a-zA-Z]+")
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)


def _framing(tag: str, given: str) -> bool:
    if tag in FRAME:
        return True
    names = COMMENTS if tag == "article" else FRAME_NAMES if tag not in ("html", "body", "main") else frozenset()
    for name, *values in _ATTRIBUTE.findall(given) if given else ():
        name, value = name.lower(), unescape("".join(values)).lower()
        if name == "role" and FRAME_ROLES & set(value.split()):
            return True
        if name in ("class", "id") and names & set(_NAME.findall(value)):
            return True
    return False


def page_blocks(html: str) -> tuple[str, list[tuple[str, str]]]:
    """The landmark that holds a page's text, and (place, text) of its blocks in order.

    Places are ``article``, ``main``, ``frame`` and ``open``; the landmark is the first of these two that
    the page has an element of, or empty.  A block is what stands between two block elements, with
    character references decoded and white space merged.  Scripts, styles, comments and markup give none.
    """
    blocks, words, stack, depth, seen = [], [], [], Counter(), set()
    at, end = 0, len(html)

    def close() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append((next((place for place in ("frame", "article", "main") if depth[place]), "open"), text))

    def pop() -> str:
        tag, places = stack.pop()
        if places and places != ["silent"]:
            close()
        depth.subtract((f"<{tag}", *places))
        return tag

    while at < end:
        found = _TOKEN.search(html, at)
        upto = found.start() if found else end
        if upto > at and not depth["silent"]:
            words.append(unescape(html[at:upto]))
        if not found:
            break
        at, tag = found.end(), (found.group(2) or "").lower()
        if not tag:
            continue
        if tag == "br":
            words.append(" ")
        elif tag not in INLINE and tag not in SILENT:
            close()
        if found.group(1):
            # An end tag closes its element and what was left open inside it.
            while depth[f"<{tag}"] and pop() != tag:
                pass
            continue
        given = found.group(3)
        if tag == "body" or depth["<head"] and tag not in HEAD:
            stack.clear()
            depth.clear()
        if stack and (stack[-1][0] == "p" and tag not in INLINE and tag not in SILENT or stack[-1][0] == tag == "li"):
            pop()
        if tag in VOID:
            continue
        places = [place for place, holds in (
            ("frame", _framing(tag, given)), ("article", tag == "article" or "articlebody" in given.lower()),
            ("main", tag == "main" or _MAIN.search(given)), ("silent", tag in SILENT)) if holds]
        if places and places != ["silent"] and tag in INLINE:
            close()
        if "frame" not in places and not depth["frame"]:
            seen.update(places)
        stack.append((tag, places))
        depth.update((f"<{tag}", *places))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = stop.start() if stop else end
    close()
    return next((place for place in ("article", "main") if place in seen), ""), blocks


def repeated_runs(words: np.ndarray, pages: np.ndarray, rows: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words lie in a run of at least ``run`` words that another page has too.

    ``words`` are the numbered words of all rows, one row after the other; ``pages`` and ``rows`` are theirs.
    The suffixes are sorted by doubling as far as ``run`` words, since what follows cannot change which
    words are covered; suffixes that a row's end cuts shorter take no part.
    """
    n = len(words)
    covered = np.zeros(n, bool)
    if n < run:
        return covered
    last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True])
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
    rank, length = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        after = np.full(n, -1, np.int64)
        whole = np.flatnonzero(left >= length + step)
        after[whole] = rank[whole + step]
        pair = rank * (n + 1) + after + 1
        rank, length = np.unique(pair, return_inverse=True)[1].astype(np.int64), length + step
    suffixes = np.flatnonzero(left >= run)
    suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
    if not len(suffixes):
        return covered
    # Runs of one rank are neighbours in the array; they are boilerplate if their pages differ.
    opens = np.flatnonzero(np.r_[True, np.diff(rank[suffixes]) != 0])
    least = np.minimum.reduceat(pages[suffixes], opens)
    most = np.maximum.reduceat(pages[suffixes], opens)
    shared = np.repeat(least != most, np.diff(np.r_[opens, len(suffixes)]))
    starts = suffixes[shared]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _window_keys(words: np.ndarray, pages: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a page has ``run`` more words, and a hash of them."""
    n = len(words)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(pages[:n - run + 1] == pages[run - 1:])
    key = np.zeros(len(starts), np.uint64)
    for j in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[starts + j].view(np.uint64)
    return starts, key


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pages of an array one after the other: words, their row, their page, and where rows start."""
    column = table.column("words").combine_chunks()
    counts = np.asarray([len(w) // 8 for w in column.to_pylist()], np.int64)
    words = np.frombuffer(b"".join(column.to_pylist()), np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    return words, rows, table.column("page").to_numpy()[rows], np.r_[0, np.cumsum(counts)]


def _flags(covered: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.array([np.packbits(covered[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())


def host_boilerplate(framed: DataFrame, run: int = RUN, array_words: int = ARRAY_WORDS) -> DataFrame:
    """``key`` and ``covered`` (bits, one per word): the words that other pages of the host repeat.

    ``framed`` has one row per ``key`` with its ``host``, its ``page`` (a number; rows of one page are not
    distinct pages) and ``words`` (64-bit numbers of host and word, as bytes).  A word is covered if it
    lies in ``run`` words in a row that a distinct page of the host has too.

    The pages of a host are dealt to suffix arrays of about ``array_words`` words.  Where a host needs
    several, each sends every run once with its least and greatest page; runs that turn out to be on distinct
    pages go back to the arrays that hold them.  So a host of any size is split and the result is the same.
    """
    sizes = framed.groupBy("host").agg(F.sum(F.octet_length("words") / 8).alias("n")).select(
        "host", F.greatest(F.lit(1), F.ceil(F.col("n") / array_words)).cast("long").alias("parts"))
    total = framed.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    arrays = max(1, -(-int(total) // array_words))
    dealt = stage_table(framed.join(sizes, "host").withColumn("array", F.pmod(
        F.xxhash64("host", F.pmod("key", "parts")), F.lit(arrays)).cast("int")))

    def local(table: pa.Table) -> pa.Table:
        words, rows, pages, starts = _joined(table)
        return pa.table({"key": table.column("key"), "covered": _flags(repeated_runs(words, pages, rows, run), starts)})

    def windows(table: pa.Table) -> pa.Table:
        words, rows, pages, _ = _joined(table)
        at, key = _window_keys(words, rows, run)
        held, place = np.unique(key, return_inverse=True)
        least, most = np.full(len(held), np.iinfo(np.int64).max), np.full(len(held), np.iinfo(np.int64).min)
        np.minimum.at(least, place, pages[at])
        np.maximum.at(most, place, pages[at])
        return pa.table({"array": pa.array(np.full(len(held), table.column("array")[0].as_py()), pa.int32()),
                         "window": held.view(np.int64), "least": least, "most": most})

    def across(table: pa.Table, shared: pa.Table) -> pa.Table:
        words, rows, _, starts = _joined(table)
        at, key = _window_keys(words, rows, run)
        at = at[np.isin(key.view(np.int64), shared.column("window").to_numpy())]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + run, -1)
        return pa.table({"key": table.column("key"), "covered": _flags(np.cumsum(edge[:-1]) > 0, starts)})

    inside = dealt.groupBy("array").applyInArrow(local, "key long, covered binary")
    several = dealt.filter("parts > 1")
    sent = stage_table(several.groupBy("array").applyInArrow(windows, "array int, window long, least long, most long"))
    shared = sent.groupBy("window").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n"))
    shared = sent.select("array", "window").join(shared.filter("n > 1 AND least < most").select("window"), "window")
    outside = several.groupBy("array").cogroup(shared.groupBy("array")).applyInArrow(across, "key long, covered binary")
    return inside.unionByName(outside)


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", run: int = RUN,
              array_words: int = ARRAY_WORDS) -> DataFrame:
    """The main text of every source page: ``id``, ``url``, ``text``, ``n_chars`` and ``n_boilerplate``.

    The text is that of the page's ``<article>`` elements (``<main>`` if there are none) without what frames
    it: menus, headers, footers, sidebars, forms, adverts, notices, comments of readers, told by element, role, class
    or id.  Of a page without such a landmark it is all text outside of frames, less the words that other pages
    of its host repeat (``host_boilerplate``).  Blocks are joined by an empty line, in page order, whole
    and with their repetitions.  ``n_boilerplate`` counts the words outside of the landmark that the host repeats.

    Null or empty pages have an empty text.  Rows with the same url are one page, rows with a null url are pages of
    their own and share a host without name.  Repeated rows, tied or null ids each give a row with the same text.
    Pages are read whole, however long; other columns are ignored.
    """
    number = F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.col(url).isNull(), F.coalesce(html, F.lit("")))
    page = F.coalesce(F.xxhash64(F.when(F.col(url).isNotNull(), F.col(url))), number)
    page = F.when(F.col(url).isNull(), number).otherwise(page)
    given = pages.select(number.alias("key"), page.alias("page"), F.col(id).alias("id"), F.col(url).alias("url"),
                         F.coalesce(html, F.lit("")).alias("html"))

    def host_of(address: str | None) -> str:
        try:
            return (urlsplit(address or "").hostname or "").lower()
        except ValueError:
            return ""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hosts = [], []
            for address, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                host, (mark, blocks) = host_of(address), page_blocks(body)
                hosts.append(host)
                words.append(b"".join(xxhash.xxh64_digest(f"{host}\n{word}") for place, text in blocks
                                      if not mark or place != mark for word in text.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(words, pa.binary())],
                                             names=["key", "page", "host", "words"])

    framed = stage_table(given.select("key", "page", "url", "html").mapInArrow(frames, "key long, page long, host string, words binary")
                         .dropDuplicates(["key"]))
    covered = host_boilerplate(framed, run, array_words).groupBy("key").agg(F.collect_list("covered").alias("covered"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body in batch.column(3).to_pylist():
                mark, blocks = page_blocks(body)
                held = [(place, text) for place, text in blocks if place == mark] if mark else blocks
                bodies.append(zlib.compress("\n".join(f"{place} {text}" for place, text in held).encode(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.binary())], names=["key", "id", "url", "body"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for body, flags in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                bits = [np.unpackbits(np.frombuffer(f, np.uint8)) for f in flags or ()]
                repeated = np.bitwise_or.reduce(bits) if bits else np.zeros(0, np.uint8)
                counts.append(int(repeated.sum()))
                kept, at = [], 0
                for line in zlib.decompress(body).decode().split("\n") if body else ():
                    place, _, text = line.partition(" ")
                    if place in ("open", "frame"):
                        words = text.split()
                        mine, at = repeated[at:at + len(words)], at + len(words)
                        text = " ".join(w for w, r in zip(words, mine) if not r) if place == "open" else ""
                    if text:
                        kept.append(text)
                found.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(counts, pa.int64())],
                                             names=["id", "url", "text", "n_boilerplate"])

    kind = given.schema["id"].dataType.simpleString()
    read = given.select("key", "id", "url", "html").mapInArrow(texts, f"key long, id {kind}, url string, body binary")
    done = read.join(covered, "key", "left").select("id", "url", "body", "covered").mapInArrow(
        finish, f"id {kind}, url string, text string, n_boilerplate long")
    return done.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"), "n_boilerplate")
