"""Main text of web pages, with the help of a suffix array over each host's pages.

A page's markup gives blocks of text, each inside an article, inside page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments), or plain. The token streams of a group of a host's pages are then
concatenated, and a suffix array, built by prefix doubling to depth RUN, finds the runs of RUN tokens or more
that occur on PAGES distinct pages or more. Pages of a host whose blocks are equal count as one. Blocks mostly covered by such runs are boilerplate, unless markup
says that they belong to the article; what stays are the article's blocks, and, on pages without an
article, the plain blocks that are unique to them. A passage that an article shares with other pages is kept.

A host's pages are dealt into groups of about GROUP pages, by a hash, so that no host meets in one task whole. Where
a host has several groups, each sends the hashes of its runs, every one with up to PAGES of the contents that it
stands in; the contents are united over the host, in as many shares of the hashes as there are groups, and the runs
found on PAGES distinct pages of the whole host go back to the groups that asked. A group asks for runs that touch a
block outside the article; runs inside articles are only counted, and are sent only where a bit filter of fixed size
says that some page may ask for them. A full filter costs exchange, not results.

Defined results: a null or empty html gives an empty text; a null url counts as a host of its own; repeated rows stay
and count as one page; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import table
from locusflow.llm.grams import ngrams, words_of

RUN, PAGES, COVERED = 8, 3, 0.8
GROUP = 256
FILTER_BITS = 1 << 26
ARTICLE, FURNITURE, PLAIN = 0, 1, 2
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "head", "select", "textarea", "object", "math", "canvas", "audio", "video"}
ASIDE = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "label", "fieldset"}
MAIN = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NAMES = set("ad ads advert adverts advertisement sponsor sponsored banner cookie cookies consent notice notices sidebar menu nav navbar navigation footer header masthead comment comments disqus share sharing social related recommended subscribe newsletter promo breadcrumb breadcrumbs popup modal contentinfo complementary search".split())

#: What a furniture name may be joined to and still be one.
BOXES = set("area bar block body box button buttons column container content field form group holder inner item items label left line link links list main outer panel right row section slot text title top bottom unit widget wrap wrapper".split())


def _names_furniture(word: str, inside_main: bool) -> bool:
    """Whether a class, id or role says furniture and nothing else: ``ad-box`` does, ``share-price`` and ``ad-hoc`` don't."""
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    found = NAMES.intersection(parts)
    return bool(found - {"header"} if inside_main else found) and all(p in NAMES or p in BOXES for p in parts)


def _kind(name: str, attributes: str, inside_main: bool) -> int | None:
    """What an element makes of the text in it; None leaves that to what it stands in."""
    if attributes and "=" in attributes:
        for value in MARK.findall(attributes):
            if any(_names_furniture(word, inside_main) for word in "".join(value).lower().split()):
                return FURNITURE
    if name in MAIN:
        return ARTICLE
    if name == "header" and inside_main:
        return None
    return FURNITURE if name in ASIDE else None


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order; white space is one space, character references are decoded."""
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int | None]] = []
    parts: list[str] = []
    at, size, skipped = 0, len(html), None

    def state() -> int:
        return next((k for _, k in reversed(open_) if k is not None), PLAIN)

    def close() -> None:
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append((state(), text))
            parts.clear()

    while at < size:
        if skipped:
            end = re.compile(rf"</{skipped}\b[^>]*>", re.I).search(html, at)
            at, skipped = (end.end() if end else size), None
            continue
        tag = TAG.search(html, at)
        parts.append(html[at : tag.start() if tag else size])
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in INLINE and (name not in ("span", "a") or not tag[3]):
            continue
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        if tag[1]:
            place = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if place is not None:
                close()
                del open_[place:]
        elif name in SKIPPED:
            skipped = name
        else:
            inside = any(k == ARTICLE for _, k in open_)
            kind = _kind(name, tag[3], inside)
            if kind == ARTICLE:  # an article ends furniture left open, but for furniture in an article
                while not inside and open_ and open_[-1][1] == FURNITURE:
                    open_.pop()
            if name == "p" and open_ and open_[-1][0] == "p" or name == "li" and open_ and open_[-1][0] == "li":
                open_.pop()
            if kind is not None and name in INLINE:
                close()
            open_.append((name, kind))
    close()
    return out


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES, contents: np.ndarray | None = None, known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page's tokens whether a run of ``run`` tokens or more, found on ``pages`` pages or more, covers them.

    contents: a number for each page, equal for pages that count as one. known: for each token of all streams whether
    the run that starts there is found on enough pages anyway.

    The suffixes of the concatenated streams are ranked by their first 1, 2, 4, ... tokens until ``run`` tokens count;
    equal ranks are neighbours in the suffix array.
    """
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(t, len(ids)) for s in streams for t in s], np.int64)
    lengths = [len(s) for s in streams]
    page = np.repeat(np.arange(len(streams)), lengths)
    content = page if contents is None else np.repeat(contents, lengths)
    n, end = len(flat), np.cumsum([len(s) for s in streams])
    covered = np.zeros(n + 1, np.int64)
    if n >= run:
        left = end[page] - np.arange(n)  # tokens to the end of the page
        rank, depth = flat + 1, 1
        while depth < run:
            step = min(depth, run - depth)
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:]
            ahead[left <= step] = 0  # nothing follows inside the page
            key = rank * (rank.max() + 1) + ahead
            suffixes = np.argsort(key, kind="stable")
            new = np.empty(n, bool)
            new[0], new[1:] = True, key[suffixes][1:] != key[suffixes][:-1]
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(new)
            depth += step
        suffixes = np.lexsort((content, rank))
        r, p = rank[suffixes], content[suffixes]
        first = np.ones(n, bool)
        first[1:] = r[1:] != r[:-1]
        fresh = first.copy()
        fresh[1:] |= p[1:] != p[:-1]
        on = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1]
        often = on >= pages if known is None else (on >= pages) | known[suffixes]
        hits = suffixes[often & (left[suffixes] >= run)]
        np.add.at(covered, hits, 1)
        np.add.at(covered, np.minimum(hits + run, n), -1)
    return np.split(np.cumsum(covered[:-1]) > 0, end[:-1]) if streams else []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array([[k for k, _ in b] for b in found], pa.list_(pa.int32())), pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))],
            names=["page_id", "url", "host", "kinds", "texts"],
        )


def _runs(kinds: list[list[int]], texts: list[list[str]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(page, place of its first token among all tokens, hashes of the runs of RUN tokens, whether they touch a block outside the article)."""
    place = 0
    for at, offsets, hashes in words_of(pa.array([" ".join(ts) for ts in texts], pa.string())):
        grams = ngrams(hashes, RUN)
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), at):
            if hi - lo >= RUN:
                outside = np.repeat(np.array(kinds[i]) != ARTICLE, [t.count(" ") + 1 for t in texts[i]])
                sums = np.concatenate([[0], np.cumsum(outside)])
                yield i, place + lo, grams[lo : hi - RUN + 1], sums[RUN:] > sums[:-RUN]
        place += len(hashes)


def _prints(kinds: list[list[int]], texts: list[list[str]]) -> np.ndarray:
    """Fingerprints of the pages' blocks."""
    return np.array([int.from_bytes(blake2b(("\n".join(ts) + "\n" + " ".join(map(str, ks))).encode("utf-8", "replace"), digest_size=8).digest()) for ks, ts in zip(kinds, texts)], np.uint64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's bits, as words, for the runs of html that touch a block outside the article."""
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in batches:
        found = [blocks(h or "") for h in batch.column("html").to_pylist()]
        for *_, grams, touch in _runs([[k for k, _ in b] for b in found], [[t for _, t in b] for b in found]):
            bit = grams[touch] % np.uint64(FILTER_BITS)
            np.bitwise_or.at(held, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].view(np.int64))], names=["word", "bits"])


def _filter(pages: DataFrame) -> np.ndarray:
    words = pages.select("html").mapInArrow(_asked, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


SENT = "host string, group bigint, share bigint, asks boolean, runs binary, contents binary"
ARROW_SENT = pa.schema([("host", pa.string()), ("group", pa.int64()), ("share", pa.int64()), ("asks", pa.bool_()), ("runs", pa.binary()), ("contents", pa.binary())])


def _distinct(run: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, the number of each one among its run's, and how many its run has."""
    order = np.lexsort((content, run))
    run, content = run[order], content[order]
    new = np.append(True, (run[1:] != run[:-1]) | (content[1:] != content[:-1]))[: len(run)]
    run, content = run[new], content[new]
    heads = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
    size = np.diff(np.append(heads, len(run)))
    return run, content, np.arange(len(run)) - np.repeat(heads, size), np.repeat(size, size)


def _send(held):
    """The runs of one group, for hosts of several groups, by share."""

    def run(pages: pa.Table) -> pa.Table:
        groups = pages.column("groups")[0].as_py()
        if groups < 2:
            return ARROW_SENT.empty_table()
        kinds, texts = pages.column("kinds").to_pylist(), pages.column("texts").to_pylist()
        prints = (_prints(kinds, texts) >> np.uint64(32)).astype(np.uint32)
        parts, asked = [], []
        for i, _, grams, touch in _runs(kinds, texts):
            bit = grams % np.uint64(FILTER_BITS)
            use = touch | ((held.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1)
            parts.append((grams[use], np.full(int(use.sum()), prints[i])))
            asked.append(grams[touch])
        if not parts:
            return ARROW_SENT.empty_table()
        grams, content, nth, _ = _distinct(*(np.concatenate(x) for x in zip(*parts)))
        grams, content = grams[nth < PAGES], content[nth < PAGES]
        lane = (grams % np.uint64(groups)).astype(np.int64) * 2 + np.isin(grams, np.concatenate(asked))
        order = np.argsort(lane, kind="stable")
        host, group = pages.column("host")[0].as_py(), pages.column("group")[0].as_py()
        out = [
            {"host": host, "group": group, "share": int(lane[p[0]]) // 2, "asks": bool(lane[p[0]] % 2), "runs": grams[p].tobytes(), "contents": content[p].tobytes()}
            for p in np.split(order, np.flatnonzero(np.diff(lane[order])) + 1)
            if len(p)
        ]
        return pa.Table.from_pylist(out, ARROW_SENT)

    return run


def _meet(sent: pa.Table) -> pa.Table:
    """The runs of one share of a host that stand on PAGES distinct pages, for each group that asks."""
    runs = [np.frombuffer(x, np.uint64) for x in sent.column("runs").to_pylist()]
    grams, _, _, size = _distinct(np.concatenate(runs), np.concatenate([np.frombuffer(x, np.uint32) for x in sent.column("contents").to_pylist()]))
    common = np.unique(grams[size >= PAGES])
    out = [(h, g, np.intersect1d(r, common)) for h, g, asks, r in zip(sent.column("host").to_pylist(), sent.column("group").to_pylist(), sent.column("asks").to_pylist(), runs) if asks]
    out = [(h, g, r.tobytes()) for h, g, r in out if len(r)]
    return pa.table([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["host", "group", "runs"])


def _decide(pages: pa.Table, common: pa.Table) -> pa.Table:
    """The texts of one group of pages of a host; common has the runs that are repeated over the whole host."""
    kinds, texts = pages.column("kinds").to_pylist(), pages.column("texts").to_pylist()
    streams = [[w for t in ts for w in t.split(" ")] for ts in texts]
    known = None
    if common.num_rows:
        found, known = np.frombuffer(b"".join(common.column("runs").to_pylist()), np.uint64), np.zeros(sum(map(len, streams)), bool)
        for _, place, grams, _ in _runs(kinds, texts):
            known[place : place + len(grams)] = np.isin(grams, found)
    contents = np.unique(_prints(kinds, texts), return_inverse=True)[1]
    out, gone = [], []
    for ks, ts, cover in zip(kinds, texts, repeated(streams, contents=contents, known=known)):
        ends = np.cumsum([t.count(" ") + 1 for t in ts])
        common = [bool(cover[e - t.count(" ") - 1 : e].mean() >= COVERED) for t, e in zip(ts, ends.tolist())]
        article = ARTICLE in ks
        kept = [t for k, t, c in zip(ks, ts, common) if (k == ARTICLE if article else k == PLAIN and not c)]
        out.append("\n".join(kept))
        gone.append(sum(c and k != ARTICLE for k, c in zip(ks, common)))
    text = pa.array(out, pa.string())
    return pa.table([pages.column("page_id"), pages.column("url"), text, pa.array([len(x) for x in out], pa.int64()), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_boilerplate"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_boilerplate (blocks that repeat over the host's pages) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    named = pages.select("page_id", "url", host.alias("host"), "html")
    parsed = named.mapInArrow(_parse, "page_id bigint, url string, host string, kinds array<int>, texts array<string>")
    # Hosts of several groups alone are broadcast, so that no text is exchanged for the join: at most one row for GROUP pages.
    counts = named.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups")).where("groups > 1")
    dealt = parsed.join(F.broadcast(counts), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1).cast("bigint")))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("page_id", "url"), "groups"))
    grouped = dealt.groupBy("host", "group")
    held = pages.sparkSession.sparkContext.broadcast(_filter(pages))
    sent = grouped.applyInArrow(_send(held), SENT)
    common = sent.groupBy("host", "share").applyInArrow(lambda t: _meet(t), "host string, group bigint, runs binary")
    return grouped.cogroup(common.groupBy("host", "group")).applyInArrow(lambda t, c: _decide(t, c), "page_id bigint, url string, text string, n_chars bigint, n_boilerplate bigint")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
