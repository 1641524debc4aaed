"""HTML extraction (operator 5): host suffix array over page token streams.

Each page is read into blocks (paragraphs, headings, list items ...). Blocks are marked by their place in the markup:
inside an article or main element, inside menus, headers, footers, sidebars, notices, adverts, forms or reader comments,
or neither. All words outside marked articles form the page's token stream, with a mark at each block end.

The streams of a host are one long sequence; its suffix array is built down to RUN tokens, which is all that is asked of
it: suffixes that share their first RUN tokens stand together, and a substring of RUN or more tokens occurs on several pages
just if each of its RUN-token pieces does. Spark groups the suffixes by (host, first RUN tokens) and counts the
distinct streams of each, so neither a large host nor a piece on every page is ever one task's rows: counts are partly
summed before the shuffle. A piece on LEAST_PAGES streams is boilerplate, on a host of any size.

The main text is the marked article where a page has one, with its own header, and what a main element holds beside its
articles. That, and the unmarked blocks of pages without a marked article or main, go if boilerplate covers them by half or
more; the others, the unique runs, stay. Equal streams count once, so copies of a page are not each other's boilerplate; pages
of equal words share an answer only if their blocks are marked alike and their articles are equal.

The blocks of marked articles are the host's second sequence, and all its suffixes of RUN tokens inside a block are looked up.
There passages that some articles share are text, so a piece is boilerplate only if it is on LEAST_ARTICLES different articles
and on more than HOST_SHARE of all that the host has. A block goes if such pieces cover it by half or more. An article of which
half or more would go is a copy or a revision of others and stays whole, as do blocks under RUN tokens. Suffixes by themselves
would be more to shuffle than the pages: each article first sends the 16-bit buckets that its suffixes fall into. They are
summed by host in groups of GROUP articles, and a piece that more than half of all have is above that share in one group at
least, so only suffixes in such buckets are sent and counted.

Cases: null or empty html gives the empty text; null urls are a host of their own; markup that is cut off ends where it
ends; very long pages are taken whole; repeated rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.catalog import query
from runloom.llm.common import flat, may_match, mix, read, span_hashes, steps, word_spans, written

RUN = 6
LEAST_PAGES = 3
COVERED = 0.5
#: In place of the position of a block that stays whatever is repeated.
SURE = -1
#: Different articles of a host that a piece of a marked article's boilerplate is on, and what share of them it exceeds.
LEAST_ARTICLES, HOST_SHARE = 10, 0.5
#: Articles of a host whose buckets are summed together, about.
GROUP = 500

#: Fixed names of HTML: elements without text of the page, elements that end a block, void elements, chrome elements.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|title|select|button|canvas|audio|video"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
                  "summary table tbody td tfoot th thead tr ul".split())
NESTED = BLOCK - frozenset("p hr li dd dt h1 h2 h3 h4 h5 h6 tr td th tbody thead tfoot caption legend summary html body".split())
CHROME = frozenset("nav footer aside form head header dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert toolbar".split())
#: Words of class and id names: these always mark chrome ...
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted cookie cookies consent gdpr "
                  "popup modal newsletter subscribe signup sidebar widget widgets related recommended recommendations nav navbar "
                  "navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus respond replies pagination pager "
                  "copyright noprint".split())
#: ... and these unless the name also speaks of the article itself.
WEAK = frozenset("header banner side notice notices alert search share sharing social login form reply legal toolbar skip topbar".split())
ARTICLE = frozenset("article post entry story content body main".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def marks_of(name: str, attributes: str, inside: bool = False) -> tuple[bool, int]:
    """Whether an element is chrome by its markup, and its level: 3 article, 2 main, 1 named like one, 0 other.
    inside: in an article, whose plain header is text."""
    chrome, level = name in CHROME and not (inside and name == "header"), {"article": 3, "main": 2}.get(name, 0)
    words: set[str] = set()
    if attributes and not attributes.isspace():
        for key, a, b, c in NAMED.findall(attributes):
            key, value = key.lower(), (a or b or c).strip()
            if key in ("class", "id"):
                words |= {w.lower() for w in SPLIT.split(value)}
            elif key == "role":
                chrome |= value.lower() in ROLES
                level = max(level, {"article": 3, "main": 2}.get(value.lower(), 0))
            elif key == "itemprop":
                level = max(level, 3 if value.lower() == "articlebody" else 0)
            elif key == "hidden" or value.lower() == "true":
                chrome = True
    if name not in ("html", "body"):
        chrome |= bool(words & MARKS) or bool(words & WEAK) and not words & ARTICLE
        if words & {"article", "post", "entry", "story", "content"}:
            level = max(level, 1)
    return chrome, level


def blocks(page: str) -> list[tuple[int, bool, str]]:
    """(level, chrome, text) of every block of a page, in order."""
    out: list[tuple[int, bool, str]] = []
    stack: list[tuple[str, bool, int]] = []  # element, chrome and level that hold inside it
    chrome, level, at = False, 0, 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((level, chrome, text))
            parts.clear()

    glue = False  # inline elements don't separate words
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            if glue and parts:
                parts[-1] += piece
            else:
                parts.append(piece)
            glue = True
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            glue = False
            continue
        if name not in BLOCK:
            continue
        flush()
        glue = False
        if name not in NESTED:
            if name == "body":
                while stack and stack[-1][0] == "head":
                    stack.pop()
                chrome, level = stack[-1][1:] if stack else (False, 0)
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif not m[4].rstrip().endswith("/"):
            own, rank = marks_of(name, m[4], level == 3)
            if name in ("article", "main"):  # an unclosed menu or header ends where the article begins
                while stack and stack[-1][0] in ("nav", "header", "head", "menu"):
                    stack.pop()
                chrome, level = stack[-1][1:] if stack else (False, 0)
            stack.append((name, chrome or own, max(level, rank)))
        chrome, level = stack[-1][1:] if stack else (False, 0)
    if at < len(page):
        piece = page[at:]
        if glue and parts:
            parts[-1] += piece
        else:
            parts.append(piece)
    flush()
    return out


def _heads(words: np.ndarray) -> np.ndarray:
    """Hashes of the first RUN tokens of every suffix that has as many."""
    n = max(0, len(words) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for k in range(RUN):
        out = mix(out * np.uint64(3) + words[k:k + n])
    return out


def _pieces(articles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of articles (blocks apart by an empty line): rows and blocks of their tokens; first tokens and hashes of all suffixes of
    RUN tokens that end inside their block."""
    raw, offsets = flat(articles)
    starts, ends, rows = word_spans(raw, offsets)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    block = (lines[starts] - lines[offsets[rows]]) // 2
    heads = _heads(span_hashes(raw, starts, ends))
    n = len(heads)
    at = np.flatnonzero((rows[:n] == rows[RUN - 1:]) & (block[:n] == block[RUN - 1:])) if n else np.zeros(0, np.int64)
    return rows, block, at, heads[at]


def _buckets(heads: np.ndarray) -> np.ndarray:
    return (heads >> np.uint64(48)).astype(np.uint16)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of every article, once in a step."""
    for batch in steps(batches, "blocks"):
        keys = np.stack([batch.column(c).to_numpy() for c in ("site", "article")])
        batch = batch.take(pa.array(np.unique(keys, axis=1, return_index=True)[1]))
        rows, _, at, heads = _pieces(batch.column("blocks"))
        both = np.unique(rows[at].astype(np.uint64) << np.uint64(16) | _buckets(heads))
        to = np.concatenate([[0], np.cumsum(np.bincount((both >> np.uint64(16)).astype(np.int64), minlength=batch.num_rows))]) * 2
        held = (both & np.uint64(0xFFFF)).astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("site"), batch.column("article"), pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(held)])], ["site", "article", "buckets"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets that a group's articles (sorted by site and part) have often enough for a piece of the host's boilerplate."""
    last, counts = None, np.zeros(1 << 16, np.int64)

    def found() -> pa.RecordBatch:
        site, _, parts, articles = last
        often = np.flatnonzero((counts * parts >= LEAST_ARTICLES) & (counts * parts > HOST_SHARE * articles))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(often), site)), pa.array(often.astype(np.int32))], ["site", "bucket"])
    for batch in batches:
        for *key, held in zip(*(batch.column(c).to_pylist() for c in ("site", "part", "parts", "articles", "buckets")), strict=True):
            if key != last:
                if last is not None:
                    yield found()
                last = key
                counts[:] = 0
            counts[np.frombuffer(held, "<u2")] += 1  # an article has a bucket once
    if last is not None:
        yield found()


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, article, head): the suffixes of the articles that fall into their host's buckets."""
    for batch in steps(batches, "blocks"):
        rows, _, at, heads = _pieces(batch.column("blocks"))
        own = [np.unique(heads[a:b][np.isin(_buckets(heads[a:b]), held)]) for (a, b), held in zip(_spans(rows[at], batch.num_rows), batch.column("buckets").to_pylist(), strict=True)]
        of = np.repeat(np.arange(batch.num_rows), [len(h) for h in own])
        yield pa.RecordBatch.from_arrays([batch.column("site").take(pa.array(of)), batch.column("article").take(pa.array(of)), pa.array(np.concatenate(own).view(np.int64))], ["site", "article", "head"])


def _spans(rows: np.ndarray, n: int) -> zip:
    """Where the entries of each of n rows lie (rows ascending)."""
    ends = np.cumsum(np.bincount(rows, minlength=n))
    return zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)


def _covered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gone): the blocks of each article that its host's pieces cover."""
    for batch in steps(batches, "blocks"):
        rows, block, at, heads = _pieces(batch.column("blocks"))
        over = np.zeros(len(rows), bool)
        for (a, b), held in zip(_spans(rows[at], batch.num_rows), batch.column("heads").to_pylist(), strict=True):
            hit = at[a:b][np.isin(heads[a:b].view(np.int64), held)]
            for k in range(RUN):
                over[hit + k] = True
        gone = []
        for a, b in _spans(rows, batch.num_rows):
            size, n = np.bincount(block[a:b]), np.bincount(block[a:b][over[a:b]])
            n = np.pad(n, (0, len(size) - len(n)))
            gone.append(np.flatnonzero((n > 0) & (n >= COVERED * size)).tolist())
        out = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])
        yield out.filter(pa.array([bool(g) for g in gone], pa.bool_()))


def _parse(id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "html"):
        texts, opens, streams, begins, marks, articles = [], [], [], [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page or "")
            best = max((lv for lv, chrome, _ in found if not chrome), default=0)
            main = [best >= 2 and lv == best and not chrome for lv, chrome, _ in found]
            judged = [not chrome and not sure and (best < 2 or lv >= 2) for (lv, chrome, _), sure in zip(found, main, strict=True)]
            settled = best >= 2 and not any(judged)
            articles.append([t for (_, _, t), sure in zip(found, main, strict=True) if sure])
            texts.append("\n\n".join(articles[-1]) if settled else None)
            # where each block begins in the stream; blocks of the main text aren't in it
            at = np.cumsum([0, *(0 if sure else len(t.split()) + 1 for (_, _, t), sure in zip(found, main, strict=True))])[:-1].tolist()
            held = [] if settled else [i for i in range(len(found)) if main[i] or judged[i]]
            opens.append([found[i][2] for i in held])
            begins.append([SURE if main[i] else at[i] for i in held])
            streams.append("".join(t + " \0 " for (_, _, t), sure in zip(found, main, strict=True) if not sure))
            layout = hashlib.blake2b(bytes(2 * sure + chosen for sure, chosen in zip(main, judged, strict=True)), digest_size=8)
            for (_, _, t), sure in zip(found, main, strict=True):
                if sure and not settled:
                    layout.update(b"\0" + t.encode("utf-8", "surrogatepass"))
            marks.append(int.from_bytes(layout.digest(), "big"))
        raw, offsets = flat(pa.array(streams, pa.string()))
        starts, ends, rows = word_spans(raw, offsets)
        words = span_hashes(raw, starts, ends)
        suffix = _heads(words)
        n = len(suffix)
        whole = rows[:n] == rows[RUN - 1:] if n else np.zeros(0, bool)
        per_row = np.bincount(rows[:n][whole], minlength=batch.num_rows) if n else np.zeros(batch.num_rows, np.int64)
        heads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.array(suffix[whole].view(np.int64)))
        stream = span_hashes(raw, offsets[:-1], offsets[1:])
        layout = mix(stream * np.uint64(3) + np.array(marks, np.uint64))
        article = [int.from_bytes(hashlib.blake2b("\n\n".join(a).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if a else None for a in articles]
        yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("url"), pa.array(texts, pa.string()), pa.array(opens, pa.list_(pa.string())),
                                          pa.array(begins, pa.list_(pa.int32())), heads, pa.array(stream.view(np.int64)), pa.array(layout.view(np.int64)),
                                          pa.array(article, pa.int64())],
                                         [id_col, "url", "text", "open", "begins", "heads", "stream", "layout", "article"])


def article_boilerplate(parsed: DataFrame) -> DataFrame:
    """(site, article, text, open, begins) -> key of an article on its host, gone: the places of its blocks that are boilerplate."""
    inside = F.transform(F.filter(F.arrays_zip("open", "begins"), lambda b: b["begins"] == SURE), lambda b: b["open"])
    articles = parsed.where("article is not null").select("site", "article", "key", F.coalesce("text", F.array_join(inside, "\n\n")).alias("blocks"))
    sites = articles.groupBy("site").agg(F.count_distinct("article").alias("articles")).where(F.col("articles") >= LEAST_ARTICLES)
    sites = written(sites, "pages-sites")
    judged = may_match(articles, sites, "site")
    profiles = judged.select("site", "article", "blocks").mapInArrow(_profiles, "site long, article long, buckets binary").join(sites, "site")
    parts = F.ceil(F.col("articles") / GROUP).cast("long")
    profiles = profiles.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("article"), "parts"))
    grouped = profiles.repartition("site", "part").sortWithinPartitions("site", "part")
    likely = grouped.mapInArrow(_likely, "site long, bucket int").groupBy("site").agg(F.collect_set("bucket").alias("buckets"))
    likely = written(likely, "pages-likely")
    if likely.isEmpty():
        return parsed.sparkSession.createDataFrame([], "key long, gone array<int>")
    few = may_match(judged, likely, "site").join(likely, "site")
    both = few.select("site", "article", "blocks", "buckets").mapInArrow(_in_buckets, "site long, article long, head long").distinct()
    often = both.groupBy("site", "head").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_ARTICLES)
    often = often.join(sites, "site").where(F.col("pages") > HOST_SHARE * F.col("articles"))
    common = written(often.groupBy("site").agg(F.collect_list("head").alias("heads")), "pages-articles")  # at most twice a mean article's suffixes
    covered = may_match(judged, common, "site").join(common, "site").select("key", "blocks", "heads").mapInArrow(_covered_blocks, "key long, gone array<int>")
    return written(covered.groupBy("key").agg(F.first("gone").alias("gone")), "pages-gone")


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, html) -> page_id, url, text."""
    schema = T.StructType([pages.schema[id_col], pages.schema["url"], *T.StructType.fromDDL(
        "text string, open array<string>, begins array<int>, heads array<long>, stream long, layout long, article long").fields])
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parsed = written(pages.select(id_col, "url", "html").mapInArrow(lambda it: _parse(id_col, it), schema).withColumn("host", host), "pages-parsed", "zstd")
    parsed = parsed.withColumn("site", F.xxhash64("host")).withColumn("key", F.xxhash64("site", "article"))
    gone = article_boilerplate(parsed)
    # the suffix array of each host to depth RUN: distinct streams of every group of equal beginnings
    heads = parsed.select("host", "stream", F.explode(F.array_distinct("heads")).alias("head")).groupBy("host", "head", "stream").agg(F.count("*").alias("n"))
    common = heads.groupBy("host", "head").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("host", "head")
    # pages without a marked article: positions that a common piece covers; equal words with equal marks have one answer
    undecided = parsed.where("text is null").select("host", "layout", "key", "open", "begins", "heads").dropDuplicates(["host", "layout"])
    places = undecided.select("host", "layout", F.posexplode("heads").alias("at", "head")).join(common, ["host", "head"])
    covered = places.groupBy("host", "layout").agg(F.collect_list("at").alias("covered"))  # at most the page's own length
    none = F.array().cast("array<int>")
    stay = undecided.join(covered, ["host", "layout"], "left").join(gone, "key", "left").select(
        "host", "layout", "open", "begins", F.coalesce("covered", none).alias("covered"), F.coalesce("gone", none).alias("gone"))
    kept = stay.mapInArrow(_unique_runs, "host string, layout long, open_text string")
    decided = parsed.where("text is not null").select(id_col, "url", "key", "text")
    plain = decided.schema[id_col], decided.schema["url"], decided.schema["text"]
    # only the texts that may lose blocks are shuffled
    cut = may_match(decided, gone, "key").join(gone.hint("merge"), "key", "left").select(id_col, "url", "text", F.coalesce("gone", none).alias("gone"))
    cut = cut.mapInArrow(lambda it: _without(id_col, it), T.StructType([*plain]))
    whole = may_match(decided, gone, "key", "left_anti").select(id_col, "url", "text")
    rest = parsed.where("text is null").select(id_col, "url", "host", "layout").join(kept, ["host", "layout"])
    return whole.unionByName(cut).unionByName(rest.select(id_col, "url", F.col("open_text").alias("text")))


def article_left(article: list[str], gone: set[int]) -> list[bool]:
    """Which blocks of an article stay: all if those that should go are half of it or more."""
    sizes = [t.count(" ") + 1 for t in article]
    if 2 * sum(sizes[i] for i in gone) >= sum(sizes):
        gone = set()
    return [i not in gone for i in range(len(article))]


def _without(id_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            blocks = text.split("\n\n")  # no block holds a line end
            texts.append("\n\n".join(t for t, left in zip(blocks, article_left(blocks, {*gone}), strict=True) if left) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("url"), pa.array(texts, pa.string())], [id_col, "url", "text"])


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for opens, begins, covered, gone in zip(*(batch.column(c).to_pylist() for c in ("open", "begins", "covered", "gone")), strict=True):
            over = {p for a in covered for p in range(a, a + RUN)}
            sizes = [len(t.split()) for t in opens]
            article = iter(article_left([t for t, b in zip(opens, begins, strict=True) if b == SURE], {*gone}))
            kept = [t for t, b, n in zip(opens, begins, sizes, strict=True)
                    if (next(article) if b == SURE else sum(b + k in over for k in range(n)) < COVERED * n)]
            texts.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(texts, pa.string())], ["host", "layout", "open_text"])


@query("op5_html_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
