"""Main-text extraction with a host suffix array.

Pages are split into blocks of text in page order.  Markup settles what it can:
navigation, page headers and footers, asides, forms, scripts, comments and
elements named as adverts, menus, notices and the like are *chrome*; what
stands in an ``article`` or ``main`` element is *content*, also where a form or
a named element is wrapped around it.  Everything else is
*open*, and the suffix array decides about it.

The suffix array of a host covers the token streams of all its articles and,
where a host has open text, of what its pages have beside them (an article that
is published under two addresses is one article, and no boilerplate).  A stream
ends at every block border, so no repeat runs from one block into the next.  The
array is never built in one place: suffixes, cut to their first ``DEPTH`` tokens,
are sorted over range partitions, and one pass over each compares neighbours.
Those whose common prefix has ``DEPTH`` tokens or more are repeats, of which
longer ones are made up; how many distinct pages an interval of such neighbours
has is added up over its partitions, and a repeat that is on every page of a
large host is spread by page, so it is no hot group.

Open runs covered by repeats of two pages are removed, unique runs stay.
Articles of a host share passages, so a run that two of them have is no
boilerplate.  A content block goes only if repeats that stand in more than half
of the host's distinct articles cover it whole, as a notice on every page does.
Such a repeat is in more than half of the articles by any hash of it, too: suffixes whose
hash is not are left out of the sort, which changes no result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches, stored

DEPTH = 6                # tokens of a repeat that counts as long
ARTICLES = 5             # distinct articles that a run stands in at least before it can be boilerplate of a content block
MARKS = 2048             # hashes of runs that are counted by host; fewer let more suffixes into the sort
BORDER = ""              # stands after every block of a stream; no token is empty

OPEN, CONTENT, CHROME = 0, 1, 2
# kinds inside the parser: what stands in an element that is chrome by its name, or in a form; in an article; in an
# article that such an element holds
WEAK, ARTICLE, LIFTED = 3, 4, 5
BLOCKS = "array<struct<text:string,kind:int>>"

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
    search section select summary table tbody td tfoot th thead tr ul""".split())
# elements that are never main text, and those that are not unless they stand in an article
NEVER = frozenset("head nav aside footer menu button select dialog search object audio video canvas fieldset".split())
OUTSIDE = frozenset(["header"])
# words in class, id or role that name chrome
NAMED = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices paywall
    popup promo promoted related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe
    toolbar widget complementary contentinfo alert""".split())
# words that make a class speak of what stands beside or below ("has-sidebar", "comments-open")
STATES = frozenset("has with no without open closed".split())
# elements that a name never makes chrome
WHOLE = frozenset("html body main article".split())
# an element whose start closes an open element of the same kind
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

SIGN = re.compile("[>\"']")
# longer names go on as attributes, so that a name without an end is not read again and again
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,80})")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
# a form with one of these before its end holds the page, not fields
WRAPS = re.compile(r"<(?:article|main|nav|footer|h1)\b", re.I)
FORM_END = re.compile(r"</form\s*>", re.I)


def _named_chrome(attributes: str) -> bool:
    for m in NAMES.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        for name in value.split():
            words = re.split("[_-]+", name)
            if any(w in NAMED for w in words) and not any(w in STATES for w in words):
                return True
    return False


def _tag_ends(page: str):
    """A function from a place inside a tag to its ``>`` outside of quotes, -1 if
    there is none.  What was found out for a sign holds for all tags that come
    by it, so all calls together take time in proportion to the page."""
    signs = [m.start() for m in SIGN.finditer(page)]
    known: dict[int, int] = {}

    def tag_end(at: int) -> int:
        i, passed = bisect_left(signs, at), []
        while True:
            if i == len(signs):
                found = -1
            elif i in known:
                found = known[i]
            elif page[signs[i]] == ">":
                found = signs[i]
            else:
                passed.append(i)
                over = page.find(page[signs[i]], signs[i] + 1)
                if over >= 0:
                    i = bisect_left(signs, over + 1)
                    continue
                found = -1
            known.update(dict.fromkeys(passed, found))
            return found

    return tag_end


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks of text with their kind, in page order.  Character
    references are decoded, white space is one blank, empty blocks are left
    out.  An article or main in an element that is chrome by its name, or in a
    form, is content; articles only if no article stands outside of such
    elements (else they are teasers or comments).  Unclosed and crossed elements are taken as they come."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []            # open elements and the kind of what stands in them
    opened: Counter = Counter()                  # how many of each name are in the stack
    barriers: list[int] = []                     # places in the stack at which the search for one to close can end
    seen: dict[re.Pattern, int] = {}

    def ahead(pattern: re.Pattern, at: int) -> int:
        """Where the pattern is next; every stretch is searched once."""
        if seen.get(pattern, -1) < at:
            m = pattern.search(page, at)
            seen[pattern] = m.start() if m else len(page)
        return seen[pattern]

    def flush():
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                out.append((joined, stack[-1][1] if stack else OPEN))

    def close(depth: int):
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]
        while barriers and barriers[-1] >= depth:
            barriers.pop()

    at = look = 0
    end, tag_end = len(page), _tag_ends(page)
    while at < end:
        start = page.find("<", look)
        if start < 0:
            text.append(page[at:])
            break
        m, look = None, -1
        if page.startswith(("<!", "<?"), start):
            # a comment or the like that does not end takes the rest of the page
            opens, closes = next(x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if page.startswith(x[0], start))
            stop = page.find(closes, start + len(opens))
            look = end if stop < 0 else stop + len(closes)
        elif m := TAG.match(page, start):
            look = tag_end(m.end()) + 1
        if look <= 0:                                        # a sign like any other
            look = start + 1
            continue
        if start > at:
            text.append(page[at:start])
        at = look
        if m is None:
            if page.startswith("<![CDATA[", start):
                text.append(html.escape(page[start + 9:at - 3]))
            continue
        name, attributes = m[2].lower(), page[m.end():at - 1]
        if m[1]:                                             # an end tag
            if name in BLOCK:
                flush()
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW:
            if name != "svg" and name != "math" or not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = look = over.end() if over else end
            if name in ("iframe", "textarea"):
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            if name in ("br", "hr"):
                text.append(" ")
            continue
        for i in reversed(barriers[-2:]) if name in CLOSES else ():
            if stack[i][0] in CLOSES[name]:
                close(i)
                break
            if stack[i][0] in BLOCK:
                break
        kind = stack[-1][1] if stack else OPEN
        if kind != CHROME:
            # an inline element does not change the kind of the block it stands in
            if name in NEVER or name in OUTSIDE and kind not in (CONTENT, ARTICLE, LIFTED):
                kind = CHROME
            elif name == "form":
                kind = kind if ahead(WRAPS, at) < ahead(FORM_END, at) else WEAK
            elif name == "article":
                if kind == WEAK:
                    kind = WEAK if opened["article"] else LIFTED
                elif kind != LIFTED:
                    kind = ARTICLE
            elif name == "main":
                kind = kind if kind in (ARTICLE, LIFTED) else CONTENT
            elif name in BLOCK and name not in WHOLE and _named_chrome(attributes):
                kind = WEAK
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, kind))
            opened[name] += 1
            if name in BLOCK or name in CLOSES:
                barriers.append(len(stack) - 1)
    flush()
    final = {WEAK: CHROME, ARTICLE: CONTENT, LIFTED: CHROME if any(k == ARTICLE for _, k in out) else CONTENT}
    return [(t, final.get(k, k)) for t, k in out]


def _split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([[{"text": t, "kind": k} for t, k in blocks(p)] for p in pages], dtype=object)


def host(url: Column) -> Column:
    """The lower-cased host of an address; null for null, "" where there is none."""
    return F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _stream(chosen: Column) -> Column:
    """The tokens of all blocks with a border after each."""
    return F.flatten(F.transform(chosen, lambda b: F.concat(F.split(b["text"], " "), F.array(F.lit(BORDER)))))


def _windows(stream: Column, depth: int) -> Column:
    """Every ``depth`` neighbouring tokens, by where they begin."""
    n = F.size(stream)
    return F.when(n < depth, F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - depth), lambda i: F.slice(stream, i + 1, depth)))


def _mark(window: Column) -> Column:
    return F.pmod(F.xxhash64(window), F.lit(MARKS)).cast("int")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> those that share all their tokens with the one before
    or after them, and the first and the last, whose neighbours may be in
    another partition."""
    held, shares = None, True                    # the last suffix so far, and whether it is kept whatever comes next
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        n, with_last = rows.num_rows, np.zeros(rows.num_rows + 1, bool)
        for name in ("host", "prefix"):
            column = rows.column(name)
            same = pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
            with_last[1:n] = same if name == "host" else with_last[1:n] & same
        with_last[0] = shares
        keep = with_last[:n] | with_last[1:]
        yield from rows.slice(0, n - 1).filter(pa.array(keep[:n - 1])).to_batches()
        held, shares = rows.slice(n - 1).to_batches()[0], bool(with_last[n - 1])
    if held is not None:
        yield held


def suffix_array(streams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, page, stream, least, marks) -> (host, prefix, page, at, least): of
    the sorted suffixes of each host's streams, cut to ``depth`` tokens, those
    that share all of them with a neighbour in the array, and those at the
    borders of partitions.  Suffixes with a border in them are left out, and,
    where ``marks`` is not null, those whose mark it does not hold."""
    suffixes = (streams.select("host", "page", "least", "marks", F.posexplode(_windows(F.col("stream"), depth)).alias("at", "tokens"))
                .where(~F.array_contains("tokens", F.lit(BORDER)))
                .where(F.col("marks").isNull() | F.array_contains("marks", _mark(F.col("tokens"))))
                .select("host", F.array_join("tokens", " ").alias("prefix"), "page", "at", "least"))
    # a page's equal suffixes are in one partition, those of many pages spread over several
    array = suffixes.repartitionByRange("host", "prefix", "page").sortWithinPartitions("host", "prefix", "page", "at")
    return array.mapInArrow(_neighbours, array.schema)


def repeated(streams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, page, stream: array of tokens), distinct -> (host, page, starts):
    where on each page a repeat begins that ``least`` distinct pages of the host
    have (a column, constant by host; two where there is none)."""
    for name, kind, value in (("least", "long", 2), ("marks", "array<int>", None)):
        if name not in streams.columns:
            streams = streams.withColumn(name, F.lit(value).cast(kind))
    near = stored(suffix_array(streams, depth), "pages-suffixes")
    on = near.select("host", "prefix", "page", "least").distinct().groupBy("host", "prefix").agg(
        F.count("*").alias("pages"), F.max("least").alias("least"))
    long = on.where("pages >= least").select("host", "prefix")
    return (near.join(long, ["host", "prefix"]).groupBy("host", "page")
            .agg(F.array_sort(F.collect_list("at")).alias("starts")))     # bounded by the page's own tokens


def common_marks(articles: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, page, stream) of articles -> (host, least, marks): how many
    distinct articles boilerplate of the host has at least, and the marks of
    runs that so many have; hosts without any are left out.  An article that
    stands there several times counts as often here, which only adds marks."""
    least = F.greatest(F.lit(ARTICLES), F.floor(F.count("*") / 2) + 1).cast("long")
    hosts = (articles.select("host", "page").distinct().groupBy("host")
             .agg(F.count("*").alias("articles"), least.alias("least")).where(F.col("articles") >= ARTICLES))
    whole = F.filter(_windows(F.col("stream"), depth), lambda w: ~F.array_contains(w, F.lit(BORDER)))
    touched = articles.select("host", F.explode(F.array_distinct(F.transform(whole, _mark))).alias("mark")) \
        .groupBy("host", "mark").agg(F.count("*").alias("n"))
    return (touched.join(hosts, "host").where("n >= least").groupBy("host")
            .agg(F.max("least").alias("least"), F.collect_list("mark").alias("marks")))   # MARKS at most


def unique_runs(page_blocks: list, starts, common=None, depth: int = DEPTH) -> str:
    """The text of a page: of open blocks the runs that no long repeat covers,
    content blocks whole unless repeats of most articles cover them whole,
    chrome left out.  ``starts`` are places in the stream of the blocks that are
    no content, ``common`` in that of the content."""
    covered, boiler = ({i for s in (found if found is not None else ()) for i in range(s, s + depth)} for found in (starts, common))
    out, at, in_content = [], 0, 0
    for b in page_blocks:
        words = b["text"].split(" ")
        if b["kind"] == CONTENT:
            if not all(i in boiler for i in range(in_content, in_content + len(words))):
                out.append(b["text"])
            in_content += len(words) + 1
            continue
        if b["kind"] == OPEN:
            kept = " ".join(w for i, w in enumerate(words, at) if i not in covered)
            if kept:
                out.append(kept)
        at += len(words) + 1
    return "\n\n".join(out)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              depth: int = DEPTH) -> DataFrame:
    """page_id, url and text (the main text; empty if there is none), one row
    per input row.

    Null and empty pages have an empty text.  Pages without a host (null or odd
    addresses) share one host.  An article that is published under several
    addresses is one article.  A page that stands in the table several times
    (equal html) is one page to the suffix array, not a repeat of itself.  An
    empty table gives an empty result; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    split = F.pandas_udf(_split, BLOCKS)
    content = F.filter("blocks", lambda b: b["kind"] == CONTENT)
    beside = F.filter("blocks", lambda b: b["kind"] != CONTENT)
    on_host = F.coalesce(host(F.col(url_col)), F.lit(""))
    # a host's articles and what its pages have beside them are two parts of the array
    cut = stored(pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.xxhash64(on_host).alias("host"), F.xxhash64(on_host, F.lit("articles")).alias("articles"),
        F.xxhash64(html_col).alias("page"), split(F.col(html_col)).alias("blocks"))
        .withColumn("has_open", F.exists("blocks", lambda b: b["kind"] == OPEN))
        .withColumn("has_content", F.size(content) > 0)
        .withColumn("article", F.xxhash64(F.transform(content, lambda b: b["text"]))), "pages-blocks")
    articles = cut.where("has_content").select(F.col("articles").alias("host"), F.col("article").alias("page"),
                                               _stream(content).alias("stream"))
    # written, so that Spark knows how few they are and the pages need no shuffle to meet them
    marks = stored(common_marks(articles, depth), "pages-marks")
    # what stands beside articles matters on hosts with open text only
    open_hosts = stored(cut.where("has_open").select("host").distinct(), "pages-open-hosts")
    streams = articles.join(marks, "host").unionByName(
        cut.join(open_hosts, "host", "left_semi").select("host", "page", _stream(beside).alias("stream")), allowMissingColumns=True)
    starts = stored(repeated(streams.dropDuplicates(["host", "page"]).withColumn("least", F.coalesce("least", F.lit(2))), depth),
                    "pages-starts")
    of = lambda name: starts.select(F.col("host").alias(f"{name}_host"), F.col("page").alias(f"{name}_page"),
                                    F.col("starts").alias(name))
    met = (cut.join(of("repeats"), (F.col("host") == F.col("repeats_host")) & (F.col("page") == F.col("repeats_page")), "left")
           .join(of("common"), (F.col("articles") == F.col("common_host")) & (F.col("article") == F.col("common_page")), "left"))
    # pages on which the array found no repeat keep all that is no chrome
    none = F.col("repeats").isNull() & F.col("common").isNull()
    whole = met.where(none).select("page_id", "url", F.array_join(F.transform(
        F.filter("blocks", lambda b: b["kind"] != CHROME), lambda b: b["text"]), "\n\n").alias("text"))
    assemble = F.udf(lambda b, s, c: unique_runs(b, s, c, depth), "string")
    return whole.unionByName(met.where(~none).select("page_id", "url", assemble("blocks", "repeats", "common").alias("text")))
