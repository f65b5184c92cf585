"""HTML main text: page differencing against the nearest URLs of the same host, then structural labels.

A page becomes blocks of text in page order. Every page is compared with its neighbours in the order of URL
paths within the host: the blocks of both are aligned by longest common subsequence, and blocks that all
neighbours but at most one share are frame and go. Labels come second. Of what is left they take blocks that
the markup names as something else (menus, forms, adverts, notices, reader comments) and, on pages with an
article or main element, blocks outside it. And they give back a shared block that stands between two blocks
of one article which are the page's own: a frame does not interrupt an article, a quoted passage does. Pages
of a host with equal blocks are one page, so copies delete nothing of each other.

Neighbours are found by a range partition over (host, path) whose edges are stitched, so no host is gathered
into one task; alignment takes four neighbours a page, two on either side.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workledger.llm.common import python_batches, skew_join, text_bytes, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])(?:[^>]*[^/>])?>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|textarea|svg|iframe|select)(?=[\s/>])(?:[^>]*[^/>])?>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_URL = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")

# Elements that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that never hold article text.
FRAME_TAGS = frozenset("head nav footer aside form menu dialog button".split())
# Words in class, id or role that name something other than the article.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo promoted related replies search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toc toolbar widget".split()
)
CONTENT_TAGS = frozenset(("article", "main"))


# Words that go with one of FRAME_WORDS in a name, and beginnings that negate it.
FRAME_PARTS = frozenset(
    "area bar block body box container content footer form header inner item items link links list main panel "
    "posts section slot top unit wrap wrapper zone articles bottom left right".split()
)
NEGATIONS = frozenset("no has with without not hide hidden".split())


def _names_frame(value: str) -> bool:
    """Whether one name (``site-footer``, ``ad_slot``, ``commentList``) means a frame: it ends in such a word,
    or begins with one and goes on with words for parts of a page only."""
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
    if not parts or parts[0] in NEGATIONS:
        return False
    return parts[-1] in FRAME_WORDS or parts[0] in FRAME_WORDS and FRAME_PARTS.issuperset(parts[1:])


def _is_frame(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FRAME_TAGS or tag == "header" and not inside:
        return True
    if "=" in attributes and tag not in ("html", "body", "article", "main"):
        for found in _NAMED.finditer(attributes):
            if any(map(_names_frame, (found[1] or found[2] or found[3] or "").split())):
                return True
    return False


#: What the markup says of a block: inside an article, nothing, or that it is frame.
ARTICLE, LOOSE, FRAME = 2, 1, 0


def blocks_of(page: str) -> tuple[list[str], list[int]]:
    """Blocks of text in page order, and the label of each."""
    blocks: list[str] = []
    labels: list[int] = []
    parts: list[str] = []
    depth = 0  # open article or main elements
    ended = False
    skip, skip_depth = "", 0
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(text)
                labels.append(FRAME if skip else ARTICLE if depth else LOOSE)

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at : token.start()])
        at = token.end()
        name = token[4]
        if name is None:
            continue
        tag, closing = name.lower(), token[3] == "/"
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS and not (skip == tag):
            if skip or closing or not _is_frame(tag, token[5], depth > 0):
                continue
        flush()
        if skip:
            opens_article = tag in CONTENT_TAGS and not closing and not ended and not _is_frame(tag, token[5], False)
            if opens_article and depth == 0 and skip != tag or tag == "body" and skip == "head":
                skip, skip_depth = "", 0  # the frame element was never closed
            else:
                if tag == skip:
                    skip_depth += -1 if closing else 1
                    if skip_depth == 0:
                        skip = ""
                continue
        if closing:
            if tag in CONTENT_TAGS and depth:
                depth -= 1
                ended = ended or depth == 0
        elif _is_frame(tag, token[5], depth > 0):
            if not token[5].rstrip().endswith("/"):
                skip, skip_depth = tag, 1
        elif tag in CONTENT_TAGS:
            depth += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return blocks, labels


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Positions of ``mine`` on one longest common subsequence with ``other``; bit-parallel over ``other``."""
    where: dict[int, int] = {}
    for j, line in enumerate(other):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    rows = [full]
    for line in mine:
        v = rows[-1]
        u = v & where.get(line, 0)
        rows.append(((v + u) | (v - u)) & full)
    found: set[int] = set()
    j = len(other)
    for i in range(len(mine), 0, -1):
        # zeros among the low j bits of a row count the common subsequence of the prefixes
        low = (1 << j) - 1
        here = j - (rows[i] & low).bit_count()
        if not here:
            break
        if here == j - (rows[i - 1] & low).bit_count():
            continue
        while j and (j - 1) - (rows[i] & ((1 << (j - 1)) - 1)).bit_count() == here:
            j -= 1
        found.add(i - 1)
        j -= 1
    return found


#: Neighbours on either side that a page is compared with.
NEAR = 2
#: Pages that differencing changes up to which these are sent to all executors; beyond, the join shuffles.
BROADCAST_ROWS = 500_000

_PARSED = "page_id long, url string, host string, path string, blocks array<string>, labels binary, hashes array<long>"


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        columns: list[list] = [[] for _ in kinds]
        for url, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            blocks, labels = blocks_of(body.decode("utf-8", "replace"))
            place = _URL.match(url or "")
            row = (place[1].lower() if place else "", place[2] if place else url or "", blocks, bytes(labels), [*map(_hash, blocks)])
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *map(pa.array, columns, kinds)],
            names=["page_id", "url", "host", "path", "blocks", "labels", "hashes"],
        )


def neighbours(pages: DataFrame) -> DataFrame:
    """``(page, host, path, page_id)``, one row a page -> ``page, near``: up to ``NEAR`` pages before and after it
    in its host's path order."""
    names = ["host", "path", "page_id", "page"]
    key = F.struct(*names)
    placed = written(
        pages.select(*names).repartitionByRange("host", "path", "page_id").withColumn("part", F.spark_partition_id()), "url-order"
    )
    # the ends of the parts before and after, stitched on: a few rows a partition
    order = Window.partitionBy("part").orderBy(*names)
    back = Window.partitionBy("part").orderBy(*(F.desc(c) for c in names))
    ends = placed.withColumn("i", F.row_number().over(order)).withColumn("j", F.row_number().over(back))
    ends = ends.where((F.col("i") <= NEAR) | (F.col("j") <= NEAR)).withColumn("me", key)
    over = Window.orderBy(*(F.col(f"me.{c}") for c in names))
    moves = [k for k in range(-NEAR, NEAR + 1) if k]
    stitched = ends.select("page", F.array(*(F.lag("me", k).over(over) for k in moves)).alias("outer"))
    within = placed.withColumn("me", key).select("*", F.array(*(F.lag("me", k).over(order) for k in moves)).alias("inner"))
    both = F.array(*(F.coalesce(F.col("inner")[i], F.col("outer")[i]) for i in range(len(moves))))
    rows = within.join(stitched, "page", "left").select("page", "host", F.explode(both).alias("o"))
    return rows.where("o.host = host").select("page", F.col("o.page").alias("near")).distinct()


def main_blocks(hashes: list[int], labels: bytes, others: list[list[int]]) -> list[int]:
    """Places of the blocks that are the page's main text, given the blocks of its different neighbours."""
    times = Counter(i for other in others for i in shared_lines(hashes, other))
    most = max(2, len(others) - 1)
    own = [times[i] < most for i in range(len(hashes))]
    least = ARTICLE if ARTICLE in labels else LOOSE
    kept: list[int] = []
    article: list[int] = []
    for i, label in enumerate([*labels, LOOSE]):
        if label < least:
            if label == LOOSE:  # an article ends; another may follow
                kept += article if any(own[k] for k in article) else []
                article = []
        elif i == len(labels):
            break
        elif least == ARTICLE:
            article.append(i)
        elif own[i]:
            kept.append(i)
    return kept


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of main blocks, of pages where they are others than without neighbours."""
    for batch in batches:
        pages, places = [], []
        for page, labels, hashes, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kept = main_blocks(hashes, labels, others)
            if kept != main_blocks(hashes, labels, []):
                pages.append(page)
                places.append(kept)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["page", "kept"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks, labels, kept in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            places = main_blocks([0] * len(blocks), labels, []) if kept is None else kept
            texts.append("\n".join(blocks[i] for i in places))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` -> ``page_id, url, text, n_chars``, one row per input row.

    A null or empty html gives the empty text. Without a url the host is empty; without a page_id a page is
    compared with no other. Pages of a host with equal blocks stand at the first of their paths. A page with
    fewer than two different neighbours is judged by its labels alone. Repeated rows repeat; the smaller
    page_id comes first among equal paths. No rows give no rows; other columns are not read.
    """
    python_batches(pages.sparkSession)
    parsed = written(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_bytes("html").alias("body"))
        .mapInArrow(_parse, _PARSED)
        .withColumn("page", F.xxhash64("host", "hashes", "labels")),
        "pages-parsed",
    )
    contents = parsed.where("page_id is not null").groupBy("page", "host").agg(F.min(F.struct("path", "page_id")).alias("at"))
    pairs = written(neighbours(contents.select("page", "host", "at.path", "at.page_id")), "page-pairs")
    known = parsed.where("page_id is not null").groupBy("page").agg(F.first("hashes").alias("hashes"), F.first("labels").alias("labels"))
    known = written(known, "page-hashes")
    near = skew_join(pairs, known.select(F.col("page").alias("near"), F.col("hashes").alias("other")), "near")
    others = near.groupBy("page").agg(F.collect_list("other").alias("others"))
    # pages without two different neighbours lose nothing; of the others, only those that change go on
    compared = skew_join(known, others.where("size(others) > 1"), "page").select("page", "labels", "hashes", "others")
    changed = written(compared.mapInArrow(_difference, "page long, kept array<int>"), "page-changes")
    few = changed.count() <= BROADCAST_ROWS
    alone = F.when(F.col("page_id").isNotNull(), F.col("page"))
    whole = parsed.withColumn("page", alone).join(F.broadcast(changed) if few else changed, "page", "left")
    texts = whole.select("page_id", "url", "blocks", "labels", "kept").mapInArrow(_texts, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
