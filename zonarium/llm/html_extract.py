"""HTML extraction: block parsing, then differencing of pages with the nearest URL.

A page is cut into lines, one for each block.  Lines in menus, headers, footers, asides, notices,
adverts, forms, scripts, styles and comment sections are template; lines inside ``article`` or
``main`` are article; on a page without either, the other lines are *open*.  Pages of a host are put
in the order of their paths, each is paired with the neighbour whose path shares the longer
beginning, the lines of a pair are aligned by longest common subsequence, and shared lines that are
template or open are deleted.  Shared lines that the page itself marks as article stay: articles
quote one another, and deleting what they share would lose their text.  A page all of whose open
lines are shared (a copy) has none of them deleted, since nothing tells template from text there.

The order is made by a range partitioning of slim rows (host, path, line hashes) and ranks from
per-partition counts, so a host with a third of all pages is spread over many tasks; neighbours
meet in a join on the rank.

Edge cases: null html counts as empty and gives an empty text; null urls share one empty host;
cut-off tags, comments and elements end with the page; repeated rows and ids are treated row by row;
an empty table gives an empty result; only the three named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm.simhash_dedup import written
from zonarium.llm.url_filter import host_of, path_of

ARTICLE, OPEN, TEMPLATE = 0, 1, 2

# Elements by their role.
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "title", "xmp"])
SKIPPED = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "input", "head"]) | RAW
HOLDS_ARTICLE = frozenset(["article", "main"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NOISE = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alerts?|sidebar|nav(?:bar|igation)?|menu|breadcrumbs?|footer|header|masthead|comments?|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|widget|toolbar|pagination|pager)(?:$|[\s_-])"
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<|[^<]+""", re.S)
_ROLE = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def _is_noise(attributes: str) -> bool:
    return bool(attributes) and any(NOISE.search(a or b or c) for a, b, c in _ROLE.findall(attributes))


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of every block with text, in page order."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    skip, depth = "", 0  # the template element we are in, and how many of its name are open
    inside = 0  # open article or main elements
    ever = False

    def flush(kind: int) -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, kind))

    def kind_now() -> int:
        return TEMPLATE if skip else ARTICLE if inside else OPEN

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if not m[0].startswith(("<!", "<?")) and skip not in RAW:
                buffer.append(m[0])
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK or name in SKIPPED:
            flush(kind_now())
        elif name == "br":
            buffer.append(" ")
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
                if depth <= 0:
                    skip = ""
            continue
        if closing:
            if name in HOLDS_ARTICLE:
                inside = max(0, inside - 1)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in SKIPPED or (name in BLOCK and name not in HOLDS_ARTICLE and name not in ("html", "body") and _is_noise(attributes)):
            skip, depth = name, 1
            if name in RAW:  # nothing inside is markup
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
                skip = ""
        elif name in HOLDS_ARTICLE:
            inside += 1
            ever = True
    flush(kind_now())
    return [(t, TEMPLATE if k == OPEN and ever else k) for t, k in out]


def common_lines(left: list[int], right: list[int]) -> list[int]:
    """Indices of ``left`` in one longest common subsequence.

    Equal beginnings and ends are taken off; the rest is a bit-parallel table, a row of which is one integer with a
    bit for each line of ``right`` (zero where the subsequence grows), so equal lines cost no more than others.
    Rows are kept at block boundaries only and made again block by block on the way back.
    """
    n, m, head, tail = len(left), len(right), 0, 0
    while head < min(n, m) and left[head] == right[head]:
        head += 1
    while tail < min(n, m) - head and left[n - 1 - tail] == right[m - 1 - tail]:
        tail += 1
    n, m = n - head - tail, m - head - tail
    places: dict[int, int] = {}
    for j in range(m):
        places[right[head + j]] = places.get(right[head + j], 0) | 1 << j
    whole = (1 << m) - 1

    def rows(v: int, begin: int, end: int) -> list[int]:
        out = [v]
        for x in left[head + begin : head + end]:
            u = v & places.get(x, 0)
            v = ((v + u) | (v - u)) & whole
            out.append(v)
        return out

    step = isqrt(n) + 1
    starts = [whole]
    for begin in range(0, n, step):
        starts.append(rows(starts[-1], begin, min(n, begin + step))[-1])
    inner: list[int] = []
    j = m
    for block in range((n - 1) // step if m else -1, -1, -1):
        begin = block * step
        table = rows(starts[block], begin, min(n, begin + step))
        i = len(table) - 1
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            elif table[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                inner.append(head + begin + i)
            else:
                i -= 1
    return [*range(head), *inner[::-1], *range(len(left) - tail, len(left))]


def _code(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [lines_of(x) for x in batch.column(2).to_pylist()]
        texts = [[t for t, k in p if k != TEMPLATE] for p in pages]
        cols = [
            pa.array([[_code(t) for t, _ in p] for p in pages], pa.list_(pa.int64())),
            pa.array([[k for _, k in p] for p in pages], pa.list_(pa.int8())),
            pa.array(texts, pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["page_id", "url", "codes", "kinds", "texts"])


def nearest(path: str, before: str | None, after: str | None) -> int:
    """0 for the neighbour before, 1 for the one after: whose path shares the longer beginning (ties: before)."""
    if before is None or after is None:
        return 0 if after is None else 1
    share = lambda other: next((k for k, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))
    return int(share(after) > share(before))


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, codes, kinds, path, before, after, codes_before, codes_after = (c.to_pylist() for c in batch.columns)
        shared = []
        for i in range(len(row)):
            other = (codes_before, codes_after)[nearest(path[i], before[i], after[i])][i]
            same = set(common_lines(codes[i], other)) if other else set()
            opened = [k for k, kind in enumerate(kinds[i]) if kind == OPEN]
            if all(k in same for k in opened):
                same = same - set(opened)
            order = [k for k, kind in enumerate(kinds[i]) if kind != TEMPLATE]
            shared.append([n for n, k in enumerate(order) if k in same and kinds[i][k] == OPEN])
        keep = [k for k, x in enumerate(shared) if x]
        yield pa.RecordBatch.from_arrays([pa.array([row[k] for k in keep], pa.int64()), pa.array([shared[k] for k in keep], pa.list_(pa.int32()))], ["row", "gone"])


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: one row a page with its text and the text's length in code points."""
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = raw.mapInArrow(_parse, "page_id long, url string, codes array<long>, kinds array<tinyint>, texts array<string>")
    parsed = written(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    slim = parsed.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "codes", "kinds")
    ordered = slim.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row").withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered, "ordered")
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["count"]
    offsets = ordered.sparkSession.createDataFrame(starts, "part long, start long")
    ranked = ordered.join(F.broadcast(offsets), part == F.col("part")).select("row", "host", "path", "codes", "kinds", (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))

    def neighbour(step: int, tag: str) -> DataFrame:
        return ranked.select((F.col("rank") - step).alias("rank"), F.col("host").alias(f"host_{tag}"), F.col("path").alias(f"path_{tag}"), F.col("codes").alias(f"codes_{tag}"))

    pairs = ranked.join(neighbour(-1, "b"), "rank", "left").join(neighbour(1, "a"), "rank", "left")
    same = lambda c, t: F.when(F.col(f"host_{t}") == F.col("host"), F.col(f"{c}_{t}"))
    pairs = pairs.select("row", "codes", "kinds", "path", same("path", "b").alias("pb"), same("path", "a").alias("pa"), same("codes", "b").alias("cb"), same("codes", "a").alias("ca"))
    gone = written(pairs.mapInArrow(_difference, "row long, gone array<int>"), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda x, i: ~F.array_contains("gone", i)))
    text = F.array_join(kept, "\n")
    return parsed.join(gone, "row", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
