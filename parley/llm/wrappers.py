"""Main text of web pages by wrappers inferred for each host.

A page is a sequence of block tags and texts.  Repeated groups collapse to iterators; the sequences of a
host are aligned one after another: what does not match becomes optional, texts that differ become slots,
texts that stay are part of the template (union-free expressions, after "RoadRunner", Crescenzi, Mecca and
Merialdo, 2001).  The pages of a host are dealt by their expressions, so that a host with a third of all
pages is folded in many tasks, each in order; their wrappers then merge.  The wrapper decides what is
extracted: its content region, less the texts of its template outside of article elements.  Markup only labels containers,
as furniture (menus, headers, footers and the like) or as article, when the region is chosen.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import materialise, small_batches
from parley.llm.urls import with_host_and_path

#: Elements that stay within a block, that are containers, and that hold no main text.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = set(
    "html body div section article main nav header footer aside form ul ol li dl table tbody thead tr td th blockquote "
    "figure menu dialog fieldset details button select template noscript".split()
)
NO_TEXT = set("head title nav footer aside form menu dialog button select template noscript iframe svg object".split())
NO_TEXT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|alert|popup|modal|overlay|sidebar|side|"
    r"aside|menu|nav\w*|breadcrumbs?|toolbar|pagination|pager|header|masthead|footer|foot|copyright|comments?|replies|reply|"
    r"disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|tags)(?:$|[\s_-])",
    re.I,
)
#: Names that tell what a container has or lacks, or that belong to the article itself.
NO_FURNITURE = re.compile(r"(?:has|have|no|not|with|without|hide|show|is)[_-].*|(?:article|post|entry|story|content|page|section)[_-]*(?:header|head|title|tags)", re.I)
LEAST_PAGES = 3
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|"
    r"</?[a-zA-Z](?:[^>\"'=]++|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z|<|[^<]+",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, str]]:
    """(labels of the open containers, block tag, text) of every block of text in page order."""
    out, stack, buffer, tag = [], [], [], ""

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((tuple(stack), tag, text))

    for m in _TOKEN.finditer(page):
        token = m.group()
        found = _TAG.match(token) if token[0] == "<" else None
        if not found:
            if token[0] != "<" or token == "<":
                buffer.append(token)
            continue
        closing, name = found[1], found[2].lower()
        if name in ("script", "style"):
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                buffer.append(" ")
            continue
        flush()
        tag = "" if closing else name
        if name in CONTAINERS or name in NO_TEXT:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].split("|")[0] == name:
                        del stack[i:]
                        break
            elif not token.endswith("/>"):
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(token)).replace(">", " ").replace("|", " ")
                stack.append(f"{name}|{re.sub(r'[0-9]+', '0', names)}" if names else name)
    flush()
    return out


def _is_furniture(label: str, inside: bool) -> bool:
    """Whether a container is a menu, header, footer, sidebar, notice, advert, form or comments; ``inside`` an article headers are not."""
    name, _, names = label.partition("|")
    if name in NO_TEXT or (name == "header" and not inside):
        return True
    if name in ("html", "body", "main"):
        return False
    return any(NO_TEXT_NAMES.search(n) and not NO_FURNITURE.fullmatch(n) and not (inside and n.lower() == "header") for n in names.split())


def furniture(paths: list, sizes: list[int]) -> list[bool]:
    """Of blocks with these open containers and lengths, those that stand in furniture.

    A container that looks like furniture is none if it holds more than half of the text of all article and main
    elements (a page's layout, an unclosed menu).  Where no block would be left, names do not count, and where none
    is left even so, forms and menus hold text as well.
    """
    first = [next((i for i, label in enumerate(p) if label.partition("|")[0] in ("article", "main")), len(p)) for p in paths]
    marked = sum(n for p, i, n in zip(paths, first, sizes, strict=True) if i < len(p))
    held: dict[tuple, int] = {}
    if marked:
        for p, i, n in zip(paths, first, sizes, strict=True):
            for k in range(1, i + 1) if i < len(p) else ():
                held[tuple(p[:k])] = held.get(tuple(p[:k]), 0) + n
    known: dict[tuple, bool] = {}

    def inside(path, at: int) -> bool:
        whole = tuple(path)
        if whole not in known:
            known[whole] = any(
                _is_furniture(label, k > at) and not (k < at < len(path) and 2 * held.get(whole[: k + 1], 0) > marked) for k, label in enumerate(path)
            )
        return known[whole]

    out = [inside(p, i) for p, i in zip(paths, first, strict=True)]
    for hidden in (NO_TEXT, NO_TEXT - {"form", "menu", "nav", "dialog"}):
        if not all(out):
            break
        out = [any(label.partition("|")[0] in hidden or label.partition("|")[0] == "header" for label in p) for p in paths]
    return out


def digest(text: str) -> str:
    """The mark by which equal texts are told."""
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def _alike(a: list, b: list, together: bool) -> list:
    """One item for two; the texts that stay are those of both (of either, if both stand in one page)."""
    texts = {**a[3], **b[3]} if together else {h: n for h, n in a[3].items() if h in b[3]}
    return [a[0], a[1] and b[1], a[2] or b[2], texts, a[4] + b[4], max(a[5], b[5]) if together else a[5] + b[5]]


def collapse(items: list[list], together: bool = True) -> list[list]:
    """Adjacent equal groups of up to 6 items become one iterator."""
    for size in range(1, 7):
        out: list[list] = []
        for item in items:
            out.append(item)
            if len(out) >= 2 * size and all(out[j - size][0] == out[j][0] for j in range(-size, 0)):
                last = [_alike(out[j - size], out[j], together) for j in range(-size, 0)]
                del out[-2 * size :]
                out += [[k, o, True, t, n, s] for k, o, _, t, n, s in last]
        items = out
    return items


def expression(page: str) -> list[list]:
    """A page as items [key, optional, repeated, {texts that stay: characters}, characters, pages]."""
    return collapse([[f"{'>'.join(path)} {tag}", False, False, {digest(text): len(text)}, len(text), 1] for path, tag, text in blocks(page)])


def merge(a: dict, b: dict) -> dict:
    """The wrapper that covers both: unmatched items are optional, differing texts are slots."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    x, y = a["items"], b["items"]
    out = []
    keys = [[i[0] for i in x], [j[0] for j in y]]
    same = [("equal", 0, len(x), 0, len(y))] if keys[0] == keys[1] else None
    for op, i0, i1, j0, j1 in same or SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if op == "equal":
            for p, q in zip(x[i0:i1], y[j0:j1], strict=True):
                both = _alike(p, q, False)
                both[1] = p[1] or q[1]
                out.append(both)
        else:
            out += [[k, True, *rest] for k, _, *rest in (*x[i0:i1], *y[j0:j1])]
    return {"n": a["n"] + b["n"], "items": out if same else collapse(out, False)}


def _expressions(shares: int):
    """(host, share, expression) of each page; equal pages of a host have equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(expression(page or "")) for page in batch.column(1).to_pylist()]
            share = [zlib.crc32(e.encode()) % shares for e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.int32()), pa.array(found, pa.string())], names=["host", "share", "wrapper"])

    return run


def _folded(keys: int, pages: bool):
    """One wrapper for each run of rows with equal first ``keys`` columns; rows are sorted, only one wrapper is held.

    With ``pages`` rows are expressions of pages, and repeated ones count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, before = None, None, None

        def row() -> pa.RecordBatch:
            out = json.dumps(held if keys > 1 else _digest(held))
            types = pa.string(), pa.int32()
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(now, types, strict=False)), pa.array([out], pa.string())], names=["host", "share"][:keys] + ["wrapper"])

        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in (*batch.columns[:keys], batch.columns[-1])), strict=True):
                if key != now:
                    if now is not None:
                        yield row()
                    now, held, before = key, {"n": 0, "items": []}, None
                if pages and text == before:
                    continue
                before = text
                held = merge(held, {"n": 1, "items": json.loads(text)} if pages else json.loads(text))
        if now is not None:
            yield row()

    return run


def _digest(wrapper: dict) -> dict:
    """What extraction needs of a wrapper: its template texts by place, and the content region.

    A text that stays in all pages that have its place, at least LEAST_PAGES and half of the host's, is
    template.  The region is the innermost container that holds nine tenths of the slot text outside of
    furniture; where slots stand within article or main elements, only those count.
    """
    enough = max(LEAST_PAGES, wrapper["n"] / 2)
    fixed: dict[str, list[str]] = {}
    slots: list[tuple[list[str], int]] = []
    paths = [key.rpartition(" ")[0].split(">") if key.rpartition(" ")[0] else [] for key, *_ in wrapper["items"]]
    for labels, hidden, (key, _, _, texts, n, support) in zip(paths, furniture(paths, [i[4] for i in wrapper["items"]]), wrapper["items"], strict=True):
        if support >= enough and texts:
            fixed[key] = sorted({*fixed.get(key, []), *texts})
            n -= support * sum(texts.values())
        if n > 0 and not hidden:
            slots.append((labels, n))
    marked = any(is_marked(labels) for labels, _ in slots)
    if marked:
        slots = [s for s in slots if is_marked(s[0])]
    region: list[str] = []
    while slots:
        below: dict[str, int] = {}
        for labels, n in slots:
            if len(labels) > len(region):
                below[labels[len(region)]] = below.get(labels[len(region)], 0) + n
        best = max(sorted(below), key=below.get) if below else None
        if best is None or below[best] < 0.9 * sum(n for _, n in slots):
            break
        region.append(best)
        slots = [s for s in slots if s[0][: len(region)] == region]
    return {"fixed": fixed, "region": region, "marked": marked}


def is_marked(labels) -> bool:
    """Whether some open container is an article or main element."""
    return any(label.split("|")[0] in ("article", "main") for label in labels)


def main_text(page: str, wrapper: dict) -> str:
    """The slots of the wrapper's content region, joined by line ends.

    Within an article or main element texts of the template are the author's as well and stay.  A page without any block there is not covered by the wrapper: its blocks outside of furniture and
    template count.
    """
    fixed, region = wrapper["fixed"], wrapper["region"]
    read = blocks(page)
    found = [
        (path, text)
        for (path, tag, text), hidden in zip(read, furniture([p for p, *_ in read], [len(t) for *_, t in read]), strict=True)
        if not hidden and (is_marked(path) or digest(text) not in fixed.get(f"{'>'.join(path)} {tag}", ()))
    ]
    inside = [text for path, text in found if list(path[: len(region)]) == region and (not wrapper["marked"] or is_marked(path))]
    return "\n".join(inside or [text for _, text in found])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper not in parsed:
                if len(parsed) > 1000:
                    parsed.clear()
                parsed[wrapper] = json.loads(wrapper)
            texts.append(main_text(page or "", parsed[wrapper]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; pages without a host (null urls as well) share one wrapper.
    Character references are decoded, white space within a block becomes one space, blocks are joined by
    one line end.  Repeated rows are extracted each, but count once in the wrapper.  Long pages are read
    whole; an empty table gives no rows; other columns are ignored, whatever their names.  Pages are
    dealt and folded in the order of their expressions, so the layout of the input does not matter.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosted = with_host_and_path(pages)
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = hosted.select("host", "html").mapInArrow(_expressions(shares), "host string, share int, wrapper string")
    parts = rows.repartition("host", "share").sortWithinPartitions("host", "share", "wrapper").mapInArrow(_folded(2, True), "host string, share int, wrapper string")
    wrappers = parts.repartition("host").sortWithinPartitions("host", "share").mapInArrow(_folded(1, False), "host string, wrapper string")
    wrappers = materialise(wrappers, "wrappers")
    joined = hosted.join(wrappers, "host").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
