"""Main text of web pages: equivalence-class template deduction over the pages of a host, then slot extraction."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuelake.llm.common import written

#: An equivalence class is part of a template if it has this many tokens, on this many different pages, whatever share
#: of the host's they are: each layout of a host has its own classes.
CLASS_TOKENS, CLASS_PAGES = 3, 3
#: Bytes of all templates up to which they are broadcast; beyond, pages and templates are joined by host.
BROADCAST_BYTES = 64 << 20

# Elements and words of class, id and role attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
_OUT = frozenset("nav footer aside form button dialog menu head label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations pagination pager widget widgets toolbar login search skip".split()
)
_COMMENTS = frozenset("comment comments commentlist respond replies reply disqus".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)),
    "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",)),
}

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z0-9]+")


class Node(NamedTuple):
    """One run of text: its block and the path, what it stands in, and its text with references decoded."""

    block: int
    path: str
    tag: str
    main: bool
    out: bool
    text: str


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}


def _kind(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it holds reader comments."""
    words = {w for k in ("class", "id") if k in attributes for w in _PART.findall(attributes[k].lower())}
    comments = bool(words & _COMMENTS)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
    return comments or hidden or tag in _OUT or attributes.get("role", "") in _ROLES or bool(words & _WORDS), comments


def parse(html: str) -> Iterator[Node | tuple[str, str]]:
    """Text nodes and ("<", path) for each element in page order. Unclosed and stray tags don't matter."""
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, path, main, out, comments
    block, at, n = 0, 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None and (loose := _LOOSE.search(html, at)):
            m = loose
        text = html[at : m.start() if m else n]
        if text and not text.isspace():
            tag, path, main, out, _ = stack[-1] if stack else ("", "", False, False, False)
            yield Node(block, path, tag, main, out, unescape(text))
        elif text:
            tag, path, main, out, _ = stack[-1] if stack else ("", "", False, False, False)
            yield Node(block, path, tag, main, out, " ")
        if m is None:
            return
        at = m.end()
        if m.lastindex is None:
            continue
        closing, tag, raw = m[1], m[2].lower(), m[3]
        if tag in _BLOCK:
            block += 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag doesn't end the article
            continue
        if tag == "br":
            top = stack[-1] if stack else ("", "", False, False, False)
            yield Node(block, top[1], top[0], top[2], top[3], " ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not raw.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in _BLOCK and tag not in ("html", "body"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        if tag in _CLOSES:
            same, stops = _CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in (same, tag):
                    del stack[k:]
                    break
                if stack[k][0] in stops:
                    break
        attributes = _attributes(raw)
        _, above, main, out, comments = stack[-1] if stack else ("", "", False, False, False)
        own_out, own_comments = _kind(tag, attributes) if tag not in ("html", "body") else (False, False)
        comments = comments or own_comments
        starts = not comments and (tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody")
        if tag == "header" and not main:
            own_out = True
        path = f"{above}/{tag}" + "".join(f".{attributes[k]}" for k in ("class", "id") if k in attributes)
        stack.append((tag, path, (main or starts) and not comments, (out and not (starts and not main)) or (own_out and not starts), comments))
        yield "<", path


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(*parts: object) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - 2**63


@functools.lru_cache(maxsize=1 << 16)
def element_token(path: str) -> int:
    return _hash("e", path)


def text_token(x: Node) -> int | None:
    """A text by its path and words; None for white space."""
    words = x.text.split()
    return _hash("t", x.path, *words) if words else None


def token_sequence(html: str) -> Iterator[int]:
    """The page's tokens in page order: each element by its path, each text by its path and words."""
    found = (text_token(x) if isinstance(x, Node) else element_token(x[1]) for x in parse(html))
    return (t for t in found if t is not None)


def page_tokens(html: str) -> Counter[int]:
    """The page's tokens with their counts, in the order of their first places."""
    return Counter(token_sequence(html))


def _not_increasing(keys: list[int]) -> set[int]:
    """Places of keys that are not in the longest increasing subsequence found first."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, key in enumerate(keys):
        i = bisect_left(ends, key)
        before.append(at[i - 1] if i else -1)
        ends[i : i + 1] = [key]
        at[i : i + 1] = [k]
    inside, k = set(), at[-1] if at else -1
    while k >= 0:
        inside.add(k)
        k = before[k]
    return set(range(len(keys))) - inside


def invalid_tokens(found: list[tuple[int, int, int]], sizes: dict[int, int]) -> tuple[set[int], set[int]]:
    """What keeps a page's classes from being valid: tokens out of their class's order, and tokens that begin a new part of it.

    found: the page's tokens of classes in page order, with class and place in it. A class is ordered if all its tokens
    come once in their order, then all again. It is nested if no token of a class that began before comes between its own:
    at such a token its parts end, so that each lies in one gap of every class around it.
    """
    times: Counter[int] = Counter()
    keys: dict[int, list[int]] = {}
    places: dict[int, list[int]] = {}
    for i, (token, own, rank) in enumerate(found):
        keys.setdefault(own, []).append(times[token] * sizes[own] + rank)
        places.setdefault(own, []).append(i)
        times[token] += 1
    stray = {places[c][k] for c, ks in keys.items() if any(x >= y for x, y in zip(ks, ks[1:], strict=False)) for k in _not_increasing(ks)}
    out, cut = {found[i][0] for i in stray}, set()
    opened: list[int] = []
    round_of: dict[int, int] = {}
    times.clear()
    for token, own, rank in found:
        n = times[token]
        times[token] += 1
        if token in out:
            continue
        if own in opened and round_of[own] == n:
            while opened[-1] != own:
                opened.pop()
        else:
            if own in opened:
                opened.remove(own)
            elif round_of.get(own) == n:
                cut.add(token)
            opened.append(own)
            round_of[own] = n
        if rank == sizes[own] - 1:
            opened.pop()
    return out, cut


_TOKENS = "host string, token long, low long, high long, m0 long, m1 long, m2 long, m3 long, page long, place long"
_MAPS = ["m0", "m1", "m2", "m3"]
_LOW = (1 << 64) - 1


def templates(pages: DataFrame) -> DataFrame:
    """host and tokens: the sorted tokens of the host's valid equivalence classes. pages: page, host, html.

    A token's occurrence vector is its count on each page of the host; its digest are two sums of halves of a hash of
    each page and count, so that vectors of any length add up map-side, and pages that repeat count in all tokens
    alike. Tokens of one digest form a class. Beside it go bits of the different pages that have the token, by hashes
    of their whole html, so that copies of one page, however many, are one page. Four maps of 64 bits are kept: three
    pages fall on fewer bits in all of them once in 200,000. A class's order is that of its tokens' first places on the
    page of least hash, which all of them have. Each page is then held against the classes (see invalid_tokens): tokens
    out of order on any page leave their class, and a class that isn't nested is broken up at the tokens that any page
    finds, of which parts with CLASS_TOKENS stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[tuple[str, int], list] = {}

        def rows() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in hosts], pa.string()), pa.array([k[1] for k in hosts], pa.int64())]
            sums = np.array([s for s in hosts.values()], np.uint64).reshape(-1, 8).view(np.int64)
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(8))], names=["host", "token", "low", "high", *_MAPS, "page", "place"])

        for batch in batches:
            for page, host, html in zip(*(batch[c].to_pylist() for c in ("page", "host", "html")), strict=True):
                content = _hash(html) + 2**63
                own = _hash(page, content) + 2**63
                bits = [1 << (content >> 6 * k & 63) for k in range(4)]
                for place, (token, n) in enumerate(page_tokens(html).items()):
                    h = (own ^ n * 0x9E3779B97F4A7C15) * 0xC2B2AE3D27D4EB4F & _LOW
                    h ^= h >> 29
                    s = hosts.get((host, token))
                    if s is None:
                        hosts[host, token] = [h & 0xFFFFFFFF, h >> 32, *bits, own, place]
                        continue
                    s[0] += h & 0xFFFFFFFF
                    s[1] += h >> 32
                    for k in range(4):
                        s[2 + k] |= bits[k]
                    if own < s[6]:
                        s[6:] = own, place
            if len(hosts) > 200_000:
                yield rows()
                hosts.clear()
        if hosts:
            yield rows()

    # Hashes as signed longs are ordered with their highest bit flipped.
    first = F.min_by("place", F.col("page").bitwiseXOR(F.lit(-(2**63)))).alias("place")
    sums = pages.mapInArrow(count, _TOKENS).groupBy("host", "token").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), first, *(F.bit_or(m).alias(m) for m in _MAPS))
    frequent = written(sums.where(F.greatest(*map(F.bit_count, _MAPS)) >= CLASS_PAGES).drop(*_MAPS), "html-tokens")
    classes = frequent.groupBy("host", "low", "high").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("found")).where(F.size("found") >= CLASS_TOKENS)
    classes = written(classes.select("host", F.xxhash64("low", "high").alias("class"), F.col("found.token").alias("tokens")), "html-classes")
    ranked = classes.select("host", "class", F.posexplode("tokens").alias("rank", "token"))
    faults = _faults(pages, classes).groupBy("host", "token").agg(F.max("out").alias("out"), F.max("cut").alias("cut"))
    # A class's parts are numbered by the cuts up to each token.
    part = F.sum(F.coalesce(F.col("cut").cast("int"), F.lit(0))).over(Window.partitionBy("host", "class").orderBy("rank"))
    parts = ranked.join(faults, ["host", "token"], "left").withColumn("part", part).where(~F.coalesce("out", F.lit(False)))
    valid = parts.groupBy("host", "class", "part").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= CLASS_TOKENS)
    return valid.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def _faults(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """host, token, out and cut: what the pages find against the classes, each token at most once a batch and host."""
    spark = pages.sparkSession

    def table(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted tokens, with class and place in it."""
        tokens = np.array([t for own in lists for t in own], np.int64)
        own = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        rank = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists]) if lists else own
        order = np.argsort(tokens)
        return tokens[order], own[order], rank[order]

    def run(batches: Iterator[pa.RecordBatch], known: dict[str, tuple] | None = None) -> Iterator[pa.RecordBatch]:
        last: tuple[str, tuple, dict] | None = None
        for batch in batches:
            faults: dict[tuple[str, int], list[bool]] = {}
            for k, (host, html) in enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True)):
                if known is not None and host not in known:
                    continue
                if last is None or last[0] != host:
                    own = known[host] if known is not None else table(batch["classes"][k].as_py())
                    last = host, own, Counter(own[1].tolist())
                tokens, numbers, ranks = last[1]
                seen = np.fromiter(token_sequence(html), np.int64)
                at = np.minimum(np.searchsorted(tokens, seen), len(tokens) - 1)
                at = at[tokens[at] == seen]
                for which, found in enumerate(invalid_tokens(list(zip(tokens[at].tolist(), numbers[at].tolist(), ranks[at].tolist(), strict=True)), last[2])):
                    for token in found:
                        faults.setdefault((host, token), [False, False])[which] = True
            flags = list(faults.values())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in faults], pa.string()), pa.array([t for _, t in faults], pa.int64()), pa.array([o for o, _ in flags], pa.bool_()), pa.array([c for _, c in flags], pa.bool_())], names=["host", "token", "out", "cut"])

    schema = "host string, token long, out boolean, cut boolean"
    by_host = classes.groupBy("host").agg(F.collect_list("tokens").alias("classes"))
    size = classes.agg(F.sum(F.size("tokens") * 16 + F.length("host") + 400)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: table(r["classes"]) for r in by_host.toLocalIterator()})
        return pages.select("host", "html").mapInArrow(lambda batches: run(batches, shared.value), schema)
    return pages.select("host", "html").join(by_host, "host").mapInArrow(run, schema)


_NONE = np.empty(0, np.int64)


def main_text(html: str, template: np.ndarray = _NONE) -> str:
    """The blocks of a page's main text, joined by line ends. template: sorted tokens of the page's host.

    Template tokens and their slots: a text that is itself of the template is boilerplate unless it is prose of the
    article; the rest are slots. If the page has an article or main element, slots in it are taken; else of the slots
    outside of left-out elements all those below the template path that holds most of their text.
    """
    found = list(parse(html))
    if len(template):
        # Prose of the article and what is left out don't depend on the template.
        own = (element_token(x[1]) if not isinstance(x, Node) else None if x.out or x.main and _is_prose(x) else text_token(x) for x in found)
        tokens = np.array([0 if t is None else t for t in own], np.int64)
        known = (template[np.minimum(np.searchsorted(template, tokens), len(template) - 1)] == tokens).tolist()
    else:
        known = [False] * len(found)
    nodes: list[tuple[Node, str, bool]] = []
    slots: dict[str, str] = {}
    for x, fixed in zip(found, known, strict=True):
        if isinstance(x, Node):
            nodes.append((x, slots.get(x.path, ""), fixed))
        else:
            path = x[1]
            slots[path] = path if fixed else slots.get(path.rpartition("/")[0], "")
    has_main = any(x.main and not x.out and not x.text.isspace() for x, _, _ in nodes)
    kept = [(x, slot) for x, slot, fixed in nodes if not x.out and x.main == has_main and not fixed]
    if not has_main and len(template):
        weight: Counter[str] = Counter()
        for x, slot in kept:
            weight[_section(slot)] += len(x.text)
        if weight:
            best = max(sorted(weight), key=weight.__getitem__)
            kept = [(x, s) for x, s in kept if _section(s) == best]
    blocks: dict[int, list[str]] = {}
    for x, _ in kept:
        blocks.setdefault(x.block, []).append(x.text)
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))))


def _is_prose(x: Node) -> bool:
    return x.tag in _PROSE or any(f"/{p}" in x.path[x.path.rfind("article") :] for p in ("p", "h1", "li"))


def _section(slot: str) -> str:
    """A slot's template path without the prose elements that end it."""
    parts = slot.split("/")
    while parts and parts[-1].partition(".")[0] not in _BLOCK - _PROSE - {"ul", "ol", "dl"} and len(parts) > 1:
        parts.pop()
    return "/".join(parts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row of pages: page_id, url, text and n_chars.

    A null html is empty, a null url has the empty host; both columns come back as they were. Very long pages are
    read whole. Rows that repeat are rows of their own. Other columns don't matter. An empty table gives an empty
    result. Hosts with fewer than three pages have no template; of those, what isn't in a left-out element is main.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    found = written(templates(rows), "html-templates")
    size = found.agg(F.sum(F.size("tokens") * 8 + F.length("host") + 200)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch], known: dict[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] | None = None  # joined rows of one host come together
        for batch in batches:
            texts = []
            for k, (host, html) in enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True)):
                if known is not None:
                    template = known.get(host, _NONE)
                else:
                    if last is None or last[0] != host:
                        last = host, np.array(batch["tokens"][k].as_py() or (), np.int64)
                    template = last[1]
                texts.append(main_text(html, template))
            yield pa.RecordBatch.from_arrays([batch["page"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        # Sorted arrays: as many bytes on the driver and in a worker as are counted here.
        shared = spark.sparkContext.broadcast({r["host"]: np.array(r["tokens"], np.int64) for r in found.toLocalIterator()})
        return rows.mapInArrow(lambda batches: run(batches, shared.value), schema)
    return rows.join(found, "host", "left").mapInArrow(run, schema)
