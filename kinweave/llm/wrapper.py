"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page is a stream of tags and texts. Runs that repeat at once become repeated groups; a host's pages align one by
one with the host's wrapper, and whatever only one side has becomes an optional group. Texts are slots: each page is
then matched against its host's expression, and what its slots hold is summed over all pages by slot and place (the
containers around it), in an aggregate without a limit. Slots in the host's article are its main text, but not those
of menus, adverts and the like, whether their text varies or not; pages without an article keep the place of most
plain text among such pages of their host, without slots that hold the same text on every page. Only articles, menus and
the like are told by names of tags and classes; with words=False no name is read, and places and slots decide alone.

Each task first folds its own pages host by host and only wrappers are moved, so a host of any size stays spread; they
merge by host and salt, then by host, as wrappers align with each other as pages do. An expression beyond MOST_ITEMS is
made more general: its largest run of optional parts becomes one gap that takes anything, so pages of any number and
kind still fit it.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .url_gbt import host_path

MOST_ITEMS, WIDEST, SALTS = 300, 16, 32
#: The item that takes any tags and texts.
GAP = "*"
#: Bytes up to which the rules of all hosts are broadcast.
SMALL_RULES = 8 << 20

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "xmp", "noembed", "noframes"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img input".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = {"article", "main"}
_CHROME = set("nav footer aside form button select option dialog menu head fieldset datalist".split())
_CHROME_WORD = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|aside|"
    r"comment\w*|respond|discussion|disqus|share\w*|social\w*|related\w*|recommend\w*|subscribe\w*|newsletter\w*|sign-?up|login|search\w*|footer\w*|widget\w*|pagination|pager|skip\w*|toolbar)(?=$|[-_ ])"
)
_HEAD_WORD = re.compile(r"(?:^|[-_ .])(?:header\w*|masthead)(?=$|[-_ ])")
_MAIN_WORD = re.compile(r"(?:^|[-_ ])(?:article\w*|story\w*|post-?(?:body|content|text)?|entry-?(?:content|body|text)?|main-?(?:content|text)?|content-?(?:body|main)?)(?=$|[-_ ])")


def _key(name: str, attrs: str) -> tuple[str, bool, bool]:
    """(what tells a container from others, whether it holds chrome, whether it holds an article)."""
    words = " ".join(b or c or d for a, b, c, d in _ATTR.findall(attrs)).lower() if attrs else ""
    chrome = name in _CHROME or bool(words and _CHROME_WORD.search(words))
    main = not chrome and (name in _MAIN or bool(words and name not in _INLINE and _MAIN_WORD.search(words)))
    words = re.sub(r"\d+", "0", words)
    if len(words) > 40:  # long ones by a digest
        words = f"{words[:24]}~{xxhash.xxh64_hexdigest(words.encode('utf-8', 'surrogatepass'))}"
    return name + ("." + words if words else ""), chrome, main


class Page:
    """items: keys of structural tags and texts; blocks: (place, chrome, main, link characters, text) in page order."""

    def __init__(self, source: str, words: bool = True):
        self.items: list[str] = []
        self.blocks: list[tuple[str, bool, bool, int, str]] = []
        stack: list[tuple[str, str, bool, bool, bool]] = []
        text: list[str] = []
        links, in_link, pos = 0, 0, 0

        def close() -> None:
            nonlocal links
            t = " ".join("".join(text).split())
            if t:
                place = ">".join(s[1] for s in stack)
                chrome = any(s[2] for s in stack)
                # A header of the page is chrome, a header inside an article is the article's.
                inside = False
                for s in stack:
                    inside = inside or s[3]
                    chrome = chrome or (s[4] and not inside)
                self.blocks.append((place, chrome, inside, min(links, len(t)), t))
                self.items.append("T")
            text.clear()
            links = 0

        while True:
            m = _TAG.search(source, pos)
            piece = source[pos : m.start() if m else len(source)]
            if piece:
                piece = entities.unescape(piece)
                text.append(piece)
                links += len(piece) if in_link else 0
            if not m:
                break
            pos = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            shut, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in _RAW and not shut:
                if not attrs.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, pos)
                    pos = end.end() if end else len(source)
                continue
            if name in _INLINE:
                key, chrome, _ = _key(name, attrs)
                chrome = chrome and words
                if name == "a":
                    in_link = 0 if shut else 1
                elif name == "br":
                    text.append(" ")
                if not (chrome and not shut and name not in _VOID and name != "a"):
                    if not (shut and any(s[0] == name for s in stack)):
                        continue
            close()
            if shut:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                self.items.append("/" + name)
                if name not in _INLINE:
                    in_link = 0
            else:
                key, chrome, main = _key(name, attrs)
                chrome, main = chrome and words, main and words
                self.items.append(key)
                if name not in _VOID and name not in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") or chrome:
                    stack.append((name, key, chrome, main, words and (name == "header" or bool(_HEAD_WORD.search(key)))))
        close()


def collapse(items: list) -> list:
    """Runs that repeat at once as groups ["+", run], the shortest first."""
    width = 1
    while width <= WIDEST:
        out, i, n, found = [], 0, len(items), False
        while i < n:
            j = i + width
            if j + width <= n and items[i] == items[j] and items[i:j] == items[j : j + width]:
                unit = items[i:j]
                while items[j : j + width] == unit:
                    j += width
                out.append(unit[0] if width == 1 and isinstance(unit[0], list) else ["+", unit])
                i, found = j, True
            else:
                out.append(items[i])
                i += 1
        items = out
        width = 1 if found and width > 1 else width + 1
    return items


def _groups(items: list, kinds: str) -> list[list]:
    out = []
    for x in items:
        if isinstance(x, list):
            if x[0] in kinds:
                out.append(x)
            out += _groups(x[1], kinds)
    return out


def _fold(items: list, groups: list[list]) -> list:
    """items with each run that a known group holds as that group."""
    for g in sorted(groups, key=lambda g: -len(g[1])):
        unit, n = g[1], len(g[1])
        if not unit or (g[0] == "?" and n < 3) or unit[0] not in items:
            continue
        out, i = [], 0
        while i < len(items):
            if items[i : i + n] == unit:
                while items[i : i + n] == unit:
                    i += n
                if not (out and out[-1] == g):
                    out.append(g)
            else:
                if not (items[i] == g and out and out[-1] == g):
                    out.append(items[i])
                i += 1
        items = out
    return items


def align(wrapper: list, other: list) -> list:
    """The wrapper that also takes the other items: what one side lacks is optional."""
    other = _fold(other, _groups(wrapper, "+?"))
    keys = [[json.dumps(x) for x in side] for side in (wrapper, other)]

    def optional(part: list) -> list:
        if not part:
            return []
        return part if len(part) == 1 and isinstance(part[0], list) and part[0][0] == "?" else [["?", part]]

    out: list = []
    for kind, a, b, c, d in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if kind == "equal":
            out += wrapper[a:b]
        else:
            plain = [x for x in wrapper[a:b] if isinstance(x, list) and x[0] == "?"]
            out += plain if len(plain) == b - a else optional(wrapper[a:b])
            out += optional(other[c:d])
    return collapse(out)


def size(items: list) -> int:
    return sum(size(x[1]) + 1 if isinstance(x, list) else 1 for x in items)


def general(items: list, most: int | None = None) -> list:
    """An expression of at most MOST_ITEMS that takes all that items takes: gaps stand for the largest runs of optional parts.

    Without any, the middle becomes a gap. Optional parts next to a gap are in it already.
    """
    most = MOST_ITEMS if most is None else most

    def loose(x) -> bool:
        return x == GAP or isinstance(x, list) and x[0] == "?"

    while True:
        runs, at = [], 0
        while at < len(items):
            end = at
            while end < len(items) and loose(items[end]):
                end += 1
            if end > at:
                runs.append((size(items[at:end]), at, end))
            at = max(end, at + 1)
        for _, s, e in reversed(runs):
            if GAP in items[s:e] and e - s > 1:
                items = [*items[:s], GAP, *items[e:]]
                break
        else:
            if size(items) <= most:
                return items
            n, s, e = max(runs, default=(0, 0, 0))
            if n > 1:
                items = [*items[:s], GAP, *items[e:]]
            else:
                inner = [i for i, x in enumerate(items) if isinstance(x, list) and size(x[1]) > most // 2]
                if inner:
                    items = [*items[: inner[0]], GAP, *items[inner[0] + 1 :]]
                else:
                    cut = max(1, min(most // 3, len(items) // 3))
                    items = [*items[:cut], GAP, *items[len(items) - cut :]]


def expression(items: list) -> str:
    """The wrapper as a regular expression over tags and #text."""
    return " ".join(f"( {expression(x[1])} ){x[0]}" if isinstance(x, list) else "#text" if x == "T" else ".*" if x == GAP else f"<{x}>" for x in items)


class Wrapper:
    """items: the expression that the pages added so far align into."""

    def __init__(self, items: list | None = None):
        self.items, self.known = items, set()

    def add(self, page: Page) -> None:
        mark = hash(tuple(page.items))
        if mark not in self.known:
            self.known.add(mark)
            if self.items is None or GAP not in self.items or Matcher(self.items).slots(page.items) is None:
                self._take(collapse(page.items))

    def _take(self, items: list) -> None:
        if self.items is None:
            self.items = general(items)
        elif items != self.items:
            self.items = general(align(self.items, items))

    def merge(self, other: Wrapper) -> None:
        self._take(other.items or [])

    def dump(self) -> str:
        return json.dumps(self.items)

    @classmethod
    def load(cls, s: str) -> Wrapper:
        return cls(json.loads(s))


def infer(pages: DataFrame, html_col: str, host_col: str, words: bool = True) -> DataFrame:
    """(host, wrapper) of each host, over all its pages."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = defaultdict(Wrapper)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([w.dump() for w in held.values()])], ["host", "wrapper"])
                held.clear()

        for b in batches:
            for host, source in zip(b.column("host").to_pylist(), b.column("source").to_pylist()):
                held[host].add(Page(source or "", words))
                if len(held) > 2_000:
                    yield from flush()
        yield from flush()

    def merge(rows: pa.Table) -> pa.Table:
        total = Wrapper()
        for w in sorted(rows.column("wrapper").to_pylist()):
            total.merge(Wrapper.load(w))
        return pa.table({"host": rows.column("host").slice(0, 1), "wrapper": [total.dump()]})

    src = pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("source"))
    parts = src.mapInArrow(fold, "host string, wrapper string")
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInArrow(merge, "host string, wrapper string")
    return parts.groupBy("host").applyInArrow(merge, "host string, wrapper string")


class Matcher:
    """An expression as an automaton whose states are its tags and slots, numbered from the left."""

    def __init__(self, items: list):
        self.names: list[str] = []
        self.follow: list[dict[str, list[int]]] = []
        self.empty, first, last = self._build(items)
        self.first, self.last = self._by_name(first), set(last)

    def _by_name(self, states: list[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for p in states:
            out.setdefault(self.names[p], []).append(p)
        return out

    def _next(self, table: dict[str, list[int]], name: str) -> list[int]:
        named, any_ = table.get(name, ()), table.get(GAP, ())
        return [*named, *any_] if any_ else named

    def _link(self, last: list[int], first: list[int]) -> None:
        by_name = self._by_name(first)
        for p in last:
            for name, states in by_name.items():
                held = self.follow[p].setdefault(name, [])
                held += [q for q in states if q not in held]

    def _build(self, items: list) -> tuple[bool, list[int], list[int]]:
        """(whether nothing fits, first states, last states)."""
        empty, first, last = True, [], []
        for x in items:
            if isinstance(x, list):
                e, f, z = self._build(x[1])
                if x[0] == "+":
                    self._link(z, f)
                e = e or x[0] == "?"
            else:
                self.names.append(x)
                self.follow.append({})
                e, f, z = x == GAP, [len(self.names) - 1], [len(self.names) - 1]
                if x == GAP:
                    self._link(z, f)
            self._link(last, f)
            first = first + f if empty else first
            last = last + z if e else z
            empty = empty and e
        return empty, first, last

    def slots(self, items: list[str]) -> list[int] | None:
        """The slot of each text of a page, None if the page does not fit."""
        if not items:
            return [] if self.empty else None
        steps: list[dict[int, int] | tuple[int, int]] = []
        live = {q: -1 for q in self._next(self.first, items[0])}
        for name in items[1:]:
            if not live:
                return None
            steps.append(live if len(live) > 1 else next(iter(live.items())))
            step: dict[int, int] = {}
            for p in live:
                for q in self._next(self.follow[p], name):
                    step.setdefault(q, p)
            live = step
        p = next((q for q in live if q in self.last), None)
        if p is None:
            return None
        out, before = [], live[p]
        for i in range(len(items) - 1, -1, -1):
            if items[i] == "T":
                out.append(p)
            p = before
            if i > 1:
                before = steps[i - 1][p] if isinstance(steps[i - 1], dict) else steps[i - 1][1]
        return out[::-1]


class Reader:
    """Pages with the slot of each block: -1 on pages that their host's expression does not fit."""

    def __init__(self, words: bool = True):
        self.matchers: dict[str, Matcher] = {}
        self.words = words

    def read(self, source: str | None, wrapper: str) -> tuple[Page, list[int]]:
        m = self.matchers.get(wrapper)
        if m is None:
            if len(self.matchers) >= 500:
                self.matchers.clear()
            m = self.matchers[wrapper] = Matcher(json.loads(wrapper) or [])
        page = Page(source or "", self.words)
        slots = m.slots(page.items)
        return page, [-1] * len(page.blocks) if slots is None else slots


_STATS = "host string, slot int, place string, own boolean, chars long, links long, main boolean, pages long, low long, high long, page_low long, page_high long"


def tally(batches: Iterator[pa.RecordBatch], words: bool = True) -> Iterator[pa.RecordBatch]:
    """Sums per host, slot, place and whether the page has an article, over blocks outside chrome; several rows of a key add up.

    low and high are the least and greatest hash of what a page has there, page_low and page_high those of the pages'
    plain texts as a whole.
    """
    reader, held = Reader(words), {}

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            columns = zip(*((*k, *v) for k, v in held.items()))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in _STATS.split(", ")])
            held.clear()

    def mark(text: str) -> int:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)

    for b in batches:
        for host, source, wrapper in zip(*(b.column(c).to_pylist() for c in ("host", "source", "wrapper"))):
            page, slots = reader.read(source, wrapper)
            here: dict[tuple[int, str], list] = {}
            own_main = any(m and not chrome for _, chrome, m, _, _ in page.blocks)
            for slot, (place, chrome, main, links, text) in zip(slots, page.blocks):
                if not chrome:
                    h = here.setdefault((slot, place), [0, 0, False, []])
                    h[0] += len(text)
                    h[1] += links
                    h[2] = h[2] or main
                    h[3].append(text)
            whole = mark("\n".join(t for _, chrome, _, links, t in page.blocks if not chrome and links * 2 < len(t)))
            for (slot, place), (chars, links, main, texts) in here.items():
                own = mark("\n".join(texts))
                s = held.get((host, slot, place, own_main))
                if s is None:
                    held[host, slot, place, own_main] = [chars, links, main, 1, own, own, whole, whole]
                else:
                    s[:] = [s[0] + chars, s[1] + links, s[2] or main, s[3] + 1, min(s[4], own), max(s[5], own), min(s[6], whole), max(s[7], whole)]
            if len(held) > 20_000:
                yield from flush()
    yield from flush()


def decide(stats: DataFrame) -> DataFrame:
    """(host, best, main, fixed) from tallies, over all places of a host.

    main: slots in an article; fixed: slots that hold the same text on three or more pages which are not all the same;
    best: the place of most text that is neither links nor fixed on pages without an article.
    """
    total = [F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("main").alias("main"), F.sum("pages").alias("pages")]
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("page_low").alias("page_low"), F.max("page_high").alias("page_high")]
    rows = common.cut(stats.groupBy("host", "slot", "place", "own").agg(*total, *ends))
    fixed = (F.col("pages") > 2) & (F.col("low") == F.col("high")) & (F.col("page_low") != F.col("page_high"))
    rows = rows.withColumn("fixed", (F.col("slot") >= 0) & fixed)
    per_place = rows.where("not own and not fixed").groupBy("host", "place").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).where("links * 2 < chars")
    best = per_place.groupBy("host").agg(F.min(F.struct(-F.col("chars"), "place"))["place"].alias("best"))
    per_slot = rows.groupBy("host", "slot").agg(F.max("main").alias("main"), F.min("fixed").alias("fixed"))
    slots = per_slot.groupBy("host").agg(
        F.collect_list(F.when(F.col("main") & (F.col("slot") >= 0), F.col("slot"))).alias("main"), F.collect_list(F.when(F.col("fixed"), F.col("slot"))).alias("fixed")
    )
    return slots.join(best, "host", "left").select("host", "best", "main", "fixed")


def extract(page: Page, slots: list[int], best: str | None, main: frozenset[int], fixed: frozenset[int]) -> str:
    """Main text of one page, given the slots of its blocks and what its host's pages say about them."""
    if any(m and not chrome for _, chrome, m, _, _ in page.blocks):
        return "\n".join(t for slot, (_, chrome, m, _, t) in zip(slots, page.blocks) if not chrome and (slot in main if slot >= 0 else m))
    plain = [(slot, place, t) for slot, (place, chrome, _, links, t) in zip(slots, page.blocks) if not chrome and links * 2 < len(t)]
    texts = [t for slot, place, t in plain if best is not None and (place + ">").startswith(best + ">") and slot not in fixed]
    return "\n".join(texts or [t for _, _, t in plain])  # a layout of its own: its plain text outside all chrome


def main_texts(df: DataFrame, url_col: str = "url", html_col: str = "html", words: bool = True) -> DataFrame:
    """df with text (main text, empty if none) and n_chars; columns of these names give way.

    Blocks hold no white space but single spaces and are joined by line feeds; character references are decoded. A
    null or empty html has no text; pages with a null url share one wrapper. words=False reads no names of tags and classes.
    Repeated rows stay, very long pages are read whole, other columns pass through; an empty table gives no rows.
    """
    keep = [c for c in df.columns if c.lower() not in ("text", "n_chars")]
    host, _ = host_path(F.col(f"`{url_col}`"))
    pages = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host.alias("host"), F.col(f"`{html_col}`").alias("source"))

    def with_rules(rows: DataFrame, rules: DataFrame, volume: int) -> DataFrame:
        # Pages need not move while the rules of all hosts are small; beyond that Spark joins by host and splits hot ones.
        return rows.join(F.broadcast(rules) if volume <= SMALL_RULES else rules, "host")

    wrappers = common.cut(infer(pages, "source", "host", words))
    volume = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 64)).first()[0] or 0
    stats = with_rules(pages.select("host", "source"), wrappers, volume).mapInArrow(partial(tally, words=words), _STATS)
    rules = common.cut(wrappers.join(decide(stats), "host", "left"))
    volume += rules.agg(F.sum(F.coalesce(F.octet_length("best"), F.lit(0)) + 4 * (F.coalesce(F.size("main"), F.lit(0)) + F.coalesce(F.size("fixed"), F.lit(0))))).first()[0] or 0
    ruled = ("source", "wrapper", "best", "main", "fixed")
    joined = with_rules(pages, rules, volume).select("row", *ruled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words)
        for b in batches:
            for part in common.byte_slices(b, "source"):
                texts = []
                for source, wrapper, best, main, fixed in zip(*(part.column(c).to_pylist() for c in ruled)):
                    page, slots = reader.read(source, wrapper)
                    texts.append(extract(page, slots, best, frozenset(main or ()), frozenset(fixed or ())))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"row {kind}, text string, n_chars long")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "text", "n_chars")


def op3_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all `pages`."""
    return main_texts(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
