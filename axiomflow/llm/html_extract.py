"""Main text of web pages by wrappers that are inferred from the pages of each host.

A page is parsed leniently into elements and texts. A wrapper is a union-free expression over the children of each
element: fixed elements, optional ones, repeated groups, constant texts and text slots. Pages of one host are
aligned one after another; what one side lacks becomes optional, neighbours of one shape become repeated, texts that
differ become slots. Wrappers of parts of a host are aligned in the same way, so all pages count and no task
needs a whole host. The main text lies in the smallest region that holds all of the slots' text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.llm.common import free_name, materialised, prepare, release

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template noscript xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose start ends an open one of these kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
BARRIERS = frozenset("ul ol dl table td th body html article section div main".split())
#: Never part of an article's text.
DROPPED = frozenset("head title nav header footer aside form button select input menu dialog svg math object audio video canvas map".split()) | RAW
NOT_CONTENT = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|footer|header|masthead|breadcrumb\w*|comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|cookies?|consent|notice|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|search|pagination|pager|toolbar|widget|skip-link|legal|copyright)(?:$|[-_ ])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Texts up to this length are compared as they are, longer ones by a digest of the whole.
CONSTANT_CHARS = 120
#: A text that is the same on this many pages of a host, or more, belongs to the wrapper; copies of a page count once.
CONSTANT_PAGES = 5
PART_HOSTS, PARTS = 500, 64
#: Elements below this depth hang side by side at it, as in browsers; none of their text is lost.
DEPTH = 200
#: Elements that hold an article's own blocks; names of classes say nothing about them.
BLOCKS = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody figcaption".split()) | INLINE


def parse(page: str) -> list:
    """The page as [key, children, dropped]; children are such lists and texts."""
    root = ["", [], False]
    stack, names, opened = [root], [""], Counter()
    at, n = 0, len(page)

    def cut(i: int) -> None:
        for name in names[i:]:
            opened[name] -= 1
        if len(stack) > DEPTH and any(name not in INLINE for name in names[max(i, DEPTH) :]):
            stack[DEPTH - 1][1].append(["br", [], False])
        del stack[i:], names[i:]

    def shut(kinds, stop) -> None:
        if not any(opened[k] for k in kinds):
            return
        for i in range(len(names) - 1, 0, -1):
            if names[i] in kinds:
                return cut(i)
            if names[i] in stop:
                return

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                if len(stack) <= DEPTH:
                    stack[-1][1].append(html.unescape(m[0]))
                elif not stack[-1][2]:
                    stack[DEPTH - 1][1].append(html.unescape(m[0]))
            continue
        name = name.lower()
        if m[1] or m[4]:
            if opened[name]:
                i = len(names) - 1
                while names[i] != name:
                    i -= 1
                cut(i)
            continue
        if name in CLOSES:
            shut(CLOSES[name], BARRIERS - CLOSES[name])
        elif name in ENDS_P:
            shut({"p"}, BARRIERS)
        given = m[3] or m[6] or ""
        own = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(given)} if "=" in given else {}
        mark = f"{own.get('class', '')} {own.get('id', '')}".strip()
        dropped = name in DROPPED or bool(mark and name not in BLOCKS and NOT_CONTENT.search(mark)) or own.get("role", "") in ROLES or "hidden" in own or own.get("aria-hidden") == "true"
        if name in ("html", "body", "main", "article"):
            dropped = False
        key = name + "." + re.sub(r"\d+", "", own.get("class") or own.get("id") or "") if mark else name
        node = [key, [], dropped]
        if len(stack) < DEPTH:
            stack[-1][1].append(node)
        else:  # its texts go to the element at DEPTH, in page order; only what is dropped is handed down
            node[2] = dropped or len(stack) > DEPTH and stack[-1][2]
            if name not in INLINE:
                stack[DEPTH - 1][1].append(["br", [], False])
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = n if end is None else page.find(">", end.start()) + 1 or n
        elif name not in VOID:
            stack.append(node)
            names.append(name)
            opened[name] += 1
    return root


def tag(key: str) -> str:
    return key.split(".", 1)[0]


# A wrapper item is [key, optional, repeated, pages, chars, constant, items]; key "#" is a text, "(" a repeated group. The pages of
# a text are the digests of up to CONSTANT_PAGES different ones.
KEY, OPTIONAL, REPEATED, PAGES, CHARS, CONSTANT, ITEMS = range(7)


def _constant(text: str) -> str:
    return text if len(text) <= CONSTANT_CHARS else f"\0{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def _digest(page: list) -> int:
    """Of all texts of a page that aren't dropped."""
    h = hashlib.blake2b(digest_size=6)
    todo = [page]
    while todo:
        for child in todo.pop()[1]:
            if isinstance(child, str):
                h.update(f"{' '.join(child.split())}\0".encode("utf-8", "surrogatepass"))
            elif not child[2]:
                todo.append(child)
    return int.from_bytes(h.digest(), "little")


def describe(node: list, page: int | None = None) -> list:
    """A page's element as a wrapper item; ``page`` is the digest of the page, by default of the element."""
    if page is None:
        page = _digest(node)
    items = []
    for child in node[1]:
        if isinstance(child, str):
            text = " ".join(child.split())
            if text:
                items.append(["#", False, False, [page], len(text), _constant(text), []])
        elif not child[2]:
            items.append(describe(child, page))
    items = _folded(items)
    return [node[0], False, False, [], sum(i[CHARS] for i in items), None, items]


def _shape(item: list) -> str:
    return item[KEY] if item[KEY] != "(" else "(" + " ".join(i[KEY] for i in item[ITEMS])


def _folded(items: list) -> list:
    """Neighbours of one shape, then neighbouring groups of two or three, become one repeated item."""
    for width in (1, 2, 3):
        out: list = []
        at = 0
        while at < len(items):
            unit = items[at : at + width]
            shape = [i[KEY] for i in unit]
            end = at + width
            if "#" in shape and width == 1 or len(unit) < width:
                out.append(items[at])
                at += 1
                continue
            while [i[KEY] for i in items[end : end + width]] == shape:
                unit = [combine(a, b) for a, b in zip(unit, items[end : end + width], strict=True)]
                end += width
            if end == at + width:
                out.append(items[at])
                at += 1
                continue
            if width == 1:
                unit[0][REPEATED] = True
                out.append(unit[0])
            else:
                out.append(["(", False, True, [], sum(i[CHARS] for i in unit), None, unit])
            at = end
        items = out
    return items


def combine(a: list, b: list) -> list:
    """One item for two of one key: differing texts make a slot, children are aligned."""
    pages = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:CONSTANT_PAGES]
    constant = a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None
    return [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], pages, a[CHARS] + b[CHARS], constant, align(a[ITEMS], b[ITEMS])]


def align(a: list, b: list) -> list:
    """Children of two items in one sequence; what only one side has becomes optional."""
    left, right = [_shape(i) for i in a], [_shape(i) for i in b]
    if left == right:
        return [combine(x, y) for x, y in zip(a, b, strict=True)]
    out = []
    for what, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            out += [combine(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[x[KEY], True, *x[REPEATED:]] for x in (*a[i:j], *b[k:m])]
    return out


def slot_chars(item: list) -> int:
    """Characters in text slots; texts that many pages share don't count."""
    if item[KEY] == "#":
        return 0 if item[CONSTANT] is not None and len(item[PAGES]) >= CONSTANT_PAGES else item[CHARS]
    return sum(map(slot_chars, item[ITEMS]))


def plan(wrapper: list) -> tuple[list[str], set[str]]:
    """The way to the main region, and the constant texts of places that aren't repeated, as "path\\0text"."""
    way, here = [], wrapper
    while True:
        inner = [(slot_chars(i), i) for i in here[ITEMS] if i[KEY] not in ("#", "(") and not i[REPEATED] and tag(i[KEY]) not in INLINE and not re.fullmatch(r"p|h\d|pre|blockquote|ul|ol|table", tag(i[KEY]))]
        most, best = max(inner, key=lambda x: x[0], default=(0, None))
        if not most or most < slot_chars(here):  # a sibling with text of its own belongs to the article
            break
        way.append(best[KEY])
        here = best
    constants: set[str] = set()

    def gather(item: list, path: str) -> None:
        for i in item[ITEMS]:
            if i[KEY] == "#":
                if i[CONSTANT] is not None and len(i[PAGES]) >= CONSTANT_PAGES and not i[REPEATED]:
                    constants.add(f"{path}\0{i[CONSTANT]}")
            elif not i[REPEATED] and not re.fullmatch(r"h\d", tag(i[KEY])):  # a heading is content even if pages share it
                gather(i, f"{path}/{i[KEY]}")

    gather(here, "")
    return way, constants


def main_text(page: str, way: list[str], constants: set[str]) -> str:
    """Texts of the page's main region: blocks in page order, joined by one space."""
    here = parse(page)
    for key in way:
        inner = [c for c in here[1] if not isinstance(c, str) and c[0] == key and not c[2]]
        if not inner:
            break
        here = inner[0] if len(inner) == 1 else ["", [x for c in inner for x in c[1]], False]
    pieces: list[str] = []

    def walk(node: list, path: str) -> None:
        for child in node[1]:
            if isinstance(child, str):
                if not constants or f"{path}\0{_constant(' '.join(child.split()))}" not in constants:
                    pieces.append(child)
            elif not child[2]:
                block = tag(child[0]) not in INLINE
                if block:
                    pieces.append(" ")
                walk(child, f"{path}/{child[0]}")
                if block:
                    pieces.append(" ")

    walk(here, "")
    return " ".join("".join(pieces).split())


def infer_wrappers(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, wrapper as JSON): all pages of a host aligned; hosts with many parts are put together in rounds."""
    pages = df.select(_host(url_col).alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def parts(batches):
        release()
        found: dict[str, list] = {}
        made = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal made
            numbers = range(made, made + len(found))
            out = pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([json.dumps(w) for w in found.values()]), pa.array(numbers, pa.int64())], names=["host", "wrapper", "part"])
            made += len(found)
            found.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = describe(parse(page))
                found[host] = combine(found[host], item) if host in found else item
                if len(found) >= PART_HOSTS:
                    yield flush()
        yield flush()

    def together(group: pa.Table) -> pa.Table:
        rows = sorted(group.column("wrapper").to_pylist())
        part = pc.min(group.column("part"))
        whole = json.loads(rows[0])
        for row in rows[1:]:
            whole = combine(whole, json.loads(row))
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(whole)]), "part": pa.array([part.as_py()], pa.int64())})

    now = materialised(pages.mapInArrow(parts, "host string, wrapper string, part bigint"), "wrappers")
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        salt = F.pmod(F.xxhash64("part"), F.lit(-(-most // PARTS)))
        now = materialised(now.withColumn("salt", salt).groupBy("host", "salt").applyInArrow(together, "host string, wrapper string, part bigint"), "wrappers")


def _host(url_col: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def extract_main_text(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds ``main_text`` (empty if there is none). All rows stay, repeated ones too; a null or empty page has no text; pages
    with a null or odd url share one nameless host. Pages of any length and depth are taken whole; below DEPTH elements
    are flattened, their text stays. An empty table gives no rows. A column of the added name is replaced, others may have any names."""
    prepare(df.sparkSession)
    own, host, wrapper = (free_name(df, f"__hx_{c}") for c in ("own", "host", "wrapper"))
    wrappers = infer_wrappers(df, url_col, html_col).select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    passed = [c for c in df.columns if c != "main_text"]
    met = df.select(*[F.col(f"`{c}`") for c in passed], _host(url_col).alias(own)).join(wrappers, F.col(own) == F.col(host), "left").drop(own, host)
    schema = T.StructType([*(met.schema[c] for c in passed), T.StructField("main_text", T.StringType())])

    def run(batches):
        release()
        plans: dict[str, tuple] = {}
        for batch in batches:
            n = batch.num_columns
            texts = []
            for page, wrapper in zip(batch.column(passed.index(html_col)).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                if wrapper not in plans:
                    if len(plans) >= PART_HOSTS:
                        plans.clear()
                    plans[wrapper] = plan(json.loads(wrapper))
                texts.append(main_text(page or "", *plans[wrapper]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 1], pa.array(texts, pa.string())], names=[*passed, "main_text"])

    return met.mapInArrow(run, schema)
