"""HTML extraction by union-free wrappers. A page is a stream of text fields, each with the path of elements that holds it. The streams of all pages of
one host are aligned one after another: where texts differ, the field is a slot; neighbours of one path are a repeated group; fields that
only some pages have are optional. What results is the host's wrapper: a regular expression without alternatives. It tells template from
text: a field that says the same on all its pages is template, unless it stands beside slots, or is optional and stands under a container of slots; and so is a
repeated group of links, whatever they say. And it tells the region: the deepest container that holds nearly all characters of slots that aren't in links, and the title; what is outside, such as
adverts and footers that change from page to page, goes.
What is left is checked by names: menus, adverts and the like go, as told by their elements' names, roles, classes and ids, and of a page that names its
article by an element what is outside goes, wherever the region is.

Wrappers are folded from all pages: equal shapes within a task first, then over tasks, in rounds where one shape has very many; then the shapes of a host by salts of their
hashes, more for a host of many shapes, in the order of the shapes; then paths by host.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Bytes of all wrappers up to which they are broadcast.
WRAPPERS_MOST = 8 << 20
#: Salts of a host at least; bytes of wrappers that one task aligns, about; fields that a task holds before it gives them away.
SALTS, GROUP, HELD = 32, 16 << 20, 100_000
#: Share of a repeated group's characters in links from which it is a menu.
LINKED = 0.9
#: Share of a host's own characters that its region holds at least.
REGION = 0.8
#: Fields of a wrapper up to which streams are aligned with it.
FIELDS_MOST = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics".split())
#: Elements that never hold the article's text.
DROPPED = RAW | frozenset("head nav footer aside form button input option optgroup fieldset dialog menu canvas audio video applet datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id of what isn't the article.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promos banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist replies respond disqus discussion "
    "share sharing social related recommended recommendations widget widgets search pagination pager toolbar skip copyright disclaimer paywall".split()
)
#: Words that leave a class or id of BOILER words what it is; any other word makes it a name of its own, such as `social-history`.
PLAIN_WORDS = frozenset(
    "area bar block blocks body bottom box btn button buttons card cards col column container content count desktop fixed float floating follow footer form global google grid group head heading holder icon icons image "
    "img info inner international item items js label large leaderboard left like link links list lists logo main meta mini mobile module more native news outer page panel placeholder post posts primary rectangle right row secondary "
    "section side site skyscraper slot small space sticky stories story strip text thread title top unit us user wrap wrapper zone".split()
)
#: Words that make a `header` in a class the article's own, as headings stand in it.
OWN = frozenset("article post entry story section content".split())
MAIN_WORDS = frozenset("article-body articlebody article-content article post-content post-body entry-content entry story-body story content main main-content maincontent body-content page-content text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>", re.S)
#: What behind the last `>` isn't text.
UNCLOSED = re.compile(r"<!--.*|<!\[CDATA\[(.*)|<[!?].*", re.S)
#: Characters of a path from which its hash stands for what an element hangs on; so it does for very long class names.
PATH_MOST = 2000
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z0-9]+")
SIZE = re.compile(r"[a-z]?[0-9]+(?:x[0-9]+)?")
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Elements that end an open one of the same kind, up to the elements given.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: A paragraph ends where one of these begins.
BREAK_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

KEEP, DROP, MAIN, CONTENT = 0, 1, 2, 3


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw.strip() else {}


def judged(name: str, raw: str, inside: bool) -> tuple[int, str]:
    """What an element is to the article, and its name with classes. inside: does it stand in an <article>?"""
    own = attributes(raw) if len(raw) > 1 else {}
    names = own.get("class", "")
    label = f"{name}.{'.'.join(sorted(names.split()))}".replace("/", "|") if names else name
    if name in ("body", "html"):
        return KEEP, name
    if name in DROPPED or name == "header" and not inside:
        return DROP, label
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in ROLES or "display:none" in own.get("style", "").replace(" ", "").lower():
        return DROP, label
    marks = names + " " + own.get("id", "")
    if name != "article" and name != "main" and len(marks) > 1:
        for mark in marks.split():
            words = WORDS.findall(CAMEL.sub(r"\1-\2", mark).lower())
            bad = [w for w in words if w in BOILER]
            own_name = any(w not in BOILER and w not in PLAIN_WORDS and not w.isdigit() and not SIZE.fullmatch(w) for w in words)
            if bad and not own_name and not (bad == ["header"] and OWN & set(words)) and not (name in HEADINGS and bad == ["header"]):
                return DROP, label
    if name == "article" or own.get("itemprop") == "articleBody":
        return MAIN, label
    if name == "main" or own.get("role") == "main":
        return CONTENT, label
    if any(m.lower() in MAIN_WORDS for m in marks.split()):
        return CONTENT, label
    return KEEP, label


def fields(page: str, region: str | None = None) -> list[tuple[str, str, int, int, int]]:
    """In time linear in the page, however malformed: the text blocks of a page in order: path, text, strongest mark around it (MAIN, CONTENT or KEEP), or DROP in menus, adverts and the like; characters in links, as written;
    which element of the path `region` it stands in, from 1, or 0."""
    out: list[tuple[str, str, int, int, int]] = []
    stack: list[tuple[str, str, int, int]] = []  # name, path, drop depth begun here, mark
    parts: list[str] = []
    refused: list[str] = []
    mark, path, dropping, inside, links, linked = KEEP, "", 0, 0, 0, 0
    at, n = 0, len(page)
    closed = page.rfind(">")  # behind it no element begins
    regions, within = 0, 0
    endless: set[str] = set()  # names of which no end tag is left
    places: dict[str, list[int]] = {}  # where in the stack elements of a name stand

    def last(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def add(text: str) -> None:
        nonlocal linked
        (refused if dropping else parts).append(text)
        if links:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        for own, kind in ((parts, mark), (refused, DROP)):
            if own:
                text = " ".join(entities.unescape("".join(own)).split())
                own.clear()
                if text:
                    out.append((path, text, kind, min(linked, len(text)), within))
        linked = 0

    def leave() -> None:
        nonlocal dropping, path, mark, inside, links, within
        name, label, dropped, kind = stack.pop()
        places[name].pop()
        if name in ("td", "th"):
            (refused if dropping else parts).append(" ")
        elif name not in INLINE:
            flush()
        dropping -= dropped
        inside -= name == "article"
        links -= name == "a"
        if path == region and name not in INLINE:
            within = 0
        path = stack[-1][1] if stack else ""
        mark = stack[-1][3] if stack else KEEP

    while at < n:
        m = TOKEN.search(page, at) if at <= closed else UNCLOSED.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3] if m.re is TOKEN else None
        if name is None:
            if m[1]:
                add(entities.unescape(m[1]))
            continue
        name = name.lower()
        if m[2]:
            if places.get(name):
                while stack[-1][0] != name:
                    leave()
                leave()
            elif name == "p":
                flush()
            continue
        if name in VOID:
            if not dropping:
                if name in INLINE:
                    parts.append(" " if name == "br" else "")
                else:
                    flush()
            continue
        if name in BREAK_P:
            while places.get("p") and last(("button", "table")) < places["p"][-1]:
                leave()
        if name in ENDS and name != "p":
            while (k := last(ENDS[name])) > last(SCOPES[name]):
                while len(stack) > k:
                    leave()
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not end:
                endless.add(name)
            at = end.end() if end else n if name in ("script", "style") else at
            if not end and name not in ("script", "style"):
                continue
            if not name in INLINE:
                if not dropping:
                    parts.append(" ")
            continue
        kind, label = judged(name, m[4], inside > 0)
        if name not in INLINE and name not in ("td", "th"):
            flush()
        elif name in ("td", "th") and not dropping:
            parts.append(" ")
        drop = int(kind == DROP)
        dropping += drop
        inside += name == "article"
        links += name == "a"
        if name not in INLINE:
            path = f"{path if len(path) < PATH_MOST else '~' + xxhash.xxh3_128_hexdigest(path)}/{label if len(label) < PATH_MOST else xxhash.xxh3_128_hexdigest(label)}"
            if path == region:
                regions += 1
                within = regions
        mark = MAIN if MAIN in (mark, kind) else CONTENT if CONTENT in (mark, kind) else KEEP
        places.setdefault(name, []).append(len(stack))
        stack.append((name, path, drop, mark))
        if m[4].endswith("/") and name not in INLINE and name not in BREAK_P:
            leave()
    flush()
    return out


def main_text(page: str, template: frozenset[str] | None, region: str | None = None) -> str:
    """The article's blocks, one a line. Names go first where they call an element the article or the main container: then its blocks alone are looked at. Of these stay what the host's wrapper doesn't hold for template, and of
    pages whose names call nothing so, what stands in the host's region, if the page has one. Where nothing is left, names alone tell."""
    found = [f for f in fields(page, region) if f[2] != DROP]

    def checked(own: list) -> list:
        marks = {f[2] for f in own}
        best = MAIN if MAIN in marks else CONTENT if CONTENT in marks else KEEP
        return own if best == KEEP else [f for f in own if f[2] == best]

    def placed(own: list) -> list:
        # an element of the region's path that holds loose text alone is another one, of the same looks
        good = {f[4] for f in own if f[4] and f[0] != region}
        return [f for f in own if f[4] in good or f[2] != KEEP] if good else own

    own = placed([f for f in checked(found) if not template or f[0] not in template]) or checked(found)
    return "\n".join(f[1] for f in own)


# --- wrappers: lists of [path, hash of the text or None for a slot, optional, repeated, pages, characters, characters in links]; a path ends in REFUSED where the names speak against it,
# and in STATED in an <article>

REFUSED, STATED = "/!", "/="
#: In place of a path: all pages of a wrapper.
WHOLE = "/"


def stream(page: str) -> list[list]:
    """Neighbours of one path are one field; so are all fields of one path where a page has very many."""
    own = [(path + {DROP: REFUSED, MAIN: STATED}.get(mark, ""), text, linked) for path, text, mark, linked, _ in fields(page)]
    runs: list[tuple[str, list[str], list[int]]] = []
    for path, text, linked in own:
        if not (runs and runs[-1][0] == path):
            runs.append((path, [], []))
        runs[-1][1].append(text)
        runs[-1][2].append(linked)
    if len(runs) > FIELDS_MOST:
        by: dict[str, tuple[str, list[str], list[int]]] = {}
        for path, text, linked in own:
            one = by.setdefault(path, (path, [], []))
            one[1].append(text)
            one[2].append(linked)
        runs = list(by.values())
    return [[path, xxhash.xxh3_64_hexdigest("\n".join(texts)), False, len(texts) > 1, 1, sum(map(len, texts)), sum(linked)] for path, texts, linked in runs]


def grouped(wrapper: list[list]) -> list[list]:
    """Neighbours of one path become one repeated field."""
    out: list[list] = []
    for f in wrapper:
        if out and out[-1][0] == f[0]:
            last = out[-1]
            last[1:] = [last[1] if last[1] == f[1] else None, last[2] and f[2], True, max(last[4], f[4]), last[5] + f[5], last[6] + f[6]]
        else:
            out.append(list(f))
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The wrapper that matches what either matches."""
    out: list[list] = []
    before, after = [f[0] for f in a], [f[0] for f in b]
    same = [("equal", 0, len(a), 0, len(b))]
    for tag, i, i2, j, j2 in same if before == after else SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [[x[0], x[1] if x[1] == y[1] else None, x[2] or y[2], x[3] or y[3], x[4] + y[4], x[5] + y[5], x[6] + y[6]] for x, y in zip(a[i:i2], b[j:j2])]
        else:
            out += [[*x[:2], True, *x[3:]] for x in [*a[i:i2], *b[j:j2]]]
    return grouped(out)


def told(wrapper: list[list]) -> dict[str, list]:
    """What a wrapper says of each path: the hash of its texts or None for a slot, whether all pages have it, pages, whether it is repeated, characters, characters in links."""
    out: dict[str, list] = {}
    for path, text, optional, repeated, n, chars, linked in wrapper:
        if path in out:
            own = out[path]
            # where only some pages have it, its texts needn't be on one page
            own[0] = None if text is None or own[0] is None or text != own[0] and (optional or not own[1]) else own[0] + text
            own[1:] = [own[1] or not optional, max(own[2], n), True, own[4] + chars, own[5] + linked]
        else:
            out[path] = [text, not optional, n, repeated, chars, linked]
    for own in out.values():
        own[0] = own[0] and xxhash.xxh3_64_hexdigest(own[0])
    return out


def host() -> F.Column:
    """Of the url, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


#: Wrappers of one shape each; part tells rows of one shape apart.
SHAPES = "host string, shape bigint, wrapper string, pages bigint, part bigint"


def shaped(pages: DataFrame) -> DataFrame:
    """SHAPES of each task: pages of one host that hold the same paths in order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, list] = {}
        held, given = 0, TaskContext.get().partitionId() << 32

        def give() -> pa.RecordBatch:
            nonlocal given
            shapes = [xxhash.xxh3_64_intdigest("\n".join(k[1:])) - (1 << 63) for k in by]
            columns = [pa.array([k[0] for k in by], pa.string()), pa.array(shapes, pa.int64()), pa.array([json.dumps(w) for w, _ in by.values()], pa.string()), pa.array([n for _, n in by.values()], pa.int64())]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(range(given, given + len(by)), pa.int64())], names=["host", "shape", "wrapper", "pages", "part"])
            given += len(by)
            by.clear()
            return out

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = stream(raw.as_py() or "")
                shape = (key, *[f[0] for f in own])
                if shape in by:
                    by[shape] = [aligned(by[shape][0], own), by[shape][1] + 1]
                    continue
                by[shape] = [own, 1]
                held += len(own) + 1
                if held > HELD:
                    held = 0
                    yield give()
        if by:
            yield give()

    return pages.select(host().alias("host"), "html").mapInArrow(fold, SHAPES)


def gathered(shapes: DataFrame, most: int) -> DataFrame:
    """SHAPES with at most so many bytes, about, of one host and shape in several rows. Wrappers of one shape are aligned field by field, in any order: a shape of more
    bytes is dealt to several tasks, each of which makes one row of its own, in as many rounds as it takes. A round has fewer tasks than rows for each shape, so that rounds end."""

    def add(t: pa.Table) -> pa.Table:
        own = None
        for raw in t.column("wrapper"):
            w = json.loads(raw.as_py())
            own = w if own is None else aligned(own, w)
        columns = [t.column("host")[:1], t.column("shape")[:1], pa.array([json.dumps(own)], pa.string()), pa.array([sum(t.column("pages").to_pylist())], pa.int64()), t.column("salt")[:1]]
        return pa.table(columns, names=["host", "shape", "wrapper", "pages", "part"])

    while True:
        shapes = written(shapes, "shapes")
        sizes = shapes.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("wrapper")).alias("size")).where((F.col("rows") > 1) & (F.col("size") > most))
        tasks = F.least(F.ceil(F.col("size") / most), F.ceil(F.col("rows") / 2)).cast("long")
        large = written(sizes.select("host", "shape", tasks.alias("tasks")), "large")
        if large.isEmpty():
            return shapes
        dealt = shapes.join(large, ["host", "shape"]).withColumn("salt", F.pmod(F.xxhash64("part"), F.col("tasks")))
        shapes = shapes.join(large, ["host", "shape"], "left_anti").unionByName(dealt.groupBy("host", "shape", "salt").applyInArrow(add, SHAPES))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, slot, required, n, repeated, linked, chars): what the wrappers of a host say of each path, the pages that have it, the share of its characters in links, and their number."""

    def merge(t: pa.Table) -> pa.Table:
        by: dict[tuple, list] = {}
        for raw, n in zip(t.column("wrapper").to_pylist(), t.column("pages").to_pylist()):
            w = json.loads(raw)
            shape = tuple(f[0] for f in w)
            by[shape] = [aligned(by[shape][0], w), by[shape][1] + n] if shape in by else [w, n]
        rows: list[tuple] = []
        own, total = None, 0

        def give() -> None:
            rows.append((WHOLE, None, total, total, False, 0, 0))
            rows.extend((path, text, total if required else 0, n, *more) for path, (text, required, n, *more) in told(own).items())

        for shape in sorted(by):
            w, n = by.pop(shape)
            own, total = w if own is None else aligned(own, w), total + n
            if len(own) > FIELDS_MOST:  # what it says of its paths is kept, and another one begun
                give()
                own, total = None, 0
        if own is not None:
            give()
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
        return pa.table([pa.array([t.column("host")[0].as_py()] * len(rows), pa.string()), *columns], names=["host", "path", "text", "required", "n", "repeated", "chars", "linked"])

    shapes = gathered(shaped(pages), GROUP)
    many = shapes.groupBy("host").agg(F.ceil(F.sum(F.length("wrapper")) / GROUP).alias("salts")).where(F.col("salts") > SALTS)
    shapes = shapes.join(many, "host", "left").withColumn("salt", F.pmod(F.col("shape"), F.coalesce("salts", F.lit(SALTS)))).drop("salts", "part")
    parts = shapes.groupBy("host", "salt").applyInArrow(merge, "host string, path string, text string, required bigint, n bigint, repeated boolean, chars bigint, linked bigint")
    per = parts.groupBy("host", "path").agg((F.count("text") < F.count(F.lit(1))).alias("null"), (F.min("text") != F.max("text")).alias("differ"), F.sum("required").alias("required"), F.sum("n").alias("n"), F.max("repeated").alias("repeated"), (F.sum("linked") / F.greatest(F.sum("chars"), F.lit(1))).alias("linked"), F.sum("chars").alias("chars"))
    per = written(per, "wrappers")
    total = per.where(F.col("path") == WHOLE).select("host", F.col("n").alias("pages"))
    slot = F.col("null") | F.coalesce("differ", F.lit(False))
    return per.where(F.col("path") != WHOLE).join(total, "host").select("host", "path", slot.alias("slot"), (F.col("required") == F.col("pages")).alias("required"), "n", "repeated", "linked", "chars")


def templates(found: DataFrame) -> DataFrame:
    """(host, template): the paths of each host that are template by its wrapper. Those that say the same on all their pages, two at least, and neither stand beside slots nor, when optional, below a container of slots:
    a host without slots has none, as nothing tells its text from its template. And those that are a repeated group, on two pages at least, whose text is in links nearly throughout: menus, whatever they say.
    In an <article> neither counts against a list of links."""
    plain = F.regexp_replace("path", "/[!=]$", "")
    own = found.withColumns({"refused": F.col("path").endswith(REFUSED), "stated": F.col("path").endswith(STATED), "path": plain})
    parent = F.when(F.col("path") == "", "/").otherwise(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))"))
    menus = own.where(F.col("repeated") & (F.col("linked") >= LINKED) & (F.col("n") > 1)).select("host", "path").join(own.where("stated").select("host", "path"), ["host", "path"], "left_anti")
    kept = own.where(~F.col("refused")).join(menus, ["host", "path"], "left_anti")
    containers = kept.where("slot").select("host", parent.alias("above")).distinct()
    same = kept.where("not slot and n > 1").join(containers.select("host").distinct(), "host", "left_semi").join(kept.where("slot").select("host", "path"), ["host", "path"], "left_anti")
    # an optional path is looked for with all it stands in, a required one with its parent
    names = F.split(parent, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))
    above = F.when(F.col("required"), F.array(parent)).otherwise(F.transform(above, lambda x: F.when(x.endswith("/"), x).otherwise(F.concat(x, F.lit("/")))))
    asks = same.select("host", "path", F.explode(F.array_distinct(above)).alias("above"))
    beside = asks.join(containers, ["host", "above"], "left_semi").select("host", "path").distinct()
    same = same.join(beside, ["host", "path"], "left_anti").select("host", "path")
    return same.unionByName(menus).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("template"))


def regions(found: DataFrame) -> DataFrame:
    """(host, region): the deepest container of each host that holds the share REGION at least of its own characters, and its title: those of texts that change from page to page, or that one page alone has, outside of
    links and of what names refuse. The title is what changes in headings of the highest rank. More than half of what a region holds changes from page to page, so that copies, and a page alone, have none."""
    own = found.where(~F.col("path").endswith(REFUSED) & (F.col("slot") | (F.col("n") == 1))).withColumn("path", F.regexp_replace("path", "/=$", ""))
    rank = F.regexp_extract(F.substring_index("path", "/", -1), r"^h([1-6])(?:$|\.)", 1).try_cast("int")
    rank = F.when(F.col("slot") & (F.col("linked") < LINKED), rank)
    own = own.select("host", "path", (F.col("chars") * (1 - F.col("linked"))).alias("mass"), "slot", rank.alias("rank"))
    total = own.groupBy("host").agg(F.sum("mass").alias("total"), F.min("rank").alias("top"))
    own = own.join(total, "host").withColumn("title", (F.coalesce("rank", F.lit(9)) == F.coalesce("top", F.lit(0))).cast("int"))
    titles = own.groupBy("host").agg(F.sum("title").alias("titles"))
    names = F.split("path", "/")
    above = F.when(F.size(names) > 2, F.transform(F.sequence(F.lit(2), F.size(names) - 1), lambda k: F.array_join(F.slice(names, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))
    held = own.select("host", "total", "mass", "slot", "title", F.explode(above).alias("region")).groupBy("host", "region")
    held = held.agg(F.first("total").alias("total"), F.sum("mass").alias("mass"), F.sum(F.when(F.col("slot"), F.col("mass")).otherwise(0)).alias("changing"), F.sum("title").alias("held"))
    good = held.join(titles, "host").where((F.col("mass") >= REGION * F.col("total")) & (F.col("changing") > F.col("mass") / 2) & (F.col("held") == F.col("titles")))
    return good.groupBy("host").agg(F.max_by("region", F.struct(F.size(F.split("region", "/")), "region")).alias("region"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. A null or empty html has an empty text; pages with a null url are of one host; repeated rows get
    equal texts; an empty table gives no rows."""
    told_ = wrappers(pages)
    found = written(templates(told_).join(regions(told_), "host", "full"), "templates")
    size = found.agg(F.sum(F.coalesce(F.length(F.array_join("template", "\n")), F.lit(0)) + F.coalesce(F.length("region"), F.lit(0)))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[str] | None, str | None]] = {}
        for batch in batches:
            texts = []
            for raw, key, template, region in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("template"), batch.column("region")):
                if key not in known:
                    known.clear() if len(known) > 1000 else None
                    known[key] = frozenset(template.as_py()) if template.is_valid else None, region.as_py()
                texts.append(main_text(raw.as_py() or "", *known[key]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    if size == 0:
        own = own.withColumns({"template": F.lit(None).cast("array<string>"), "region": F.lit(None).cast("string")})
    else:
        own = own.join(F.broadcast(found) if size <= WRAPPERS_MOST else found, "host", "left")
    return own.select("page_id", "url", "html", "host", "template", "region").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
