"""Main text of web pages: a template of nested classes of tokens from their occurrences over a host's pages, and the slots that hold the article."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, written

RAW = "script|style|noscript|template|iframe|svg|textarea|title|math|canvas"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
NAMED = re.compile(r"(?<![\w:.-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Opening one of these closes an open one of those, up to the nearest boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that say that they hold an article, and those whose meaning is that they are none of its text; a header within an article is its own.
ARTICLE = frozenset(("article", "main"))
APART = frozenset("head nav header footer aside form button select dialog menu".split())
#: Elements that no name makes part of the boilerplate.
WHOLE = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that decide over a minor slot of varying text, which the template leaves open.
TIES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Share of a host's pages that a token of its template is on, and pages at least.
FREQUENT, REPEATED = 0.5, 3
#: A slot is minor below this share of the free text; it is a menu from this share of linked text on; its texts rotate if so few times as many differ as in the richest slot, on so many pages at least.
MINOR, LINKED, ROTATING, MANY = 0.5, 0.5, 0.5, 10


def key_of(path: str, text: str) -> int:
    """A block's token: 64 bits of its path and text."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Page:
    """Elements opened, by path, and blocks of text (path, text, characters in links) in page order."""

    seen: Counter
    blocks: list[tuple[str, str, int]]


def walk(page: str) -> Page:
    """A path is the names of the open elements, each with its classes, roles (after "@") and id (after "#"); it tells all that is decided by."""
    seen: Counter = Counter()
    blocks: list[tuple[str, str, int]] = []
    names: list[str] = []
    paths = [""]
    held: list[str] = []
    at, linked = "", 0

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                blocks.append((at, text, min(linked, len(text))))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        del names[to:], paths[to + 1 :]

    for m in TOKEN.finditer(page):
        name = m[3]
        if name is None:
            if m[1] is None and not m[0].startswith(("<!", "<?")):
                if not held:
                    # links and other inline elements are no part of where a block is
                    at = next(p for p, n in zip(reversed(paths), [*reversed(names), "html"], strict=True) if n in BLOCKS)
                held.append(entities.unescape(m[0]) if "&" in m[0] else m[0])
                if "a" in names:
                    linked += len(" ".join(held[-1].split()))
            continue
        name = name.lower()
        if name in BLOCKS or name in APART:
            flush()
        if m[2]:
            for i in range(len(names) - 1, -1, -1):
                if names[i] == name:
                    pop(i)
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCKS and "p" in names:
            i = len(names) - 1 - names[::-1].index("p")
            if not any(x in BLOCKS and x != "p" for x in names[i + 1 :]):
                pop(i)
        if name in CLOSES:
            which, bound = CLOSES[name]
            for i in range(len(names) - 1, -1, -1):
                if names[i] in bound:
                    break
                if names[i] in which:
                    pop(i)
                    break
        attributes = m[4]
        if attributes.rstrip().endswith("/"):
            continue
        mark = ""
        if "=" in attributes:
            for kind, *values in NAMED.findall(attributes):
                sign = {"class": ".", "role": "@", "id": "#"}[kind.lower()]
                mark += "".join(sign + v for v in sorted("".join(values).lower().replace("/", "_").split()) if sign != "#" or not any(c.isdigit() for c in v))
        names.append(name)
        paths.append(f"{paths[-1]}/{name}{mark}")
        seen[paths[-1]] += 1
    flush()
    return Page(seen, blocks)


SIGN = re.compile(r"[.@#]")


def _name(path: str) -> str:
    return SIGN.split(path.rpartition("/")[2], maxsplit=1)[0]


def _above(path: str) -> Iterator[str]:
    """The path and all paths above it but the empty one."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def _inside(path: str) -> bool:
    """Whether an element above says that it holds an article."""
    return any(_name(p) in ARTICLE for p in _above(path.rpartition("/")[0]))


def _tie(path: str) -> bool:
    """Whether the element's names are those of boilerplate: whole names, and outside of articles also words of a class or role."""
    inside = _inside(path)
    for sign, name in re.findall(r"([.@#])([^.@#]+)", path.rpartition("/")[2]):
        words = {name} if inside or sign == "#" else {name, *re.split(r"[^a-z]+", name)}
        if not (inside and sign == "#") and not TIES.isdisjoint(words):
            return True
    return False


@dataclass
class Slot:
    """What one element holds, its own blocks only: pages it is on, blocks, different texts, characters, characters in links, the element's occurrence vector."""

    pages: int
    blocks: int
    texts: int
    chars: int
    linked: int
    vector: object = None


def template(slots: dict[str, Slot]) -> dict[str, tuple[str, ...]]:
    """The nested template: each element with the outermost elements of its record.

    Elements of one occurrence vector are a class. Classes nest by the elements
    around them: a class whose outermost elements lie within several elements is as
    many valid ones, one by element around. What such a class holds within one
    element is a record: it is on a page as a whole, or not at all.
    """
    classes: defaultdict[object, list[str]] = defaultdict(list)
    for path in sorted(slots):
        classes[slots[path].vector].append(path)
    out: dict[str, tuple[str, ...]] = {}
    for members in map(frozenset, classes.values()):
        records: defaultdict[str, list[str]] = defaultdict(list)
        outermost = {p: [a for a in _above(p) if a in members][-1] for p in members}
        for path in sorted(set(outermost.values())):
            records[next((a for a in _above(path.rpartition("/")[0]) if a in slots), "")].append(path)
        record = {p: tuple(ps) for ps in records.values() for p in ps}
        out.update((p, record[outermost[p]]) for p in members)
    return out


def decide(slots: dict[str, Slot], pages: int) -> set[str]:
    """Elements that hold no article, from the slots of a host's template, or of a page by itself.

    Apart from elements whose meaning says it, a slot goes by what it holds: mostly
    links (a menu), or text that rotates over the pages. A minor part of a record
    that is on some of many pages only goes by what all of it holds as well, so an
    advert takes its own varying parts along. Names decide only over minor slots of varying text. What holds most of the free text never goes,
    unless there is an element that says it holds the article, and this is beside it.
    """
    nested = template(slots) if pages >= MANY else {}
    whole: defaultdict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, s in slots.items():
        for up in _above(path):
            w = whole[up]
            for i, x in enumerate((s.blocks, s.texts, s.chars, s.linked)):
                w[i] += x
    gone: set[str] = set()
    order = sorted(whole, key=lambda p: p.count("/"))
    out = lambda p: any(a in gone for a in _above(p))
    for path in order:
        if not out(path) and _name(path) in APART and not (_name(path) == "header" and _inside(path)):
            gone.add(path)
    free = sum(s.chars - s.linked for p, s in slots.items() if not out(p)) or 1
    richest = max((w[1] / w[0] for p, w in whole.items() if w[0] and not out(p) and w[2] - w[3] >= MINOR * free), default=1.0)
    articles = [p for p in whole if _name(p) in ARTICLE and not out(p)]
    around = {up for p in articles for up in _above(p.rpartition("/")[0])}
    held = {r: [sum(x) for x in zip(*(whole[p] for p in r if p in whole and not out(p)), strict=True)] for r in set(nested.values()) if len(r) > 1}
    for path in order:
        blocks, texts, chars, linked = whole[path]
        if out(path) or path not in slots or _name(path) in WHOLE or path in around:
            continue
        inside = _inside(path)
        if chars - linked >= MINOR * free and (inside or not articles):
            continue
        evidence = [(blocks, texts, chars, linked)]
        record = held.get(nested.get(path))
        if record and path in nested[path] and slots[path].pages < pages and chars < MINOR * record[2]:
            evidence.append(record)
        menu = not inside and any(e[3] >= LINKED * max(1, e[2]) for e in evidence)
        rotates = not inside and pages >= MANY and any(e[0] and e[1] / e[0] <= ROTATING * richest for e in evidence)
        if menu or rotates or _tie(path):
            gone.add(path)
    return gone


def repeated(tokens: list[tuple[str, int, bool]], slots: dict[str, Slot]) -> list[int]:
    """Keys of the template text among `tokens` (path, key, whether one word), which are on enough pages.

    One word, which may well be on many pages by itself, counts only in minor slots and not as a heading.
    """
    free = sum(s.chars - s.linked for s in slots.values()) or 1
    minor = lambda p: _name(p) not in HEADINGS and (p not in slots or slots[p].chars - slots[p].linked < MINOR * free)
    return [key for path, key, single in tokens if not single or minor(path)]


def page_slots(page: Page) -> dict[str, Slot]:
    slots = {p: Slot(1, 0, 0, 0, 0, n) for p, n in page.seen.items()}
    for path, text, linked in page.blocks:
        s = slots.setdefault(path, Slot(1, 0, 0, 0, 0, 1))
        s.blocks, s.texts, s.chars, s.linked = s.blocks + 1, s.texts + 1, s.chars + len(text), s.linked + linked
    return slots


def extract(html: str, gone: frozenset[str] | None = None, known: frozenset[str] = frozenset(), text: frozenset[int] = frozenset()) -> str:
    """Blocks in the slots that are left: those of the host's template, and for elements that it doesn't know those of the page by itself.

    Template text (keys in `text`) goes; a page of nothing else, as copies of one
    page are, keeps it.
    """
    page = walk(html)
    if not page.blocks:
        return ""
    own = decide(page_slots(page), 1) - known
    if gone:
        own |= gone
    left = [(p, t) for p, t, _ in page.blocks if not any(a in own for a in _above(p))]
    varied = [t for p, t in left if key_of(p, t) not in text] if text else []
    return "\n".join(varied or [t for _, t in left])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Pages of one host share a template: counts of each token (elements by path,
    blocks of text by path) are joined into one number by a random weight a page,
    so equal numbers mean equal occurrence vectors; sums are combined in each batch
    and before the shuffle, so a hot host is no burden. Text that is the same on
    FREQUENT of a host's pages (REPEATED at least) is template; what varies is in
    slots, which decide() keeps or not. Hosts of fewer pages have no template: each
    of their pages is judged by itself. Null or empty html gives an empty text; a
    null url is a host of its own. Repeated rows appear as often as given, ids may
    be null, an empty table gives no rows, other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 4096):
            sums: dict[tuple[str, str, int | None], list[int]] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = walk(html)
                weight = xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass"))
                every = sums.setdefault((host, "", None), [0, 0, 0, 0, 0])
                every[0] += weight
                every[1] += 1
                for path, n in page.seen.items():
                    own = sums.setdefault((host, path, None), [0, 0, 0, 0, 0])
                    own[0] += weight * n
                    own[1] += 1
                fresh = set()
                for path, text, linked in page.blocks:
                    own = sums.setdefault((host, path, None), [0, 0, 0, 0, 0])
                    for i, x in enumerate((1, len(text), linked), 2):
                        own[i] += x
                    key = (host, path, key_of(path, text))
                    if key not in fresh:
                        fresh.add(key)
                        own = sums.setdefault(key, [0, 0, 0, 0, 0])
                        own[1] += 1
                        own[2] += " " not in text
            keys = list(sums)
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array([None if k[2] is not None else Decimal(sums[k][0]) for k in keys], pa.decimal128(38, 0)), *[pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(1, 5)]]
            yield pa.RecordBatch.from_arrays(cols, ["host", "path", "key", "vector", "pages", "blocks", "chars", "linked"])

    counted = base.select("host", "html").mapInArrow(tokens, "host string, path string, key bigint, vector decimal(38,0), pages bigint, blocks bigint, chars bigint, linked bigint")
    sums = [F.sum("vector").cast("decimal(38,0)").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "blocks", "chars", "linked")]]
    counted = written(counted.groupBy("host", "path", "key").agg(*sums), "page-tokens")
    totals = counted.filter("path = '' and key is null").select("host", F.col("pages").alias("all")).filter(F.col("all") >= REPEATED)
    texts = counted.filter("key is not null").groupBy("host", "path").agg(F.count("*").alias("texts")).withColumnsRenamed({"host": "_h", "path": "_p"})
    # tokens on half of the pages, three at least: at most twice as many as a page has
    frequent = counted.join(totals, "host").filter((F.col("pages") >= FREQUENT * F.col("all")) & (F.col("pages") >= REPEATED))
    frequent = frequent.join(texts, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    by_host = frequent.groupBy("host").agg(F.first("all").alias("all"), F.collect_list(F.struct("path", "key", "vector", "pages", "blocks", "texts", "chars", "linked")).alias("tokens"))

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 64):
            gone, known, text = [], [], []
            for n, ts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                slots = {t["path"]: Slot(t["pages"], t["blocks"], t["texts"] or 0, t["chars"], t["linked"], t["vector"]) for t in ts if t["key"] is None and t["path"]}
                gone.append(sorted(decide(slots, n)))
                known.append(sorted(slots))
                own = [(t["path"], t["key"], bool(t["blocks"])) for t in ts if t["key"] is not None]
                text.append(repeated(own, slots))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, strings), pa.array(known, strings), pa.array(text, pa.list_(pa.int64()))], ["_host", "gone", "known", "template"])

    hosts = written(by_host.mapInArrow(templates, "_host string, gone array<string>, known array<string>, template array<bigint>"), "page-templates")
    size = F.octet_length(F.array_join(F.concat("gone", "known"), "")) + 8 * F.size("template") + 64
    small = (hosts.agg(F.sum(size)).first()[0] or 0) <= 16 << 20  # else the join shuffles
    joined = base.join(F.broadcast(hosts) if small else hosts, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "gone", "known", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = [extract(html, *map(frozenset, (gone or (), known or (), text or ()))) for html, gone, known, text in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return joined.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
