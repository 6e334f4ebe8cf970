"""Retail receipts: key registry, page extraction, parsing and upserts.

Acquisition of pages is outside; pages come as html strings. A note is parsed as a whole: if any of its fields fails it is
rejected with a reason and nothing of it is stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from millrace.functions.scalars import (
    QUANTITY_LABEL,
    UNIT_PRICE_LABEL,
    access_key,
    day_first_timestamp,
    emission_text,
    finite,
    number_of,
    perhaps_infinite,
    point_text,
    strip,
)
from millrace.sources.folders import written

ITEM = StructType([StructField(n, StringType()) for n in ("product", "quantity", "unit_price", "total")])
NOTE = StructType([StructField(n, StringType()) for n in ("emission", "total", "payment", "missing")] + [StructField("items", ArrayType(ITEM))])

# Places of the fields in a receipt page, as paths below body (name, 1-based position; None: any).
SECTION = [("div", 1), ("div", 4), ("div", None), ("div", 2)]
EMISSION_AT = [*SECTION, ("div", 2), ("div", 1), ("div", None), ("ul", None), ("li", None)]
ROWS_AT = [*SECTION, ("div", 1), ("table", None), ("tbody", None), ("tr", None)]
TOTAL_AT = [*SECTION, ("div", 1), ("div", 3), ("div", 2), ("span", None)]
PAYMENT_AT = [*SECTION, ("div", 1), ("div", 3), ("div", 4), ("label", None)]
ITEM_AT = {
    "product": [("td", 1), ("span", 1)],
    "quantity": [("td", 1), ("span", 3)],
    "unit_price": [("td", 1), ("span", 5)],
    "total": [("td", 2), ("span", None)],
}
NUMBERS = ("quantity", "unit_price", "total")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def scanned(texts: DataFrame, text_col: str = "qr_text") -> DataFrame:
    """url and access_key (null if there is none) of scanned codes."""
    url = strip(F.col(text_col))
    return texts.select(url.alias("url"), access_key(url).alias("access_key"))


def new_registrations(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each key that has been scanned and isn't registered yet; of several urls the smallest."""
    firsts = scans.where(F.col("access_key").isNotNull()).groupBy("access_key").agg(F.min("url").alias("url"))
    fresh = firsts.join(registry.select("access_key"), "access_key", "left_anti")
    return fresh.select("url", "access_key")


def register(scans: DataFrame, registry: DataFrame, read_at: Column | None = None) -> DataFrame:
    """The rows to append to the registry, stamped. Running it twice appends nothing the second time."""
    stamp = F.localtimestamp() if read_at is None else read_at
    return new_registrations(scans, registry).withColumn("read_at", stamp)


def registry_listing(registry: DataFrame) -> DataFrame:
    """place (from 1) and access_key, in order of key.

    Keys are range-partitioned and written once; a key's place is the number of keys in earlier ranges plus its rank
    in its own, so no task sorts all keys.
    """
    ranged = registry.select("access_key").repartitionByRange("access_key").withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "registry")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy("access_key")
    place = F.col("_start") + F.row_number().over(within)
    return ranged.join(F.broadcast(starts), "_range").select(place.cast("long").alias("place"), "access_key")


def key_by_url(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """``notes`` (url) with the access_key registered first for that url; null if unknown."""
    first = registry.groupBy("url").agg(F.min_by("access_key", F.struct("read_at", "access_key")).alias("access_key"))
    return notes.join(first, "url", "left")


def pending_notes(registry: DataFrame, headers: DataFrame) -> DataFrame:
    """Registered keys whose note isn't stored yet."""
    return registry.join(headers.select("access_key"), "access_key", "left_anti")


class Node:
    __slots__ = ("tag", "children")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def every(self, path: list[tuple[str, int | None]]) -> list[Node]:
        """All elements at ``path``, in order of the page."""
        found = [self]
        for tag, place in path:
            same = [[c for c in node.children if isinstance(c, Node) and c.tag == tag] for node in found]
            found = [c for cs in same for c in (cs if place is None else cs[place - 1 : place])]
        return found

    def at(self, path: list[tuple[str, int | None]]) -> Node | None:
        """The first element at ``path``."""
        return next(iter(self.every(path)), None)

    def content(self) -> str:
        parts, waiting = [], [self]
        while waiting:
            part = waiting.pop()
            if isinstance(part, Node):
                waiting.extend(reversed(part.children))
            else:
                parts.append(part)
        return "".join(parts)


class TreeBuilder(HTMLParser):
    """Elements by position. End tags close up to their element; strays are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def note_fields(page: str | None) -> dict:
    """Raw texts of a receipt page; ``missing`` names the first required place that isn't there."""
    builder = TreeBuilder()
    builder.feed(page or "")
    builder.close()
    root = builder.root
    body = root.at([("html", 1), ("body", 1)]) or root.at([("body", 1)]) or root

    def text(node: Node | None) -> str | None:
        return None if node is None else " ".join(node.content().split())

    found = {"emission": text(body.at(EMISSION_AT)), "total": text(body.at(TOTAL_AT)), "payment": text(body.at(PAYMENT_AT))}
    items = [{name: text(row.at(path)) for name, path in ITEM_AT.items()} for row in body.every(ROWS_AT)]
    absent = [n for n, v in found.items() if v is None] + ["items"] * (not items)
    absent += [f"item {i + 1}" for i, item in enumerate(items) if None in item.values()]
    return found | {"items": items, "missing": absent[0] if absent else None}


# A tag whose attributes are written as they should be, a comment or a declaration; and what else may begin with an angle bracket.
TOKEN = re.compile(r"""<(/?)([a-zA-Z][^\t\n\r\f />"'=<]*)((?:[\s/]+[^\s/>"'=<]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+(?=[\s>])))?)*[\s/]*)>|<!--(?!-?>).*?-->|<![a-zA-Z][^>\[]*>""", re.DOTALL)
DOUBTFUL = re.compile(r"<[a-zA-Z/!?]")
RAW = {name: re.compile(rf"</{name}(?=[\t\n\r\f />])", re.IGNORECASE) for name in ("script", "style")}
SPECIAL = frozenset("title textarea xmp iframe noembed noframes noscript plaintext svg math".split())
PATHS = {"emission": EMISSION_AT, "total": TOTAL_AT, "payment": PAYMENT_AT, "item": ROWS_AT}
WITHIN = list(ITEM_AT.items())


class Doubt(Exception):
    """The page is written in a way that only the tree can be trusted with."""


class Open:
    """An element on the way from the root: children so far by name, how far it has come on each path, and what it collects the text for."""

    __slots__ = ("tag", "counts", "states", "slots")

    def __init__(self, tag: str, states: list, slots: list):
        self.tag, self.counts, self.states, self.slots = tag, {}, states, slots


def scan(page: str, below: list[tuple[str, int]]) -> tuple[bool, dict, list[dict]]:
    """One pass over a page's tags, without a tree: whether the element at ``below`` is there, the texts of the first elements at PATHS below it, and the items' fields."""
    start = [(below, 0, None, None)] if below else [(path, 0, name, None) for name, path in PATHS.items()]
    stack, found, items, collecting, reached, at = [Open("", start, [])], {}, [], [], not below, 0

    def close(element: Open) -> None:
        for held, name, parts in element.slots:
            held[name] = " ".join("".join(parts).split())
            collecting.remove(parts)

    def opened(tag: str) -> Open:
        nonlocal reached
        parent = stack[-1]
        place = parent.counts[tag] = parent.counts.get(tag, 0) + 1
        states, slots = [], []
        for path, step, name, row in parent.states:
            wanted, position = path[step]
            if wanted != tag or (position is not None and position != place):
                continue
            if step + 1 < len(path):
                states.append((path, step + 1, name, row))
            elif name is None:
                if not reached:
                    reached = True
                    states += [(p, 0, n, None) for n, p in PATHS.items()]
            elif name == "item":
                items.append({})
                states += [(p, 0, n, items[-1]) for n, p in WITHIN]
            else:
                held = found if row is None else row
                if name not in held:
                    held[name], parts = None, []
                    slots.append((held, name, parts))
                    collecting.append(parts)
        return Open(tag, states, slots)

    def text(a: int, b: int, raw: bool = False) -> None:
        if a < b:
            piece = page[a:b]
            if not raw and "<" in piece and DOUBTFUL.search(piece):
                raise Doubt
            if collecting:
                piece = piece if raw else unescape(piece)
                for parts in collecting:
                    parts.append(piece)

    while token := TOKEN.search(page, at):
        text(at, token.start())
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    for element in reversed(stack[i:]):
                        close(element)
                    del stack[i:]
                    break
            continue
        element = opened(tag)
        if tag in VOID or token[3].endswith("/"):
            close(element)
            continue
        stack.append(element)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if not end:
                raise Doubt
            text(at, end.start(), raw=True)
            at = end.start()
        elif tag in SPECIAL and not page[page.find("<", at) :][: len(tag) + 3].lower().startswith(f"</{tag}>"):
            raise Doubt
    text(at, len(page))
    for element in reversed(stack):
        close(element)
    return reached, found, items


def scanned_fields(page: str | None) -> dict:
    """What ``note_fields`` gives, in one pass where a page is written as most are."""
    try:
        for below in ([("html", 1), ("body", 1)], [("body", 1)], []):
            reached, found, items = scan(page or "", below)
            if reached:
                break
    except Doubt:
        return note_fields(page)
    return told({n: found.get(n) for n in HEADS}, [{n: item.get(n) for n in FIELDS} for item in items])


TAG, TAGS = re.compile(r"<[^<>]*>"), re.compile(r"((?:<[^<>]*>)+)")
HEADS, FIELDS = ("emission", "total", "payment"), tuple(ITEM_AT)
#: Children of a name are counted up to one more than any path asks for.
COUNTED = 1 + max(place or 0 for path in (*PATHS.values(), *ITEM_AT.values()) for _, place in path)
#: Ways through pages that a worker remembers; and the open elements, or names of their children, and the characters of a page that are read along them.
REMEMBERED, DEEP, LONG = 20_000, 64, 1_000_000


class Spot:
    """Where a page's reader stands: the open elements, what has been found, and where each run of tags met here leads.

    ``stack`` has for each open element its name, its children counted so far, how far it has come on which paths, and the fields that it holds. Pages of a kind lead through the same
    spots, so most runs of tags cost one look into ``ways``.
    """

    __slots__ = ("stack", "reached", "found", "collecting", "ways")

    def __init__(self, stack: tuple, reached: bool, found: frozenset):
        self.stack, self.reached, self.found, self.ways = stack, reached, found, {}
        self.collecting = tuple(slot for element in stack for slot in element[3])


class Spots:
    """The spots met lately. A slot is (whether it is an item's, name of the field)."""

    def __init__(self):
        self.known: dict[tuple, Spot] = {}
        self.starts: list[Spot] = []
        self.ways = 0

    def spot(self, stack: tuple, reached: bool, found: frozenset) -> Spot:
        key = (stack, reached, found)
        if key not in self.known:
            self.known[key] = Spot(*key)
        return self.known[key]

    def begin(self) -> list[Spot]:
        if not self.starts or max(len(self.known), self.ways) > REMEMBERED:
            self.known, self.ways = {}, 0
            heads = tuple((path, 0, False, name) for name, path in SLOTS.items())
            bodies = [(("html", 1), ("body", 1)), (("body", 1),)]
            self.starts = [self.spot((("", (), ((b, 0, False, None),), ()),), False, frozenset()) for b in bodies] + [self.spot((("", (), heads, ()),), True, frozenset())]
        return self.starts

    def way(self, spot: Spot, written: str) -> tuple[Spot, tuple] | None:
        """The spot behind tags that follow each other, and what is to be done there: whether an item begins, and the slots that are opened and closed. None where only ``scan`` can tell."""
        to_do = []
        for tag in TAG.findall(written):
            leads = self.led(spot, tag)
            if leads is None:
                return None
            spot, *step = leads
            if any(step):
                to_do.append(tuple(step))
        return spot, tuple(to_do)

    def led(self, spot: Spot, written: str) -> tuple[Spot, bool, tuple, tuple] | None:
        token = TOKEN.fullmatch(written)
        if not token:
            return None
        if token[2] is None:
            return None if spot.stack[-1][0] in SPECIAL else (spot, False, (), ())
        tag, stack = token[2].lower(), spot.stack
        if stack[-1][0] in SPECIAL and written.lower() != f"</{stack[-1][0]}>":
            return None
        if token[1]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), len(stack))
            return self.spot(stack[:at], spot.reached, spot.found), False, (), tuple(slot for element in stack[at:] for slot in element[3])
        if tag in RAW:
            return None
        name, counts, paths, held = stack[-1]
        if len(stack) > DEEP or len(counts) > DEEP:
            return None
        counts = dict(counts)
        place = counts[tag] = min(counts.get(tag, 0) + 1, COUNTED)
        stack = (*stack[:-1], (name, tuple(sorted(counts.items())), paths, held))
        on, slots, begins, reached, found = [], [], False, spot.reached, spot.found
        for path, step, within, field in paths:
            wanted, position = path[step]
            if wanted != tag or (position is not None and position != place):
                continue
            if step + 1 < len(path):
                on.append((path, step + 1, within, field))
            elif field is None:
                reached = True
                on += [(p, 0, False, n) for n, p in SLOTS.items()]
            elif field == "item":
                begins, found = True, frozenset(f for f in found if not f[0])
                on += [(p, 0, True, n) for n, p in ITEM_SLOTS.items()]
            elif (within, field) not in found:
                found |= {(within, field)}
                slots.append((within, field))
        if tag in VOID or token[3].endswith("/"):
            return self.spot(stack, reached, found), begins, tuple(slots), tuple(slots)
        return self.spot((*stack, (tag, (), tuple(on), tuple(slots))), reached, found), begins, tuple(slots), ()

    def fields(self, page: str) -> dict | None:
        """What ``scanned_fields`` gives; None where a page isn't plain enough."""
        if len(page) > LONG:
            return None
        pieces = TAGS.split(page)
        texts, tags = pieces[::2], pieces[1::2]
        if "<" in "".join(texts):
            return None
        for spot in self.begin():
            heads, items, parts = dict.fromkeys(HEADS), [], {}
            item = heads
            for text, written in zip(texts, tags):
                if text and spot.collecting:
                    if "&" in text:
                        text = unescape(text)
                    for slot in spot.collecting:
                        parts[slot].append(text)
                way = spot.ways.get(written)
                if way is None:
                    way = self.way(spot, written)
                    if way is None:
                        return None
                    if len(written) <= 2000 and self.ways <= REMEMBERED:
                        spot.ways[written] = way
                        self.ways += 1
                spot, to_do = way
                for begins, opened, closed in to_do:
                    if begins:
                        item = dict.fromkeys(FIELDS)
                        items.append(item)
                    for slot in opened:
                        parts[slot] = []
                    for slot in closed:
                        (item if slot[0] else heads)[slot[1]] = " ".join("".join(parts[slot]).split())
            if spot.stack[-1][0] in SPECIAL:
                return None
            for slot in spot.collecting:
                parts[slot].append(unescape(pieces[-1]))
                (item if slot[0] else heads)[slot[1]] = " ".join("".join(parts[slot]).split())
            if spot.reached:
                return told(heads, items)
        return None  # not reached: the last start is always there


SLOTS, ITEM_SLOTS = ({name: tuple(path) for name, path in paths.items()} for paths in (PATHS, ITEM_AT))


def told(heads: dict, items: list[dict]) -> dict:
    absent = [n for n, v in heads.items() if v is None] + ["items"] * (not items)
    if not absent:
        absent = [f"item {i + 1}" for i, item in enumerate(items) if None in item.values()]
    return heads | {"items": items, "missing": absent[0] if absent else None}


def read_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spots = Spots()
    for batch in batches:
        notes = [spots.fields(page or "") or scanned_fields(page) for page in batch.column(1).to_pylist()]
        texts = [pa.array([n[name] for n in notes], pa.string()) for name in (*HEADS, "missing")]
        each = pa.StructArray.from_arrays([pa.array([item[f] for n in notes for item in n["items"]], pa.string()) for f in FIELDS], list(FIELDS))
        ends = list(accumulate((len(n["items"]) for n in notes), initial=0))
        yield pa.RecordBatch.from_arrays([batch.column(0), *texts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["url", *HEADS, "missing", "items"])


def extract_notes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` (url, html) as raw notes: url, emission, total, payment, items, missing.

    A step of a place without a position means any element of that name, so items may stand in several tables. A page is read once, without a tree of it, along ways that a worker
    remembers from pages before; one that isn't plain enough is scanned tag by tag, and one with markup that leaves room for doubt is read by the tree. Pages are sent to Python in batches of
    spark.sql.execution.arrow.maxRecordsPerBatch, or of spark.sql.execution.arrow.maxBytesPerBatch if that is less.
    """
    texts = pages.select(F.col("url").cast("string"), F.col(html_col).cast("string").alias("html"))
    return texts.mapInArrow(read_notes, StructType([StructField("url", StringType()), *NOTE.fields]))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are computed once a row. A generator gives them, as filters on them don't pass it: they would compute them anew wherever they name them."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.drop(*columns).select("*", F.inline(F.array(made)))


def parse_notes(notes: DataFrame, thousands: bool = False) -> DataFrame:
    """Raw notes with an access_key as typed ones: access_key, sold_at, payment, total, items, status, reason."""
    point = lambda c, *labels: point_text(c, *labels, thousands=thousands)
    sold = emission_text(F.col("emission"))
    # Each text is cleaned once and read once; only where that gives no number is it looked at again.
    cleaned = F.transform(
        "items",
        lambda i: F.struct(
            i.product.alias("product"), point(i.quantity, QUANTITY_LABEL).alias("quantity"), point(i.unit_price, UNIT_PRICE_LABEL).alias("unit_price"), point(i.total).alias("total")
        ),
    )
    numbers = F.transform("_cleaned", lambda i: F.struct(*(perhaps_infinite(i[n]).alias(n) for n in NUMBERS)))
    read = F.zip_with("_cleaned", "_numbers", lambda i, x: F.struct(i.product.alias("product"), *(finite(x[n]).alias(n) for n in NUMBERS)))
    failed = F.zip_with("_cleaned", "_read", lambda i, x: reduce(or_, (x[n].isNull() & F.coalesce(strip(i[n]) != "", F.lit(False)) for n in NUMBERS)))
    notes = once(notes, _cleaned=cleaned, _total=point(F.col("total")), _sold=sold)
    notes = once(notes, _numbers=numbers, _number=number_of(F.col("_total")), _sold_at=day_first_timestamp(F.col("_sold")))
    notes = once(notes, _read=read)
    bad_item = F.array_contains(failed, True)
    bad_total = F.col("_number").isNull() & F.coalesce(strip(F.col("_total")) != "", F.lit(False))
    missing = F.col("missing") if "missing" in notes.columns else F.lit(None).cast("string")
    reason = (
        F.when(missing.isNotNull(), F.concat(F.lit("missing: "), missing))
        .when(F.col("access_key").isNull(), F.lit("no access key"))
        .when(F.col("_sold").isNotNull() & F.col("_sold_at").isNull(), F.lit("impossible date"))
        .when(bad_total, F.lit("total isn't a number"))
        .when(bad_item, F.lit("an item isn't a number"))
    )
    typed = once(notes, reason=reason).select("access_key", F.col("_sold_at").alias("sold_at"), "payment", F.col("_number").alias("total"), F.col("_read").alias("items"), "reason")
    return typed.withColumn("status", F.when(F.col("reason").isNull(), "saved").otherwise("rejected"))


def header_rows(notes: DataFrame) -> DataFrame:
    return notes.where("reason is null").select("access_key", "sold_at", "payment", "total")


def item_rows(notes: DataFrame) -> DataFrame:
    """One row for each item; line_no keeps equal products of a note apart."""
    lines = notes.where("reason is null").select("access_key", F.posexplode("items").alias("line_no", "item"))
    return lines.select("access_key", (F.col("line_no") + 1).alias("line_no"), "item.product", "item.quantity", "item.unit_price", F.col("item.total").alias("item_total"))


def notes_with_items(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Each item beside the header of its note; headers without items are left out."""
    return headers.join(items, "access_key")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table after the upsert: incoming rows replace existing ones with the same keys, the last by ``order`` wins."""
    names = incoming.columns
    last = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in (order or [c for c in names if c not in keys])))
    newest = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return existing.select(names).join(newest.select(keys), keys, "left_anti").unionByName(newest)


def upsert_headers(existing: DataFrame, notes: DataFrame) -> DataFrame:
    return upsert(existing, header_rows(notes), ["access_key"])


def upsert_items(existing: DataFrame, notes: DataFrame) -> DataFrame:
    return upsert(existing, item_rows(notes), ["access_key", "line_no"])
