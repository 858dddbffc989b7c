"""Pages to rows.

One small Python step (``page_rows``) turns HTML into table rows and a few elements
outside tables, as arrays of cells; pages without a table or heading never reach it.
What the cells mean is decided by column expressions afterwards.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MINUTES, STAT_INPUTS
from ..functions.stats import (
    field_goals, game_pct, height_weight, minutes_decimal, parse_all_made_attempted, parse_number, parse_rebounds, to_float,
)
from ..functions.text import (
    abbr, abs_url, blank_to_null, clean_text, image_key, iso_date, name_and_jersey, parse_jersey,
    player_slug_from_url, slugify, starter_flag, team_slug_from_url, title_from_slug,
)
from ..session import computed, cut_lineage, expanded
from .positions import first_per_group

# --- HTML to cells -----------------------------------------------------------------------

ITEM = pa.struct([("ord", pa.int32()), ("last", pa.int32()), *[(n, pa.string()) for n in ("tag", "cls", "text", "link", "alt")]])
CELL = pa.struct([*[(n, pa.string()) for n in ("tag", "cls", "label", "real_id", "text")], ("items", pa.list_(ITEM))])
ROWS = pa.schema([
    ("page_id", pa.int64()), ("kind", pa.string()), ("table_no", pa.int32()), ("table_cls", pa.string()),
    ("idq", pa.string()), ("idx", pa.string()), ("around", pa.string()), ("header", pa.list_(pa.string())),
    ("section", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(CELL)),
])
_ITEM_SQL = "struct<ord:int,last:int,tag:string,cls:string,text:string,link:string,alt:string>"
_ROW_SQL = (
    "page_id bigint, kind string, table_no int, table_cls string, idq string, idx string, around string, "
    "header array<string>, section string, row_no int, cells array<struct<{cells}>>"
)
CELL_FIELDS = tuple(f.name for f in CELL)
# all that statistics are read from
TEXTS = ("text",)
TABLES = pa.schema([
    *[f for f in ROWS if f.name in ("page_id", "table_no", "table_cls", "idq", "idx", "around", "header")],
    ("lines", pa.list_(pa.struct([("row_no", pa.int32()), ("texts", pa.list_(pa.string()))]))),
])
_TABLE_SQL = (
    "page_id bigint, table_no int, table_cls string, idq string, idx string, around string, header array<string>, "
    "lines array<struct<row_no:int,texts:array<string>>>"
)

_RAW = {"script", "style"}
_VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed"}
_SECTIONS = {"thead", "tbody", "tfoot"}
_CELLS = {"td", "th"}
_IN_TABLE = {"td", "th", "tr"}
# a new cell, row or section ends the open one of the same table
_ENDS = {**dict.fromkeys(_CELLS, _CELLS), "tr": _IN_TABLE, **dict.fromkeys(_SECTIONS, _IN_TABLE | _SECTIONS)}

# Plain markup, in which one pattern finds what the standard parser finds: text, then a cell without
# inner elements, another tag with plainly written attributes, a comment or a document type.
_S = r"[ \t\n\r\f]"
_NAME = r"[A-Za-z][A-Za-z0-9]*(?=[ \t\n\r\f/>])"
_ATTRS = rf"""((?:{_S}+[A-Za-z][A-Za-z0-9_-]*(?:="[^"<>]*"|='[^'<>]*'|=[^ \t\n\r\f"'=<>`/&]+(?=[ \t\n\r\f>]))?(?=[ \t\n\r\f/>]))*){_S}*"""
_PLAIN = re.compile(rf"([^<]*)<(?:(td|th)(?={_S}|>){_ATTRS}>([^<]*)</\2{_S}*>|({_NAME}){_ATTRS}(/?)>|/({_NAME}){_S}*>"
                    rf"|!--(?!-?>)(?:[^-]|-(?!-))*-->|!(?i:doctype)[^<>\[\]\"']*>)")
_PLAIN_ATTR = re.compile(rf"""{_S}+([A-Za-z][A-Za-z0-9_-]*)(?:="([^"]*)"|='([^']*)'|=([^ \t\n\r\f"'=<>`/&]+))?""")
_BARE_CELLS = re.compile(r"(?:<td>[^<]*</td>)+|(?:<th>[^<]*</th>)+")
_RAW_END = {tag: re.compile(rf"(?i)</{tag}(?=[ \t\n\r\f/>])") for tag in _RAW}
_PLAIN_REFERENCES = re.compile(r"(?:[^&]|&(?:amp|quot|lt|gt|#[0-9]+);)*")
# in these the standard parser, by its version, reads no tags
_NO_TAGS = {"title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "listing"}

# rows leave Python in batches of about this many bytes, whatever the number of pages in a batch read
BATCH_BYTES = 4 << 20


class _Open:
    """An element that has not been closed yet; ``cell`` is the cell it lies in."""

    __slots__ = ("tag", "attrs", "ord", "cell", "texts_from", "shows_text", "items", "rows")

    def __init__(self, tag: str, attrs: dict, ord_: int, cell, texts_from: int):
        self.tag, self.attrs, self.ord, self.cell, self.texts_from = tag, attrs, ord_, cell, texts_from
        self.shows_text = cell is not None or tag in _CELLS or tag == "h1"
        self.items, self.rows = [], []

    def item(self, last: int, text: str) -> tuple:
        a = self.attrs
        return self.ord, last, self.tag, a.get("class", ""), text, a.get("src") or a.get("href") or "", a.get("alt", "")


class _PageParser(HTMLParser):
    """Collects rows of tables as they close, and headings and images outside of tables.

    Texts are kept once, while an element that shows them is open; such an element
    remembers where its texts begin.  Cells and items are tuples in the order of ``CELL``
    and ``ITEM``; the items of cells may be left out.  Tables may be kept whole, with the
    texts of their rows.
    """

    def __init__(self, with_items: bool = True, whole_tables: bool = False):
        super().__init__(convert_charrefs=True)
        self.with_items, self.whole_tables = with_items, whole_tables
        self.found: list[dict] = []
        self.stack: list[_Open] = []
        self.open: defaultdict[str, int] = defaultdict(int)
        self.texts: list[str] = []
        self.showing = self.count = 0
        self.raw = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)
        if tag in _RAW:
            self.raw = tag
        elif tag in _VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)
        if tag not in _RAW:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if tag == self.raw:
            self.raw = None
        elif self.open[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.showing and self.raw is None:
            self.texts.append(data)

    def close(self) -> None:
        super().close()
        while self.stack:
            self._close()

    def _start(self, tag: str, attrs: list) -> None:
        self.count += 1
        if tag in _RAW:
            return
        ends = _ENDS.get(tag)
        if ends and not ends.isdisjoint(self.open):
            while any(self.open[e] for e in ends) and self._innermost(ends) != "table":
                while self._close() not in ends:
                    pass
        above = self.stack[-1] if self.stack and tag != "table" else None
        cell = None if above is None else above if above.tag in _CELLS else above.cell
        named = {k: v for k, v in attrs if v is not None} if attrs else {}
        el = _Open(tag, named, self.count, cell, len(self.texts))
        self.stack.append(el)
        self.open[tag] += 1
        self.showing += el.shows_text

    def read_plain(self, page: str) -> bool:
        """Read a page of plain markup; false, with nothing to keep, if some part needs the standard parser."""
        at, match, stack, bare = 0, _PLAIN.match, self.stack, _BARE_CELLS.match
        while True:
            if stack and stack[-1].tag == "tr" and (m := bare(page, at)):
                self._bare_cells(page[at + 1:at + 3], m.group())
                at = m.end()
            m = match(page, at)
            if m is None:
                break
            before, cell, cell_attrs, cell_text, tag, attrs, slash, end = m.groups()
            at = m.end()
            if before and self.showing:
                self.handle_data(unescape(before) if "&" in before else before)
            if end is not None:
                self.handle_endtag(end.lower())
                continue
            if cell is None and tag is None:
                continue
            found, written = [], cell_attrs or attrs
            for name, quoted, single, plain in _PLAIN_ATTR.findall(written) if written else ():
                value = quoted or single or plain
                if "&" in value:
                    if _PLAIN_REFERENCES.fullmatch(value) is None:
                        return False
                    value = unescape(value)
                found.append((name.lower(), value))
            if cell is not None:
                if "&" in cell_text:
                    cell_text = unescape(cell_text)
                if stack and stack[-1].tag == "tr":
                    self._leaf_cell(cell, dict(found), cell_text)
                else:
                    self.handle_starttag(cell, found)
                    if cell_text:
                        self.handle_data(cell_text)
                    self.handle_endtag(cell)
                continue
            tag = tag.lower()
            if slash:
                if tag in _RAW or tag in _NO_TAGS:
                    return False
                self.handle_startendtag(tag, found)
                continue
            self.handle_starttag(tag, found)
            if tag in _RAW:
                stop = _RAW_END[tag].search(page, at)
                if stop is None:
                    return False
                at = stop.start()
            elif tag in _NO_TAGS:
                inner = match(page, at)
                if inner is None or (inner.group(8) or "").lower() != tag:
                    return False
        if page.find("<", at) >= 0:
            return False
        if at < len(page):
            self.handle_data(unescape(page[at:]))
        self.close()
        return True

    def _leaf_cell(self, tag: str, attrs: dict, text: str) -> None:
        """A cell without inner elements, directly in its row."""
        self.count += 1
        if self.showing and text:
            self.texts.append(text)
        text, cls, label, real_id, link, alt = " ".join(text.split()), "", "", "", "", ""
        if attrs:
            get = attrs.get
            cls, label, real_id, alt = get("class", ""), get("data-label", ""), get("data-real-id", ""), get("alt", "")
            link = get("src") or get("href") or ""
        items = [(self.count, self.count, tag, cls, text, link, alt)] if self.with_items else ()
        self.stack[-1].items.append((tag, cls, label, real_id, text, items))

    def _bare_cells(self, tag: str, run: str) -> None:
        """Cells without attributes and inner elements, side by side in their row."""
        between = f"</{tag}><{tag}>"
        if self.showing or "&" in run:
            texts = run[4:-5].split(between)
            if "&" in run:
                texts = [unescape(text) for text in texts]
            if self.showing:
                self.texts += filter(None, texts)
            texts = [" ".join(text.split()) for text in texts]
        else:
            # white space is made single in all cells at once, what is left of it at their ends goes
            run = " ".join(run.split())
            run = run.replace(f"<{tag}> ", f"<{tag}>").replace(" <", "<")
            texts = run[4:-5].split(between)
        at, cells = self.count, self.stack[-1].items
        if not self.with_items:
            cells += [(tag, "", "", "", text, ()) for text in texts]
            self.count += len(texts)
            return
        for text in texts:
            at += 1
            cells.append((tag, "", "", "", text, [(at, at, tag, "", text, "", "")]))
        self.count = at

    def _innermost(self, tags: set) -> str:
        """The innermost open element of these kinds, or ``table`` where that lies further in."""
        for el in reversed(self.stack):
            if el.tag in tags:
                return el.tag
            if el.tag == "table":
                break
        return "table"

    def _around(self, with_ids: bool) -> str:
        marks = [f".{c}" for e in self.stack for c in e.attrs.get("class", "").split()]
        if with_ids:
            marks += [f"#{e.attrs['id']}" for e in self.stack if "id" in e.attrs]
        return f" {' '.join(marks)} "

    def _close(self) -> str:
        """Close the innermost element and hand its content to what encloses it; returns its tag."""
        el = self.stack.pop()
        tag, text = el.tag, ""
        self.open[tag] -= 1
        if el.shows_text:
            text = " ".join(" ".join(self.texts[el.texts_from:]).split())
            self.showing -= 1
            if not self.showing:
                self.texts.clear()
        if tag in _CELLS:
            self._end_cell(el, text)
        elif tag == "tr":
            self._end_row(el)
        elif tag == "table":
            self._end_table(el)
        elif el.cell is not None:
            if self.with_items:
                el.cell.items.append(el.item(self.count, text))
        elif tag == "h1" or tag == "img":
            item = el.item(self.count, text)
            cell = (tag, el.attrs.get("class", ""), "", "", text, [item])
            self.found.append({"kind": tag, "table_no": el.ord, "table_cls": "", "idq": "", "idx": "", "around": self._around(False),
                               "header": [], "section": "", "row_no": 0, "cells": [cell]})
        return tag

    def _end_cell(self, el: _Open, text: str) -> None:
        if self.stack and self.stack[-1].tag == "tr":
            a = el.attrs
            items = [el.item(self.count, text)] if self.with_items else []
            if el.items:
                items += sorted(el.items, key=lambda i: i[0])
            self.stack[-1].items.append((el.tag, a.get("class", ""), a.get("data-label", ""), a.get("data-real-id", ""), text, items))

    def _end_row(self, el: _Open) -> None:
        section = ""
        for outer in reversed(self.stack):
            if outer.tag in _SECTIONS:
                section = outer.tag
            elif outer.tag == "table":
                if el.items:
                    outer.rows.append((section, el.items))
                return

    def _end_table(self, el: _Open) -> None:
        a = el.attrs
        heads = [text for s, cells in el.rows if s == "thead" for tag, _, _, _, text, _ in cells if tag == "th" and text]
        common = {"kind": "row", "table_no": el.ord, "table_cls": a.get("class", ""), "idq": a.get("idq", ""),
                  "idx": a.get("idx", ""), "around": self._around(True),
                  "header": heads or [text for _, cells in el.rows[:1] for _, _, _, _, text, _ in cells]}
        if self.whole_tables:
            self.found.append({**common, "lines": [[cell[4] for cell in cells] for _, cells in el.rows]})
            return
        self.found.extend({**common, "section": section, "row_no": n, "cells": cells} for n, (section, cells) in enumerate(el.rows))


def _page_records(page: str, with_items: bool = True, whole_tables: bool = False) -> list[dict]:
    """Rows of all tables, headings and images outside of tables, in the order they close."""
    parser = _PageParser(with_items, whole_tables)
    if not parser.read_plain(page):
        parser = _PageParser(with_items, whole_tables)
        parser.feed(page)
        parser.close()
    return parser.found


def _record_bytes(record: dict) -> int:
    """About the size of a record in an Arrow batch."""
    size = sum(map(len, record["header"])) + len(record["around"])
    for *_, text, items in record["cells"]:
        size += 16 + len(text)
        for _, _, _, _, text, link, alt in items:
            size += 64 + len(text) + len(link) + len(alt)
    return size


def _structs(values: list[tuple], fields: list[pa.Field]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(column, f.type) for f, column in zip(fields, zip(*values))], fields=fields)


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(accumulate(sizes, initial=0), pa.int32()), values)


def _record_batch(rows: list[dict], fields: tuple[str, ...]) -> pa.RecordBatch:
    """Records as a batch with these fields of the cells; each field of all rows is made in one go."""
    cells = dict(zip(CELL_FIELDS, zip(*chain.from_iterable(r["cells"] for r in rows))))

    def column(field: pa.Field) -> pa.Array:
        if field.name != "items":
            return pa.array(cells[field.name], field.type)
        return _lists(map(len, cells["items"]), _structs(list(chain.from_iterable(cells["items"])), list(ITEM)))

    kept = [f for f in CELL if f.name in fields]
    structs = pa.StructArray.from_arrays([column(f) for f in kept], fields=kept)
    plain = {f.name: pa.array([r[f.name] for r in rows], f.type) for f in ROWS if f.name != "cells"}
    return pa.RecordBatch.from_pydict({**plain, "cells": _lists((len(r["cells"]) for r in rows), structs)})


def _parse_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES, fields: tuple[str, ...] = CELL_FIELDS) -> Iterator[pa.RecordBatch]:
    """Pages are turned into Python strings one by one; at most one page's rows wait beside a batch."""
    for batch in batches:
        rows, size = [], 0
        for page_id, page in zip(batch.column("page_id"), batch.column("html")):
            number = page_id.as_py()
            for record in _page_records(page.as_py(), "items" in fields):
                record["page_id"] = number
                rows.append(record)
                size += _record_bytes(record)
                if size >= limit:
                    yield _record_batch(rows, fields)
                    rows, size = [], 0
        if rows:
            yield _record_batch(rows, fields)


def _table_bytes(table: dict) -> int:
    """About the size of a table in an Arrow batch."""
    return len(table["around"]) + 64 + sum(4 + len(text) for texts in (table["header"], *table["lines"]) for text in texts)


def _table_batch(tables: list[dict]) -> pa.RecordBatch:
    lines = list(chain.from_iterable(t["lines"] for t in tables))
    numbers = chain.from_iterable(range(len(t["lines"])) for t in tables)
    texts = _lists(map(len, lines), pa.array(chain.from_iterable(lines), pa.string()))
    kind = TABLES.field("lines").type.value_type
    structs = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), texts], fields=list(kind))
    plain = {f.name: pa.array([t[f.name] for t in tables], f.type) for f in TABLES if f.name != "lines"}
    return pa.RecordBatch.from_pydict({**plain, "lines": _lists((len(t["lines"]) for t in tables), structs)})


def _table_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """As ``_parse_batches``, a row for a table."""
    for batch in batches:
        tables, size = [], 0
        for page_id, page in zip(batch.column("page_id"), batch.column("html")):
            number = page_id.as_py()
            for table in _page_records(page.as_py(), False, True):
                if "lines" in table and table["lines"]:
                    tables.append(table | {"page_id": number})
                    size += _table_bytes(table)
                    if size >= limit:
                        yield _table_batch(tables)
                        tables, size = [], 0
        if tables:
            yield _table_batch(tables)


def page_tables(pages: DataFrame) -> DataFrame:
    """Tables of pages with the texts of their rows, numbered from 0; a header and marks leave Python once a table.

    Boxscores are read from these as from ``page_rows``.
    """
    return _with_tables(pages).mapInArrow(_table_batches, _TABLE_SQL)


def _with_tables(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("html").rlike(r"(?i)<(table|h1)[\s>]")).select("page_id", "html")


def page_rows(pages: DataFrame, fields: tuple[str, ...] = CELL_FIELDS) -> DataFrame:
    """Table rows (kind ``row``), headings (``h1``) and images (``img``) of pages.

    ``around`` lists classes and ids of the enclosing elements.  Items are numbered
    in page order; an item contains those numbered up to its ``last``.  Cells leave Python
    with the stated fields: their items are most of a row, and statistics are read without them.
    """
    if unknown := set(fields) - set(CELL_FIELDS):
        raise ValueError(f"no such fields of a cell: {sorted(unknown)}")
    types = dict.fromkeys(CELL_FIELDS, "string") | {"items": f"array<{_ITEM_SQL}>"}
    schema = _ROW_SQL.format(cells=",".join(f"{n}:{types[n]}" for n in CELL_FIELDS if n in fields))
    return _with_tables(pages).mapInArrow(partial(_parse_batches, fields=fields), schema)


# --- reading cells ---------------------------------------------------------------------------


def _has_class(c: Column, name: str) -> Column:
    """Whether the name is one of the words; most texts do not hold it at all, so only the others are split."""
    return c.contains(name) & F.array_contains(F.split(c, r"\s+"), name)


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _cell(name: str) -> Column:
    """First cell of the row that has the class."""
    return _first(F.filter("cells", lambda c: _has_class(c["cls"], name)))


def _items(cell: Column, tag: str | None = None, cls: str | None = None) -> Column:
    def wanted(i: Column) -> Column:
        ok = F.lit(True)
        if tag:
            ok = ok & (i["tag"] == tag)
        if cls:
            ok = ok & _has_class(i["cls"], cls)
        return ok

    return F.filter(cell["items"], wanted)


def _text(item: Column) -> Column:
    """Text of a cell or item, in which ``page_rows`` left single spaces only."""
    return F.nullif(item["text"], F.lit(""))


def _table_rows(rows: DataFrame, table_class: str) -> DataFrame:
    return rows.filter((F.col("kind") == "row") & (F.col("section") == "tbody") & _has_class(F.col("table_cls"), table_class))


# --- games list ---------------------------------------------------------------------------------


def extract_games(rows: DataFrame, base_url: str) -> DataFrame:
    """Games of a match table, one per row; repeated rows of a page are dropped."""
    matches = _table_rows(rows, "table_matches_table")
    number, home, away, score = (F.col(f"__{c}") for c in ("number", "home", "away", "score"))
    date = _first(F.filter("cells", lambda c: _has_class(c["cls"], "date_value") & (c["label"] == "DATA")))
    # the cells are found once, and their items before what is read of them
    found = matches.withColumns({
        "__number": _cell("position_value"), "__home": _cell("home_team_value"), "__away": _cell("visitor_team_value"), "__score": _cell("score_value"),
        "__spans": _items(date, "span"), "__small": _items(_cell("matche_for_small"), "strong"),
    }).filter(number.isNotNull() & home.isNotNull() & away.isNotNull())
    spans, small = F.col("__spans"), F.col("__small")
    two = F.size(small) >= 2
    home_score, away_score = _text(_first(_items(score, "span", "home"))), _text(_first(_items(score, "span", "away")))
    logo = lambda name: abs_url(_first(_items(_cell(name), "img"))["link"], base_url)
    games = found.select(
        "page_id", "table_no", "row_no",
        _text(number).alias("game_number"), blank_to_null(number["real_id"]).alias("source_game_id"),
        _text(_first(spans)).alias("game_date"), _text(F.get(spans, F.lit(1))).alias("game_time"),
        clean_text(F.array_join(F.transform(_items(_cell("game_value"), "span"), lambda s: s["text"]), " ")).alias("round"),
        _text(_cell("stage_value")).alias("phase"),
        _text(_cell("champ_value")).alias("championship"),
        _text(_first(_items(home, cls="team-shortname"))).alias("home_team_name_raw"),
        _text(_first(_items(away, cls="team-shortname"))).alias("away_team_name_raw"),
        F.when(two, abbr(_first(small)["text"])).alias("home_team_abbr_raw"),
        F.when(two, abbr(F.element_at(small, -1)["text"])).alias("away_team_abbr_raw"),
        logo("logo_home_team").alias("home_logo_url"), logo("logo_visitor_team").alias("away_logo_url"),
        home_score.alias("home_score"), away_score.alias("away_score"),
        F.when(home_score.isNotNull() & away_score.isNotNull(), "finished").otherwise("scheduled").alias("status"),
        _text(_cell("gym_value")).alias("arena"),
        abs_url(_first(_items(score, "a", "match_score_relatorio"))["link"], base_url).alias("boxscore_url"),
    )
    keys = ["page_id", F.coalesce("source_game_id", "game_number"), "game_date", "home_team_name_raw", "away_team_name_raw"]
    return first_per_group(games, keys, [F.col("table_no"), F.col("row_no")]).drop("table_no", "row_no")


# --- teams of a standings page --------------------------------------------------------------------


def _all_items(cells: Column | str = "cells") -> Column:
    return F.flatten(F.transform(cells, lambda c: c["items"]))


def extract_teams(rows: DataFrame, base_url: str) -> DataFrame:
    """Teams of a standings table with link, slug, names and typed aliases.

    The name used in a season stands beside the team's logo in the game block of the
    row that follows the team's own row.
    """
    table = rows.filter("kind = 'row'").select("page_id", "table_no", "row_no", _all_items().alias("items"))
    following = table.select("page_id", "table_no", (F.col("row_no") - 1).alias("row_no"), F.col("items").alias("detail"))
    node = _first(F.filter("items", lambda i: _has_class(i["cls"], "team_first")))
    named = table.withColumn("abbreviation", clean_text(node["text"])) \
        .filter(F.col("abbreviation").isNotNull() & (F.length("abbreviation") <= 12)) \
        .join(expanded(following), ["page_id", "table_no", "row_no"], "left") \
        .withColumn("detail", F.coalesce("detail", F.filter("items", lambda i: F.lit(False))))

    box = _first(F.filter("items", lambda i: _has_class(i["cls"], "logo")))
    in_box = F.filter("items", lambda i: (i["tag"] == "img") & (i["ord"] >= box["ord"]) & (i["ord"] <= box["last"]))
    image = F.coalesce(_first(in_box), _first(F.filter("items", lambda i: i["tag"] == "img")))
    links = lambda c: F.filter(c, lambda i: (i["tag"] == "a") & i["link"].contains("/equipes/"))
    link = F.coalesce(_first(links("items")), _first(links("detail")))
    named = named.withColumns({
        "logo_url": abs_url(image["link"], base_url), "logo_alt": clean_text(image["alt"]),
        "team_url": abs_url(link["link"], base_url), "link_text": clean_text(link["text"]),
    }).withColumn("team_slug", team_slug_from_url("team_url"))

    def name_in(block: Column) -> Column:
        inner = F.filter("detail", lambda i: (i["ord"] > block["ord"]) & (i["ord"] <= block["last"]))
        images = F.filter(inner, lambda i: i["tag"] == "img")
        names = F.filter(inner, lambda i: (i["tag"] == "strong") & ~_has_class(i["cls"], "amarelo_clarot")
                         & clean_text(i["text"]).isNotNull() & ~i["text"].contains(" X "))
        pairs = F.slice(F.arrays_zip(images.alias("image"), names.alias("name")), 1, 2)
        hits = F.filter(pairs, lambda p: image_key(p["image"]["link"]) == image_key(F.col("logo_url")))
        return F.when((F.size(images) >= 2) & (F.size(names) >= 2), clean_text(_first(hits)["name"]["text"]))

    blocks = F.filter("detail", lambda i: _has_class(i["cls"], "games_last_next_next"))
    season_name = _first(F.filter(F.transform(blocks, name_in), lambda n: n.isNotNull()))
    fallback = F.coalesce("logo_alt", "link_text", title_from_slug("team_slug"), "abbreviation")
    teams = named.withColumn("season_display_name", F.coalesce(season_name, fallback)).withColumn(
        "team_slug", F.coalesce("team_slug", slugify("season_display_name"))
    )
    typed = F.filter(F.array(*[
        F.struct(value.alias("alias"), F.lit(kind).alias("alias_type"))
        for value, kind in (
            (F.col("abbreviation"), "abbreviation"), (F.col("season_display_name"), "season_display_name"),
            (F.col("logo_alt"), "logo_alt"), (F.col("link_text"), "link_text"),
            (title_from_slug("team_slug"), "slug_name"),
        )
    ]), lambda a: a["alias"].isNotNull())
    once = F.filter(typed, lambda a, n: ~F.exists(F.slice(typed, 1, n), lambda b: F.lower(b["alias"]) == F.lower(a["alias"])))
    teams = teams.select("page_id", "table_no", "row_no", "abbreviation", "season_display_name", "logo_url", "logo_alt",
                         "team_url", "team_slug", "link_text", once.alias("aliases"))
    return first_per_group(teams, ["page_id", "team_slug"], [F.col("table_no"), F.col("row_no")]).drop("table_no", "row_no")


def team_aliases(teams: DataFrame) -> DataFrame:
    """The typed aliases of ``extract_teams``, one per row."""
    return teams.select("page_id", "team_slug", F.inline("aliases"))


# --- players -----------------------------------------------------------------------------------------


def extract_player_links(rows: DataFrame, base_url: str) -> DataFrame:
    """Player and team links of a statistics table; the first row of a player counts."""
    cells = F.filter("cells", lambda c: c["tag"] == "td")
    player = _first(F.filter(F.get(cells, F.lit(1))["items"], lambda i: (i["tag"] == "a") & i["link"].contains("/atletas/")))
    team = _first(F.filter(F.get(cells, F.lit(2))["items"], lambda i: (i["tag"] == "a") & i["link"].contains("/equipes/")))
    name = name_and_jersey(player["text"])
    links = _table_rows(rows, "stats-table-catch").filter((F.size(cells) >= 3) & player.isNotNull()).select(
        "page_id", "table_no", "row_no",
        abs_url(player["link"], base_url).alias("player_url"), name.getField("name").alias("display_name"),
        name.getField("jersey_number").alias("jersey_number"),
        clean_text(F.get(cells, F.lit(2))["text"]).alias("team_name_raw"), abs_url(team["link"], base_url).alias("team_url"),
    ).withColumn("player_slug", player_slug_from_url("player_url")).filter("player_slug IS NOT NULL")
    return first_per_group(links, ["page_id", "player_slug"], [F.col("table_no"), F.col("row_no")]).drop("table_no").withColumnRenamed("row_no", "position")


PROFILE_LABELS = {
    "Nome": "full_name", "Data de Nascimento": "birth_date", "Posição": "position",
    "Naturalidade": "naturality", "Altura / Peso": "height_weight",
}


def extract_player_profiles(rows: DataFrame, pages: DataFrame, base_url: str) -> DataFrame:
    """Profile columns from the label/value table, the heading and the photo."""
    sheet = (F.col("kind") == "row") & _has_class(F.col("table_cls"), "ficha_tecnica_athlete_stats")
    wide = sheet & _has_class(F.col("table_cls"), "hide-for-small-only")
    heading = F.get(F.col("cells"), F.lit(0))
    number = F.regexp_extract(clean_text(heading["text"]), r"^#\s*(\d+)\s+(.+)$", 1)
    name = F.regexp_extract(clean_text(heading["text"]), r"^#\s*(\d+)\s+(.+)$", 2)
    photo = (F.col("kind") == "img") & F.col("around").contains(" .photo_athlete_blue ")

    window = Window.partitionBy("page_id")
    chosen = F.coalesce(F.min(F.when(wide, F.col("table_no"))).over(window), F.min(F.when(sheet, F.col("table_no"))).over(window))
    tds = F.filter("cells", lambda c: c["tag"] == "td")
    texts = F.transform(tds, lambda c: c["text"])
    kept = rows.select(
        "page_id", "row_no", "table_no", (sheet & (F.col("table_no") == chosen)).alias("in_sheet"), texts.alias("texts"),
        F.when((F.col("kind") == "h1") & (name != ""), F.struct(name.alias("name"), number.alias("number"))).alias("heading"),
        F.when(photo, _first(heading["items"])["link"]).alias("photo"),
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size("texts") / 2).cast("int") - 1, F.lit(0))),
        lambda n: F.struct(F.get("texts", n * 2).alias("label"), F.get("texts", n * 2 + 1).alias("value"), n.alias("n")),
    )
    entries = kept.withColumn("pair", F.explode_outer(F.when(F.col("in_sheet") & (F.size("texts") >= 2), pairs)))
    value = lambda label: F.max_by(
        F.when(F.col("pair.label") == label, F.col("pair.value")),
        F.when(F.col("pair.label") == label, F.struct("row_no", "pair.n")))
    profile = entries.groupBy("page_id").agg(
        *[clean_text(value(label)).alias(column) for label, column in PROFILE_LABELS.items()],
        F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("table_no"))).alias("heading"),
        F.min_by("photo", F.when(F.col("photo").isNotNull(), F.col("table_no"))).alias("photo"),
    ).join(pages.select("page_id", F.col("url").alias("player_url")), "page_id")
    slug = player_slug_from_url("player_url")
    full = F.coalesce("full_name", clean_text("heading.name"), title_from_slug(slug))
    size = height_weight("height_weight")
    return profile.select(
        "page_id", "player_url", slug.alias("player_slug"), full.alias("full_name"),
        F.coalesce(clean_text("heading.name"), F.element_at(F.split(full, " "), 1)).alias("display_name"),
        F.col("heading.number").alias("profile_jersey_number"), abs_url("photo", base_url).alias("photo_url"),
        iso_date("birth_date").alias("birth_date"), "position", "naturality",
        size.getField("height_cm").alias("height_cm"), size.getField("weight_kg").alias("weight_kg"),
    )


# --- boxscores --------------------------------------------------------------------------------------------

# column order after the leading cells, without and with the "games" column
ORDER_PLAIN = ("minutes", "points", "three", "two", "ft", "rebounds", "assists", "steals", "blocks",
               "fouls_committed", "fouls_received", "turnovers", "dunks", "plus_minus", "efficiency")
ORDER_GAMES = ("minutes", "points", "rebounds", "assists", "three", "two", "ft", "steals", "blocks",
               "fouls_committed", "fouls_received", "turnovers", "dunks", "plus_minus", "efficiency")
COLLECTIVE = ("ações coletivas", "acoes coletivas")


def _row_kind(texts: Column) -> Column:
    """player, team_total, collective or NULL, judged by the first two cells."""
    joined = F.lower(F.array_join(texts, " "))
    first, second = F.get(texts, F.lit(0)), F.lower(F.trim(F.get(texts, F.lit(1))))
    squeezed = F.replace(first, F.lit(" "), F.lit(""))
    numbered = squeezed.startswith("#") | (
        squeezed.rlike(r"^\d+$") & ~second.isin("jogador", "total", "equipe", *COLLECTIVE))
    return (
        F.when(joined.contains(COLLECTIVE[0]) | joined.contains(COLLECTIVE[1]), "collective")
        .when(F.lower(F.trim(first)).isin("total", "equipe") | second.isin("total", "equipe"), "team_total")
        .when(numbered & blank_to_null(second).isNotNull(), "player")
    )


def _has_stats(texts: Column) -> Column:
    joined = F.lower(F.array_join(texts, " "))
    rest = F.array_join(F.slice(texts, 3, F.greatest(F.size(texts) - 2, F.lit(0))), " ")
    broken = joined.contains("fatal error") | joined.contains("erro crítico")
    return (F.size(texts) >= 5) & ~broken & rest.rlike(r"\d")


def _tables(rows: DataFrame) -> DataFrame:
    """Rows of ``page_rows`` as the tables of ``page_tables``."""
    marks = [f.name for f in TABLES if f.name != "lines"]
    line = F.struct("row_no", F.transform("cells", lambda c: c["text"]).alias("texts"))
    return rows.filter("kind = 'row'").groupBy(*marks).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def boxscore_rows(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of the two tables of each boxscore page with side, model and kind.

    Tables marked for home and away come first, in the newer and the older layout;
    else the first two of a layout, else of any layout, that show player lines.
    Takes the tables of ``page_tables``, which move once, to ``tasks`` tasks, or the rows of
    ``page_rows``; its own result is left as it is, so that several readers can share a stored one.
    """
    if "row_kind" in rows.columns:
        return rows
    tables = rows if "lines" in rows.columns else _tables(rows)
    if tasks:
        tables = tables.repartition(tasks, "page_id")
    header = F.lower(F.array_join("header", " "))
    player = lambda line: (_row_kind(line["texts"]) == "player") & _has_stats(line["texts"])
    lines = tables.select(
        "page_id", "table_no", "header", "lines",
        (_has_class(F.col("table_cls"), "real_time_table_stats") & (F.col("idq") == "0")).alias("realtime"),
        (F.col("idx") == "general").alias("classic"),
        F.col("around").contains(" .stats_real_time_table_home ").alias("rt_home"),
        F.col("around").contains(" .stats_real_time_table_away ").alias("rt_away"),
        F.col("around").contains(" #team_home_stats ").alias("cl_home"),
        F.col("around").contains(" #team_away_stats ").alias("cl_away"),
        (header.contains("jogador") & header.contains("min") & (header.contains("pts") | header.contains("pontos"))
         & F.exists("lines", player)).alias("shows"),
        F.array_contains(F.transform("header", F.upper), "JO").alias("has_games"),
    )

    page = Window.partitionBy("page_id")
    first = lambda condition: F.min(F.when(condition, F.col("table_no"))).over(page)
    two = lambda condition: F.array_sort(F.collect_set(F.when(condition & F.col("shows"), F.col("table_no"))).over(page))
    lines = lines.withColumns({
        "p1": F.array(first(F.col("realtime") & F.col("rt_home")), first(F.col("realtime") & F.col("rt_away"))),
        "p2": F.array(first(F.col("classic") & F.col("cl_home")), first(F.col("classic") & F.col("cl_away"))),
        "p3": two(F.col("realtime")), "p4": two(F.col("classic")), "p5": two(F.lit(True)),
    })
    both = lambda c: F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull()
    ways = (("p1", "realtime"), ("p2", "classic"), ("p3", "realtime_fallback_scan"),
            ("p4", "classic_fallback_scan"), ("p5", "generic_fallback_scan"))
    choice = reduce(
        lambda rest, way: F.when(both(way[0]), F.struct(
            F.get(way[0], F.lit(0)).alias("home"), F.get(way[0], F.lit(1)).alias("away"),
            F.lit(way[1]).alias("model"))).otherwise(rest),
        reversed(ways), F.lit(None),
    )
    side = F.when(F.col("table_no") == F.col("choice.home"), "home").when(F.col("table_no") == F.col("choice.away"), "away")
    chosen = lines.withColumn("choice", choice).withColumn("side", side).filter(F.col("side").isNotNull()).select(
        "page_id", "side", F.col("choice.model").alias("parse_model"), "has_games", "header", F.inline("lines"))
    return computed(chosen.filter(F.col("texts") != F.col("header")), row_kind=_row_kind(F.col("texts"))) \
        .filter(F.col("row_kind").isNotNull()).select("page_id", "side", "parse_model", "row_no", "row_kind", "has_games", "texts")


def _raw_cell(name: str, first_plain: int, first_games: int) -> Column:
    plain = F.get("texts", F.lit(first_plain + ORDER_PLAIN.index(name)))
    games = F.get("texts", F.lit(first_games + ORDER_GAMES.index(name)))
    return F.when(F.col("has_games"), games).otherwise(plain)


def _numbers(df: DataFrame, keep: list[str], first_games: int, minutes: bool) -> DataFrame:
    """Statistic columns from the printed cells.

    Cells of a kind are read as one array: an expression per column makes a method of more bytes than the
    JVM compiles.
    """
    cell = lambda name: _raw_cell(name, 2, first_games)
    marks = ("points", "three", "two", "ft")
    plain = ("assists", "steals", "blocks", "turnovers", "fouls_committed", "fouls_received", "dunks", "plus_minus", "efficiency")
    cells = df.select(*keep, *([cell("minutes").alias("minutes_text")] if minutes else []), cell("rebounds").alias("__rebounds"),
                      F.array(*map(cell, marks)).alias("__shots"), F.array(*map(cell, plain)).alias("__plain"))
    read = computed(
        cells, shots=parse_all_made_attempted("__shots"), reb=parse_rebounds("__rebounds", True),
        numbers=F.transform("__plain", lambda c: parse_number(c, True).cast("bigint")),
        **({MINUTES: minutes_decimal("minutes_text", True)} if minutes else {}),
    )
    found = {s: F.get("shots", F.lit(i)) for i, s in enumerate(marks)}
    found["fg"] = field_goals(found["two"]["made"], found["three"]["made"], found["two"]["attempted"], found["three"]["attempted"], found["points"]["pct"])
    whole = lambda c: c.cast("bigint")
    shots = [
        col.alias(f"{s}_{part}")
        for s in ("fg", "three", "two", "ft")
        for part, col in (("made", whole(found[s]["made"])), ("attempted", whole(found[s]["attempted"])), ("pct", found[s]["pct"]))
    ]
    return read.select(
        *keep, *(["minutes_text", MINUTES] if minutes else []),
        whole(found["points"]["made"]).alias("points"), whole(found["points"]["attempted"]).alias("points_attempted"), *shots,
        F.col("reb.offensive").alias("offensive_rebounds"), F.col("reb.defensive").alias("defensive_rebounds"),
        F.col("reb.total").alias("total_rebounds"), *[F.get("numbers", F.lit(i)).alias(p) for i, p in enumerate(plain)],
    )


def is_dnp(df: DataFrame) -> Column:
    """No minutes and every statistic zero or blank."""
    zero = lambda c: to_float(c) == 0 if dict(df.dtypes)[c] == "string" else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0
    minutes = to_float(MINUTES) if dict(df.dtypes)[MINUTES] == "string" else F.coalesce(F.col(MINUTES), F.lit(0.0))
    return reduce(lambda a, b: a & b, [zero(s) for s in STAT_INPUTS], minutes <= 0)


def drop_dnp(df: DataFrame) -> DataFrame:
    return df.filter(~is_dnp(df))


def boxscore_player_lines(rows: DataFrame) -> DataFrame:
    """Player lines of boxscore pages; players who did not play are left out."""
    wide_enough = F.size("texts") >= F.when(F.col("has_games"), 18).otherwise(17)
    players = boxscore_rows(rows).filter((F.col("row_kind") == "player") & wide_enough)
    name = starter_flag(F.get("texts", F.lit(1)))
    named = computed(
        players, jersey_number=parse_jersey(F.get("texts", F.lit(0))),
        player_name_raw=name.getField("name"), is_starter=name.getField("is_starter").cast("bigint"),
    ).filter("player_name_raw IS NOT NULL")
    keep = ["page_id", "side", "parse_model", "row_no", "jersey_number", "player_name_raw", "is_starter"]
    return drop_dnp(_numbers(named.select(*keep, "has_games", "texts"), keep, 3, True))


def printed_team_lines(rows: DataFrame) -> DataFrame:
    """Total rows as printed, with the rebounds credited to the team as such."""
    rebounds = parse_rebounds(F.get("texts", F.when(F.col("has_games"), 4).otherwise(7)), True)
    is_total = (F.col("row_kind") == "team_total") & (F.size("texts") >= 17)
    is_collective = F.col("row_kind") == "collective"
    last = lambda value, condition: F.max_by(F.when(condition, value), F.when(condition, F.col("row_no")))
    sides = boxscore_rows(rows).filter(is_total | is_collective).groupBy("page_id", "side").agg(
        last(F.struct("parse_model", "has_games", "texts"), is_total).alias("t"), last(rebounds, is_collective).alias("c")
    ).filter("t IS NOT NULL").select(
        "page_id", "side", "t.*",
        *[F.col(f"c.{p}").alias(f"collective_{p}_rebounds") for p in ("offensive", "defensive", "total")],
    )
    collective = [f"collective_{p}_rebounds" for p in ("offensive", "defensive", "total")]
    keep = ["page_id", "side", "parse_model"]
    return _numbers(sides, [*keep, *collective], 2, False)


def team_totals_from_players(players: DataFrame, printed: DataFrame) -> DataFrame:
    """Team lines for sides without a printed total: sums of the whole parts."""
    return _side_totals(players.join(printed.select("page_id", "side"), ["page_id", "side"], "left_anti"))


def _side_totals(players: DataFrame) -> DataFrame:
    summed = [s for s in (*STAT_INPUTS, "points_attempted")]
    totals = players.groupBy("page_id", "side").agg(
        F.concat(F.min("parse_model"), F.lit("_computed_total")).alias("parse_model"),
        *[F.coalesce(F.sum(F.col(s).cast("bigint")), F.lit(0)).alias(s) for s in summed],
    )
    return totals.withColumns({f"{s}_pct": game_pct(f"{s}_made", f"{s}_attempted") for s in ("fg", "three", "two", "ft")})


def boxscore_team_lines(rows: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Printed totals, and computed ones where a page prints none.

    The rows that both are read from, and the printed totals, are written once; numbers of players
    are read on the sides without a printed total only.
    """
    if "row_kind" not in rows.columns:
        rows = cut_lineage(boxscore_rows(rows))
    printed = cut_lineage(printed_team_lines(rows))
    if players is None:
        open_ = rows.filter("row_kind = 'player'").join(printed.select("page_id", "side"), ["page_id", "side"], "left_anti")
        totals = _side_totals(boxscore_player_lines(open_))
    else:
        totals = team_totals_from_players(players, printed)
    return printed.unionByName(totals, allowMissingColumns=True)


def complete_boxscores(players: DataFrame, team_lines: DataFrame) -> DataFrame:
    """Pages that have player lines and exactly two team lines."""
    two = team_lines.groupBy("page_id").agg(F.count("*").alias("n")).filter("n = 2").select("page_id")
    return two.join(players.select("page_id"), "page_id", "left_semi")


# --- page features -------------------------------------------------------------------------------------------

_ATTR_END = r"[\"'\s/>]"
_REALTIME = r"(?i)<table\b(?=[^>]*\bclass\s*=\s*[\"'][^\"'>]*\breal_time_table_stats\b)"
_IDQ0 = rf"(?=[^>]*\bidq\s*=\s*[\"']?0{_ATTR_END})"
_GENERAL = rf"(?i)<table\b(?=[^>]*\bidx\s*=\s*[\"']?general{_ATTR_END})"


def page_features(pages: DataFrame) -> DataFrame:
    """Size, tables by kind and marker texts of each page."""
    page = F.coalesce("html", F.lit(""))
    low = F.lower(page)
    count = lambda pattern: F.regexp_count(page, F.lit(pattern)).cast("bigint")
    flag = lambda *texts: reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in texts]).cast("bigint")
    return pages.select(
        "page_id", F.length(page).cast("bigint").alias("html_size"),
        count(r"(?i)<table\b").alias("table_count"), count(_REALTIME).alias("realtime_tables"),
        count(_REALTIME + _IDQ0).alias("realtime_idq0_tables"), count(_GENERAL).alias("classic_general_tables"),
        low.rlike(r"id\s*=\s*[\"']?team_home_stats\b").cast("bigint").alias("has_team_home_stats"),
        low.rlike(r"id\s*=\s*[\"']?team_away_stats\b").cast("bigint").alias("has_team_away_stats"),
        flag("Total").alias("has_total"), flag(*COLLECTIVE).alias("has_acoes_coletivas"),
        flag("Pts C/T", "PTS").alias("has_pts_header"), flag("fatal error", "erro crítico").alias("has_fatal_error"),
    )


def realtime_player_rows(rows: DataFrame) -> DataFrame:
    """Player rows with numbers in the newer tables, per page."""
    texts = F.transform("cells", lambda c: c["text"])
    first = F.replace(F.get(texts, F.lit(0)), F.lit(" "), F.lit(""))
    name = F.lower(clean_text(F.get(texts, F.lit(1))))
    rest = F.array_join(F.slice(texts, 3, F.greatest(F.size(texts) - 2, F.lit(0))), " ")
    real = (
        (F.col("kind") == "row") & F.col("section").isin("tbody", "tfoot")
        & _has_class(F.col("table_cls"), "real_time_table_stats") & (F.col("idq") == "0")
        & (F.size("cells") >= 5) & first.startswith("#") & name.isNotNull()
        & ~name.isin("total", *COLLECTIVE) & rest.rlike(r"\d")
    )
    return rows.filter(real).groupBy("page_id").agg(F.count("*").alias("player_rows"))


def classify_missing_boxscore(pages: DataFrame) -> DataFrame:
    """Why a page has no readable boxscore.  Only pages with two newer tables are
    parsed, to see whether these hold any player."""
    features = page_features(pages)
    doubtful = features.filter("realtime_idq0_tables >= 2").select("page_id")
    counted = realtime_player_rows(page_rows(pages.join(doubtful, "page_id", "left_semi"), TEXTS))
    kind = (
        F.when(F.col("html_size") == 0, "empty_html")
        .when(F.col("has_fatal_error") == 1, F.when(F.col("table_count") == 1, "broken_partial_boxscore").otherwise("wordpress_fatal_error"))
        .when(F.col("realtime_idq0_tables") >= 2,
              F.when(F.coalesce("player_rows", F.lit(0)) == 0, "empty_boxscore_template").otherwise("unrecognized_realtime_boxscore"))
        .when(F.col("classic_general_tables") == 1, "partial_classic_boxscore")
        .when(F.col("classic_general_tables") >= 2, "unrecognized_classic_boxscore")
        .when(F.col("table_count") == 0, "no_table_in_page")
        .otherwise("unrecognized_table_model")
    )
    return features.join(counted, "page_id", "left").select("page_id", kind.alias("error_type"))
