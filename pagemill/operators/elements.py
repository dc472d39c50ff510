"""HTML -> element rows: the one Python step, a small tag reader inside ``mapInArrow``.

The reader is lenient and implies nothing: void tags close at once, an end tag pops
to its nearest open match, an unmatched one is ignored. What the elements mean is
decided in Spark by :mod:`pagemill.operators.pages`.

A page's text is kept once, as its pieces in order: all of them (``text_pieces``), and those outside
boilerplate (``body_pieces``). An element holds the range of pieces inside it, so a page of unclosed tags, in which
every element contains all that follow, costs no more than its text. Rules cut the texts they need by ``text_of`` and ``body_of``.

Elements are numbered as nested sets: ``seq`` counts start tags, ``last`` is the greatest number inside, so an element is inside another if
its number is above the other's and at most the other's ``last``. In the same way a table holds a range of the page's rows and a video one of
its sources. What rules ask of a paragraph (its length, words and first characters) comes from running sums over the pieces, without its text.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

# --- fixed values: tag groups -------------------------------------------------
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
BOILERPLATE = frozenset(["script", "style", "nav", "footer", "header"])
TEXTLESS = frozenset(["script", "style", "template", "rt", "rp"])
TEXT_TAGS = frozenset(["title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "main", "article"])
CONTENT_NAMES = frozenset(["content", "main-content", "main"])
# Tag -> attributes that some rule reads.
ATTRIBUTES = {
    "html": ["lang"], "meta": ["name", "property", "http-equiv", "content", "charset"], "link": ["rel", "href"],
    "a": ["href", "title", "rel"], "img": ["src", "alt", "title", "width", "height", "loading"],
    "video": ["poster", "controls", "autoplay"], "source": ["src", "type"], "script": ["type"],
    "ul": [], "ol": [], "table": [], "tr": [],
}
PART_OF = {"li": ("ul", "ol"), "td": ("tr",), "th": ("tr",)}
HOLDERS = {"table": "tr", "video": "source"}  # what holds a range of what
GATHERS = frozenset(["ul", "ol", "tr"])  # what has parts
JSON_LD = "application/ld+json"
TEXTS = ("text_pieces", "body_pieces")
OUTPUT_ROWS = 256  # pages per output batch: bounds a task's memory whatever the session's batch size
HELD_ROWS = 16  # pages held as Python objects at a time

# Plain start tags have nothing left open to reading: double-quoted or no values, one white space between attributes. Others go to the parser's own rules.
PLAIN_ATTRIBUTES = r'(?:[ \n\t][a-zA-Z][a-zA-Z0-9:_-]*+(?:="[^"]*+")?+)*+'
# Text up to a "<" or the end, and the plain tag that starts there: of a start tag its name and attributes, of an end tag its name.
PLAIN = re.compile(rf"([^<]*+)(?:\Z|<(?:([a-zA-Z][a-zA-Z0-9]*+)({PLAIN_ATTRIBUTES})>|/([a-zA-Z][a-zA-Z0-9]*+)>)?+)")
PLAIN_ATTRIBUTE = re.compile(r'[ \n\t]([^=\s]+)(?:="([^"]*)")?')
START_OPEN = re.compile("<[a-zA-Z]")
# Elements whose content is no markup: some versions of the parser also name these.
UNPLAIN = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS) | frozenset(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())) | {"plaintext"}



def _kind(tag):
    """What the reader asks of a tag: void, textless, boilerplate, keeps its text, the attributes of its row (None: no row), what it holds, held, gathers parts."""
    wanted = ATTRIBUTES.get(tag, () if tag in TEXT_TAGS else None)
    return (
        tag in VOID, tag in TEXTLESS, tag in BOILERPLATE, tag in TEXT_TAGS or tag in PART_OF, wanted, HOLDERS.get(tag),
        tag in HOLDERS.values(), tag in GATHERS,
    )


OTHER = _kind("")
KINDS = {tag: _kind(tag) for tag in {*VOID, *BOILERPLATE, *TEXTLESS, *TEXT_TAGS, *ATTRIBUTES, *PART_OF} - UNPLAIN}

PIECES = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])
PART = T.StructType([T.StructField("whole", T.BooleanType()), *PIECES.fields])  # whole: a range of text_pieces, else of body_pieces
HEAD = 32  # first characters of a measured text
MEASURE = T.StructType(
    [T.StructField("chars", T.LongType()), T.StructField("squeezed", T.LongType()), T.StructField("words", T.LongType()), T.StructField("head", T.StringType())]
)
ELEMENT = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("data", T.StringType()),  # content of a JSON-LD script
        T.StructField("text", PIECES),  # all text inside, scripts and comments left out
        T.StructField("body", PIECES),  # without boilerplate descendants; null inside boilerplate, where it is the same
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("boilerplate", T.BooleanType()),
        T.StructField("parts", T.ArrayType(PART)),  # items of a list, cells of a table row
        T.StructField("last", T.IntegerType()),  # greatest seq inside, or its own
        T.StructField("post", T.IntegerType()),  # its number by end
        T.StructField("level", T.IntegerType()),  # how many elements it is inside
        T.StructField("container", T.IntegerType()),  # seq of the innermost of them; 0 at the top
        T.StructField("held", PIECES),  # rows of a table, sources of a video, as a range of all on the page
        T.StructField("body_held", PIECES),  # the same among those outside boilerplate
        T.StructField("measure", MEASURE),  # of a paragraph's text
        T.StructField("body_measure", MEASURE),  # of its body; null where it is the same
    ]
)
ARROW_PIECES = pa.struct([("start", pa.int32()), ("size", pa.int32())])
ARROW_PART = pa.struct([("whole", pa.bool_()), ("start", pa.int32()), ("size", pa.int32())])
ARROW_MEASURE = pa.struct([("chars", pa.int64()), ("squeezed", pa.int64()), ("words", pa.int64()), ("head", pa.string())])
ARROW_ELEMENT = pa.struct(
    [
        ("seq", pa.int32()), ("tag", pa.string()), ("data", pa.string()), ("text", ARROW_PIECES), ("body", ARROW_PIECES),
        ("attrs", pa.map_(pa.string(), pa.string())), ("boilerplate", pa.bool_()), ("parts", pa.list_(ARROW_PART)),
        ("last", pa.int32()), ("post", pa.int32()), ("level", pa.int32()), ("container", pa.int32()),
        ("held", ARROW_PIECES), ("body_held", ARROW_PIECES), ("measure", ARROW_MEASURE), ("body_measure", ARROW_MEASURE),
    ]
)


FIELDS = [field.name for field in ELEMENT.fields]


class TextIndex:
    """Text pieces with running sums, from which any range of them is measured without being joined."""

    def __init__(self):
        self.pieces = []
        self.worn, self.worn_at = [], []  # pieces with more than white space, and where their first other character is
        # At the border before each piece and at the end: characters, those other than white space, word starts, end of the last word.
        self.chars, self.letters, self.starts, self.ends = [0], [0], [0], [0]

    def add(self, piece):
        self.pieces.append(piece)

    def _index(self, stop):
        """Sums up to piece ``stop``: pages are indexed as far as something is measured."""
        for place in range(len(self.chars) - 1, stop):
            piece = self.pieces[place]
            at, words = self.chars[-1], piece.split()
            end, starts = self.ends[-1], len(words)
            if words:
                lead = len(piece) - len(piece.lstrip())
                self.worn.append(place)
                self.worn_at.append(at + lead)
                starts -= not lead and at > 0 and end == at  # goes on with the word before it
                end = at + len(piece.rstrip())
            self.chars.append(at + len(piece))
            self.letters.append(self.letters[-1] + sum(map(len, words)))
            self.starts.append(self.starts[-1] + starts)
            self.ends.append(end)

    def measure(self, start, stop):
        """Of pieces ``start`` to ``stop`` joined: characters when stripped, when squeezed too, words, and the first squeezed ones."""
        self._index(stop)
        first = bisect_left(self.worn, start)
        if first == len(self.worn) or self.worn[first] >= stop:
            return {"chars": 0, "squeezed": 0, "words": 0, "head": ""}
        at, border = self.worn_at[first], self.chars[start]
        cut = at == border and border > 0 and self.ends[start] == border  # starts within a word
        words = self.starts[stop] - self.starts[start] + cut
        squeezed = self.letters[stop] - self.letters[start] + words - 1
        return {"chars": self.ends[stop] - at, "squeezed": squeezed, "words": words, "head": self._head(first, stop)}

    def _head(self, worn, stop):
        head, end = "", None
        while len(head) < HEAD and worn < len(self.worn) and self.worn[worn] < stop:
            piece, at = self.pieces[self.worn[worn]], self.worn_at[worn]
            head += (" " if end is not None and end < at else "") + " ".join(piece[: 4 * HEAD].split() if len(piece) < 4 * HEAD else piece.split(None, HEAD)[:HEAD])
            end = self.ends[self.worn[worn] + 1]
            worn += 1
        return head[:HEAD]


class TagReader(HTMLParser):
    """Collects the elements of one page in document order."""

    def __init__(self, every=False):
        super().__init__()
        self.every = every  # all tags, not only those that some rule reads
        self.rows, self.open, self.text, self.body = [], [], TextIndex(), TextIndex()
        self.opened = {}  # tag -> how many are open
        self.counts = {tag: [0, 0] for tag in HOLDERS.values()}  # held tags so far: all, outside boilerplate
        self.seq = self.ended = self.hidden = self.boiler = 0

    def goahead(self, end):
        """Plain tags by one match each, whatever else by the parser's own methods, in its order; what they leave open by its own loop.

        Of a plain tag it does what ``handle_starttag``, ``handle_endtag`` and ``handle_data`` do, in one place and without what the tag's kind never asks for.
        """
        if end:
            return super().goahead(end)
        rawdata, i = self.rawdata, 0
        n, steps, attributes = len(rawdata), PLAIN.finditer(rawdata), PLAIN_ATTRIBUTE.findall
        open_, opened, rows, counts, every = self.open, self.opened, self.rows, self.counts, self.every
        texts, bodies = self.text.pieces, self.body.pieces
        seq, ended, hidden, boiler = self.seq, self.ended, self.hidden, self.boiler
        while i < n and self.cdata_elem is None:
            found = next(steps)
            text, tag, values, closed = found.groups()
            if found.end() == found.end(1):  # no "<"
                break
            if text:
                i += len(text)
                if "&" in text:
                    text = unescape(text)
                if open_ and open_[-1][5]:
                    self.handle_data(text)
                elif not hidden:
                    texts.append(text)
                    if not boiler:
                        bodies.append(text)
            if closed:
                i = found.end()
                if closed not in opened:
                    closed = closed.lower()
                if not opened.get(closed):
                    continue
                last = open_[-1]
                if last[0] == closed and last[1] is None and last[2] is None and closed not in TEXTLESS and closed not in BOILERPLATE:
                    open_.pop()
                    opened[closed] -= 1
                    ended += 1
                    continue
                self.seq, self.ended = seq, ended
                while self._pop() != closed:
                    pass
                ended, hidden, boiler = self.ended, self.hidden, self.boiler
                continue
            if tag:
                kind = KINDS.get(tag)
                if kind is None:
                    tag = tag.lower()
                    kind = KINDS.get(tag, OTHER)
            if tag and tag not in UNPLAIN:
                i = found.end()
                self.lasttag = tag
                void, textless, boilerplate, keeps, wanted, holds, held, gathers = kind
                own = {}
                if values and (every or wanted or "content" in values or "main" in values or "&" in values):
                    own = {name.lower(): unescape(value) if "&" in value else value for name, value in attributes(values)}
                if every:
                    self.seq, self.ended = seq, ended
                    self.handle_starttag(tag, own.items())
                    seq, ended, hidden, boiler = self.seq, self.ended, self.hidden, self.boiler
                    continue
                named = ("class" in own or "id" in own) and CONTENT_NAMES.intersection([*own.get("class", "").split(), own.get("id", "")])
                seq += 1
                row = None
                if wanted is not None or named:
                    if named:
                        wanted = [*(wanted or ()), "class", "id"]
                    row = {
                        "seq": seq, "tag": tag, "data": None, "text": None, "body": None, "attrs": [(name, own[name]) for name in wanted if name in own] if own else [],
                        "boilerplate": boiler > 0 or boilerplate, "parts": None, "last": seq, "post": None, "level": len(open_),
                        "container": open_[-1][3] if open_ else 0, "held": None, "body_held": None, "measure": None, "body_measure": None,
                    }
                    rows.append(row)
                before = list(counts[HOLDERS[tag]]) if holds else None
                if held:
                    counts[tag][0] += 1
                    counts[tag][1] += not row["boilerplate"]
                if void:
                    ended += 1
                    if row is not None:
                        row["post"] = ended
                    continue
                if textless or boilerplate:
                    hidden += textless
                    boiler += boilerplate
                    self.hidden, self.boiler = hidden, boiler
                opened[tag] = opened.get(tag, 0) + 1
                open_.append((tag, row, (len(texts), len(bodies)) if keeps or named else None, seq, [] if gathers else None, False, before))
                continue
            self.seq, self.ended = seq, ended
            if tag:
                k = self._raw(self.parse_starttag(i))
            elif rawdata.startswith("<!--", i):
                k = self.parse_comment(i)
            elif rawdata.startswith("<!", i):
                k = self.parse_html_declaration(i)
            elif START_OPEN.match(rawdata, i):
                k = self._raw(self.parse_starttag(i))
            else:
                break
            seq, ended, hidden, boiler = self.seq, self.ended, self.hidden, self.boiler
            if k < 0:
                break
            i, steps = k, PLAIN.finditer(rawdata, k)
        self.seq, self.ended = seq, ended
        self.rawdata = rawdata[i:]
        super().goahead(end)

    def _raw(self, at):
        """After the content of a script or style that starts at ``at`` and is closed; else ``at``."""
        if self.cdata_elem is None or getattr(self, "_escapable", False):
            return at
        match = self.interesting.search(self.rawdata, at)
        if not match or self.rawdata.find(">", match.start()) < 0:
            return at
        if at < match.start():
            self.handle_data(self.rawdata[at:match.start()])
        return self.parse_endtag(match.start())

    def handle_starttag(self, tag, attrs):
        self.seq += 1
        found = {name: value or "" for name, value in attrs} if attrs else {}
        named = ("class" in found or "id" in found) and CONTENT_NAMES.intersection(
            [*found.get("class", "").split(), found.get("id", "")]
        )
        data = tag == "script" and found.get("type") == JSON_LD
        keeps_text = self.every or tag in TEXT_TAGS or bool(named) or tag in PART_OF
        row = None
        if self.every or tag in TEXT_TAGS or named or data or (tag in ATTRIBUTES and tag != "script"):
            wanted = found if self.every else [*ATTRIBUTES.get(tag, ()), *(("class", "id") if named else ())]
            row = dict.fromkeys(FIELDS)
            row["seq"], row["tag"], row["last"], row["level"] = self.seq, tag, self.seq, len(self.open)
            row["container"] = self.open[-1][3] if self.open else 0
            row["attrs"] = [(name, found[name]) for name in wanted if name in found]
            row["boilerplate"] = bool(self.boiler) or tag in BOILERPLATE
            self.rows.append(row)
        held = None
        if tag in HOLDERS:
            held = list(self.counts[HOLDERS[tag]])
        if tag in self.counts:
            self.counts[tag][0] += 1
            self.counts[tag][1] += not row["boilerplate"]
        if tag in VOID:
            self._ended(row)
            return
        self.hidden += tag in TEXTLESS
        self.boiler += tag in BOILERPLATE
        self.opened[tag] = self.opened.get(tag, 0) + 1
        at = (len(self.text.pieces), len(self.body.pieces)) if keeps_text else None
        self.open.append((tag, row, at, self.seq, [], data, held))

    def _ended(self, row):
        self.ended += 1
        if row is not None:
            row["post"], row["last"] = self.ended, self.seq

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        if self.opened.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1][5]:
            self.open[-1][1]["data"] = (self.open[-1][1]["data"] or "") + data
        if not self.hidden:
            self.text.add(data)
            if not self.boiler:
                self.body.add(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[len("CDATA["):])

    def _pop(self):
        tag, row, at, seq, parts, _, held = self.open.pop()
        self.opened[tag] -= 1
        self.hidden -= tag in TEXTLESS
        self.boiler -= tag in BOILERPLATE
        self._ended(row)
        if at is not None:
            n_text, n_body = len(self.text.pieces), len(self.body.pieces)
            text, body = {"start": at[0], "size": n_text - at[0]}, {"start": at[1], "size": n_body - at[1]}
            if row is not None:
                row["text"], row["body"] = text, None if self.boiler else body
            if tag == "p":
                row["measure"] = self.text.measure(at[0], n_text)
                # As many pieces are the same pieces.
                if not self.boiler and text["size"] != body["size"]:
                    own = self.body.measure(at[1], n_body)
                    row["body_measure"] = None if own == row["measure"] else own
            if tag in PART_OF:
                holders, part = PART_OF[tag], None
                for holder in self.open if any(map(self.opened.get, holders)) else ():
                    # boilerplate inside a holder is no part of it
                    if holder[0] in holders and (not self.boiler or holder[1]["boilerplate"]):
                        part = part or {"whole": bool(self.boiler), **(text if self.boiler else body)}
                        holder[4].append((seq, part))
        if held:
            row["held"], row["body_held"] = ({"start": then, "size": now - then} for then, now in zip(held, self.counts[HOLDERS[tag]]))
        if row is not None and tag in GATHERS:
            row["parts"] = [part for _, part in sorted(parts, key=lambda p: p[0])]
        return tag

    def finish(self):
        self.close()
        while self.open:
            self._pop()


def read_page(html: str | None, every: bool = False) -> tuple[list[dict], list[str], list[str], str | None]:
    """Elements of a page, its text pieces, those outside boilerplate, and what stopped the reader, if anything did."""
    reader, stopped = TagReader(every), None
    try:
        reader.feed(html or "")
        reader.finish()
    except AssertionError as error:  # malformed marked sections
        stopped = str(error) or "malformed markup"
    while reader.open:
        reader._pop()
    return reader.rows, reader.text.pieces, reader.body.pieces, stopped


# Ship the reader with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_elements(pages: DataFrame, html: str = "html", every: bool = False) -> DataFrame:
    """Replace the HTML column by ``content_length`` (its characters), ``elements``, the text pieces and ``parse_error``.

    Elements are those that some rule reads, with the attributes that rules read, or with ``every`` all of them, with all attributes.

    One row in, one row out: no shuffle, and the wide HTML goes no further.
    """
    kept = pages.withColumn("content_length", F.coalesce(F.length(html), F.lit(0)).cast("long"))
    position = kept.columns.index(html)
    fields = [f for f in kept.schema.fields if f.name != html]
    schema = T.StructType(
        [
            *fields, T.StructField("elements", T.ArrayType(ELEMENT)), *[T.StructField(c, T.ArrayType(T.StringType())) for c in TEXTS],
            T.StructField("parse_error", T.StringType()),
        ]
    )

    def columns(done):
        pieces = [pa.array([page[i] for page in done], pa.list_(pa.string())) for i in (1, 2)]
        return [pa.array([page[0] for page in done], pa.list_(ARROW_ELEMENT)), *pieces, pa.array([page[3] for page in done], pa.string())]

    def read(batches):
        for batch in (b.slice(at, OUTPUT_ROWS) for b in batches for at in range(0, b.num_rows, OUTPUT_ROWS)):
            texts = batch.column(position)
            chunks = [columns([read_page(text, every) for text in texts.slice(at, HELD_ROWS).to_pylist()]) for at in range(0, batch.num_rows, HELD_ROWS)]
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != position]
            arrays += [pa.concat_arrays(chunk) for chunk in zip(*chunks)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return kept.mapInArrow(read, schema)


def _joined(pieces: str, place: Column) -> Column:
    return F.array_join(F.slice(F.col(pieces), place["start"] + 1, place["size"]), "")


def text_of(element: Column) -> Column:
    """All text inside an element of the row's page; null for elements that hold none by their kind."""
    return _joined("text_pieces", element["text"])


def body_of(element: Column) -> Column:
    """Text inside an element without boilerplate descendants."""
    return F.when(element["body"].isNull(), text_of(element)).otherwise(_joined("body_pieces", element["body"]))


def part_of(part: Column) -> Column:
    """Text of a list item or table cell."""
    return F.when(part["whole"], _joined("text_pieces", part)).otherwise(_joined("body_pieces", part))


def element_table(pages: DataFrame, keys: list[str], html: str = "html", tags: list[str] | None = None, texts: bool = True) -> DataFrame:
    """The corpus as one row per element, of ``tags`` if given: nested-set numbers, attributes, and its texts written out.

    An element is inside another of its page if ``seq`` is above the other's ``seq`` and at most its ``last``. A text stands in the row of
    every element that it is inside; ``texts=False`` leaves texts out, which keeps pages of unclosed tags linear.
    """
    chosen = F.filter("elements", lambda e: e["tag"].isin(*tags)) if tags else F.col("elements")

    def row(e: Column) -> Column:
        fields = [e[c].alias(c) for c in ("seq", "last", "post", "level", "container", "tag", "attrs", "boilerplate")]
        if texts:
            parts = F.transform(e["parts"], part_of).alias("parts")
            fields += [F.coalesce(e["data"], text_of(e)).alias("text"), body_of(e).alias("body_text"), parts]
        return F.struct(*fields)

    parsed = with_elements(pages.select(*keys, html), html, every=True).select(*keys, F.transform(chosen, row).alias("_rows"))
    return parsed.select(*keys, F.inline_outer("_rows")).filter("seq IS NOT NULL")
