"""S2 and S3 for .docx and .xlsx: files decoded to the tables that the operators take, and masks written back into them.

Spark lists and reads the files (``binaryFile``), so any store that Spark reads will do and a task has a group of files. A file is parsed
once: its parts stream through an event parser, and all it holds is stored as one table with a folder for each kind of row;
``Office`` gives the tables, of which a query then reads the kinds it needs. Only what a file's format asks for is Python; paragraphs,
tables, links and notes are put together by the operators D1 to D10.

Masks go back by place: the parser that numbers runs and cells also tells where each stands, the bytes between stay as they were.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Collection, Container, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import groupby, islice
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import assemble as D
from ..operators.meeting import plain, small
from .archive import Archive
from .io import route_by_format, work_dir

# fixed values of the formats
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main "
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main "
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships "
TAG = "{" + S.strip() + "}"
_VALUES, _FORMULA, _TEXT, _SI, _ROW, _CELL = {TAG + "v", TAG + "t"}, TAG + "f", TAG + "t", TAG + "si", TAG + "row", TAG + "c"
TEXT_OF = {"tab": "\t", "ptab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47}
MASK_FONT = '<rPr><b/><sz val="11"/><color rgb="FFC00000"/><rFont val="Calibri"/></rPr>'
PLAIN_FONT = '<rPr><sz val="11"/><color rgb="FF000000"/><rFont val="Calibri"/></rPr>'
FILL = '<fill><patternFill patternType="solid"><fgColor rgb="FFFFF2CC"/><bgColor rgb="FFFFF2CC"/></patternFill></fill>'


def office_files(spark: SparkSession, path: str, doc_id: Column | None = None) -> DataFrame:
    """(doc_id, filename, file_type, content) of the .docx and .xlsx files under ``path``; a file's path is its doc_id if no other is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select((F.col("path") if doc_id is None else doc_id).alias("doc_id"), F.regexp_extract("path", "[^/]*$", 0).alias("filename"), "content")
    return route_by_format(named).filter("file_type in ('docx', 'xlsx')").select("doc_id", "filename", "file_type", "content")


# -- events -------------------------------------------------------------------


def _walk(data: bytes, space: str, start, end, text=None, placed: Container[str] = ()) -> None:
    """start(tag, attributes, first byte), end(tag, byte after the element); tags of other name spaces are empty. Only ``placed`` tags get their bytes."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    empty = False  # whether nothing has come since the last start
    tags: dict[str, str] = {}

    def began(name: str, a: dict) -> None:
        nonlocal empty
        tag = tags.get(name)
        if tag is None:
            tag = tags[name] = name[len(space) :] if name.startswith(space) else ""
        start(tag, a, parser.CurrentByteIndex if tag in placed else -1)
        empty = True

    def ended(name: str) -> None:
        nonlocal empty
        tag, at = tags[name], -1
        if tag in placed:
            at = parser.CurrentByteIndex  # of the closing tag, or behind an element that closes itself
            at = at if empty and data[at - 2 : at] == b"/>" else data.index(b">", at) + 1
        end(tag, at)
        empty = False

    def said(found: str) -> None:
        nonlocal empty
        empty = False
        if text:
            text(found)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = began, ended, said
    parser.Parse(data, True)


SMALL = 1 << 20  # bytes of a part that may be held as a tree


def _tree(data: bytes | str) -> ET.Element:
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise expat.ExpatError(str(e)) from e


def _elements(data: bytes, tag: str | None = None) -> Iterator[ET.Element]:
    """The elements of a tag (or all); the tree is built without a call of ours for each. Of a large part no more than one such element is held."""
    try:
        if len(data) <= SMALL:
            yield from ET.fromstring(data).iter(tag)
        else:
            for _, e in ET.iterparse(io.BytesIO(data)):
                if tag is None or e.tag == tag:
                    yield e
                    e.clear()
    except ET.ParseError as e:
        raise expat.ExpatError(str(e)) from e


WTAG = "{" + W.strip() + "}"
_P, _R, _T, _TBL, _PPR, _RPR = (WTAG + x for x in ("p", "r", "t", "tbl", "pPr", "rPr"))
_READ = {WTAG + x for x in ("p", "r", "t", "tbl", "tr", "tc", "gridSpan", "vMerge", "hyperlink", "footnoteReference", "endnoteReference")}


def _quiet(e: ET.Element) -> bool:
    """Whether properties hold nothing that ``Paragraphs`` reads."""
    return not len(e) or _READ.isdisjoint([x.tag for x in e.iter()])


def _plain(p: ET.Element) -> list[str] | None:
    """The texts of a paragraph's runs, if it holds nothing but runs of text."""
    texts = []
    for r in p:
        tag = r.tag
        if tag == _R:
            text = ""
            for t in r:
                tag = t.tag
                if tag == _T and not len(t):
                    text += t.text or ""
                elif tag != _RPR or not _quiet(t):
                    return None
            texts.append(text)
        elif tag != _PPR or not _quiet(r):
            return None
    return texts


CUT = "plain-block"  # the attribute that numbers what stood in an element's place
_CUT, _OTHER_CODE = CUT.encode(), re.compile(rb"""<\?xml[^>]*encoding=["'](?!utf-8["']|us-ascii["'])""", re.I)
_CONTROL = bytes(x for x in range(32) if x not in (9, 10, 13))
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_TEXT_RE = r"[^<&]*+(?:&(?:lt|gt|quot|apos|amp);[^<&]*+)*+"


def _unescaped(text: str) -> str:
    return re.sub(r"&\w+;", lambda m: _ENTITIES[m[0]], text) if "&" in text else text


def _cuttable(data: bytes) -> str | None:
    """A part's text, if whatever looks like an element there is one, and all characters may stand in XML."""
    if not data.startswith(b"<") or b"<!" in data or b"]]>" in data or data.find(b"<?", 1) >= 0 or _CUT in data or len(data.translate(None, _CONTROL)) < len(data):
        return None
    if b"\xef\xbf" in data and (b"\xef\xbf\xbe" in data or b"\xef\xbf\xbf" in data) or data.startswith(b"<?") and _OTHER_CODE.match(data):
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


@functools.lru_cache(maxsize=8)
def _blocks(p: str, also: str) -> tuple[re.Pattern, re.Pattern]:
    """A plain paragraph or table where the format's prefix is ``p`` (and others stand for what they usually do), and the texts inside.
    What the first matches is well-formed in itself."""
    a = rf'(?: (?:{also}|{p})\w+="[^"<&]*")*+'
    flat = rf"<{p}(?!(?:p|r|t|tbl|tr|tc|gridSpan|vMerge|hyperlink|footnoteReference|endnoteReference)[ />])\w+{a}/>"
    several = "|".join(rf"<{p}{x}>(?:{flat})*+</{p}{x}>" for x in ("rPr", "numPr", "tabs", "pBdr", "tcBorders", "tcMar", "tblBorders", "tblCellMar"))
    quiet = lambda x: rf"(?:<{p}{x}>(?:{flat}|{several})*+</{p}{x}>)?+"
    text = rf'<{p}t(?: xml:space="preserve")?>{_TEXT_RE}</{p}t>'
    runs = rf"(?:<{p}r{a}>{quiet('rPr')}(?:{text})*+</{p}r>)*+"
    para = rf"<{p}p{a}>{quiet('pPr')}{runs}</{p}p>"
    rows = lambda cell: rf"(?:<{p}tr{a}>{quiet('trPr')}(?:<{p}tc{a}>{quiet('tcPr')}(?:{cell})</{p}tc>)++</{p}tr>)"
    table = rf"<{p}tbl>{quiet('tblPr')}(?:<{p}tblGrid>(?:{flat})*+</{p}tblGrid>)?+"
    one = rf"<{p}p{a}>{quiet('pPr')}<{p}r{a}>{quiet('rPr')}{text}</{p}r></{p}p>"
    every = rf"<{p}p{a}>{quiet('pPr')}({runs})</{p}p>|{table}(?:({rows(one)}++)</{p}tbl>|({rows(f'(?:{para})++')}*+)</{p}tbl>)"
    return re.compile(every), re.compile(rf"<{p}t(?: xml:space=\"preserve\")?>([^<]*)</{p}t>")


class Misplaced(Exception):
    """A plain block stands where it isn't one."""


def _without_blocks(data: bytes) -> tuple[str, list] | None:
    """A part with an empty, numbered paragraph or table in the place of each plain one, and these: the texts of a paragraph's runs, or a table's rows of cells of
    paragraphs (a cell of one paragraph of one run is its text). The parser sees what is left, and so in which name space and where the blocks stand."""
    text = _cuttable(data)
    root = text and re.match(r"(?:<\?xml[^>]*\?>)?\s*<((?:\w+:)?)\w+( [^<>]*)?>", text)
    if not root:
        return None
    p, declared = root[1], root[2] or ""
    also = "|".join(["xml:", *[x for x in ("w14:",) if f" xmlns:{x[:-1]}=" in declared]])
    plain_block, shown = _blocks(p, also)
    found: list = []
    end_run, end_para, end_cell, end_row = (f"</{p}{x}>" for x in ("r", "p", "tc", "tr"))

    def texts(runs: str) -> list[str]:
        return [_unescaped("".join(shown.findall(r))) for r in runs.split(end_run)[:-1]]

    def cut(m: re.Match) -> str:
        if m[1] is not None:
            found.append(texts(m[1]))
            return f'<{p}p {CUT}="{len(found) - 1}"/>'
        if m[2] is not None:  # a text for each cell
            every = iter(shown.findall(m[2]))
            rows = [list(islice(every, r.count(end_cell))) for r in m[2].split(end_row)[:-1]]
            found.append([list(map(_unescaped, r)) for r in rows] if "&" in m[2] else rows)
        else:
            found.append([[[texts(x) for x in c.split(end_para)[:-1]] for c in r.split(end_cell)[:-1]] for r in m[3].split(end_row)[:-1]])
        return f'<{p}tbl {CUT}="{len(found) - 1}"/>'

    return plain_block.sub(cut, text), found


class Paragraphs:
    """The paragraphs of a part: runs (with the bytes they take up), pieces of visible text, note references, the place in the body."""

    def __init__(self, data: bytes, places: bool = False):
        self.clear()
        cut = None if places else _without_blocks(data)
        if cut is not None and len(cut[0]) <= SMALL:
            try:
                return self.tree(_tree(cut[0]), cut[1])
            except Misplaced:
                self.clear()
        if places or len(data) > SMALL:
            _walk(data, W, self.start, self.end, self.text, ("r", "rPr") if places else ())
        else:
            self.tree(_tree(data))

    def clear(self) -> None:
        self.rows: list[dict] = []
        self.tags: list[str] = []
        self.open: list[dict] = []  # paragraphs, the innermost last
        self.run: dict | None = None
        self.link: dict | None = None
        self.elements, self.tables, self.vertical, self.cell_from = -1, [], {}, 0
        self.in_text = False

    def tree(self, root: ET.Element, blocks: list = ()) -> None:
        """The events of a part. Its plain paragraphs (``plain``: the texts of their runs) and tables (part ``table``) need none."""
        todo = [(root, False)]  # what is still to begin or, begun, to end; the next last
        while todo:
            e, begun = todo.pop()
            tag, found = e.tag, None
            if begun:
                self.end(self.tags[-1], -1)
            elif blocks and CUT in e.attrib:
                found = blocks[int(e.attrib[CUT])]
                if self.open or tag != _P and (tag != _TBL or self.tables):
                    raise Misplaced
                if tag == _P:
                    self.paragraph(found)
                else:
                    self.elements += self.tags[-1] == "body"
                    self.rows.append({"part": "table", "element": self.elements, "rows": found})
            elif tag == _P and not self.open and (found := _plain(e)) is not None:
                self.paragraph(found)
            else:
                self.start(tag[len(WTAG) :] if tag.startswith(WTAG) else "", {k[1:].replace("}", " ", 1) if k[0] == "{" else k: v for k, v in e.items()}, -1)
                if e.text:
                    self.text(e.text)
                todo.append((e, True))
                todo += [(x, False) for x in reversed(e)]
                continue
            if e.tail:
                self.text(e.tail)

    def place(self, parent: str) -> dict:
        """What of a paragraph is known before its content. Of what stands in text boxes and inner tables the runs are masked, the body's text doesn't hold it."""
        of_text = not self.open and parent in ("body", "tc", "hdr", "ftr", "footnote", "endnote") and len(self.tables) < 2
        cell = self.tables[0] if of_text and self.tables else None
        return {"part": "body" if of_text else "inner", "cell": cell, "element": self.elements, "row": cell and cell["row"], "col": cell and cell["col"]}

    def paragraph(self, texts: list[str]) -> None:
        parent = self.tags[-1] if self.tags else ""
        if parent == "body":
            self.elements += 1
        self.rows.append(self.place(parent) | {"plain": texts, "refs": ()})

    def start(self, tag: str, a: dict, at: int) -> None:
        parent = self.tags[-1] if self.tags else ""
        if parent == "body":
            self.elements += 1
        if self.run is not None and parent == "r" and tag not in ("rPr", "t"):
            self.run["is_complex"] = True
        if tag == "tbl":
            self.tables.append({"row": -1, "col": 0, "span": 1, "same": False})
            self.vertical = {} if len(self.tables) == 1 else self.vertical
        elif tag == "tr" and self.tables:
            self.tables[-1] |= {"row": self.tables[-1]["row"] + 1, "col": 0}
        elif tag == "tc" and self.tables:
            self.tables[-1] |= {"span": 1, "same": False}
            self.cell_from = len(self.rows) if len(self.tables) == 1 else self.cell_from
        elif tag == "gridSpan" and self.tables:
            self.tables[-1]["span"] = int(a.get(W + "val", 1))
        elif tag == "vMerge" and self.tables:
            self.tables[-1]["same"] = a.get(W + "val", "continue") == "continue"
        elif tag == "p":
            self.open.append(self.place(parent) | {"plain": None, "runs": [], "pieces": [], "refs": []})
        elif self.open and tag == "hyperlink":
            self.link = {"text": "", "rel_id": a.get(REL + "id"), "is_link": True}
            self.open[-1]["pieces"].append(self.link)
        elif self.open and tag == "r":
            self.run = {"text": "", "is_complex": False, "from": at, "rpr": None, "outer": self.run}
            self.open[-1]["runs"].append(self.run)
            if self.link is None and parent == "p":
                self.open[-1]["pieces"].append({"text": "", "rel_id": None, "is_link": False, "run": self.run})
        elif self.run is not None and tag == "rPr" and parent == "r":
            self.run["rpr"] = at
        elif self.run is not None and parent == "r" and tag in TEXT_OF:
            self.text(TEXT_OF[tag], True)
        elif self.open and tag in ("footnoteReference", "endnoteReference"):
            self.open[-1]["refs"].append((tag[:-9], a.get(W + "id")))
        self.in_text = tag == "t" and parent == "r"
        self.tags.append(tag)

    def text(self, data: str, sign: bool = False) -> None:
        if (self.in_text or sign) and self.run is not None:
            self.run["text"] += data
            if self.link is not None:
                self.link["text"] += data

    def end(self, tag: str, at: int) -> None:
        self.tags.pop()
        if tag == "t":
            self.in_text = False
        elif tag == "rPr" and self.run is not None and isinstance(self.run["rpr"], int) and self.tags[-1] == "r":
            self.run["rpr"] = (self.run["rpr"], at)
        elif tag == "r" and self.run is not None:
            self.run["to"] = at
            self.run = self.run["outer"]
        elif tag == "hyperlink":
            self.link = None
        elif tag == "p" and self.open:
            self.rows.append(self.open.pop())
        elif tag == "tc" and self.tables:
            t = self.tables[-1]
            if len(self.tables) == 1:
                self.vertical |= {c: (self.vertical.get(c, (t["row"], t["col"])) if t["same"] else (t["row"], t["col"])) for c in range(t["col"], t["col"] + t["span"])}
                places = [(c, *self.vertical[c]) for c in range(t["col"], t["col"] + t["span"])]
                texts = [p for p in self.rows[self.cell_from :] if p["part"] == "body"]
                for p in texts:
                    p["hidden"] = places[0][1:] != (t["row"], t["col"])
                # a cell that shows its own text in its own place needs no row
                self.rows.append({"part": "grid", "element": self.elements, "row": t["row"], "cells": [x for x in places if x[1:] != (t["row"], x[0]) or not texts]})
            t["col"] += t["span"]
        elif tag == "tbl" and self.tables:
            self.tables.pop()


@functools.lru_cache(maxsize=64)
def _targets(data: bytes) -> dict[str, str]:
    return {e.get("Id"): e.get("Target", "") for e in _elements(data) if e.tag.endswith("}Relationship")}


def _relations(z: Archive, name: str) -> dict[str, str]:
    return _targets(z.read(name)) if name in z.names() else {}


MASKED_PARTS = re.compile(r"word/(?:document|header\d*|footer\d*)\.xml")


def _docx(z: Archive, kinds: Container[str] | None) -> Iterator[tuple]:
    runs, tables = kinds is None or "run" in kinds, kinds is not None and "table" in kinds
    yield from (("link", i, url) for i, url in _relations(z, "word/_rels/document.xml.rels").items())
    for name in sorted(x for x in z.names() if MASKED_PARTS.fullmatch(x)):
        of_body, para = name == "word/document.xml", -1
        for p in Paragraphs(z.read(name)).rows:
            if p["part"] == "grid":
                if of_body:
                    yield from (("grid", p["element"], p["row"], c, r, k) for c, r, k in p["cells"])
                continue
            if p["part"] != "table":
                several = (p,)
            elif of_body and tables:
                rows = p["rows"]
                para += sum([1 if c.__class__ is str else len(c) for r in rows for c in r])
                yield "table", name, p["element"], [[_line(c) if c.__class__ is str else " ".join([_line("".join(x)) for x in c]).strip() for c in r] for r in rows]
                continue
            else:
                several = ({"part": "body", "element": p["element"], "row": i, "col": j, "plain": x, "refs": ()} for i, r in enumerate(p["rows"]) for j, c in enumerate(r) for x in ([[c]] if c.__class__ is str else c))
            for p in several:
                para += 1
                texts = p["plain"]
                if runs:
                    found = [(t, False) for t in texts] if texts is not None else [(r["text"], r["is_complex"]) for r in p["runs"]]
                    yield from (("run", name, p["element"], para, i, t, c) for i, (t, c) in enumerate(found))
                if not of_body or p["part"] != "body":
                    continue
                pieces = texts if texts is not None else [x["run"]["text"] if "run" in x else x["text"] for x in p["pieces"]]
                linked = texts is None and any(x["is_link"] for x in p["pieces"])
                # ref: whether notes follow; flag: whether the text isn't shown, as a merged cell covers it
                yield "paragraph", name, p["element"], para, p["row"], p["col"], "note" if p["refs"] else None, None if linked else "".join(pieces), p.get("hidden", False)
                if linked:
                    yield from (("piece", name, p["element"], para, i, x["rel_id"], t, x["is_link"]) for i, (t, x) in enumerate(zip(pieces, p["pieces"], strict=True)))
                yield from (("note_ref", name, p["element"], para, i, ref, k) for i, (k, ref) in enumerate(p["refs"]))
    for kind in ("footnote", "endnote"):
        if f"word/{kind}s.xml" in z.names():
            yield from _notes(z.read(f"word/{kind}s.xml"), kind)


def _line(text: str) -> str:
    """``D.one_line`` of a plain paragraph."""
    return text.replace("\n", " ").strip()


def _notes(data: bytes, kind: str) -> Iterator[tuple]:
    """A row of cells for each paragraph or table row of the notes proper, which are numbered from 1."""
    out: list[tuple] = []
    at = {"note": 0, "on": False, "cells": None, "text": None, "row": 0}

    def start(tag: str, a: dict, _: int) -> None:
        if tag == kind:
            at["on"] = W + "type" not in a or a[W + "type"] == "normal"
            at["note"] += at["on"]
        elif tag == "tr":
            at["cells"] = []
        elif tag == "tc" and at["cells"] is not None:
            at["cells"].append("")
        elif tag == "p":
            at["text"] = ""
        at["t"] = tag == "t"
        if tag in TEXT_OF and at["text"] is not None:
            at["text"] += TEXT_OF[tag]

    def text(data: str) -> None:
        if at["t"] and at["text"] is not None:
            at["text"] += data

    def end(tag: str, _: int) -> None:
        at["t"] = False
        done = None
        if tag == "p" and at["text"] is not None:
            if at["cells"]:
                at["cells"][-1] += ("\n" if at["cells"][-1] else "") + at["text"]
            elif at["cells"] is None:
                done = [at["text"]]
            at["text"] = None
        elif tag == "tr":
            done, at["cells"] = at["cells"], None
        if done is not None and at["on"]:
            out.append(("note", kind, at["note"], at["row"], done))
            at["row"] += 1

    _walk(data, W, start, end, text)
    yield from out


@functools.lru_cache(maxsize=4)
def _date_styles(data: bytes) -> set[int]:
    """The numbers of the cell styles that show dates. Files of one writer mostly have the same styles."""
    own, found, at = {}, set(), {"in": False, "n": 0}

    def start(tag: str, a: dict, _: int) -> None:
        if tag == "numFmt":
            own[int(a["numFmtId"])] = bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", a.get("formatCode", "").lower())))
        elif tag == "cellXfs":
            at["in"] = True
        elif tag == "xf" and at["in"]:
            if own.get(k := int(a.get("numFmtId", 0)), k in DATE_FORMATS):
                found.add(at["n"])
            at["n"] += 1

    def end(tag: str, _: int) -> None:
        if tag == "cellXfs":
            at["in"] = False

    _walk(data, S, start, end)
    return found


_PLAIN_STRINGS = re.compile(rf'(?:<\?xml version="1.0" encoding="UTF-8"(?: standalone="yes")?\?>\s*)?<sst xmlns="{S.strip()}"(?: count="\d+")?(?: uniqueCount="\d+")?>(?:<si><t(?: xml:space="preserve")?>{_TEXT_RE}</t></si>)*+</sst>')
_STRING = re.compile(r'<t(?: xml:space="preserve")?>([^<]*)')


def _strings(z: Archive) -> list[str]:
    """The shared strings, without phonetic readings."""
    found: list[str] = []
    if "xl/sharedStrings.xml" in z.names():
        data = z.read("xl/sharedStrings.xml")
        text = _cuttable(data)
        if text and _PLAIN_STRINGS.fullmatch(text):
            return [_unescaped(x) for x in _STRING.findall(text)]
        for e in _elements(data, _SI):
            if len(e) == 1 and e[0].tag == _TEXT and not len(e[0]):
                found.append(e[0].text or "")
                continue
            read = {t for r in e.iter(TAG + "rPh") for t in r.iter(_TEXT)}
            found.append("".join(t.text or "" for t in e.iter(_TEXT) if t not in read))
    return found


@functools.lru_cache(maxsize=64)
def _titles(data: bytes) -> list[tuple[str, str | None]]:
    return [(e.get("name", ""), e.get("{" + REL.strip() + "}id")) for e in _elements(data, TAG + "sheet")]


def _sheets(z: Archive) -> list[tuple[str, str]]:
    """(name, part) in the workbook's order."""
    to, found, held = _relations(z, "xl/_rels/workbook.xml.rels"), [], set(z.names())
    for title, ref in _titles(z.read("xl/workbook.xml")):
        target = to.get(ref, "")
        found.append((title, target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return [x for x in found if x[1] in held]


@functools.lru_cache(maxsize=1 << 15)
def _number(letters: str) -> int:
    n = 0
    for ch in letters:
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch.upper()) - 64
    return n


def _column(ref: str) -> int:
    return _number(ref.rstrip("0123456789"))


@functools.lru_cache(maxsize=2)
def _plain_cells(declared: bool) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The head of a plain row (its number), a plain cell (column, style, kind, formula, value or inline text), texts inside that. What they match is well-formed."""
    a = rf'(?: (?!r=)(?:{"x14ac:" if declared else ""})?\w+="[^"<&]*")*+'
    flat = r'<\w+(?: \w+="[^"<&]*")*+/>'
    text = rf'<t(?: xml:space="preserve")?>{_TEXT_RE}</t>'
    inline = rf"{text}|(?:<r>(?:<rPr>(?:{flat})*+</rPr>)?+{text}</r>)++"
    cell = rf'<c r="([A-Za-z]+)[0-9]+"(?: s="([0-9]+)")?(?: t="(\w+)")?(?:/>|>(?:(<f(?: \w+="[^"<&]*")*+(?:/>|>{_TEXT_RE}</f>))?+(?:<v>({_TEXT_RE})</v>)?+|<is>({inline})</is>)</c>)'
    return re.compile(rf'<row r="([0-9]+)"{a}>'), re.compile(cell), re.compile(r'<t(?: xml:space="preserve")?>([^<]*)</t>')


def _plain_rows(data: bytes) -> list[tuple[int, list[tuple]]] | None:
    """``_cells`` of a sheet of plain rows, which are cut out before the parser sees it; it is left with one empty row in their place."""
    text = _cuttable(data)
    root = text and re.match(r"(?:<\?xml[^>]*\?>)?\s*<\w+( [^<>]*)?>", text)
    if not root:
        return None
    head, cell, shown = _plain_cells(" xmlns:x14ac=" in (root[1] or ""))
    rows = []
    first = at = text.find("<row ")
    while at >= 0 and text.startswith("<row ", at):
        m = head.match(text, at)
        if m is None:
            return None
        number, at, cells = int(m[1]), m.end(), []
        while m := cell.match(text, at):
            letters, style, kind, formula, value, inline = m.groups()
            if inline is not None:
                value = "".join(shown.findall(inline))
            cells.append((_number(letters), kind or "n", int(style) if style else 0, _unescaped(value) if value else None, formula is not None))
            at = m.end()
        if not text.startswith("</row>", at):
            return None
        at += 6
        rows.append((number, cells))
    return rows if rows and _one_row(f'{text[:first]}<row {CUT}=""/>{text[at:]}') else None


@functools.lru_cache(maxsize=256)
def _one_row(left: str) -> bool:
    """Whether all rows were cut out. Sheets of one writer have the same rest, mostly."""
    return [CUT in e.attrib for e in _tree(left).iter(_ROW)] == [True]


def _cells(data: bytes) -> list[tuple[int, list[tuple]]]:
    """The rows of a sheet: number, cells (column, kind, style, text of the value, whether there is a formula)."""
    found = _plain_rows(data)
    if found is not None:
        return found
    found, row = [], 0
    for of in _elements(data, _ROW):
        row, col, cells = int(of.get("r", row + 1)), 0, []
        for e in of.iter(_CELL):
            a, value, formula = e.attrib, None, False
            ref = a.get("r")
            col = col + 1 if ref is None else _column(ref)
            for x in e.iter():
                if x.tag in _VALUES:
                    if x.text:
                        value = x.text if value is None else value + x.text
                elif x.tag == _FORMULA:
                    formula = True
            cells.append((col, a.get("t", "n"), int(a.get("s", 0)), value, formula))
        found.append((row, cells))
    return found


_ATTRIBUTES = rb"""[^<>"']*+(?:"[^"]*"[^<>"']*+|'[^']*'[^<>"']*+)*+"""
_ROOT = re.compile(rb"(?:\xef\xbb\xbf)?(?:<\?xml[^>]*\?>)?\s*<[^\s:<>/?!]+(?=\s)(" + _ATTRIBUTES + rb")>")
_ATTRIBUTE = re.compile(rb"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _attributes(found: bytes) -> dict[bytes, bytes]:
    return {k: a or b for k, a, b in _ATTRIBUTE.findall(found)}


_AT_CELL = re.compile(rb'<c r="([A-Za-z]+[0-9]+)"(?: s="([0-9]+)")?(?: t="\w+")?(?:/>|>[^<]*+(?:<(?!/c\s*>)[^<]*+)*+</c\s*>)')


def _ordinary_cells(data: bytes, wanted: Collection[tuple[int, int]]) -> list[dict] | None:
    """``_placed_cells`` of a sheet whose names without a prefix are the format's own, in which nothing but an element looks like one, and whose rows and
    cells begin with their numbers; else none."""
    root = _ROOT.match(data)
    if not root or data.count(b"xmlns") != root[0].count(b"xmlns") or _attributes(root[1]).get(b"xmlns") != S.strip().encode() or b"<!" in data or data.find(b"<?", root.start(1)) >= 0:
        return None
    if data.count(b"<row") != data.count(b'<row r="'):
        return None
    found = []
    for row, cols in groupby(sorted(wanted), key=lambda x: x[0]):
        name = b'<row r="%d"' % row
        at = data.find(name)
        to = data.find(b"</row>", at)
        if at < 0 or to < 0 or data.find(b"<row", at + 1, to) >= 0 or data.find(name, to) >= 0 or data.count(b"<c", at, to) != data.count(b'<c r="', at, to):
            return None
        for _, col in cols:
            name = b'<c r="%s%d"' % (_letters(col), row)
            m = _AT_CELL.match(data, i) if (i := data.find(name, at, to)) >= 0 else None
            if m is None or data.find(name, m.end(), to) >= 0:
                return None
            found.append({"row": row, "col": col, "ref": m[1].decode(), "s": int(m[2] or 0), "from": m.start(), "to": m.end(), "prefix": None})
    return found


@functools.lru_cache(maxsize=1 << 14)
def _letters(col: int) -> bytes:
    out = b""
    while col:
        col, rest = divmod(col - 1, 26)
        out = b"%c" % (65 + rest) + out
    return out


def _placed_cells(data: bytes, wanted: Collection[tuple[int, int]]) -> list[dict]:
    """Those of the cells of a sheet, which has been parsed before: row, column, reference, style, prefix of the name and the bytes they take up."""
    ordinary = _ordinary_cells(data, wanted)
    if ordinary is not None:
        return ordinary
    found: list[dict] = []
    at = {"row": 0, "col": 0}

    def start(tag: str, a: dict, byte: int) -> None:
        if tag == "row":
            at["row"], at["col"] = int(a.get("r", at["row"] + 1)), 0
        elif tag == "c":
            at["col"] = _column(a["r"]) if "r" in a else at["col"] + 1
            found.append({"row": at["row"], "col": at["col"], "ref": a.get("r"), "s": int(a.get("s", 0)), "from": byte})

    def end(tag: str, byte: int) -> None:
        if tag == "c":
            found[-1] |= {"to": byte, "prefix": re.match(rb"<(?:([^\s:/>]+):)?c\b", data[found[-1]["from"] : byte])[1]}

    _walk(data, S, start, end, placed=("c",))
    return [c for c in found if (c["row"], c["col"]) in wanted]


def _shown(kind: str, style: int, v: str | None, strings: list[str], dates: set[int]) -> str | None:
    """The value as text: numbers as Python writes them, dates as year-month-day and time."""
    if v is None:
        return None
    if kind == "s":
        return strings[int(v)]
    if kind == "b":
        return "True" if v.strip() == "1" else "False"
    if kind != "n":
        return v
    number = float(v) if "." in v or "e" in v or "E" in v else int(v)
    if style in dates:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86_400)))
    return str(number)


def _xlsx(z: Archive) -> Iterator[tuple]:
    strings, dates = _strings(z), _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in z.names() else set()
    for n, (title, part) in enumerate(_sheets(z)):
        widest, rows = 0, {}
        for r, cells in _cells(z.read(part)):
            by = rows.setdefault(r, {}) if cells else {}
            for c in cells:
                by[c[0]] = c
                widest = c[0] if c[0] > widest else widest
        if not rows:  # a sheet without cells is a sheet
            yield "cell", part, title, n, 0, 0, None, False
        for r, by in rows.items():
            for i in range(1, widest + 1):
                c = by.get(i)
                yield ("cell", part, title, n, r, i, None, False) if c is None else ("cell", part, title, n, r, i, _shown(c[1], c[2], c[3], strings, dates), c[4])


FIELDS = "part string, element_no long, para_no int, row_no long, col_no int, run_no int, from_row long, from_col int, ref string, text string, flag boolean, cells array<string>, rows array<array<string>>, error string, kind string"


@dataclass
class Office:
    """The tables of decoded files; each reads its own kinds only."""

    parts: DataFrame

    def _kind(self, kind: str, *columns) -> DataFrame:
        return self.parts.filter(F.col("kind") == kind).select("doc_id", *columns)

    @property
    def errors(self) -> DataFrame:
        """(doc_id, error) of files that can't be parsed; they have no other rows."""
        return self._kind("error", "error")

    @property
    def cells(self) -> DataFrame:
        """(doc_id, sheet, sheet_no, part, row_no, col_no, value, is_formula), gaps of a row as null cells."""
        c = F.col
        return self._kind("cell", c("ref").alias("sheet"), c("element_no").alias("sheet_no"), "part", "row_no", "col_no", c("text").alias("value"), c("flag").alias("is_formula"))

    @property
    def runs(self) -> DataFrame:
        """(doc_id, part, para_no, run_no, text, is_complex) of bodies, headers and footers."""
        return self._kind("run", "part", "para_no", "run_no", "text", F.col("flag").alias("is_complex"))

    @property
    def notes(self) -> DataFrame:
        """(doc_id, kind, note_no, block_no, para_no, cells), D8's rows."""
        return self._kind("note", F.col("text").alias("kind"), F.col("row_no").cast("int").alias("note_no"), F.lit(0).alias("block_no"), "para_no", "cells")

    def paragraph_texts(self) -> DataFrame:
        """(doc_id, para_no, element_no, row_no, col_no, hidden, text) of the bodies' paragraphs, links as anchors (D10), notes behind the text (D8, D9);
        only those with links or notes go through a join."""
        pieces = self._kind("piece", "para_no", "run_no", "text", F.col("ref").alias("rel_id"), F.col("flag").alias("is_link"))
        links = self._kind("link", F.col("ref").alias("rel_id"), F.col("text").alias("url"))
        shown = D.render_hyperlinks(pieces, links).groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("run_no", "text"))).alias("r"))
        shown = shown.select("doc_id", "para_no", F.array_join("r.text", "").alias("text"))
        every = self._kind("paragraph", "para_no", "element_no", "row_no", "col_no", F.col("flag").alias("hidden"), F.col("ref").isNotNull().alias("noted"), "text")
        linked = every.filter("text is null").drop("text").join(shown, ["doc_id", "para_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))
        rows = every.filter("text is not null").unionByName(linked)
        refs = self._kind("note_ref", "para_no", F.col("text").alias("kind"), F.col("run_no").alias("ref_no"), F.col("ref").alias("ref_id"))
        noted = D.inline_note_refs(rows.filter("noted"), refs, D.flatten_notes(self.notes))
        return rows.filter("not noted").withColumn("text", D.one_line(F.col("text"))).unionByName(noted).drop("noted")

    def table_rows(self, paragraphs: DataFrame) -> DataFrame:
        """(doc_id, element_no, row_no, cells): a merged cell's text stands in each of its places."""
        place = ["doc_id", "element_no", "row_no", "col_no"]
        inside = paragraphs.filter("row_no is not null").groupBy(*place, "hidden").agg(F.array_sort(F.collect_list(F.struct("para_no", "text"))).alias("p"))
        texts = inside.select(*place, "hidden", D.py_strip(F.array_join("p.text", " ")).alias("text"))
        of = texts.select("doc_id", "element_no", F.col("row_no").alias("from_row"), F.col("col_no").alias("from_col"), "text")
        merged = self._kind("grid", "element_no", "row_no", "col_no", "from_row", "from_col").join(of, ["doc_id", "element_no", "from_row", "from_col"], "left")
        every = texts.filter("not hidden").select(*place, "text").unionByName(merged.select(*place, "text"))
        rows = every.groupBy("doc_id", "element_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
        return rows.select("doc_id", "element_no", "row_no", F.col("c.text").alias("cells"))

    @property
    def plain_tables(self) -> DataFrame:
        """(doc_id, element_no, rows): the cells' texts of the tables that are rows of kind ``table``; ``table_rows`` has the others."""
        return self._kind("table", "element_no", "rows")

    def body_texts(self) -> DataFrame:
        """(doc_id, text): D7 of the decoded documents."""
        paragraphs = self.paragraph_texts()
        tables = D.table_texts(self.table_rows(paragraphs.filter("row_no is not null").repartition("doc_id")))  # whose steps are by document
        whole = self.plain_tables.filter("size(rows) > 0").select("doc_id", "element_no", D.table_text(F.transform("rows", D.table_line)).alias("text"))
        return D.join_elements(paragraphs.filter("row_no is null").select("doc_id", "element_no", "text").unionByName(tables).unionByName(whole))


#: the kinds of rows that a body's text needs
BODY = ("link", "paragraph", "piece", "note_ref", "grid", "note")
#: the same, where a table of plain cells is one row (``table``) and not one for each of its paragraphs
ELEMENTS = (*BODY, "table")
#: what a row of a kind holds, in order
_HOLDS = {"link": "ref text", "run": "part element_no para_no run_no text flag", "paragraph": "part element_no para_no row_no col_no ref text flag", "piece": "part element_no para_no run_no ref text flag",
          "note_ref": "part element_no para_no run_no ref text", "grid": "element_no row_no col_no from_row from_col", "note": "text row_no para_no cells", "table": "part element_no rows",
          "cell": "part ref element_no row_no col_no text flag", "error": "error"}


def decode(files: DataFrame, path: str | None = None, kinds: Collection[str] | None = None) -> Office:
    """``files(doc_id, file_type, content)``, each parsed once, as tables stored under ``path`` (a new folder in the shared one if there
    is none). A file that isn't what its name says is one row of ``errors``. ``kinds``: the kinds of rows that will be read (``BODY``, ``ELEMENTS``, ``run``,
    ``cell``; errors always are), if not all. Of a single kind without a ``path`` nothing is stored: its rows go on to the step that reads them."""
    spark = files.sparkSession
    schema = T.StructType([T.StructField("doc_id", files.schema["doc_id"].dataType), *T._parse_datatype_string(FIELDS).fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(schema)

        def made(kind: str, ids: list, rows: list[tuple]) -> pa.RecordBatch:
            of = {"doc_id": ids, "kind": [kind] * len(ids), **dict(zip(_HOLDS[kind].split(), list(zip(*rows))[1:], strict=True))}
            return pa.RecordBatch.from_arrays([pa.array(of[f.name], f.type) if f.name in of else pa.nulls(len(ids), f.type) for f in to], schema=to)

        held: dict[str, tuple[list, list]] = {}
        for batch in small(batches):
            for doc_id, kind, content in zip(*(plain(batch.column(c)) for c in range(3)), strict=True):
                try:
                    z = Archive(content or b"")
                    found = [x for x in (_docx(z, kinds) if kind == "docx" else _xlsx(z)) if kinds is None or x[0] in kinds]
                except (zipfile.BadZipFile, expat.ExpatError, KeyError, ValueError, IndexError) as e:
                    found = [("error", f"{type(e).__name__}: {e}")]
                for x in found:
                    if x[0] not in held:
                        held[x[0]] = [], []
                    ids, rows = held[x[0]]
                    ids.append(doc_id)
                    rows.append(x)
                    if len(ids) == 10_000:
                        yield made(x[0], *held.pop(x[0]))
            yield from (made(k, *x) for k, x in held.items())
            held.clear()

    rows = files.select("doc_id", "file_type", "content").mapInArrow(parse, schema)
    if path is None and kinds is not None and len(kinds) == 1:
        return Office(rows)
    into = path or work_dir(spark)
    rows.write.partitionBy("kind").parquet(into)
    return Office(spark.read.schema(schema).parquet(into))


# -- writing back ---------------------------------------------------------------


def _spliced(data: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for start, end, new in sorted(changes):
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def _new_run(data: bytes, run: dict, pieces: list[dict]) -> bytes:
    """A run for each piece, formatted as the old one, masks highlighted."""
    w = re.match(rb"<(?:([^\s:/>]+):)?r\b", data[run["from"] :])[1]
    p = w.decode() + ":" if w else ""
    own = data[slice(*run["rpr"])].decode() if run["rpr"] else ""
    inner = re.sub(r"^<[^>]*>|</[^>]*>$", "", own) if not own.endswith("/>") or own.count("<") > 1 else ""
    out = ""
    for x in pieces:
        marked = re.sub(rf"<{p}highlight\b[^>]*/>", "", inner) + f'<{p}highlight {p}val="yellow"/>' if x["is_mask"] else inner
        out += f'<{p}r><{p}rPr>{marked}</{p}rPr><{p}t xml:space="preserve">{escape(x["text"])}</{p}t></{p}r>'
    return out.encode()


def _masked_docx(z: Archive, changes: list[dict]) -> dict[str, bytes]:
    out = {}
    for part in {c["part"] for c in changes}:
        data, own = z.read(part), {(c["para_no"], c["run_no"]): c["fragments"] for c in changes if c["part"] == part}
        paragraphs = [p for p in Paragraphs(data, places=True).rows if p["part"] != "grid"]
        out[part] = _spliced(data, [(r["from"], r["to"], _new_run(data, r, own[i, j])) for i, p in enumerate(paragraphs) for j, r in enumerate(p["runs"]) if (i, j) in own])
    return out


def _new_cell(old: dict, fragments: list[dict], style: int, space: str) -> bytes:
    runs = "".join([f'<r>{MASK_FONT if x["is_mask"] else PLAIN_FONT}<t xml:space="preserve">{escape(x["text"])}</t></r>' for x in fragments])
    ref = f' r="{old["ref"]}"' if old["ref"] else ""
    return f'<c{space}{ref} s="{style}" t="inlineStr"><is>{runs}</is></c>'.encode()


def _masked_xlsx(z: Archive, changes: list[dict], highlight: bool) -> dict[str, bytes]:
    out, shaded, by_part = {}, {}, {}
    styles = z.read("xl/styles.xml") if "xl/styles.xml" in z.names() else None
    if highlight and styles is not None:
        styles, shaded = _shaded(styles)
    for c in changes:
        by_part.setdefault(c["part"], {})[c["row_no"], c["col_no"]] = c["fragments"]
    for part, own in by_part.items():
        data, edits = z.read(part), []
        for c in _placed_cells(data, own):
            space = f" xmlns={quoteattr(S.strip())}" if c["prefix"] else ""
            edits.append((c["from"], c["to"], _new_cell(c, own[c["row"], c["col"]], shaded.get(c["s"], c["s"]), space)))
        out[part] = _spliced(data, edits)
    return out | ({"xl/styles.xml": styles} if shaded else {})


@functools.lru_cache(maxsize=4)
def _shaded(styles: bytes) -> tuple[bytes, dict[int, int]]:
    """The styles with a shaded copy of each cell style, and the copies' numbers."""
    at, xfs, inside = {}, [], {"in": ""}

    def start(tag: str, a: dict, byte: int) -> None:
        if tag in ("fills", "cellXfs"):
            at[tag] = {"n": 0}
            inside["in"] = tag
        elif tag == "fill" and inside["in"] == "fills":
            at["fills"]["n"] += 1
        elif tag == "xf" and inside["in"] == "cellXfs":
            xfs.append([byte, 0])

    def end(tag: str, byte: int) -> None:
        if tag in at:
            at[tag]["to"] = byte
            inside["in"] = ""
        elif tag == "xf" and inside["in"] == "cellXfs":
            xfs[-1][1] = byte

    _walk(styles, S, start, end, placed=("fills", "cellXfs", "xf"))
    if "fills" not in at or not xfs or styles[xfs[0][0] : xfs[0][0] + 3] != b"<xf":
        return styles, {}
    copies = []
    for a, b in xfs:
        head, rest = re.match(rb"(<xf\b[^>]*?)(/?>.*)", styles[a:b], re.S).groups()
        head = re.sub(rb'\s(fillId|applyFill)="[^"]*"', b"", head)
        copies.append(head + b' fillId="%d" applyFill="1"' % at["fills"]["n"] + rest)
    tail = lambda x, name: styles.rindex(b"</" + name, 0, x["to"])
    fills, cells = tail(at["fills"], b"fills"), tail(at["cellXfs"], b"cellXfs")
    new = _spliced(styles, [(fills, fills, FILL.encode()), (cells, cells, b"".join(copies))])
    new = re.sub(rb'(<fills\b[^>]*?)\scount="\d+"', rb"\1", new, count=1)
    new = re.sub(rb'(<cellXfs\b[^>]*?)\scount="\d+"', rb"\1", new, count=1)
    return new, {i: i + len(xfs) for i in range(len(xfs))}


def masked_files(files: DataFrame, runs: DataFrame | None = None, cells: DataFrame | None = None, highlight_cells: bool = True) -> DataFrame:
    """``files(doc_id, filename, file_type, content)`` with ``masked``, the file with its masks: ``runs`` and ``cells`` are masked tables (M5, M7) of
    decoded files, of which only changed rows are used (``changed_cells`` has no others). Files without changes stay as they are, byte for byte; so does every part without any."""
    spark, schema = files.sparkSession, T.StructType([*files.schema.fields, T.StructField("masked", T.BinaryType())])
    key = ["part", "para_no", "run_no", "row_no", "col_no", "fragments"]
    kinds = "part string, para_no int, run_no int, row_no long, col_no int, fragments array<struct<text:string,is_mask:boolean>>"
    none = spark.createDataFrame([], f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {kinds}")
    for rows in (runs, cells):
        if rows is not None:
            none = none.unionByName(rows.filter("size(fragments) > 0" if "spans" not in rows.columns else "size(spans) > 0").select("doc_id", *[c for c in key if c in rows.columns]), allowMissingColumns=True)
    columns = files.columns
    changed = none.groupBy("doc_id").agg(F.collect_list(F.struct(*key)).alias("_changes"))  # as many as the file itself has at most

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for kind, content, own in zip(*(plain(batch.column(c)) for c in ("file_type", "content", "_changes")), strict=True):
                if own:
                    z = Archive(content)
                    content = z.with_parts(_masked_docx(z, own) if kind == "docx" else _masked_xlsx(z, own, highlight_cells))
                out.append(content)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, pa.binary())], names=[*columns, "masked"])

    return files.join(changed, "doc_id", "left").select(*columns, "_changes").mapInArrow(write, schema)
