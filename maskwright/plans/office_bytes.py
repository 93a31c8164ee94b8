"""Small .docx and .xlsx files made of rows: the inputs of the queries and tests that read such files."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from ..sources import archive

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S_ONLY = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = (
    f'<styleSheet {S}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills>'
    '<cellXfs count="2"><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="164" fontId="0" fillId="0" applyNumberFormat="1"/></cellXfs><dxfs count="1"><dxf><fill/></dxf></dxfs></styleSheet>'
)


def zipped(parts: dict[str, str]) -> bytes:
    return archive.zipped({name: text.encode() for name, text in parts.items()})


def relations(pairs: Iterable[tuple[str, str]], kind: str = "x") -> str:
    items = "".join(f'<Relationship Id="{i}" Type="{KIND}/{kind}" Target={quoteattr(t)}/>' for i, t in pairs)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{items}</Relationships>'


def run(text: str, rpr: str = "", extra: str = "") -> str:
    return f'<w:r>{rpr}{extra}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def paragraph(inner: str) -> str:
    return f"<w:p>{inner}</w:p>"


def table(rows: Iterable[Iterable[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(run(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(body: str, links: Iterable[tuple[str, str]] = (), **parts: str) -> bytes:
    """parts: header1="...", footnotes="...": the inner markup of further parts."""
    roots = {"header": "hdr", "footer": "ftr", "footnotes": "footnotes", "endnotes": "endnotes"}
    more = {f"word/{n}.xml": f"<w:{(t := roots[n.rstrip('0123456789')])} {W}>{x}</w:{t}>" for n, x in parts.items()}
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": relations(links, "hyperlink")} | more)


@functools.lru_cache(maxsize=1 << 14)
def letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell(r: int, c: int, kind: str, value: str | None, style: int = 0) -> str:
    """kind ``s`` names a shared string by number, ``f`` is a formula and its value."""
    of = f' r="{letters(c)}{r}" s="{style}"'
    if kind == "f":
        return f'<c{of} t="str"><f>A1</f><v>{escape(value)}</v></c>'
    if kind == "inlineStr":
        return f'<c{of} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f'<c{of} t="{kind}"><v>{escape(value)}</v></c>' if value is not None else f"<c{of}/>"


def workbook(sheets: dict[str, list[tuple[int, str]]], strings: list[str]) -> bytes:
    """sheets: name -> rows in order, a number and the cells."""
    data = {
        f"xl/worksheets/sheet{n}.xml": f"<worksheet {S}><sheetData>" + "".join([f'<row r="{r}">{cells}</row>' for r, cells in rows]) + "</sheetData></worksheet>" for n, rows in enumerate(sheets.values(), 1)
    }
    names = "".join(f'<sheet name={quoteattr(t)} sheetId="{n}" r:id="rId{n}"/>' for n, t in enumerate(sheets, 1))
    shared = '</t></si><si><t xml:space="preserve">'.join([escape(x) for x in strings])
    shared = f'<sst {S_ONLY}><si><t xml:space="preserve">{shared}</t></si></sst>' if strings else f"<sst {S_ONLY}></sst>"
    return zipped({
        "xl/workbook.xml": f"<workbook {S}><sheets>{names}</sheets></workbook>", "xl/sharedStrings.xml": shared, "xl/styles.xml": STYLES,
        "xl/_rels/workbook.xml.rels": relations(((f"rId{n}", f"worksheets/sheet{n}.xml") for n in range(1, len(sheets) + 1)), "worksheet"), **data,
    })


def xlsx(sheets: dict[str, dict[int, dict[int, tuple[str, str, int]]]], strings: list[str] | None = None) -> bytes:
    """sheets: name -> row -> column -> (kind, value, style)."""
    return workbook({t: [(r, "".join([cell(r, c, *x) for c, x in sorted(by.items())])) for r, by in sorted(rows.items())] for t, rows in sheets.items()}, strings or [])
