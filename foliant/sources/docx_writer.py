"""A writer of plain DOCX packages, for queries that make their own input."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = "".join(f'<w:style w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/><w:sz w:val="{36 - 4 * n}"/></w:rPr></w:style>' for n in (1, 2, 3))


STYLES += "".join(f'<w:style w:styleId="{name}"><w:name w:val="{name}"/></w:style>' for name in ("Title", "Caption"))
LEVELS = "".join(f'<w:abstractNum w:abstractNumId="{n}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{form}"/></w:lvl>' for k in range(3)) + "</w:abstractNum>" for n, form in ((1, "bullet"), (2, "decimal")))
#: Numberings that paragraphs can name: 1 is a list with bullets, 2 one with numbers.
NUMBERING = LEVELS + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in (1, 2))


def paragraph(text: str, style: str | None = None, bold: bool = False, size: float | None = None, num: int | None = None, level: int = 0, note: int | None = None) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    run = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{round(2 * size)}"/>' if size else "")
    reference = f'<w:r><w:footnoteReference w:id="{note}"/></w:r>' if note else ""
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:rPr>{run}</w:rPr><w:t>{escape(text)}</w:t></w:r>{reference}</w:p>"


def cell(content: str | tuple[str, int] | None) -> str:
    """A cell: its text, text and the columns that it spans, or None where the cell above goes on."""
    if content is None:
        return "<w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc>"
    if isinstance(content, tuple):
        return f'<w:tc><w:tcPr><w:gridSpan w:val="{content[1]}"/></w:tcPr>{paragraph(content[0])}</w:tc>'
    return f"<w:tc>{paragraph(content)}</w:tc>"


def cell_table(rows: list[list], header: bool = False) -> str:
    mark = '<w:trPr><w:tblHeader/></w:trPr>' if header else ""
    made = ["".join(map(cell, row)) for row in rows]
    return "<w:tbl>" + "".join(f"<w:tr>{mark if k == 0 else ''}{row}</w:tr>" for k, row in enumerate(made)) + "</w:tbl>"


def package(body: list[str], title: str | None = None, notes: dict[int, str] | None = None) -> bytes:
    parts = {"document": f"<w:document {SPACE}><w:body>{''.join(body)}</w:body></w:document>", "styles": f"<w:styles {SPACE}>{STYLES}</w:styles>", "numbering": f"<w:numbering {SPACE}>{NUMBERING}</w:numbering>"}
    if notes:
        told = "".join(f'<w:footnote w:id="{n}">{paragraph(text)}</w:footnote>' for n, text in notes.items())
        parts["footnotes"] = f"<w:footnotes {SPACE}>{told}</w:footnotes>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in parts.items():
            archive.writestr(f"word/{name}.xml", xml)
        if title:
            archive.writestr("docProps/core.xml", f'<c:p xmlns:c="core" xmlns:dc="dc"><dc:title>{escape(title)}</dc:title></c:p>')
    return out.getvalue()
