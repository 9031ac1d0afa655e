"""A writer of plain PDF files, for tests and for queries that make their own input."""

from __future__ import annotations

import zlib

FACES = ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique")


def text(x: float, y: float, content: str, size: float = 11.0, bold: bool = False, italic: bool = False) -> str:
    """A string whose base line is ``y`` points below the top of a page 792 high."""
    safe = content.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT /F{bold + 2 * italic} {size:g} Tf 1 0 0 1 {x:g} {792 - y:g} Tm ({safe}) Tj ET"


def rule(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"0.7 w {x0:g} {792 - y0:g} m {x1:g} {792 - y1:g} l S"


def grid(xs: list[float], ys: list[float]) -> str:
    return "\n".join([rule(x, ys[0], x, ys[-1]) for x in xs] + [rule(xs[0], y, xs[-1], y) for y in ys])


def write(pages: list[list[str]], title: str | None = None, compress: bool = False) -> bytes:
    """A file of pages, each a list of drawing commands."""
    fonts = " ".join(f"/F{k} << /Type /Font /Subtype /Type1 /BaseFont /{face} /Encoding /WinAnsiEncoding >>" for k, face in enumerate(FACES))
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    info = f"<< /Title ({title}) >>" if title else "<< >>"
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 612 792] /Resources << /Font << {fonts} >> >> >>".encode(), info.encode("latin-1")]
    for k, commands in enumerate(pages):
        stream = "\n".join(commands).encode("cp1252", "replace")
        stream = zlib.compress(stream) if compress else stream
        bodies.append(f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * k} 0 R >>".encode())
        bodies.append(f"<< /Length {len(stream)}{' /Filter /FlateDecode' if compress else ''} >>\nstream\n".encode() + stream + b"\nendstream")
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{at:010d} 00000 n \n" for at in offsets)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R /Info 3 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    return bytes(out)
