"""DOCX files to blocks: a decoder over the binary file source, and a plan over its rows.

The decoder reads one package at a time with the standard library and gives a row
for each paragraph and table of the body, in order, with the styles, numbering and
notes of the package resolved. What kind of block each becomes is decided by
DataFrame operations over all packages at once. A package that can't be read
gives one row with its error."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout, tables
from ..options import Options

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = (
    "doc_id string, pos int, kind string, style string, outline int, num_id string, ilvl int, format string, size double, bold boolean, text string, "
    "rows array<array<string>>, bolds array<double>, explicit_header boolean, notes array<struct<marker:string,text:string>>, error string"
)
#: The mark that some producers write at the start of a note's text.
NOTE_MARK = r"^[\d*†‡§¶]{1,3}[.)]?\s*"
#: Heading styles by name in several languages, with the level behind the word.
HEADING_STYLE = r"^(?:heading|überschrift|titre|título|titulo|kop|rubrik|otsikko)\s*(\d)"


def sniff(head: bytes, names: list[str] | None = None) -> str:
    """pdf, docx, zip or unknown, by the first bytes and, of an archive, its members."""
    if b"%PDF" in head[:2048]:
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        return "docx" if names is not None and "word/document.xml" in names else "zip"
    return "unknown"


class Package:
    """The parts of one package, and its body as rows."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.warnings: list[str] = []
        self.styles, self.default_size = self.read_styles()
        self.formats = self.read_numbering()
        self.notes = {kind: self.read_notes(kind) for kind in ("footnote", "endnote")}
        self.cited: dict[tuple[str, str], int] = {}

    def part(self, name: str):
        try:
            return ElementTree.fromstring(self.zip.read(f"word/{name}.xml"))
        except KeyError:
            return None

    def side_part(self, name: str, what: str):
        """A part that a document can do without: if it can't be read, that is told and it counts as missing."""
        try:
            return self.part(name)
        except (ElementTree.ParseError, zipfile.BadZipFile, ValueError) as error:
            self.warnings.append(f"could not read {what} part: {error}")
            return None

    @staticmethod
    def value(parent, path: str) -> str | None:
        found = parent.find("/".join(W + p for p in path.split("/"))) if parent is not None else None
        return None if found is None else found.get(f"{W}val", "")

    def flag(self, parent, name: str) -> bool | None:
        v = self.value(parent, name)
        return None if v is None else v.lower() not in ("0", "false", "off")

    def half_points(self, parent) -> float | None:
        v = self.value(parent, "sz") or ""
        return int(v) / 2 or None if v.isdigit() else None

    def read_styles(self) -> tuple[dict, float]:
        root, raw = self.side_part("styles", "styles"), {}
        default = self.half_points(root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")) if root is not None else None
        for s in root.iter(f"{W}style") if root is not None else ():
            run, outline = s.find(f"{W}rPr"), self.value(s, "pPr/outlineLvl") or ""
            raw[s.get(f"{W}styleId", "")] = (self.value(s, "name"), self.half_points(run), self.flag(run, "b"), int(outline) if outline.isdigit() else None, self.value(s, "basedOn"))
        done = {}
        for key, (name, *_) in raw.items():
            chain, at = [], key
            while at in raw and at not in chain:
                chain.append(at)
                at = raw[at][4]
            done[key] = (name or key, *(next((raw[c][k] for c in chain if raw[c][k] is not None), None) for k in (1, 2, 3)))
        return done, default or 11.0

    def read_numbering(self) -> dict[tuple[str, int], str]:
        root = self.side_part("numbering", "numbering")
        if root is None:
            return {}
        levels = {(a.get(f"{W}abstractNumId"), int(v.get(f"{W}ilvl", "0"))): self.value(v, "numFmt") or "" for a in root.iter(f"{W}abstractNum") for v in a.iter(f"{W}lvl")}
        found = {(n.get(f"{W}numId"), lv): f for n in root.iter(f"{W}num") for (a, lv), f in levels.items() if a == self.value(n, "abstractNumId")}
        if levels and not found:
            self.warnings.append("numbering.xml defined no usable list levels")
        return found

    def read_notes(self, kind: str) -> dict[str, str]:
        root = self.side_part(f"{kind}s", "notes")
        found = {}
        for n in root.iter(f"{W}{kind}") if root is not None else ():
            if n.get(f"{W}type") not in ("separator", "continuationSeparator", "continuationNotice"):
                text = " ".join(" ".join(t.text or "" for t in n.iter(f"{W}t")).split())
                found[n.get(f"{W}id", "")] = re.sub(NOTE_MARK, "", text)
        return found

    def run_text(self, run) -> str:
        out = []
        for x in run:
            tag = x.tag.removeprefix(W)
            if tag == "t":
                out.append(x.text or "")
            elif tag in ("tab", "br", "cr"):
                out.append(" ")
            elif tag in ("footnoteReference", "endnoteReference"):
                key = tag.removesuffix("Reference"), x.get(f"{W}id", "")
                if key[1] in self.notes[key[0]]:
                    out.append(f"[^{self.cited.setdefault(key, len(self.cited) + 1)}]")
        return "".join(out)

    def paragraph(self, p) -> dict:
        props = p.find(f"{W}pPr")
        style = self.styles.get(self.value(props, "pStyle") or "", (self.value(props, "pStyle"), None, None, None))
        weights: dict[float, int] = {}
        bold = total = 0
        text = ""
        for run in p.iter(f"{W}r"):
            piece = self.run_text(run)
            text += piece
            n = len(piece.strip())
            own = run.find(f"{W}rPr")
            size = self.half_points(own) or style[1] or self.default_size
            weights[size] = weights.get(size, 0) + n
            flag = self.flag(own, "b")
            bold, total = bold + n * bool(style[2] if flag is None else flag), total + n
        outline, num, level = self.value(props, "outlineLvl") or "", self.value(props, "numPr/numId"), self.value(props, "numPr/ilvl") or "0"
        level = int(level) if level.isdigit() else 0
        num = None if num in (None, "0") else num
        return {
            "kind": "p", "style": style[0], "outline": int(outline) if outline.isdigit() else style[3], "num_id": num, "ilvl": level, "format": self.formats.get((num, level)),
            "size": max(weights, key=lambda s: (weights[s], s)) if weights else style[1] or self.default_size, "bold": bold >= 0.6 * total if total else bool(style[2]), "text": text,
        }

    def table(self, t) -> dict:
        rows, bolds, header = [], [], False
        for k, tr in enumerate(t.findall(f"{W}tr")):
            header |= k == 0 and self.flag(tr.find(f"{W}trPr"), "tblHeader") is True
            cells, heavy, total = [], 0, 0
            for tc in tr.findall(f"{W}tc"):
                props = tc.find(f"{W}tcPr")
                merged = props.find(f"{W}vMerge") if props is not None else None
                goes_on = merged is not None and merged.get(f"{W}val", "continue") != "restart"
                cells.append("" if goes_on else " ".join(" ".join(x.text or "" for x in tc.iter(f"{W}t")).split()))
                for run in tc.iter(f"{W}r"):
                    n = len("".join(x.text or "" for x in run.iter(f"{W}t")))
                    heavy, total = heavy + n * (self.flag(run.find(f"{W}rPr"), "b") is True), total + n
                span = self.value(props, "gridSpan") or "1"
                cells += [""] * ((int(span) if span.isdigit() else 1) - 1)
            rows.append(cells)
            bolds.append(heavy / total if total else 0.0)
        return {"kind": "tbl", "rows": rows, "bolds": bolds, "explicit_header": header}

    def body(self) -> list[dict]:
        root = self.part("document")
        found = []
        for x in root.find(f"{W}body") if root is not None else ():
            if x.tag == f"{W}p":
                found.append(self.paragraph(x))
            elif x.tag == f"{W}tbl":
                found.append(self.table(x))
        notes = [{"marker": str(n), "text": self.notes[kind][key]} for (kind, key), n in self.cited.items()]
        return [r | {"pos": k, "notes": notes} for k, r in enumerate(found)]


    def about(self) -> dict:
        """Title, author and last editor, and what went wrong in side parts, as a row of kind ``about``."""
        found = {}
        if "docProps/core.xml" in self.zip.namelist():
            for x in ElementTree.fromstring(self.zip.read("docProps/core.xml")):
                found[x.tag.rpartition("}")[2]] = (x.text or "").strip() or None
        return {"pos": -2, "kind": "about", "rows": [[found.get(k) for k in ("title", "creator", "lastModifiedBy")], self.warnings]}


def decode(files: DataFrame) -> DataFrame:
    """Body rows of packages from ``doc_id, content``, and a row of kind ``about`` for each package."""
    columns = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    package = Package(bytes(content))
                    rows = [package.about(), *package.body()]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError) as error:
                    rows = [{"pos": -1, "error": f"{type(error).__name__}: {error}"}]
                frame = pd.DataFrame([{c: None for c in columns} | r | {"doc_id": doc_id} for r in rows], columns=columns)
                for c in ("pos", "outline", "ilvl"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    return files.select("doc_id", "content").mapInPandas(run, SCHEMA)


def blocks_of(rows: DataFrame, options: Options | None = None) -> DataFrame:
    """Typed blocks with ``order``, from body rows of any number of packages."""
    options = options or Options()
    c, style = F.col, F.lower(F.coalesce("style", F.lit("")))
    rows = rows.where("error IS NULL AND kind != 'about'").withColumn("text", T.collapse_spaces(T.normalize_unicode(F.coalesce("text", F.lit("")))))
    rows = rows.where((c("kind") == "tbl") | (c("text") != ""))
    named = F.regexp_extract(style, HEADING_STYLE, 1)
    authority = F.when(named != "", named.try_cast("int")).when(style.isin("title", "titel"), 1).when(style.isin("subtitle", "untertitel"), 2).when(c("outline") <= 8, c("outline") + 1)
    rows = rows.withColumn("authority", F.when(c("kind") == "p", authority)).withColumn("is_item", (c("kind") == "p") & (c("num_id").isNotNull() | (style.contains("list") & T.list_marker(c("text")).isNotNull())))
    doc = Window.partitionBy("doc_id")
    lines = rows.where("kind = 'p'").select("doc_id", c("pos").alias("seq"), F.lit(None).cast("int").alias("page"), "text", "size", "bold", c("is_item").alias("listed"))
    bodies = layout.body_sizes(lines, 0, spaces=True, default=11.0)
    guessed = layout.heading_model(lines, bodies, options, numbers=False)
    rows = rows.join(bodies.hint("merge"), "doc_id", "left").join(guessed.select("doc_id", c("seq").alias("pos"), c("level").alias("guess")).hint("merge"), ["doc_id", "pos"], "left")
    known = F.max(c("authority").isNotNull()).over(doc)
    level = F.when(known, c("authority")).when(~c("is_item"), c("guess")) if options.detect_headings else F.lit(None).cast("int")
    rows = rows.withColumn("level", F.when(~c("is_item"), level))
    rows = rows.withColumn("level", F.when(c("level") > options.max_heading_level, options.max_heading_level).otherwise(c("level")))
    # Neighbouring items of one numbering make a list: a new one starts wherever either changes.
    along = doc.orderBy("pos")
    item = c("is_item") & c("level").isNull()
    same = item & F.lag(item).over(along) & F.lag("num_id").over(along).eqNullSafe(c("num_id"))
    rows = rows.withColumn("item", item).withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("unit", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    marker = T.list_marker(c("text"))
    typed = c("num_id").isNull()
    entry = F.struct(
        c("pos"), F.when(typed, marker.getField("rest")).otherwise(c("text")).alias("text"), F.least(F.coalesce("ilvl", F.lit(0)), F.lit(8)).alias("level"),
        F.when(typed, marker.getField("marker")).otherwise("-").alias("marker"), F.when(typed, marker.getField("ordered")).otherwise(~F.coalesce("format", F.lit("bullet")).isin("bullet", "none")).alias("ordered"),
    )
    first = lambda name: F.min_by(name, "pos").alias(name)
    units = rows.groupBy("doc_id", "unit").agg(
        F.min("pos").alias("pos"), first("kind"), first("level"), first("text"), first("rows"), first("bolds"), first("explicit_header"), first("notes"), first("item"), first("style"), first("size"), first("bold"), first("body"),
        F.array_sort(F.collect_list(F.when(c("item"), entry))).alias("items"),
    )
    caption = T.caption_label(c("text"))
    kind = F.when(c("kind") == "tbl", "table").when(c("item"), "list").when(c("level").isNotNull(), "heading").when(caption.isNotNull() | F.lower(F.coalesce("style", F.lit(""))).startswith("caption"), "caption").otherwise("paragraph")
    grid = tables.padded(F.transform(c("rows"), lambda r: F.transform(r, T.strip)))
    units = units.withColumn("type", kind).withColumn("rows", F.when(c("kind") == "tbl", grid))
    units = units.where((c("type") != "table") | F.exists(F.flatten("rows"), lambda x: x != ""))
    if options.normalize_heading_levels:
        rank = F.dense_rank().over(Window.partitionBy("doc_id", c("level").isNull()).orderBy("level"))
        units = units.withColumn("level", F.when(c("type") == "heading", rank))
    listed = F.array_join(F.transform("items", lambda x: F.concat(F.repeat(F.lit("  "), x.getField("level")), F.when(x.getField("ordered"), "1. ").otherwise("- "), x.getField("text"))), "\n")
    text = F.when(c("type") == "list", listed).when(c("type") == "table", F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")).otherwise(c("text"))
    marks = F.regexp_extract_all(F.col("text"), F.lit(r"\[\^([^\]]{1,3})\]"), F.lit(1))
    look = F.struct("size", F.round(c("size") / c("body"), 3).alias("size_ratio"), c("bold").cast("double").alias("bold_ratio"), F.lit(0.0).alias("italic_ratio"), F.lit(None).cast("string").alias("font"))
    return units.withColumn("text", text).select(
        "doc_id", (F.row_number().over(doc.orderBy("pos")) - 1).alias("order"), "type", "level", "text", "rows", caption.alias("caption"),
        F.when(c("type") == "table", F.coalesce("explicit_header", F.lit(False)) | tables.looks_like_header(c("rows"), c("bolds"))).alias("has_header"),
        F.when(c("type") == "table", F.lit(True)).alias("ruled"), F.when(c("type") != "table", look).alias("style"), F.when(c("type") != "table", c("style")).alias("source_style"),
        F.when(c("type") == "list", c("items")).alias("items"), F.filter("notes", lambda n: F.array_contains(marks, n.getField("marker"))).alias("notes"),
    )


def read(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """Blocks of all DOCX files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").endswith(".docx")).select(F.col("path").alias("doc_id"), "content")
    return blocks_of(decode(files), options)
