"""The Python and command-line entry points, evaluation and the stream over a folder."""

import io
import json

import pytest

import foliant
from foliant import cli, evaluation
from foliant.plans import evaluate
from foliant.streaming import folder
from foliant.sources.docx_writer import cell_table, package, paragraph
from tests.test_pdf import paged, report, ruled


def test_formats_by_content():
    assert foliant.detect_format(report()) == "pdf" and foliant.detect_format(io.BytesIO(report())) == "pdf"
    for data in (b"plain words", b"PK\x03\x04 no archive"):
        with pytest.raises(foliant.UnsupportedFormatError):
            foliant.detect_format(data)
    with pytest.raises(FileNotFoundError):
        foliant.detect_format("/nowhere/x.pdf")
    with pytest.raises(TypeError):
        foliant.parse(report(), no_such_option=1)
    with pytest.raises(ValueError):
        foliant.parse(report(), table_mode="other")
    with pytest.raises(foliant.ParseError):
        foliant.parse_bytes(b"nothing", format=".PDF")


def test_document(spark):
    doc = foliant.parse(ruled(), table_mode="csv", options=foliant.Options(table_mode="html", keep_headers=True))
    assert doc.corpus.options.keep_headers and "```csv" in doc.markdown and "<th>Station</th>" in doc.render(foliant.Options(table_mode="html"))
    assert doc.outline() == [(1, "Results")] and len(doc.tables()) == 1 and len(doc) == 3 and "Station\tRainfall" in doc.text
    told = json.loads(doc.to_json())
    assert told["source"]["format"] == "pdf" and [b["markdown"] for b in told["blocks"]] == [b.markdown for b in doc]
    (grid,), block = doc.tables(), next(b for b in doc if b.type == "table")
    assert grid.header[0] == "Station" and grid.n_rows == len(grid.all_rows()) and grid.n_cols == len(grid.header)
    assert block.markdown.startswith("| Station |") and "<table>" in block.render(foliant.Options(table_mode="html")) and block.to_dict()["type"] == "table"
    assert doc.headings()[0].is_bold and not doc.headings()[0].is_italic and repr(doc.headings()[0]) == "Block(heading 1, 'Results')"
    with pytest.raises(AttributeError):
        block.no_such_field  # noqa: B018


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(report())
    assert cli.main([str(tmp_path / "a.pdf"), "--stats"]) == 0
    out = capsys.readouterr()
    assert out.out.startswith("# Quarterly Report\n") and "heading=2, paragraph=2" in out.err
    assert cli.main([str(tmp_path / "a.pdf"), "--pages", "1-1", "--json", "-o", str(tmp_path / "a.json")]) == 0
    assert json.loads((tmp_path / "a.json").read_text())["blocks"][0]["type"] == "heading"
    assert cli.main([str(tmp_path / "none.pdf")]) == 1 and cli.main([str(tmp_path)]) == 1
    assert cli.main([str(tmp_path), "-o", str(tmp_path / "table")]) == 0
    assert spark.read.parquet(str(tmp_path / "table")).first()["markdown"].startswith("# Quarterly")
    with pytest.raises(SystemExit):
        cli.main(["x", "--pages", "a-b"])


def test_evaluation(spark):
    files = spark.createDataFrame([("a", bytearray(paged())), ("b", bytearray(ruled()))], "doc_id string, content binary")
    rows = {r["doc_id"]: r for r in evaluate.measured(files).collect()}
    assert rows["a"]["headings"] == 3 and rows["a"]["footnotes"] == 3 and rows["b"]["tables"] == 1
    assert rows["a"]["content_kept"] >= 0.9 and rows["b"]["content_kept"] == 1.0


def test_evaluation_command(spark, tmp_path, capsys):
    words = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {"?": 0}, "unk_token": "?"}}
    (tmp_path / "words.json").write_text(json.dumps(words))
    assert evaluation.main(["--check-content", "--json", str(tmp_path / "rows"), "--encoding", str(tmp_path / "words.json")], spark) == 0
    rows = {r["doc_id"]: r for r in map(json.loads, (tmp_path / "rows").read_text().splitlines())}
    counts = {name: tuple(r[c] for c in evaluation.COUNTS) for name, r in rows.items()}
    assert counts == {"season_report.pdf": (12, 6, 0, 6), "tide_paper.pdf": (5, 0, 0, 0), "keys_memo.docx": (4, 1, 2, 1), "spring_report.pdf": (4, 2, 0, 2)}
    assert "| **Total / median** |" in capsys.readouterr().out and min(r["content_kept"] for r in rows.values()) >= 0.9
    assert rows["keys_memo.docx"]["baseline_tokens"] == 64  # words of its paragraphs, counted by hand
    assert evaluation.main(["--docs", str(tmp_path / "none")], spark) == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, data in enumerate((report(), b"other")):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(data)
    for _ in range(2):
        folder.stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    blocks = spark.read.parquet(str(tmp_path / "out" / "blocks"))
    assert blocks.count() == 4 and spark.read.parquet(str(tmp_path / "out" / "documents")).where("error IS NOT NULL").count() == 1


def test_package(spark):
    doc = foliant.parse(package([paragraph("Scope", "Heading1"), paragraph("Body text."), cell_table([["a", "1"]])], title="Memo"))
    assert doc.source["title"] == "Memo" and doc.source["format"] == "docx" and doc.outline() == [(1, "Scope")]
    heading, body, table = doc.blocks
    assert heading["style"]["bold_ratio"] == 1.0 and heading["source_style"] == "heading 1" and body["style"]["size_ratio"] == 1.0 and table["ruled"]
    with pytest.raises(foliant.ParseError):
        foliant.parse_bytes(b"no archive", format="docx")
