"""A small corpus to evaluate conversion on: two reports, a paper in two columns and a memo."""

from __future__ import annotations

from .docx_writer import cell_table, package, paragraph
from .pdf_writer import grid, text, write

PROSE = (
    "The ferries carried more passengers than in any spring before, and the two",
    "new landing stages let them turn around in under nine minutes each time.",
    "Crews were trained on shore during the weeks when the river was frozen over",
    "so that no departure had to be called off once the ice had gone at last.",
    "Fares stayed where they were, while fuel became cheaper towards the summer",
    "and the workshop needed fewer spare parts than the plan had set aside.",
    "For the coming season the office expects quieter weekdays and full weekends",
    "because the bridge upstream will open again before the holidays begin.",
)
LEFT = (
    "Tide gauges along the estuary were read",
    "every ten minutes over a whole year, and",
    "their clocks were set by radio each night.",
    "Gaps of under an hour were filled from the",
    "nearest gauge, longer ones were left open",
    "and are marked in every later figure.",
    "Storm days were kept in the series since",
    "they are what harbour masters ask about.",
)
RIGHT = (
    "A harmonic model with thirty terms explains",
    "most of the signal at the outer stations but",
    "falls short where the channel narrows. Adding",
    "the river's discharge as a second input brings",
    "errors there down to those of the open coast,",
    "which no choice of further terms could do.",
    "Code and readings are published together",
    "under a licence that permits their reuse.",
)


def report(pages: int) -> bytes:
    """Pages with a running header, two headings, a cited note, a ruled table with its caption, a word broken at a line end, and a page number."""
    made = []
    for n in range(1, pages + 1):
        turn = n % len(PROSE)
        lines = PROSE[turn:] + PROSE[:turn]
        page = [text(72, 42, "River Ferry Office - Report on the Season", 8), text(72, 96, f"{n}. Traffic on Line {n}", 15, True)]
        page += [text(72, 130 + 14 * k, line, 10.5) for k, line in enumerate(lines)]
        page += [text(470, 154.5, "1", 6.5), text(72, 268, f"{n}.1 Counts at the Piers", 12, True)]
        xs, ys = [72.0, 240.0, 360.0, 470.0], [288.0 + 20 * k for k in range(5)]
        rows = [("Pier", "Boardings", "Share"), ("North Quay", f"{3100 + 17 * n:,}", "41.2%"), ("Old Mill", f"{2290 + 11 * n:,}", "30.5%"), ("Castle", f"{2120 + 5 * n:,}", "28.3%")]
        page += [grid(xs, ys), *(text(xs[c] + 6, ys[r] + 14, cell, 9.5, r == 0) for r, row in enumerate(rows) for c, cell in enumerate(row))]
        page += [text(72, 408, f"Table {n}. Boardings by pier on line {n}.", 8.5), text(72, 438, "Waiting rooms were painted and the tim-", 10.5), text(72, 452, "ber of the oldest pontoon was replaced.", 10.5)]
        page += [text(72, 706, "1  Without the days on which the river was closed.", 7.5), text(300, 752, f"Page {n} of {pages}", 8)]
        made.append(page)
    return write(made)


def paper(pages: int = 4) -> bytes:
    made = []
    for n in range(1, pages + 1):
        start = 160.0 if n == 1 else 96.0
        page = [text(60, 40, "Working paper, not reviewed", 7.5)]
        if n == 1:
            page += [text(60, 92, "Predicting Water Levels in", 17, True), text(60, 118, "Narrow Tidal Channels", 17, True)]
        page.append(text(60, start, f"{n}. Readings", 12, True))
        page += [text(x, start + 26 + 13 * k, line, 9.5) for k, pair in enumerate(zip(LEFT, RIGHT, strict=True)) for x, line in zip((60, 320), pair, strict=True)]
        made.append([*page, text(300, 756, str(n), 8)])
    return write(made)


def memo() -> bytes:
    body = [
        paragraph("Notice to All Keepers", "Title"), paragraph("Reason", "Heading1"), paragraph("Keys to the boat sheds will be numbered anew after the loss of two of them.", note=2),
        paragraph("Sheds Concerned", "Heading2"), *(paragraph(t, num=1) for t in ("All sheds on the north bank", "The paint store behind the mill", "None of the ticket offices")),
        paragraph("Steps", "Heading2"), *(paragraph(t, num=2) for t in ("Hand in the old keys", "Sign for the new ones", "Write the number on the board")),
        cell_table([["Shed", "Old", "New"], ["Mill", "A4", "17"], ["Quay", "A9", "18"], ["Castle", "B1", "19"]], header=True), paragraph("Table 1. Numbers of keys by shed.", "Caption"),
    ]
    return package(body, notes={2: "Both were found again in May."})


def corpus() -> dict[str, bytes]:
    return {"season_report.pdf": report(6), "tide_paper.pdf": paper(), "spring_report.pdf": report(2), "keys_memo.docx": memo()}
