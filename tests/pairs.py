"""Pairs of documents as layout text: a pair without discrepancies, and one with sixteen."""

from __future__ import annotations

HEADERS = {"protocol": ["Test ID", "Test", "Acceptance criterion", "Sample size", "Method / conditions"], "report": ["Test ID", "Test", "Acceptance criterion", "n tested", "Result and disposition"]}


def table(header: list[str], rows: list[list[str | list[str]]]) -> list[str]:
    """Fixed-width lines; a cell given as a list is wrapped over lines."""
    cells = [[c if isinstance(c, list) else [c] for c in row] for row in [header, *rows]]
    widths = [max(len(x) for row in cells for x in row[i]) + 3 for i in range(len(header))]
    out = []
    for row in cells:
        for k in range(max(map(len, row))):
            out.append("".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, widths, strict=True)).rstrip())
    return out


def document(fields: list[tuple[str, str]], sections: list[tuple[str, list[str]]]) -> str:
    out = ["A DOCUMENT", "", *(f"{k}:  {v}" for k, v in fields), ""]
    for i, (title, body) in enumerate(sections, 1):
        out += [f"{i}. {title}", *body, ""]
    return "\n".join(out)


TESTS = [
    ["T1", "Burst pressure", "≥ 640 kPa", "24", "Fill with water at 45°C; Lloyd 3300"],
    ["T2", "Fibre release", ["≤ 8 fibres", "≥40 µm per litre"], "24", "Filter and count, ISO 4020"],
    ["T3", "Flow", "2.1 – 3.4 L", "24", "Gravity feed, water of 45°C"],
    ["T4", "Bleaching", "No visible bleaching at 72 h", "8", "Soak and compare by eye"],
    ["T5", "Odour", "Panel score ≤ 3", "6", "Six noses, one hour apart"],
]
RESULTS = ["Min 655 kPa, mean 702 kPa. Filled at 45°C. Pass.", "Max 5 fibres. Pass.", "Range 2.4 – 3.1 L, mean 2.8 L. Fed at 45°C. Pass.", "No visible bleaching at 72 h. Pass.", "Panel score 2. Pass."]
RULES = ["Every gauge has to be within current calibration on the day that it is used.", "Cartridges are taken by the sampling plan of the works.", "Any deviation is written up in the report, with its reason."]
RECORD = ["What each of the five gave shall be recorded in the report", "QX-310-VR-002, which must reference this protocol and its version."]


def protocol(tests=TESTS, version="3.4", effective="5 February 2024") -> str:
    return document([("Document", "QX-310-TP-002"), ("Title", "Filter cartridge"), ("Version", version), ("Effective", effective)], [("Aim", ["Whether cartridges hold."]), ("Rules", [f"• {x}" for x in RULES]), ("Tests", table(HEADERS["protocol"], tests)), ("Reporting", RECORD)])


def report(rows, fields, sections) -> str:
    return document(fields, [("Summary", sections["Summary"]), ("Results", table(HEADERS["report"], rows)), *((k, v) for k, v in sections.items() if k != "Summary")])


def clean() -> tuple[str, str]:
    rows = [[t[0], t[1], t[2], t[3], r] for t, r in zip(TESTS, RESULTS, strict=True)]
    fields = [("Document", "QX-310-VR-002"), ("Verifies protocol", "QX-310-TP-002, Version 3.4"), ("Testing performed", "8 to 12 April 2024"), ("Date", "6 May 2024"), ("Test equipment", "Lloyd 3300 (no. 7); calibration due 31 January 2025")]
    return protocol(), report(rows, fields, {"Summary": ["The week's work is below."], "Deviations": ["No deviation arose."], "Conclusion": ["See the table."]})


def flawed() -> tuple[str, str]:
    tests = [*TESTS[:4], ["T5", "Odour", "Panel score ≤ 3", ["Per ISO 2859-", "1"], "As in note QX-FL310-07"]]
    rows = [
        ["T1", "Burst pressure", "≥ 600 kPa", "18", "Min 610 kPa, mean 688 kPa. Filled at room temperature. Pass."],
        ["T2", "Fibre release", ["≤ 8 fibres", "≥40 µm per litre"], "24", "Max 5 fibres. Pass."],
        ["T3", "Flow", "2.1 – 3.4 L", "24", "Range 2.3 – 3.9 L (a single one at 3.9 L), mean 2.9 L. Pass."],
        ["T4", "Bleaching", "No visible bleaching at 72 h", "8", "Nothing bleached. Pass."],
    ]
    fields = [("Document", "QX-310-VR-002"), ("Verifies protocol", "QX-310-TP-002, Version 1.7"), ("Date", "19 April 2024"), ("Test equipment", "Lloyd 3300; calibration due 30 November 2023")]
    return protocol(tests, "2.2", "5 February 2024"), report(rows, fields, {"Summary": ["All tests on record met what was asked."], "Conclusion": ["Cartridges may be sold."]})


#: Rule, scope and priority of each discrepancy of the flawed pair.
EXPECTED = {
    ("R-01", "document", "high"), ("R-04", "document", "high"), ("R-06", "document", "low"), ("R-10", "T5", "high"), ("R-12", "T1", "high"), ("R-13", "T1", "high"), ("R-14", "T1", "high"), ("R-14", "T3", "high"),
    ("R-15", "T1", "medium"), ("R-15", "T3", "medium"), ("R-16", "T1", "high"), ("R-17", "document", "high"), ("R-18", "T5", "low"), ("R-20", "document", "medium"), ("R-21", "document", "medium"), ("R-22", "T4", "low"),
}
