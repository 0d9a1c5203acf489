"""Rows that every operator has to stand."""

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (4, "one"),
    (5, "Ünïcode wörds 漢字 \U0001f600 and\x00nul\x1fctl"),
    (None, "no id at all here"),
    (6, "word " * 30000),
    (7, "x" * 200000),
]
