"""Rows that extraction yields; one schema for all of them, told apart by ``record``."""

EXTRACTED = (
    "record string, path string, qualified_name string, name string, kind string, start_line int, end_line int, "
    "decorators array<string>, source string, parent_class string, module string, raw string, callee string, line int"
)
COLUMNS = tuple(part.split()[0] for part in EXTRACTED.split(", "))


def row(**values) -> tuple:
    return tuple(values.get(c) for c in COLUMNS)
