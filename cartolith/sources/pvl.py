"""Label text (PVL): a parser into a tree of named values, and the same as rows.

One scanner expression splits a text into lexemes; a small loop over them builds the tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

LEXEME = re.compile(
    r"""(?P<skip>[ \t\r\n\f]+|/\*.*?(?:\*/|\Z)|\#[^\n]*)
      | (?P<quoted>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))
      | (?P<unit><[^>]*(?:>|\Z))
      | (?P<mark>[=(){},])
      | (?P<word>[^ \t\r\n=(){},<"\x00]+)
      | (?P<other>.)""",
    re.S | re.X,
)


class PvlError(ValueError):
    pass


@dataclass
class Node:
    """An Object or Group: ``items`` are (keyword, values) in order."""

    kind: str = ""
    name: str = ""
    items: list[tuple[str, list[str]]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name.lower() == name.lower()), None)

    def find(self, name: str) -> Node | None:
        """The first node of that name, depth first."""
        for c in self.children:
            if c.name.lower() == name.lower():
                return c
            if found := c.find(name):
                return found
        return None

    def key(self, name: str) -> list[str] | None:
        return next((v for k, v in self.items if k.lower() == name.lower()), None)

    def text(self, name: str) -> str:
        return (self.key(name) or [""])[0]

    def number(self, name: str, default: float | None = None) -> float:
        """The value as a double; without a default a missing or bad one is an error."""
        values = self.key(name)
        try:
            return float(values[0])
        except (TypeError, IndexError, ValueError):
            if default is None:
                raise PvlError(f"label keyword {name} is missing or not a number") from None
            return default

    def integer(self, name: str, default: int | None = None) -> int:
        return int(self.number(name, default))


def _lexemes(text: str) -> list[tuple[str, str]]:
    out = []
    for m in LEXEME.finditer(text):
        kind, s = m.lastgroup, m[0]
        if s == "\0":
            break
        if kind == "quoted":
            s = " ".join(s[1 : -1 if len(s) > 1 and s[-1] == s[0] else None].split())
        if kind != "skip":
            out.append((kind, s))
    return out


def parse(text: str) -> tuple[Node, bool]:
    """The tree of a label, and whether its End statement was there."""
    lex, at, root = _lexemes(text), 0, Node()
    open_nodes = [root]
    while at < len(lex):
        kind, name = lex[at]
        at += 1
        if kind not in ("word", "quoted"):
            continue
        low = name.lower()
        if low == "end":
            return root, True
        if low.replace("_", "") in ("endobject", "endgroup"):
            if len(open_nodes) > 1:
                open_nodes.pop()
            continue
        if at == len(lex) or lex[at] != ("mark", "="):
            open_nodes[-1].items.append((name, []))
            continue
        values, at = _values(lex, at + 1, name)
        if low in ("object", "group"):
            node = Node(name, values[0] if values else "")
            open_nodes[-1].children.append(node)
            open_nodes.append(node)
        else:
            open_nodes[-1].items.append((name, values))
    return root, False


def _values(lex: list[tuple[str, str]], at: int, name: str) -> tuple[list[str], int]:
    """Values that begin at a lexeme, and where they end; nested arrays are flattened, a unit is dropped."""
    if at == len(lex):
        raise PvlError(f"label keyword {name}: unexpected end of label")
    if lex[at][0] in ("word", "quoted"):
        values, at = [lex[at][1]], at + 1
    elif lex[at][1] in ("(", "{"):
        depth, values, at = 1, [], at + 1
        while depth:
            if at == len(lex):
                raise PvlError(f"label keyword {name}: unterminated array")
            kind, s = lex[at]
            at += 1
            if kind == "mark":
                depth += (s in "({") - (s in ")}")
            elif kind in ("word", "quoted"):
                values.append(s)
    else:
        return [], at
    return values, at + (at < len(lex) and lex[at][0] == "unit")


ROWS = "path array<string>, ord int, keyword string, values array<string>"


def flatten(node: Node, path: tuple[str, ...] = ()) -> list[tuple]:
    """Rows (path, ord, keyword, values) of a tree."""
    rows = [(list(path), i, k, v) for i, (k, v) in enumerate(node.items)]
    for c in node.children:
        rows += flatten(c, (*path, c.name))
    return rows


def label_rows(labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, ord, keyword, values) of label texts, one row a keyword; a broken label gives no rows."""
    from pyspark.sql.types import StructType

    schema = StructType([labels.schema[key], *StructType.fromDDL(ROWS)])

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                try:
                    rows += [(k, *r) for r in flatten(parse(t or "")[0])]
                except PvlError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "path", "ord", "keyword", "values"])

    return labels.select(key, text).mapInPandas(run, schema)


def number_text(v: float) -> str:
    """The text of a number in a label: exact, and always recognisable as a real."""
    from ..raster import format_num

    text = format_num(v) if v == 0 or 1e-6 <= abs(v) < 1e15 else repr(v)
    return text if any(c in text for c in ".eEn") else text + ".0"


def quoted(text: str) -> str:
    return '"' + text.replace('"', "'") + '"'
