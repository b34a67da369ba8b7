"""Documents kept as JSON node trees (paragraphs, lists, tables, panels, marks) as markdown, one document a row.

Spark deals the rows; a row's tree is rendered by a small table of functions, as trees nest without a bound.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The sign of a panel, and what a mark puts around its text.
PANELS = {"info": "ℹ️", "note": "📝", "warning": "⚠️", "success": "✅", "error": "❌"}
MARKS = {"strong": "**", "em": "*", "strike": "~~", "code": "`"}
#: Marks from the inside out.
ORDER = ["code", "subsup", "em", "strong", "strike", "link"]


def _attrs(node: dict) -> dict:
    found = node.get("attrs")
    return found if isinstance(found, dict) else {}


def _children(node: dict) -> list[dict]:
    found = node.get("content")
    return [c for c in found if isinstance(c, dict)] if isinstance(found, list) else []


def _marked(node: dict) -> str:
    text = str(node.get("text") or "")
    marks = {m.get("type"): _attrs(m) for m in node.get("marks") or [] if isinstance(m, dict)}
    for kind in (k for k in ORDER if k in marks and text):
        if kind == "link":
            text = f"[{text}]({marks[kind]['href']})" if marks[kind].get("href") else text
        elif kind == "subsup":
            sign = {"sub": "~", "sup": "^"}.get(marks[kind].get("type"), "")
            text = sign + text + sign
        else:
            text = MARKS[kind] + text + MARKS[kind]
    return text


def _mention(node: dict) -> str:
    attrs = _attrs(node)
    name = str(attrs.get("text") or attrs.get("displayName") or attrs.get("id") or "")
    return name if not name or name.startswith("@") else "@" + name


def _media(node: dict) -> str:
    attrs = _attrs(node)
    if attrs.get("url"):
        return f"![{attrs.get('alt') or ''}]({attrs['url']})"
    return f"<!-- media:{attrs['id']} -->" if attrs.get("id") else ""


def _card(node: dict) -> str:
    url = _attrs(node).get("url")
    return f"[{url}]({url})" if url else ""


INLINE = {
    "text": _marked, "hardBreak": lambda n: "  \n", "mention": _mention, "media": _media, "inlineCard": _card,
    "emoji": lambda n: str(_attrs(n).get("shortName") or _attrs(n).get("text") or ""),
    "status": lambda n: str(_attrs(n).get("text") or ""), "date": lambda n: str(_attrs(n).get("timestamp") or ""),
}


def _quoted(text: str) -> str:
    return "\n".join("> " + line if line else ">" for line in text.split("\n"))


def _listed(node: dict, ordered: bool) -> str:
    """Items with what is nested in them two spaces further in."""
    first = _attrs(node).get("order", 1) if ordered else 0
    first = first if isinstance(first, int) else 1
    lines = []
    for k, item in enumerate(_children(node)):
        sign = f"{first + k}. " if ordered else "- "
        body = "\n".join(x for x in map(_block, _children(item)) if x) or _line(item)
        lines.append(sign + body.replace("\n", "\n  "))
    return "\n".join(lines)


def _table(node: dict) -> str:
    rows = [[" ".join(x for x in map(_block, _children(cell)) if x).replace("\n", " ").replace("|", "\\|").strip() for cell in _children(row)] for row in _children(node)]
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    rows = [r + [""] * (width - len(r)) for r in rows]
    rows.insert(1, ["---"] * width)
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _line(node: dict) -> str:
    return "".join(INLINE[c["type"]](c) if c.get("type") in INLINE else _block(c) for c in _children(node))


def _stacked(node: dict) -> str:
    """Blocks with a blank line between; inline nodes that stand among them keep to one line."""
    out, run = [], ""
    for child in _children(node):
        if child.get("type") in INLINE:
            run += INLINE[child["type"]](child)
            continue
        out += [run, _block(child)]
        run = ""
    return "\n\n".join(x for x in [*out, run] if x.strip())


BLOCKS = {
    "paragraph": _line,
    "heading": lambda n: "#" * min(max(int(_attrs(n).get("level") or 1), 1), 6) + " " + _line(n),
    "bulletList": lambda n: _listed(n, False), "orderedList": lambda n: _listed(n, True), "table": _table,
    "codeBlock": lambda n: f"```{_attrs(n).get('language') or ''}\n{''.join(str(c.get('text') or '') for c in _children(n))}\n```",
    "blockquote": lambda n: _quoted(_stacked(n)), "rule": lambda n: "---",
    "panel": lambda n: _quoted(" ".join(x for x in (PANELS.get(_attrs(n).get("panelType"), ""), _stacked(n)) if x)),
}


def _block(node: dict) -> str:
    kind = node.get("type")
    return INLINE[kind](node) if kind in INLINE else BLOCKS.get(kind, _stacked)(node)


def markdown_of(text: str | None) -> str | None:
    """Markdown of a tree given as JSON; text that is no JSON object comes back as it is, null stays null."""
    try:
        node = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return text
    return _block(node).strip() if isinstance(node, dict) else text


@F.pandas_udf(StringType())
def _rendered(values: pd.Series) -> pd.Series:
    return values.map(markdown_of)


def adf_markdown(column: Column) -> Column:
    """Markdown of a column of JSON trees, as ``markdown_of`` gives it."""
    return _rendered(column)
