"""Wiki storage-format XHTML as markdown: a writer that keeps one buffer an open element and closes them inside out."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the format: marks of plain elements, symbols of panels, macros that only name what is drawn elsewhere.
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}
PANELS = {"info": "ℹ️", "note": "📝", "warning": "⚠️", "tip": "💡"}
DYNAMIC = {"recently-updated", "blog-posts", "children-display", "contributors", "pagetree"}
DIAGRAMS = {"drawio": None, "gliffy": None, "lucidchart": None}
VOID = {"br", "hr", "img", "ri:user", "ri:page", "ri:attachment", "ri:url", "ri:space", "ac:emoticon"}


class _Writer(HTMLParser):
    def __init__(self, base_url: str | None):
        super().__init__(convert_charrefs=True)
        self.base = (base_url or "").rstrip("/")
        self.stack: list[dict] = [{"tag": "", "attrs": {}, "out": [], "parameters": {}, "found": {}, "n": 0}]

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": dict(attrs), "out": [], "parameters": {}, "found": {}, "n": 0}
        if tag in VOID:
            self._close(node)
        else:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.stack):
            while True:
                node = self.stack.pop()
                self._close(node)
                if node["tag"] == tag:
                    return

    def handle_data(self, data):
        top = self.stack[-1]
        verbatim = any(n["tag"] in ("pre", "ac:plain-text-body") for n in self.stack)
        top["out"].append(data if verbatim else re.sub(r"\s+", " ", data))

    def unknown_decl(self, data):  # <![CDATA[...]]>
        self.stack[-1]["out"].append(data.removeprefix("CDATA["))

    def _up(self, tag):
        return next((n for n in reversed(self.stack) if n["tag"] == tag), None)

    def _close(self, node) -> None:
        tag, attrs, text = node["tag"], node["attrs"], "".join(node["out"])
        write = self.stack[-1]["out"].append
        if tag == "ac:parameter":
            self.stack[-1]["parameters"][attrs.get("ac:name", "")] = text.strip()
        elif tag in ("ac:plain-text-body", "ac:rich-text-body") and self.stack[-1]["attrs"].get("ac:name") == "code":
            self.stack[-1]["found"]["body"] = text
        elif tag == "ac:structured-macro":
            write(self._macro(attrs.get("ac:name", ""), node, text))
        elif tag.startswith("ri:"):
            for kind in ("ac:link", "ac:image"):
                if (owner := self._up(kind)) is not None:
                    owner["found"][tag] = attrs
        elif tag == "ac:link":
            write(self._link(node["found"], text))
        elif tag == "ac:image":
            source = node["found"].get("ri:attachment", {}).get("ri:filename") or node["found"].get("ri:url", {}).get("ri:value") or attrs.get("ac:src")
            write(f"![{attrs.get('ac:alt') or text.strip()}]({source})" if source else text)
        elif tag == "ac:emoticon":
            name = attrs.get("ac:emoji-shortname") or attrs.get("ac:name")
            write(f":{name}:" if name else "")
        elif tag in ("script", "style"):
            pass
        elif re.fullmatch("h[1-6]", tag):
            write(f"\n\n{'#' * int(tag[1])} {text.strip()}\n\n")
        elif tag in INLINE:
            write(f"{INLINE[tag]}{text.strip()}{INLINE[tag]}" if text.strip() and not self._up("pre") else text)
        elif tag == "a":
            write(f"[{text.strip()}]({attrs['href']})" if attrs.get("href") and text.strip() else text)
        elif tag == "img":
            write(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
        elif tag == "br":
            write("\n")
        elif tag == "hr":
            write("\n\n---\n\n")
        elif tag == "pre":
            write(f"\n\n```\n{text.strip(chr(10))}\n```\n\n")
        elif tag == "blockquote":
            write("\n\n" + "\n".join(f"> {line}".rstrip() for line in text.strip().splitlines()) + "\n\n")
        elif tag == "li":
            owner = self._up("ol") if self.stack[-1]["tag"] == "ol" else None
            self.stack[-1]["n"] += 1
            mark = f"{self.stack[-1]['n']}. " if owner is not None else "- "
            write("\n" + mark + re.sub(r"\n+", "\n  ", text.strip()))
        elif tag in ("ul", "ol"):
            write(("\n" if self._up("li") else "\n\n") + text.strip("\n") + ("" if self._up("li") else "\n\n"))
        elif tag in ("td", "th"):
            write(re.sub(r"\s*\n\s*", " ", text.strip()).replace("|", "\\|") + "\0")
        elif tag == "tr":
            write("| " + " | ".join(text.strip().split("\0")[:-1]) + " |\n")
        elif tag == "table":
            rows = [r.strip() for r in text.strip().split("\n") if r.strip()]
            rule = "|" + " --- |" * (rows[0].count(" | ") + 1) if rows else ""
            write("\n\n" + "\n".join([*rows[:1], rule, *rows[1:]]) + "\n\n")
        elif tag in ("p", "div", "section", "ac:layout-cell"):
            write(f"\n\n{text.strip()}\n\n" if text.strip() else "")
        else:
            write(text)

    def _link(self, found: dict, text: str) -> str:
        if "ri:user" in found:
            user = found["ri:user"]
            return "@" + (user.get("ri:display-name") or user.get("ri:username") or user.get("ri:userkey") or "user")
        if "ri:page" in found:
            return found["ri:page"].get("ri:content-title") or text.strip() or "page"
        return text

    def _macro(self, name: str, node: dict, text: str) -> str:
        given = node["parameters"]
        if name == "code":
            return f"\n\n```{given.get('language', '')}\n{node['found'].get('body', '')}\n```\n\n"
        if name in PANELS:
            return "\n\n" + "\n".join([f"> {PANELS[name]}", *(f"> {line}".rstrip() for line in text.strip().splitlines())]) + "\n\n"
        if name == "status":
            return f"[STATUS: {given.get('title', '')}]"
        if name == "jira":
            key = given.get("key", "")
            return f"[{key}]({self.base}/browse/{key})" if key and self.base else f"[{key}]" if key else ""
        if name in DYNAMIC:
            return f"\n\n<!-- confluence:{name} -->\n\n"
        if name in DIAGRAMS:
            return f'\n\n<!-- confluence:{name} diagram="{given.get("diagramName") or given.get("name") or given.get("filename") or ""}" -->\n\n'
        return text


def markdown(xhtml: str | None, base_url: str | None = None) -> str | None:
    """Markdown of one page body; null stays null, what is malformed gives what can be read of it."""
    if xhtml is None:
        return None
    writer = _Writer(base_url)
    writer.feed(xhtml)
    writer.close()
    while len(writer.stack) > 1:
        writer._close(writer.stack.pop())
    text = re.sub(r"[ \t]+\n", "\n", "".join(writer.stack[0]["out"]))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(column: Column, base_url: str | None = None) -> Column:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: markdown(v, base_url))

    return run(column)
