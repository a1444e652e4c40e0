"""A pushdown parser for the marks that open and close parts of an answer."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"```|`|</?think>|[“”«»()\[\]{}]|\*\*")
_CLOSES = {"”": "“", "»": "«", ")": "(", "]": "[", "}": "{", "</think>": "<think>"}
_OPENS = frozenset(_CLOSES.values())
_PARTIAL_TAG = re.compile(r"</?(?:t(?:h(?:i(?:nk?)?)?)?)?�?\s*\Z")
#: A list marker at the start of a line.
LIST_ITEM = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])\s")
#: How a line of signature begins.
SIGNATURE = ("— ", "-- ", "– ")
_BARE_MARKER = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)]?)\s*\Z")


def open_parts(text: str) -> list[str]:
    """The marks that are still open at the end, outermost first; "tag" for a tag that breaks off.

    Inside a code fence only the fence closes; inside inline code only its end or the end of the line. A closing mark
    closes the innermost mark of its kind and what was opened within; one without an opening mark (a smiley, a list
    number, the end of a thinking section whose start is missing) is passed over. Empty texts have no open parts.
    """
    stack: list[tuple[str, int]] = []
    for m in _TOKEN.finditer(text):
        t = m.group()
        top = stack[-1][0] if stack else ""
        if top == "```":
            if t == "```":
                stack.pop()
            continue
        if top == "`" and "\n" in text[stack[-1][1] : m.start()]:
            stack.pop()
            top = stack[-1][0] if stack else ""
        if top == "`":
            if t == "`":
                stack.pop()
            continue
        if t in ("```", "`"):
            stack.append((t, m.start()))
        elif t == "**":
            if any(x == "**" for x, _ in stack):
                while stack.pop()[0] != "**":
                    pass
            else:
                stack.append((t, m.start()))
        elif t in _OPENS:
            stack.append((t, m.start()))
        else:
            want = _CLOSES[t]
            if any(x == want for x, _ in stack):
                while stack.pop()[0] != want:
                    pass
    if stack and stack[-1][0] == "`" and "\n" in text[stack[-1][1] :]:
        stack.pop()
    parts = [t for t, _ in stack]
    if _PARTIAL_TAG.search(text):
        parts.append("tag")
    return parts


def last_line(text: str) -> str:
    return text.rstrip().rpartition("\n")[2]


def ending(text: str) -> str:
    """How the text ends: "" (blank), "mark" (punctuation, closing mark, symbol), "marker" (a list marker without its item),
    "list", "signature", or "bare" (a word or a comma in running text)."""
    body = text.rstrip()
    if not body:
        return ""
    line = last_line(body)
    if _BARE_MARKER.match(line) and "\n" in body:
        return "marker"
    if not (body[-1].isalnum() or body[-1] in ",;:-–—/<�&@"):
        return "mark"
    if LIST_ITEM.match(line):
        return "list"
    if line.startswith(SIGNATURE):
        return "signature"
    return "bare"
