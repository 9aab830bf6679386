"""What the author of a forum post wrote: without quotes, signatures and markup."""

from __future__ import annotations

import html
import re

_ATTRIBUTION = re.compile(r"^\s*(?:On\b.{1,60}\bwrote|Am\b.{1,60}\bschrieb.{0,40}|El\b.{1,60}\bescribió):\s*$")
_QUOTE_TAG = re.compile(r"\[quote[^\]\n]{0,60}\]|\[/quote\]|<blockquote[^>]{0,60}>|</blockquote>", re.I)
_SIGNATURE = re.compile(r"(?m)^--[ \t\xa0]*$")
_BREAK = re.compile(r"(?i)<br\s*/?>|</?(?:p|div|li)>")
_TAG = re.compile(r"<[^<>]{0,60}>|\[/?[A-Za-z]{1,5}(?:=[^\]\n]{0,60})?\]")
_REMOVED = re.compile(r"\W*(?:deleted|removed|removed by (?:a )?moderator|gelöscht|eliminado)\W*", re.I)


def _outside_quotes(text: str) -> str:
    """Text outside quote tags, nested or cut off.

    A quote that was cut off lost the closing tags of the quotes inside it: a closing
    tag closes all that is open but what later closing tags are left over for. A tag
    that is never closed (quoted by '>' and cut off) ends with its '>' lines.
    """
    tags = list(_QUOTE_TAG.finditer(text))
    closes = [m.group()[1] == "/" for m in tags]
    later = [0] * (len(tags) + 1)
    for i in range(len(tags) - 1, -1, -1):
        later[i] = later[i + 1] + (1 if closes[i] else -1)
    out, depth, pos = [], 0, 0
    for i, m in enumerate(tags):
        if depth == 0:
            out.append(text[pos : m.start()])
        pos = m.end()
        if not closes[i]:
            depth += any(closes[i:])
        else:
            next_closes = i + 1 < len(tags) and closes[i + 1]
            depth = max(0, depth - 1) if next_closes else max(0, min(depth - 1, later[i + 1]))
    if depth == 0:
        out.append(text[pos:])
    return "\n".join(out)


def own_text(text: str | None) -> str | None:
    """The author's own text; None for null, blank and removed posts, '' if there are only quotes."""
    if text is None or not text.strip() or _REMOVED.fullmatch(_TAG.sub("", _BREAK.sub("", text))):
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = []
    for line in _outside_quotes("\n".join(_shield(text))).split("\n"):
        if not line.lstrip().startswith((">", "&gt;")) and not _ATTRIBUTION.match(line):
            lines.append(line)
    text = "\n".join(lines)
    if m := _SIGNATURE.search(text):
        text = text[: m.start()]
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))


def _shield(text: str):
    """Lines of the text; blocks of '>' lines outside tags lose the quote tags in them."""
    depth, block = 0, []
    for line in [*text.split("\n"), None]:
        quoted = line is not None and line.lstrip().startswith(">")
        if quoted and depth == 0:
            block.append(line)
            continue
        if block:
            yield from (_QUOTE_TAG.sub(" ", x) for x in block)
            block = []
        if line is not None:
            for m in _QUOTE_TAG.finditer(line):
                depth = max(0, depth + (-1 if m.group()[1] == "/" else 1))
            yield line
