"""Text of HTML as a browser's parser has it: the rules of its tokenizer, and of what belongs to the body."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Content up to the element's end tag is text without tags; in the second group with character references.
RAW, ESCAPABLE = frozenset("script style xmp iframe noembed noframes".split()), frozenset("textarea title".split())
#: Elements that belong to the head where no body has begun.
HEAD = frozenset("base basefont bgsound link meta title style script noframes noscript template".split())
#: White space that a line loses at its ends.
SPACE = " \t\n\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_TAG_NAME = re.compile(r"[A-Za-z][^\t\n\x0c />]*")
_SKIPPED = re.compile(r"[\t\n\x0c /]*")
_ATTRIBUTE = re.compile(r"=?[^\t\n\x0c />=]*")
_EQUALS = re.compile(r"[\t\n\x0c ]*=[\t\n\x0c ]*")
_VALUE = re.compile(r"[^\t\n\x0c >]*")
_COMMENT_END = re.compile(r"--!?>")


def _tag_end(text: str, at: int) -> int:
    """Where a tag's attributes end, after its ``>``; -1 if the text ends before."""
    while True:
        at = _SKIPPED.match(text, at).end()
        if at >= len(text) or text[at] == ">":
            return at + 1 if at < len(text) else -1
        at = _ATTRIBUTE.match(text, at).end()
        if equals := _EQUALS.match(text, at):
            at = equals.end()
            quote = text[at : at + 1]
            if quote in ('"', "'"):  # quotes count only here
                at = text.find(quote, at + 1) + 1
                if not at:
                    return -1
            else:
                at = _VALUE.match(text, at).end()


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """("text", data), ("start", name) and ("end", name) in order; comments, doctypes and what a broken tag swallows give nothing."""
    at, held = 0, []
    while at < len(text):
        lt = text.find("<", at)
        if lt < 0:
            held.append(text[at:])
            break
        held.append(text[at:lt])
        after = text[lt + 1 : lt + 2]
        name = _TAG_NAME.match(text, lt + 1) or (_TAG_NAME.match(text, lt + 2) if after == "/" else None)
        if name:
            end = _tag_end(text, name.end())
            if end < 0:
                break
            if held and (data := html.unescape("".join(held))):
                yield "text", data
            held, kind = [], name[0].lower()
            yield ("end" if after == "/" else "start"), kind
            at = end
            if after != "/" and kind == "plaintext":
                yield "text", text[at:]
                return
            if after != "/" and (kind in RAW or kind in ESCAPABLE):
                close = re.compile(rf"</{re.escape(kind)}(?=[\t\n\x0c />])", re.IGNORECASE).search(text, at)
                data = text[at : close.start() if close else len(text)]
                if data:
                    yield "text", html.unescape(data) if kind in ESCAPABLE else data
                at = close.start() if close else len(text)
        elif text.startswith("<!--", lt):
            # a comment may end at once
            quick = next((x for x in ("<!-->", "<!--->") if text.startswith(x, lt)), None)
            end = _COMMENT_END.search(text, lt + 4)
            at = lt + len(quick) if quick else end.end() if end else len(text)
        elif after in ("!", "?") or after == "/" and lt + 2 < len(text):
            end = text.find(">", lt + 1)
            at = end + 1 if end >= 0 else len(text)
        else:
            held.append("<")
            at = lt + 1
    if held and (data := html.unescape("".join(held))):
        yield "text", data


def body_text(text: str) -> str:
    """The text content of the body: scripts and styles in it count, the head, comments and templates don't. Text that tables push out stays in its place."""
    out, in_body, in_head, templates = [], False, "", 0
    for kind, data in tokens(text.replace("\r\n", "\n").replace("\r", "\n")):
        if kind == "start" and data == "template":
            templates += 1
        elif kind == "end" and data == "template":
            templates = max(0, templates - 1)
        elif templates:
            continue
        elif in_body:
            out += [data] if kind == "text" else []
        elif kind == "start":
            in_body = data == "body" or data not in HEAD and data not in ("html", "head")
            in_head = data if data in RAW or data in ESCAPABLE else ""
            if data in RAW | ESCAPABLE and data not in HEAD:
                in_body, in_head = True, ""
        elif kind == "end":
            in_body, in_head = data in ("body", "html", "br"), ""
        elif not in_head and data.strip(" \t\n\x0c"):
            in_body = True
            out.append(data.lstrip(" \t\n\x0c"))
    return "".join(out)


def lines_of(text: str | None) -> str:
    """The body's text with its lines trimmed and without blank ones; empty for missing text."""
    return "\n".join(x for line in body_text(text).split("\n") if (x := line.strip(SPACE))) if text else ""


def strip_html(c: Column) -> Column:
    """``lines_of`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def stripped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: lines_of(x) if isinstance(x, str) else "")

    return stripped(c)
