"""Reading raw mail messages: the leaves of a message and what a person reads of it.

Small helpers for Arrow batches inside tasks; all distribution is Spark's.
"""

from __future__ import annotations

import binascii
import html
import quopri
import re
import unicodedata
from typing import NamedTuple

_HEADER = re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*(?:\n[ \t].*)*)", re.M)
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*("([^"]*)"?|[^\s;]+)')
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strike|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_WORD = re.compile(r"[^\W_]+")


class Leaf(NamedTuple):
    kind: str  # content type, lower case; text/plain where none is given
    encoding: str  # transfer encoding, lower case
    charset: str
    raw: str  # the body as it stands
    closed: bool  # every multipart around it has its closing line


def unix(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def split_head(text: str) -> tuple[dict[str, str], str, bool]:
    """Headers (names in lower case, the first of each), body, and whether the blank line between is there."""
    if text.startswith("\n"):
        return {}, text[1:], True
    head, blank, body = text.partition("\n\n")
    found = {}
    for m in _HEADER.finditer(head):
        found.setdefault(m[1].lower(), m[2].replace("\n", " "))
    if not found or not _HEADER.match(head):  # no head at all
        return {}, text, True
    return found, body, bool(blank)


def _params(value: str) -> dict[str, str]:
    return {m[1].lower(): m[3] if m[3] is not None else m[2] for m in _PARAM.finditer(value)}


def leaves(text: str) -> list[Leaf]:
    """The parts of a message that are no multipart, in order, however deep they lie; text has plain line ends."""
    out, todo = [], [(text, True)]  # what is still to be read, the next one last, and whether all around it is closed
    while todo:
        part, closed = todo.pop()
        head, body, _ = split_head(part)
        ctype = head.get("content-type", "text/plain")
        kind = ctype.partition(";")[0].strip().lower() or "text/plain"
        p = _params(ctype) if ";" in ctype else {}
        if kind.startswith("multipart/") and p.get("boundary"):
            mark = "--" + p["boundary"]
            pieces = [""]  # what stands before the first boundary is no part
            for x in ("\n" + body).split("\n" + mark)[1:]:
                if x.partition("\n")[0].strip() in ("", "--"):
                    pieces.append(x)
                else:  # a longer boundary that begins like this one
                    pieces[-1] += "\n" + mark + x
            end = next((i for i, x in enumerate(pieces) if x.startswith("--")), None)
            inner = [(x.partition("\n")[2], closed and end is not None) for x in pieces[1:end]]
            if inner:
                todo.extend(reversed(inner))
            else:
                out.append(Leaf("multipart/empty", "", "", "", closed and end is not None))
        elif kind == "message/rfc822":
            todo.append((body, closed))
        else:
            out.append(Leaf(kind, head.get("content-transfer-encoding", "").strip().lower(), p.get("charset", "utf-8"), body, closed))
    return out


def decode(leaf: Leaf) -> str:
    """The text of a leaf with its transfer encoding undone; broken ends decode as far as they go."""
    if leaf.encoding == "base64":
        packed = re.sub(r"[^A-Za-z0-9+/]", "", leaf.raw)
        packed = packed[: len(packed) - (len(packed) % 4 == 1)]
        data = binascii.a2b_base64(packed + "=" * (-len(packed) % 4))
    elif leaf.encoding == "quoted-printable":
        data = quopri.decodestring(leaf.raw.encode("utf-8", "surrogatepass"))
    else:
        return leaf.raw
    try:
        return unix(data.decode(leaf.charset, "replace"))
    except (LookupError, UnicodeError):
        return unix(data.decode("utf-8", "replace"))


def unmark(text: str) -> str:
    """HTML as text: hidden parts dropped, inline tags joined, other tags as breaks, entities undone."""
    text = _INLINE.sub("", _HIDDEN.sub(" ", text))
    return html.unescape(_TAG.sub("\n", text))


def readable(text: str | None) -> list[str]:
    """The texts that a person reads in a message: one per text leaf, quote marks undone."""
    if not text:
        return []
    out = []
    for leaf in leaves(unix(text)):
        if leaf.kind.startswith("text/"):
            t = decode(leaf)
            if leaf.kind == "text/html":
                t = unmark(t)
            out.append(_QUOTE.sub("", t))
    return out


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; composed and decomposed letters are the same."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "")
    return _WORD.findall(text.lower())
