"""The own words of an archived message: decoded body without headers, quotes, signatures, disclaimers and attachments.

A small helper for tasks; Spark partitions the messages. Null or empty texts give an empty body. Texts
that aren't messages are taken as a plain body. Cut-off encodings are decoded as far as they go.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
from collections.abc import Iterator

_HEADER = re.compile(r"^[!-9;-~]{1,60}:")
_PARAM = re.compile(r"""boundary\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)
_DROP = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|head|title|blockquote)\b.*?(?:</\1\s*>|$)")
_HIDDEN = re.compile(r"""(?is)<(\w+)[^>]*style\s*=\s*["'][^"']*(?:display\s*:\s*none|font-size\s*:\s*0)[^>]*>.*?</\1\s*>""")
_HREF = re.compile(r"""(?is)<a\b[^>]*?href\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)(?:</a\s*>|$)""")
_BLOCK = re.compile(r"(?i)</?(?:p|br|div|tr|li|ul|ol|table|h[1-6]|hr|body|html|td|th)\b[^>]*>")
_TAG = re.compile(r"(?s)<[a-zA-Z/!][^<>]*>?")

#: Lines that open a quoted message, in the languages of the archive (fixed values).
_QUOTE_OPEN = re.compile(
    r"^\W{0,3}(?:on\b.{5,150}\bwrote|le\b.{5,150}a [ée�]+crit|am\b.{5,150}\bschrieb.*|el\b.{5,150}escribi\S{0,2}|em\b.{5,150}\bescreveu|.{5,150}(?:написала?|пишет)|.{3,150}(?:のメール|書きました|wrote|さんは.{0,12}書きました))\s*[:：]?\s*$",
    re.I,
)
_FORWARD = re.compile(
    r"^\W{0,3}-{2,}\s*(?:original message|forwarded message|urspr\S{0,4}ngliche nachricht|weitergeleitete nachricht|message d.origine|message transf\S+|mensaje original|mensaje reenviado|mensagem original|mensagem encaminhada|исходное сообщение|пересылаемое сообщение|元のメッセージ|転送メッセージ)|^(?:begin forwarded message|von: .*gesendet)",
    re.I,
)
_QUOTED = re.compile(r"^\s*(?:>|\|(?!\|)|&gt;)")
_MOJIBAKE = re.compile("[ÃÂ][\x80-¿ -™]|[ÐÑ][\x80-¿‘-™]|[ãäåæçèé][\x80-¿€-™]{2}")
_RULE = re.compile(r"^\s*(?:[*_=~#-]\s?){3,}\s*$")
_SIGNATURE = re.compile(r"^\s*--\s*$")


def _charset(head: str) -> str:
    m = _CHARSET.search(head)
    return m[1].lower() if m else "utf-8"


def _text(raw: bytes, charset: str) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        return raw.decode("utf-8" if charset in ("utf8", "us-ascii", "ascii") else charset, "replace")
    except LookupError:
        return raw.decode("latin-1")


def _decoded(head: str, body: str) -> str:
    low = head.lower()
    if "base64" in low:
        data = re.sub(r"[^A-Za-z0-9+/]", "", body.split("=\n\n")[0])
        try:
            return _text(base64.b64decode(data[: len(data) // 4 * 4]), _charset(head))
        except (binascii.Error, ValueError):
            return body
    if "quoted-printable" in low:
        return _text(quopri.decodestring(body.encode("utf-8", "surrogatepass")), _charset(head))
    return body


def _split_head(text: str) -> tuple[str, str]:
    """(header block, rest); no header block if the text doesn't open with a header line."""
    start = re.sub(r"^>?From \S+ [^\n]*\n", "", text.lstrip("\n"))
    if not _HEADER.match(start):
        return "", text
    head, gap, rest = start.partition("\n\n")
    return (re.sub(r"\n[ \t]+", " ", head), rest) if gap else (start, "")


def _from_html(text: str) -> str:
    text = _HIDDEN.sub(" ", _DROP.sub(" ", text))
    text = _HREF.sub(lambda m: f"{m[2]} {m[1]}" if m[1][:4] in ("http", "hxxp", "www.") and m[1] not in m[2] else m[2], text)
    return html.unescape(_TAG.sub("", _BLOCK.sub("\n", text)))


def _pieces(head: str, body: str) -> list[str] | None:
    """The parts of a multipart entity, None for others."""
    if (m := _PARAM.search(head)) is None:
        return None
    found = []
    for piece in body.split("--" + (m[1] or m[2] or m[3]))[1:]:
        if piece.startswith("--"):
            break
        found.append(bare if _HEADER.match(bare := piece.lstrip("\r\n")) else piece)
    return found


def _texts(kind: str, head: str, body: str) -> tuple[list[str], list[str]]:
    """(plain texts, HTML texts) of an entity without parts."""
    if re.search(r"(?im)^content-disposition:\s*attachment|^content-type:[^\n]*\bname=", head) or not kind.startswith(("text/plain", "text/html")):
        return [], []
    text = _decoded(head, body)
    return ([], [_from_html(text)]) if kind == "text/html" or re.match(r"(?is)\s*<(?:!doctype|html)\b", text) else ([text], [])


def _parts(head: str, body: str) -> tuple[list[str], list[str]]:
    """(plain texts, HTML texts) of one entity, whose parts may be nested to any depth."""
    plain: list[str] = []
    rich: list[str] = []
    # open multiparts: (whether the parts are alternatives, parts still to be read, plain, rich)
    stack: list[tuple[bool, Iterator[str], list[str], list[str]]] = [(False, iter(()), plain, rich)]
    entity: tuple[str, str] | None = (head, body)
    while True:
        if entity is not None:
            head, body = entity
            kind = (re.search(r"(?im)^content-type:\s*([\w.+/-]+)", head) or ["", "text/plain"])[1].lower()
            pieces = _pieces(head, body) if kind.startswith("multipart/") else None
            if pieces is not None:
                stack.append((kind.endswith("alternative"), iter(pieces), [], []))
            else:
                p, r = _texts(kind, head, body)
                stack[-1][2].extend(p)
                stack[-1][3].extend(r)
        piece = next(stack[-1][1], None)
        if piece is not None:
            entity = _split_head(piece)
        elif len(stack) == 1:
            return plain, rich
        else:
            entity = None
            either, _, p, r = stack.pop()
            p, r = (p if any(map(str.strip, p)) else r, []) if either else (p, r)
            stack[-1][2].extend(p)
            stack[-1][3].extend(r)


def body(message: str | None) -> str:
    """The decoded text of a message, HTML as lines of text."""
    if not message:
        return ""
    plain, rich = _parts(*_split_head(message.replace("\r\n", "\n").replace("\r", "\n")))
    return "\n".join([*plain, *rich])


def _repaired(line: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again."""
    if not _MOJIBAKE.search(line):
        return line
    try:
        raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in line)
    except UnicodeEncodeError:
        return line
    fixed = raw.decode("utf-8", "ignore")
    return fixed if 4 * len(fixed) > len(line) else line


def own_lines(message: str | None) -> list[str]:
    """The lines of the body that the sender wrote: no quoted or forwarded text, signature or disclaimer."""
    out: list[str] = []
    lines = body(message).split("\n")
    skip = ""
    for i, line in enumerate(lines):
        bare = line.strip()
        if _FORWARD.match(bare):
            break
        if _QUOTED.match(line):
            skip = "" if skip == "tail" else skip
            continue
        if skip == "tabs" and (not bare or line.startswith("\t")):
            continue
        skip = "" if skip == "tabs" else skip
        if _SIGNATURE.match(line) or (_RULE.match(bare) and len(bare) >= 3):
            ahead = [x for x in lines[i + 1 : i + 5] if x.strip()]
            if _SIGNATURE.match(line) or (ahead and (len(ahead[0].split()) > 5 or len(ahead[0]) > 30)):
                skip = "tail"
                continue
        if bare and _QUOTE_OPEN.match(bare):
            ahead = next((x for x in lines[i + 1 :] if x.strip()), "")
            skip = "" if _QUOTED.match(ahead) else "tabs" if ahead.startswith("\t") else "all"
            continue
        if bare and not skip:
            out.append(_repaired(bare))
    return out
