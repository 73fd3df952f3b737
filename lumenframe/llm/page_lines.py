"""What each line of a message body is: sentence, record, link, tag, or words that only corpus counts can judge.

A small helper for tasks. Words are folded: case, width, look-alike and invisible letters, points between
letters and digits for letters make no difference.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from ..functions.text import fold_tables

#: Frequent function words of the archive's languages.
FUNCTION_WORDS = frozenset(
    """
the a an and or of to in on at for from with is are was were be been it its it's this that these those we you i he she they them his her us me my our your
not no have has had will would can could should by as but if so do did don't can't there what when than then who which how why into again before after let please
der die das den dem des ein eine einen einem und oder nicht ist sind war mit von zu zum zur auf für im in am an es ich wir sie er du uns mir bis als nach wie dass daß wird hat haben noch bei aus um ohne ihre ihren seit sich bitte
le la les un une des de du et ou ne pas est sont a au aux avec pour par sur dans en que qui nous vous je il elle ils on ce cette plus mais si sans se s'est l'écart n'en mieux votre notre
el los las una y o no es son con por para del al que en se lo su me nos más pero si sin antes hay hasta puedes muy esta este
os as um uma e ou não é são com por para do da dos das no na nos nas em que se mais mas sem ao até antes nos isso há
и в на не что с по для от за к у из мы я вы он она они это как до но же буду чем без если будет мне нас уже или
""".split()
)

URL = re.compile(r"(?i)(?:\b(?:h(?:tt|xx)ps?|ftp)\s?:\s?//|\bwww\d?\.)[^\s<>\])]+|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,8}(?:\.|\s?\[\.\]\s?)(?:example|test|invalid|com|net|org|info|shop)/[^\s<>\])]*")
_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁯﻿]")
_TABLE = str.maketrans(*fold_tables())
_SPELLED = re.compile(r"(?<!\w)\w(?:([.\-_*·])\w)(?:\1\w)+(?:\1?\s\1?\w(?:\1\w)+)*\1?")
_LEET = str.maketrans("013457", "oieast")
_WORD = re.compile(r"[^\W_](?:[\w'’-]*[^\W_])?")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[a-zA-Z]")
_CJK = re.compile("[぀-ヿ一-鿿]")
_KANA = re.compile("[ぁ-ゖ]")
_END = re.compile(r"[.!?。！？…](?:[\s\"')\]»”]*(?:\[sic\]|!!|:-\)|\(.*\)|\S{0,3}))?$")
_TAGS = re.compile(r"(?<!\w)#[^\W\d_][\w'’-]*")
_PRODUCT = re.compile(r"(?i)\b(?:product|brand|model|sku|colou?r|tags?|size|price|item no|art(?:ikel)?[.-]?nr)\s*[:=]\s*\S|(?:^|[-,|;]\s*)[a-z]\d{2,5}\s*(?:$|[-,|;])|\b(?:set of \d|size \d+)\b")
_RECORD = re.compile(
    r"""^\s*(?:[-*•]\s*)?\[[ xX✓-]?\]|^\s*[☐☑☒✓]|^\W{0,2}\d{4}-\d\d-\d\d[ T]\d\d:\d\d|^\W{0,2}\d{1,2}:\d\d(?::\d\d)?\b|\b(?:ERROR|INFO|WARN(?:ING)?|DEBUG)\b.*[=:]|^\s*File ".*line \d+|^Traceback|^\w*(?:Error|Exception):|^(?:present|absent|excused|attendees?|participants?|packed|packing list|anwesend|entschuldigt|pr[ée]sents?|absents?|presentes?|asistentes|ausentes|присутств\w*|参加者|出席者)\s*[:：]|^(?:From|To|Cc|Sent|Date|Subject|Received|Message-ID)\s*:|(?:\bIMG|\bPT)[-_]?\d{4,}""",
    re.I,
)
_SEPARATORS = re.compile(r"""\s*(?:[^\w\s.'’():?!¿¡"&%#@+-]+|!{2,}|\s[-–—>]+\s|->)\s*""")
_DIGIT = re.compile(r"\d")
_LEETED = re.compile(r"\b(?=[^\W_]*[a-z])[^\W\d_]+[013457]+[^\W\d_]+[^\W_]*\b|\b[013457]+[^\W\d_]{3,}\b")
_HIDDEN_IN = re.compile("\\w[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+\\w")
_MIXED = re.compile("[a-zA-Z][\u0400-\u04ff]|[\u0400-\u04ff][a-zA-Z]")
_MAYBE_SPELLED = re.compile(r"\w[.\-_*·]\w[.\-_*·]\w(?:[.\-_*·\s]|$)")
_MAYBE_URL = re.compile(r"(?i)//|www|\.(?:example|test|invalid|com|net|org|info|shop)/")
_ADDRESS = re.compile(r"(?:->\s*)?\b\d{1,3}(?:\.\d{1,3}){3}\b|\(?\b[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}\)?")
_CONTACT = re.compile(r"(?i)^\W*(?:tel|phone|fax|mobil\w*)\b")
_READING = re.compile(r"[^\W\d]\s*:\s*\d")
_INNER = re.compile(r"[.!?]\s+(?:\[\w+\]\s+|!+\s+|:-\)\s*)?(?=[A-ZÀ-ÖØ-ÞЀ-Я¿¡])")
_FOOTNOTE = re.compile(r"^\[\d{1,2}\]\s+\S+$")


class Line(NamedTuple):
    kind: str  # sentence, record, link, tag, open or short
    mass: int
    words: list[str]


def unspell(text: str) -> str:
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not ((c := len(_CYRILLIC.findall(text))) and c > len(_LATIN.findall(text))):
            text = text.translate(_TABLE)
    return _SPELLED.sub(lambda m: m[0].replace(m[1], ""), text) if _MAYBE_SPELLED.search(text) else text


def words(text: str) -> list[str]:
    """Folded words; a number is '#', a word with digits for letters is read with letters."""
    found = _WORD.findall(text.lower())
    if not _DIGIT.search(text):
        return found
    out = []
    for w in found:
        digits = len(_DIGIT.findall(w))
        out.append(w if not digits else "#" if digits == len(w) else w.translate(_LEET) if 2 * digits <= len(w) else w)
    return out


def disguised(text: str) -> int:
    """Words that are spelled out with points, hold digits for letters, invisible letters, or letters of two scripts."""
    return len(_SPELLED.findall(text)) + len(_LEETED.findall(text)) + (0 if text.isascii() else len(_HIDDEN_IN.findall(text)) + len(_MIXED.findall(text)))


def line(text: str) -> Line:
    hidden = disguised(text)
    text = unspell(text)
    text = _ADDRESS.sub(" ", text)
    links = URL.findall(text) if _MAYBE_URL.search(text) else []
    rest = re.sub(r"\[/?url=?\]?|\(\s*\)|\[\s*\]", " ", URL.sub(" ", text)) if links else text
    w = words(rest)
    n = len(w)
    glue = sum(x in FUNCTION_WORDS for x in w) / max(1, n)
    ends = bool(_END.search(rest.strip()))
    kana = 0 if rest.isascii() else len(_KANA.findall(rest))
    if kana >= 4 and kana >= 0.15 * len(rest) and ("。" in rest or kana >= 0.3 * len(rest)):
        return Line("sentence", max(n, len(_CJK.findall(rest)) // 3), w)
    if links and sum(x != "#" for x in w) <= 6 and not (ends and glue > 0.15 and n >= 4) and not _CONTACT.search(rest):
        return Line("link", n + 3 * len(links), [])
    tags = _TAGS.findall(rest) if "#" in rest else []
    if len(tags) >= 2 and 2 * len(tags) >= len(rest.split()):
        return Line("tag", 2 * len(tags), w)
    digits = bool(_DIGIT.search(rest))
    if (digits or ":" in rest) and len(_PRODUCT.findall(rest)) >= 2:
        return Line("tag", n, w)
    if _RECORD.search(rest) or (digits and (sum(x == "#" or bool(_DIGIT.search(x)) for x in w) >= max(3, 0.5 * n) or len(_READING.findall(rest)) >= 2)):
        return Line("record", n, w)
    items = [x for x in (len(i.split()) for i in _SEPARATORS.split(rest)) if x]
    inner = bool(_INNER.search(rest))
    listed = not inner and len(items) >= (4 if ends else 3) and sum(items) <= 4.5 * len(items) and max(items) <= 8
    if hidden >= max(3, 0.15 * n):
        return Line("open", n, w)
    if not listed and n >= 4 and (glue >= 0.08 or ((ends or inner or ". " in rest) and _CYRILLIC.search(rest))):
        return Line("sentence", n, w)
    if n <= 4 and len(items) < 3:
        return Line("short", n, w)
    return Line("open", n, w)


def stuffed(text: str) -> bool:
    """Whether sentences keep naming the same things: content words per distinct one, within each sentence, at 1.35 or more."""
    total = distinct = 0
    for sentence in re.split(r"[.!?]+\s", text.lower()):
        content = [w for w in _WORD.findall(sentence) if w not in FUNCTION_WORDS]
        total += len(content)
        distinct += len(set(content))
    return total >= 1.35 * max(1, distinct)


def page(lines: list[str]) -> list[tuple[str, int, list[str], float]]:
    """(kind, mass, words, repeated) of each line; ``repeated`` is the share of its words in collocations
    that the page has three times or more, or, for lines of a single item, of items that often. A sentence made of
    a few words over and over is open to judgement, a short line among six or more is an item, and a link that a
    sentence introduces is no list.
    """
    found = [line(x) for x in lines]
    judged = [f for f in found if f.kind in ("open", "short", "sentence")]
    pairs = Counter(p for f in judged for p in zip(f.words, f.words[1:], strict=False))
    whole = Counter(" ".join(f.words) for f in judged if f.kind == "short")
    run = [0] * (len(found) + 1)
    for i in range(len(found) - 1, -1, -1):
        run[i] = run[i + 1] + 1 if found[i].kind == "short" and found[i].words and not re.search(r"[.!?。,:：，、]$", lines[i].strip()) else 0
    out, long_run = [], 0
    for i, f in enumerate(found):
        kind = f.kind
        hit = [False] * len(f.words)
        if kind in ("open", "short", "sentence"):
            for j, p in enumerate(zip(f.words, f.words[1:], strict=False)):
                if pairs[p] >= 3:
                    hit[j] = hit[j + 1] = True
            if kind == "short" and whole[" ".join(f.words)] >= 3:
                hit = [True] * len(hit)
        share = sum(hit) / max(1, len(hit))
        long_run = run[i] and max(long_run, run[i])
        if kind == "sentence" and not _KANA.search(lines[i]) and ((share >= 0.4 and stuffed(lines[i])) or (share >= 0.6 and not _END.search(URL.sub("", lines[i]).strip()) and not _INNER.search(lines[i]))):
            kind = "open"
        elif kind == "short" and long_run >= 6 and not any(w in FUNCTION_WORDS for w in f.words[:1]):
            kind = "item"
        elif kind == "link" and f.mass <= 5:
            alone = i + 1 == len(found) or found[i + 1].kind != "link"
            if _FOOTNOTE.match(lines[i].strip()) or (i and alone and found[i - 1].kind in ("sentence", "record")):
                kind = "noted"
        out.append((kind, f.mass, f.words, share))
    return out
