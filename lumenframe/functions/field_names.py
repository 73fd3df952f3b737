"""Which catalogued field a file's own field name means.

A name is cut into words at case changes and separators, words are read as concepts, and the field whose
concepts the name holds is meant. A capture setting is meant before the camera or site it was taken at.
A name with a word that stands for no concept is a field of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Words of field names and the concept each stands for; an empty concept adds nothing.
CONCEPTS = {
    "participant": "participant", "patient": "participant", "subject": "participant", "person": "participant", "uuid": "", "id": "", "identifier": "", "no": "", "number": "",
    "cbc": "cbc", "hgb": "hb", "hb": "hb", "haemoglobin": "hb", "hemoglobin": "hb", "g": "", "dl": "", "gdl": "", "survey": "survey", "reported": "survey", "self": "survey",
    "device": "device", "phone": "device", "handset": "device", "smartphone": "device", "model": "", "modal": "", "name": "",
    "image": "image", "img": "image", "photo": "image", "picture": "image", "pic": "image", "path": "", "file": "", "tongue": "tongue", "conjunctiva": "conjunctiva", "conj": "conjunctiva", "anemia": "", "anaemia": "",
    "camera": "camera", "cam": "camera", "meta": "camera", "metadata": "camera", "white": "wb", "balance": "wb", "wb": "wb", "awb": "wb", "whitebalance": "wb", "mode": "", "setting": "", "value": "", "val": "", "speed": "", "state": "", "status": "",
    "iso": "iso", "sensitivity": "iso", "exposure": "exposure", "exp": "exposure", "shutter": "exposure", "us": "", "usec": "", "microseconds": "", "time": "", "flash": "flash", "torch": "flash",
    "session": "session", "visit": "session", "operator": "operator", "op": "operator", "focus": "focus", "af": "focus", "autofocus": "focus", "bit": "bit", "bits": "bit", "depth": "", "bitdepth": "bit", "per": "", "channel": "",
}

SETTINGS = ("iso", "exposure", "wb", "flash", "focus", "bit")


def words_of(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return [w for w in re.split(r"[^a-z0-9]+", spaced.lower()) if w]


def concepts_of(name: str) -> frozenset[str] | None:
    """The concepts of a name, or None if a word stands for none or nothing is left."""
    found = [CONCEPTS.get(w) for w in words_of(name)]
    return frozenset(filter(None, found)) or None if None not in found else None


class Catalog:
    def __init__(self, fields: Iterable[str]):
        self.fields = list(fields)
        self.exact = {"".join(words_of(f)): f for f in self.fields}
        self.meant = {f: c for f in self.fields if (c := concepts_of(f))}
        self.memo: dict[str, str] = {}

    def field(self, name: str) -> str:
        """The catalogued field that ``name`` means, else ``name`` itself."""
        if name not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[name] = self._field(name)
        return self.memo[name]

    def _field(self, name: str) -> str:
        if same := self.exact.get("".join(words_of(name))):
            return same
        held = concepts_of(name)
        if not held:
            return name
        setting = held & set(SETTINGS)
        fits = [f for f, c in self.meant.items() if c <= held and (not setting or c & setting)]
        return max(fits, key=lambda f: (len(self.meant[f]), -self.fields.index(f)), default=name)
