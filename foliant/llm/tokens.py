"""Token ids of whole texts for word-split BPE tokenizers, with a cache of words.

The tokenizer lower-cases, splits into words and encodes each word by itself, so a word's ids never change and texts
cost a split and a lookup per word. Texts for which Python's and the tokenizer's character tables could differ (anything
outside Latin, Greek, Cyrillic and common punctuation, a capital sigma, or a special token's string) are encoded by the
tokenizer as a whole, so ids are always the tokenizer's own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

_CACHE = 700_000
_RANGE = [chr(k) for k in range(0x530)]
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u2028\\u2029\\u205f\\u2000-\\u200a"


def _class(kind: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in _RANGE if unicodedata.category(c)[0] == kind)


#: Characters whose lower case lies outside _RANGE.
_FAR = "".join(c for c in _RANGE if any(x not in _RANGE for x in c.lower()))
#: Any but the characters whose classes are the same in every table: Latin, Greek but capital sigma, Cyrillic, dashes and quotes, currency signs.
_OTHER = re.compile(f"[^\x00-\u02ff\u0370-\u03a2\u03a4-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|[{_FAR}]")
#: The split that the fast way knows: contractions, letter runs, single numbers, runs of anything else but white space.
_KNOWN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = steps[0].get("pattern", {}).get("Regex") if steps[0].get("type") == "Split" and steps[0].get("invert") else None
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fast = split == _KNOWN and normal == ["NFC", "Replace", "Lowercase"] and bool(spec["model"].get("end_of_word_suffix"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str] | None:
        """The words that are encoded by themselves; None if the text must be encoded as a whole."""
        if not self.fast or any(s in text for s in self.special):
            return None
        if not text.isascii():
            if _OTHER.search(text):
                return None
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        return _SPLIT.findall(text.lower())

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = [self.split(t) for t in texts]
        new = set().union(*(f for f in found if f)) - self.cache.keys()
        if len(self.cache) + len(new) > _CACHE:
            self.cache = {}
            new = set().union(*(f for f in found if f))
        new = list(new)
        for w, e in zip(new, self.whole.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()
        cache = self.cache
        for t, f in zip(texts, found, strict=True):
            if f is None:
                yield np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                yield np.frombuffer(b"".join([cache[w] for w in f]), "<u4")
