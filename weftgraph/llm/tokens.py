"""Token ids of whole texts by a public BPE tokenizer file, as packed 32-bit ids.

A tokenizer whose file has the settings below folds case, splits at white space
and never merges over it, so for texts of well-known characters the ids of each
blank-free chunk can be kept and joined.  All other texts, and all texts under
any other file, go through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from array import array

#: Letters and marks whose case folding and composition are plain, one to one.
_LETTERS = "a-zß-öø-ÿ"
_MARKS = "¡§«·»¿×÷©®°±£€–—‘’“”„•…"
_PLAIN = re.compile(f"[\\x00-\\x7fÀ-ÿ{_MARKS}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\r\x0b\x0c0-9{_LETTERS}]+")
#: The settings of a file for which chunks may be kept.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
#: Entries of each of a worker's tables of chunks; the older half is forgotten first.
CACHED = 120_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Two generations of computed values."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PackedTokenizer:
    """``ids(text)``: the little-endian 32-bit ids of a text, without special tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        settings = json.loads(self.whole.to_str())
        added = settings["added_tokens"]
        self.special = [t["content"] for t in added]
        self.by_chunks = (
            (settings["normalizer"], settings["pre_tokenizer"], settings["model"]["type"]) == (_NORMALIZER, _PRE_TOKENIZER, "BPE")
            and not (settings["truncation"] or settings["padding"] or settings["model"]["dropout"])
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added)
        )
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.pieces = _Kept(self._piece)
        self.chunks = _Kept(self._chunk)

    def _piece(self, piece: str) -> bytes:
        spelled = "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk.decode())))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_chunks or not (text.isascii() or _PLAIN.fullmatch(text)) or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().encode().split()))


_LOADED: dict[str, PackedTokenizer] = {}


def tokenizer(path: str) -> PackedTokenizer:
    if path not in _LOADED:
        _LOADED[path] = PackedTokenizer(path)
    return _LOADED[path]
