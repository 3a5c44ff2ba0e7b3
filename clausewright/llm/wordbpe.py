"""Byte-pair encoding of many texts, with the ids that the ``tokenizers`` library gives.

The library's own ``encode`` spends most of its time on bookkeeping that no caller here needs.  A vocabulary
whose merges stand in the order of their ids can be run by ``tiktoken``, which merges the pair of least id
first; the ranks are read from the library's own file, and their order is checked.  In a vocabulary with word
ends the last symbol of each pre-token is another one than inside it.  There, pre-tokens are found with
array operations on code points, and an END character behind each stands for the word end: the ids of
"symbol and END" precede those of all merges, so that pair is always merged first.

Texts with characters whose class may differ between regular-expression engines, texts that may hold an
added token, and texts with very long runs go whole to the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

#: Outside these characters, or where an added token may begin, the whole text goes to the library.
_ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f]")
#: The pre-token pattern of the byte-level vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What may follow an apostrophe that begins a pre-token.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")
WORD_END, END = "</w>", "\x01"
#: Longest run of blanks or of other characters that doesn't send a text to the library (merging takes the square of it).
LONGEST_RUN = 2_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that print as Latin-1
    characters stand for themselves, the others take the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)}


def _ranks(path: str) -> tuple[dict[bytes, int] | None, bool]:
    """(token bytes -> id, whether words have ends); None where the merges aren't in the order of the ids."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    ends = model["end_of_word_suffix"] == WORD_END
    added = {t["content"] for t in content["added_tokens"]}
    byte_of = {c: b for b, c in byte_characters().items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    singles = [i for t, i in model["vocab"].items() if t not in added and len(t.removesuffix(WORD_END) if ends else t) == 1]
    if not made or max(singles) >= made[0] or any(b <= a for a, b in zip(made, made[1:])):
        return None, ends
    out = {}
    for token, i in model["vocab"].items():
        if token not in added:
            end = ends and token.endswith(WORD_END)
            out[bytes(byte_of[c] for c in (token.removesuffix(WORD_END) if end else token)) + END.encode() * end] = i
    return out if len(out) == len(model["vocab"]) - len(added & model["vocab"].keys()) else None, ends


def _classes() -> np.ndarray:
    """Code point -> class, for the characters that are not odd."""
    out = np.full(0x250, _OTHER, np.uint8)
    for cp in range(len(out)):
        for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            if regex.match(pattern, chr(cp)):
                out[cp] = kind
    return out


class Encoder:
    """ids of whole texts, exactly as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        ranks, self.ends = _ranks(path)
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.class_of = _classes()
        pattern = rf"[^\s{END}]+{END}" if self.ends else BYTE_PATTERN
        self.fast = None if ranks is None else Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def _plain(self, text: str) -> bool:
        if self.fast is None or "<|" in text or _ODD.search(text):
            return False
        if len(text) <= LONGEST_RUN:
            return True
        blank = self.class_of[np.frombuffer(text.encode("utf-16-le"), "<u2")] == _SPACE
        turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        return int(np.diff(np.concatenate([[0], turns, [len(blank)]])).max()) <= LONGEST_RUN

    def _marked(self, texts: list[str]) -> list[str]:
        """Each text, lower-cased, with END behind every pre-token."""
        points = np.frombuffer("".join([t.lower() + "\n" for t in texts]).encode("utf-16-le"), "<u2")
        kind = self.class_of[points]
        last = np.zeros(len(points), bool)
        last[:-1] = kind[1:] != kind[:-1]
        last |= kind == _NUMBER
        last &= kind != _SPACE
        quotes = np.flatnonzero(points == ord("'"))
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != _OTHER)]
        for form in SHORT_FORMS:
            hit = quotes
            for k, c in enumerate(form, 1):
                hit = hit[np.minimum(hit + k, len(points) - 1) == hit + k]
                hit = hit[points[hit + k] == ord(c)]
            last[hit] = False
            last[hit + len(form)] = True
        ends = np.cumsum([len(t) + 1 for t in texts])
        moved = np.concatenate([[0], ends + np.cumsum(last)[ends - 1]]).tolist()
        at = np.flatnonzero(last)
        out = np.empty(len(points) + len(at), "<u2")
        shifted = np.arange(len(points))
        shifted[1:] += np.cumsum(last)[:-1]
        out[shifted] = points
        out[shifted[at] + 1] = ord(END)
        whole = out.tobytes().decode("utf-16-le")
        return [whole[a:b] for a, b in zip(moved, moved[1:])]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        plain = [self._plain(t) for t in texts]
        fast = [t for t, p in zip(texts, plain) if p]
        ready = iter(self._marked(fast) if self.ends and fast else fast)
        out = []
        for text, p in zip(texts, plain):
            ids = self.fast(next(ready)) if p else np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind)
            out.append(ids.astype(self.kind, copy=False))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: list, limit: int = 2 << 20):
    """Row ranges of about ``limit`` characters."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)
