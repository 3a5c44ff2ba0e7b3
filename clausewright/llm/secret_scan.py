"""Secrets in texts: keyword prefilter, anchored patterns near hits, checksums inside the tokens.

1. One Aho-Corasick pass over the lower-cased bytes of a text finds every keyword that a rule can begin with.  Runs of hexadecimal
   digits have no keyword; their prefilter is the length of the run, in numpy over many texts at once.
2. A rule's pattern is tried at its own hits only, from left to right, and never before the end of its last match: that gives the
   leftmost matches that do not overlap, as a scan of the whole text would.
3. Tokens of known formats count only if the checksum that they carry is right: CRC-32 in base 62 at the end of ``gh?_`` and
   ``npm_`` tokens, a doubled SHA-256 in base-58 extended private keys.

Each row is worked on by itself (no shuffle), and a text is held once, with one byte copy.  Case is folded for ASCII letters only.

Defined results: null and empty texts hold nothing; texts are read whole, however long; spans are code points, end exclusive, in
order of start and then of the rules; rules do not hide each other's spans; repeated rows and null doc_ids each give their row;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import map_arrow

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX_LEAST = 24
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_SPANS = "array<struct<kind:string,start:long,end:long>>"


def crc_base62(token: bytes) -> bool:
    """Whether the last six digits are the CRC-32, in base 62, of what stands before them (after the prefix)."""
    body, said = token[token.index(b"_") + 1 : -6], token[-6:]
    n = 0
    for c in said:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body)


def base58_check(token: bytes) -> bool:
    """Whether the last four of 82 bytes begin the SHA-256 of the SHA-256 of the others."""
    n = 0
    for c in token:
        n = n * 58 + BASE58.index(c)
    if n >> 82 * 8:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the lower-case keywords it begins with, its pattern, and what a match must hold."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    valid: Callable[[re.Match[bytes]], bool]


RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= HEX_LEAST),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: crc_base62(m[0])),
    Rule("npm", ("npm_",), re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: crc_base62(m[0])),
    Rule("xprv", ("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"), lambda m: base58_check(m[0])),
)
BASE = ("assign", "access", "hex")


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for n, rule in enumerate(RULES):
        for word in rule.keywords:
            found.add_word(word, (n, len(word)))
    found.make_automaton()
    return found


def near_hits(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of what the rules with keywords find in one text."""
    hits: dict[int, list[int]] = {}
    for last, (n, size) in _automaton().iter(raw.lower().decode("latin-1")):  # one character a byte
        hits.setdefault(n, []).append(last + 1 - size)
    out = []
    for n, starts in hits.items():
        rule, end = RULES[n], 0
        for start in sorted(starts):
            if start >= end and (m := rule.pattern.match(raw, start)):
                end = m.end()
                if rule.valid(m):
                    out.append((start, n, end))
    return out


def found_in(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """(start, rule, end) in code points of every text of a piece, in order."""
    begun, ended = ta.runs(_HEX[data], offsets)
    long = ended - begun >= HEX_LEAST
    begun, ended = begun[long], ended[long]
    cuts = np.searchsorted(begun, offsets).tolist()
    hexes = next(n for n, r in enumerate(RULES) if r.kind == "hex")
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = data[a:b]
        found = near_hits(text.tobytes())
        found += [(s - a, hexes, e - a) for s, e in zip(begun[cuts[i] : cuts[i + 1]].tolist(), ended[cuts[i] : cuts[i + 1]].tolist())]
        if found and len(text) and text.max() > 127:
            place = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            found = [(int(place[s]), n, int(place[e])) for s, n, e in found]
        yield sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in ta.pieces(batch.column("text")):
            spans = [[{"kind": RULES[n].kind, "start": s, "end": e} for s, n, e in found] for found in found_in(data, offsets)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(spans, kind)], ["doc_id", "found"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found (kind, start, end of every secret) for each row of ``docs``."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, f"doc_id long, found {_SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]``; of overlapping secrets the first, grown to the end of all."""
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("text"))
            texts = []
            for low, _, data, offsets in ta.pieces(column):
                for i, found in enumerate(found_in(data, offsets), low):
                    text, out, at = column[i].as_py(), [], 0
                    for s, n, e in found:
                        if s >= at:
                            out += [text[at:s], f"[{RULES[n].kind}]"]
                        at = max(at, e)
                    texts.append("".join(out) + text[at:] if found else text)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, run, docs.schema)


def shown(found: str, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of a column of ``find_secrets``, comma-joined."""
    spans = F.col(found) if kinds is None else F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: str, kind: str):
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
