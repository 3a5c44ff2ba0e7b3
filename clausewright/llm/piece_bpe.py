"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Many words are encoded at once.  Their symbols lie in one flat numpy array; a round finds the best rank
of any adjacent pair in each word (a segmented minimum), merges all its occurrences that don't overlap,
leftmost first, and compacts the arrays; words without a pair left are taken out.  The sequential
algorithm does the same merges: among pairs of equal score it goes from left to right, and only if
merging can create a pair of a better score - such pieces are known from the vocabulary - does the order
matter; of those a round merges the leftmost alone.

The model must be BPE with identity normalisation, a dummy prefix and byte fallback, and no piece may hold
a space mark after another character; then words (a run of space marks and what follows it) are
independent, and each distinct word is encoded once.

Defined results: a null text is empty and has no ids; characters outside the vocabulary give their
UTF-8 bytes' pieces; a literal U+2581 is taken as a space, as the library takes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow
from .textarrays import CACHES, ranges
from .wordbpe import slices

_WORD = re.compile("▁*[^▁]+|▁+")
_NONE = np.int32(2**31 - 1)
#: Distinct words a worker remembers; beyond it the memory starts anew (results don't change).
REMEMBERED = 300_000


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("a piece crosses words")
        self.bytes_at = sp.piece_to_id("<0x00>")
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        rank = {i: order[sp.get_score(i)] for i in plain}
        # characters that only occur inside longer pieces get numbers above the vocabulary's
        parts = dict(self.pieces)
        for p in self.pieces:
            for c in p:
                parts.setdefault(c, n + len(parts))
        self.char = {c: i for c, i in parts.items() if len(c) == 1}
        self.n = n
        pairs, unsafe = {}, np.zeros(n, bool)
        for p, i in self.pieces.items():
            for cut in range(1, len(p)):
                a, b = parts.get(p[:cut]), parts.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[i], i)
                    for half in (a, b):
                        if half < n and half in rank and rank[i] < rank[half]:
                            unsafe[half] = True
        self._hash(pairs)
        self.unsafe = unsafe
        # pieces of one and the same score must be the runs of space marks and come last of all
        shared = {p for p, i in self.pieces.items() if sum(1 for _ in p) > 1 and not p.strip("▁")}
        plural = {sp.get_score(i) for i in plain} if len(scores) == len(plain) else {sp.get_score(self.pieces[p]) for p in shared}
        if len(scores) < len(plain) and (plural != {scores[-1]} or any(rank[i] == len(scores) - 1 and p.strip("▁") for p, i in self.pieces.items())):
            raise ValueError("pieces of equal score other than runs of space marks")
        self.run_rank = len(scores) - 1 if len(scores) < len(plain) else -1
        self.runs = {len(p): self.pieces[p] for p in self.pieces if not p.strip("▁")}
        spelled = [(bytes([i - self.bytes_at]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in range(n)]
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.marked = np.array([sp.id_to_piece(i).startswith("▁") for i in range(n)])
        self.decimal = [str(i) for i in range(n)]
        self.known: dict[str, bytes] = {}
        CACHES.append(self.known)

    def _hash(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open-addressing table of pairs, so that looking many up is a few array operations."""
        self.bits = max(4, (len(pairs) * 4).bit_length())
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.ranks[at[take]], self.merged[at[take]] = keys[todo[take]], values[todo[take], 0], values[todo[take], 1]
            todo, at = todo[~take], (at[~take] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or none) and merged piece of each pair."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(keys)
        hit = self.keys[at] == keys
        rank, merged = np.where(hit, self.ranks[at], _NONE), self.merged[at]
        todo = np.flatnonzero(~hit & (self.keys[at] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.ranks[at[todo[hit]]], self.merged[at[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
        return rank, merged

    def space_run(self, n: int) -> list[int]:
        """Pieces of n space marks that no letter took: equal scores, so strictly from left to right."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                top = stack.pop()
                stack[-1] += top
        return [self.runs[k] for k in stack]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """ids (little-endian 16- or 32-bit, as ``kind`` says) of each word."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        number = np.array([self.char.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
        symbols = number[back].astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_owner = [], []

        def ranks_of(sym: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = sym[at], sym[at + 1]
            rank, merged = self.look_up(np.maximum(a, 0), np.maximum(b, 0))
            rank[(own[at] != own[at + 1]) | (a < 0) | (b < 0)] = _NONE
            return rank, merged

        rank, merged = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], merged[:-1] = ranks_of(symbols, owner, np.arange(len(symbols) - 1))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.concatenate([starts, [len(symbols)]]))
            over = np.repeat(best == _NONE, counts)
            if over.any():
                done_sym.append(symbols[over])
                done_owner.append(owner[over])
                keep = ~over
                symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
                counts, best = counts[best != _NONE], best[best != _NONE]
                if not len(symbols):
                    break
            if (best == self.run_rank).any():  # only leading space marks can still merge
                last = np.repeat(best == self.run_rank, counts)
                at = 0
                for word, size in zip(best == self.run_rank, counts):
                    if word:
                        mine = symbols[at : at + size].tolist()
                        lead = next((k for k, x in enumerate(mine) if x != self.runs[1]), size)
                        fixed = self.space_run(lead) + mine[lead:]
                        done_sym.append(np.array(fixed, np.int64))
                        done_owner.append(np.full(len(fixed), owner[at]))
                    at += size
                symbols, owner, rank, merged = symbols[~last], owner[~last], rank[~last], merged[~last]
                counts, best = counts[best != self.run_rank], best[best != self.run_rank]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(best, counts)
            at = np.flatnonzero(chosen)
            # of a run of overlapping pairs every second one, from the left
            fresh = np.concatenate([[True], np.diff(at) > 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            if self.unsafe[merged[at]].any():
                lead = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
                at = at[lead | ~self.unsafe[merged[at]]]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
            redo = np.concatenate([moved, moved - 1])
            redo = redo[(redo >= 0) & (redo < len(symbols))]
            last = redo == len(symbols) - 1
            rank[redo[last]] = _NONE
            redo = redo[~last]
            if len(redo):
                rank[redo], merged[redo] = ranks_of(symbols, owner, redo)
        symbols = np.concatenate(done_sym) if done_sym else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        odd = (symbols < 0) | (symbols >= self.n)
        if odd.any():  # bytes of what the vocabulary lacks
            names = {v: k for k, v in self.char.items() if v >= self.n}
            spelled = [[int(s)] if not o else [self.bytes_at + b for b in (names[int(s)] if s >= 0 else chr(-1 - int(s))).encode("utf-8", "surrogatepass")] for s, o in zip(symbols, odd)]
            owner = np.repeat(owner, [len(x) for x in spelled])
            symbols = np.array([i for x in spelled for i in x], np.int64)
        ids, cuts = symbols.astype("<u4"), np.searchsorted(owner, np.arange(len(words) + 1))
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each whole text, as ``SentencePieceProcessor.encode``."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        split = [_WORD.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in known})
        for low in range(0, len(fresh), 100_000):
            known.update(zip(fresh[low : low + 100_000], self.encode_words(fresh[low : low + 100_000])))
        return [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ``ids`` spell, as ``SentencePieceProcessor.decode``."""
        ids = ids.astype(np.int64)
        starts = self.spelled_at[ids]
        out = self.spelled[ranges(starts, self.spelled_at[ids + 1] - starts)]
        if len(ids) and self.marked[ids[0]]:
            out = out[1:]
        content = out.tobytes()
        try:
            content.decode()
        except UnicodeDecodeError:  # only ids that no text has: each stray byte becomes U+FFFD
            content = content.decode("utf-8", "replace").encode()
        return content


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model a Python worker and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model: str, texts_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on demand, ids (array) and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts_too else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_model(model)
        decimal = coder.decimal
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in slices(texts):
                got = coder.encode(texts[low:high])
                sums = [hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest() for ids in got]
                back = [coder.decode(ids) for ids in got]
                cols = [batch.column("doc_id").slice(low, high - low), pa.array([len(x) for x in got], pa.int64()), pa.array(sums), pa.array([hashlib.sha256(b).hexdigest() for b in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts_too:
                    cols += [pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([b.decode() for b in back])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
