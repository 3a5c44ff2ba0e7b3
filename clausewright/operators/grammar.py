"""Sentences parsed where they stand, and what their arcs say: who must do what, and when.

Both functions are narrow (no shuffle), in Arrow batches cut to a bounded number of sentences.  Defined results: null and blank
sentences give empty arrays; other columns pass through, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import arcs, rules
from .words import CONDITION_MARKERS, DELEGATING_VERBS, NOT_ACTORS, REQUESTING_VERBS

#: Sentences of a batch.
STEP = 2048
# What a task's phrase leaves out, and the modal verbs.
NOT_IN_PHRASE = ("nsubj", "nsubjpass", "csubj", "csubjpass", "aux", "auxpass", "neg", "advcl", "conj", "cc", "punct")
MODALS = ("shall", "may", "should", "must")
REQUIRED = "is required to"

_WORD = pa.struct([("i", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("head", pa.int32()), ("dep", pa.string())])
_TASK = pa.struct([("verb", pa.string()), ("modality", pa.string()), ("kind", pa.string()), ("label", pa.string()), ("subjects", pa.list_(pa.string())), ("conditions", pa.list_(pa.string()))])
_WORD_DDL = "array<struct<i:int,text:string,start:int,end:int,tag:string,head:int,dep:string>>"
_TASK_DDL = "array<struct<verb:string,modality:string,kind:string,label:string,subjects:array<string>,conditions:array<string>>>"
_DETERMINER = re.compile(rf"(?i)^(?:{'|'.join(rules.DETERMINERS)})\s+")
_THING = re.compile(rf"(?i)(?:{'|'.join(NOT_ACTORS)})")
_NOISE = re.compile(rules.LABEL_NOISE)


def _mapped(rows: DataFrame, text: str, out: str, make: Callable[[list[str | None]], list | pa.Array], kind: pa.DataType, ddl: str) -> DataFrame:
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                some = batch.slice(a, STEP)
                made = make(some.column(names.index(text)).to_pylist())
                made = made if isinstance(made, pa.Array) else pa.array(made, pa.list_(kind))
                yield pa.RecordBatch.from_arrays([*some.columns, made], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` {ddl}")


def parsed(rows: DataFrame, text: str, out: str = "words") -> DataFrame:
    """``rows`` with the words of column ``text`` and their arcs (i, text, start, end, tag, head, dep) in column ``out``."""
    return _mapped(rows, text, out, arcs.parse, _WORD, _WORD_DDL)


class Sentence:
    """A parsed sentence: children of each word, phrases, subjects and conditions of verbs."""

    def __init__(self, words: list[dict]):
        self.words = words
        self.children: list[list[dict]] = [[] for _ in words]
        for w in words:
            if w["head"] >= 0:
                self.children[w["head"]].append(w)

    def under(self, word: dict, without: tuple[str, ...] = ()) -> list[dict]:
        """A word and what hangs on it, in order."""
        found, todo = [], [word]
        while todo:
            w = todo.pop()
            found.append(w)
            todo += [c for c in self.children[w["i"]] if c["dep"] not in without]
        return sorted(found, key=lambda w: w["i"])

    def phrase(self, verb: dict) -> str:
        said = " ".join(w["text"] for w in self.under(verb, NOT_IN_PHRASE))
        return " ".join(_NOISE.sub("", said).split())

    def name(self, noun: dict) -> str | None:
        """The noun group without its determiner; null for pronouns and things."""
        if noun["tag"] in ("PRON", "REL", "DET"):
            return None
        group = [w for w in self.children[noun["i"]] if w["dep"] in ("det", "amod", "compound", "nummod") and w["i"] < noun["i"]]
        name = _DETERMINER.sub("", " ".join(w["text"] for w in [*group, noun]))
        return None if _THING.match(name) else name

    def subjects(self, verb: dict) -> list[str]:
        """The agent, else the subject, else the subjects of the verb that this one hangs on."""
        while True:
            mine = self.children[verb["i"]]
            agents = [n for w in mine if w["dep"] == "agent" for n in self.children[w["i"]] if n["dep"] == "pobj"]
            found = [n for n in map(self.name, agents) if n] or [n for n in map(self.name, (w for w in mine if w["dep"] in ("nsubj", "nsubjpass"))) if n]
            if found or verb["dep"] not in ("ccomp", "xcomp", "conj") or verb["head"] < 0:
                return found
            verb = self.words[verb["head"]]

    def conditions(self, verb: dict) -> list[str]:
        clauses = [w for w in self.children[verb["i"]] if w["dep"] == "advcl"]
        marked = [w for w in clauses if any(c["dep"] == "mark" and c["text"].lower() in CONDITION_MARKERS for c in self.children[w["i"]])]
        return [" ".join(x["text"] for x in self.under(w) if x["dep"] != "punct") for w in marked]

    def modal_verbs(self) -> Iterator[tuple[dict, str]]:
        """Each verb with a modal, and the modality."""
        for w in self.words:
            if w["tag"] == "MODAL" and w["text"].lower() in MODALS and w["head"] >= 0:
                verb = self.words[w["head"]]
                first = next(c for c in self.children[verb["i"]] if c["tag"] == "MODAL")
                if first is w:
                    negated = any(c["dep"] == "neg" for c in self.children[verb["i"]])
                    yield verb, w["text"].lower() + (" not" if negated else "")
            elif w["text"].lower() == "required" and any(c["dep"] == "auxpass" for c in self.children[w["i"]]):
                if not any(c["tag"] == "MODAL" for c in self.children[w["i"]]):
                    yield from ((c, REQUIRED) for c in self.children[w["i"]] if c["dep"] == "xcomp")

    def tasks(self) -> Iterator[dict]:
        for verb, modality in self.modal_verbs():
            conditions = self.conditions(verb)
            task = lambda v, said, kind, more=(): {"verb": v["text"], "modality": said, "kind": kind, "label": self.phrase(v), "subjects": self.subjects(v), "conditions": conditions + list(more)}
            yield task(verb, modality, "own")
            low = verb["text"].lower()
            mine = self.children[verb["i"]]
            if low in DELEGATING_VERBS or low in REQUESTING_VERBS:
                kind, more = ("handed", ()) if low in DELEGATING_VERBS else ("requested", ("if requested",))
                yield from (task(c, "shall", kind, more) for c in mine if c["dep"] in ("ccomp", "xcomp"))
            else:
                yield from (task(c, modality, "joined") for c in mine if c["dep"] == "conj" and c["tag"] == "VERB")


_GROUP = pa.struct([("name", pa.string()), ("verb", pa.string())])


def _group_places(words: list[dict]) -> list[tuple[list[int], int | None]]:
    """The places of the words of each noun group, and that of the verb whose subject it is."""
    children, out = Sentence(words).children, []
    for w in words:
        if w["tag"] in ("NOUN", "PROPN") and w["dep"] not in ("compound", "amod"):
            group = [c["i"] for c in children[w["i"]] if c["dep"] in ("det", "amod", "compound", "nummod") and c["i"] < w["i"]]
            out.append(([*group, w["i"]], w["head"] if w["dep"] in ("nsubj", "nsubjpass") else None))
    return out


def _groups(texts: list[str | None]) -> pa.Array:
    """The noun groups of sentences, as flat arrays; where they stand is worked out once a tree."""
    names, verbs, ends = [], [], [0]
    for parts in arcs.trees(texts):
        for tokens, tree in parts:
            if "groups" not in tree.worked_out:
                tree.worked_out["groups"] = _group_places(arcs.words_of([(tokens, tree)]))
            for places, verb in tree.worked_out["groups"]:
                names.append(_DETERMINER.sub("", " ".join([tokens[i][0] for i in places])))
                verbs.append(None if verb is None else tokens[verb][0])
        ends.append(len(names))
    columns = [pa.array(names, pa.string()), pa.array(verbs, pa.string())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_GROUP)))


def noun_groups(rows: DataFrame, text: str, out: str = "groups") -> DataFrame:
    """``rows`` with the noun groups of each sentence in column ``out``: name without determiner, and the verb whose subject it is (or null)."""
    return _mapped(rows, text, out, _groups, _GROUP, "array<struct<name:string,verb:string>>")


def modal_tasks(rows: DataFrame, text: str, out: str = "tasks") -> DataFrame:
    """``rows`` with the tasks of each sentence in column ``out``: verb, modality, kind (own, joined by a coordinator, handed on by a
    delegating verb, or requested), label (the verb's phrase), subjects and conditions."""
    return _mapped(rows, text, out, lambda texts: [list(Sentence(words).tasks()) for words in arcs.parse(texts)], _TASK, _TASK_DDL)
