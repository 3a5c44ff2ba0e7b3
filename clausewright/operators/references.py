"""References of texts as spans: markers, citations of acts, internal references and lists of articles, joined by place.

One Arrow pass gives a table of spans with character and token offsets.  What must stand together meets in a cell: a marker and an
internal reference at the token where the one ends and the other begins (or one token later), a marker and a list of articles in a bin of
64 characters, of which a list's context of 60 touches two.  One grouping by text and cell joins both, so each text is scanned
once and shuffled once, and a cell holds no more spans than its characters can begin, however long a text is or however many rows
share a key.

Tokens are runs of letters and digits, and single other characters.  Every reading of a pattern counts: ``Article 5(2)`` is
``Article 5`` too, and ``Implementing Regulation (EU) 1/2020`` also a ``Regulation``.

Defined results: null and empty texts have no spans; texts are known by their keys and a hash of the text, so rows repeated whole count once
and null keys do not mix texts; a text of a null list of article numbers has none of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewriting import CONTEXT_WINDOW, REFERENCE_MARKERS
from ..functions.rules import ACT_TYPES

# Fixed values.
REFERENCE_TYPES = ["article", "paragraph", "section", "annex", "point", "recital", "schedule", "appendix"]
ACT_BODIES, ACT_ENDS = ["EU", "EC", "Euratom"], ["EU", "EC"]
ARTICLE_LIST = re.compile(r"\bArticles?\s+((?:\d+(?:\([0-9]+\))?)(?:\s*,\s*\d+(?:\([0-9]+\))?)*(?:\s*and\s*\d+(?:\([0-9]+\))?)?)", re.IGNORECASE)
ROMAN = re.compile(r"[IVXLCDM]{1,10}")

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
BIN = 64
MARKER, CONTEXT, CITATION, INTERNAL, LIST = "marker", "context", "citation", "internal", "articles"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("said", pa.string())])
_SPAN_DDL = "array<struct<kind:string,start:int,end:int,first:int,last:int,said:string>>"
_MARKER_WORDS = sorted(tuple(m.lower().split()) for m in REFERENCE_MARKERS)
#: Markers that hold no other: one of these stands wherever any does.
_CORES = [m for m in sorted({x.lower() for x in REFERENCE_MARKERS}) if not any(o != m and o in m for o in (x.lower() for x in REFERENCE_MARKERS))]
_CORE = re.compile("|".join(map(re.escape, _CORES)))


def _by_first(phrases: list[tuple[str, ...]]) -> dict[str, list[tuple[str, ...]]]:
    return {p[0]: [q for q in phrases if q[0] == p[0]] for p in phrases}


#: Phrases by the word that they begin with, so that most tokens are looked up once and compared with none.
_MARKERS_AT, _ACTS_AT = _by_first(_MARKER_WORDS), _by_first([tuple(a.lower().split()) for a in ACT_TYPES])
_INTERNAL_AT = {"art", *REFERENCE_TYPES}
_NUMBER = r"\d+(?:\(\d+\))?"


def _is_number(t: str) -> bool:
    return t.isdecimal()


def _citations(tokens: list[str], low: list[str], i: int) -> Iterator[int]:
    """Where a citation that begins at token i ends: (act) (EU) [No] n/n [/EU]."""
    for act in _ACTS_AT.get(low[i], ()):
        at = i + len(act)
        if tuple(low[i:at]) != act or tokens[at : at + 1] != ["("] or not set(tokens[at + 1 : at + 2]) & set(ACT_BODIES) or tokens[at + 2 : at + 3] != [")"]:
            continue
        at += 3
        numbered = tokens[at : at + 1] in (["No"], ["no"])
        at += numbered + (numbered and tokens[at + 1 : at + 2] == ["."])
        if len(tokens) >= at + 3 and _is_number(tokens[at]) and tokens[at + 1] == "/" and _is_number(tokens[at + 2]):
            yield at + 3
            if not numbered and tokens[at + 3 : at + 4] == ["/"] and set(tokens[at + 4 : at + 5]) & set(ACT_ENDS):
                yield at + 5


def _internals(tokens: list[str], low: list[str], i: int) -> Iterator[int]:
    """Where an internal reference that begins at token i ends."""
    word, rest = low[i], tokens[i + 1 : i + 6]
    if word == "art" and rest[:1] == ["."] and len(rest) > 1 and (_is_number(rest[1]) or ROMAN.fullmatch(rest[1])):
        yield i + 3
    if word not in REFERENCE_TYPES or not rest or not (_is_number(rest[0]) or ROMAN.fullmatch(rest[0])):
        return
    yield i + 2
    if word == "annex" and len(rest) > 3 and rest[1] == "," and rest[2].lower() == "point" and _is_number(rest[3]):
        yield i + 5
    if word == "article" and _is_number(rest[0]) and len(rest) > 3:
        if rest[1] == "(" and _is_number(rest[2]) and rest[3] == ")":
            yield i + 5
        if rest[1] == "," and rest[2].lower() == "paragraph" and _is_number(rest[3]):
            yield i + 5


def spans_of(text: str) -> list[dict]:
    """Every span of a text, by kind."""
    found = list(TOKEN.finditer(text))
    tokens = [m[0] for m in found]
    low = [t.lower() for t in tokens]
    out = []

    def add(kind: str, i: int, j: int) -> None:
        start, end = found[i].start(), found[j - 1].end()
        out.append({"kind": kind, "start": start, "end": end, "first": i, "last": j, "said": " ".join(text[start:end].split())})

    for i, word in enumerate(low):
        for words in _MARKERS_AT.get(word, ()):
            if tuple(low[i : i + len(words)]) == words:
                add(MARKER, i, i + len(words))
        if word in _ACTS_AT:
            for j in _citations(tokens, low, i):
                add(CITATION, i, j)
        if word in _INTERNAL_AT:
            for j in _internals(tokens, low, i):
                add(INTERNAL, i, j)
    lists = [{"kind": LIST, "start": m.start(), "end": m.end(), "first": -1, "last": -1, "said": m[1]} for m in ARTICLE_LIST.finditer(text)]
    if lists:
        small = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out += [{"kind": CONTEXT, "start": m.start(), "end": m.end(), "first": -1, "last": -1, "said": m[0]} for m in _CORE.finditer(small)]
    return out + lists


def spans(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text_hash, kind, start, end, first, last (tokens, end exclusive), said: one row a span."""
    read = rows.select(*keys, F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    names = [*keys, "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                found = pa.array([spans_of(t) if t else [] for t in some.column("_text").to_pylist()], pa.list_(_SPAN))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), found], [*names, "_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "_text")
    found = read.mapInArrow(run, f"{fields}, _spans {_SPAN_DDL}")
    return found.select(*names, F.explode_outer("_spans").alias("_s")).where("_s is not null").select(*names, "_s.*")


def _cells() -> Column:
    """Where a span may meet another: (true, a token) or (false, a bin of characters)."""
    at = lambda token, n: F.struct(F.lit(token).alias("token"), n.cast("int").alias("n"))
    bins = lambda x: F.floor(x / BIN)
    kind, start = F.col("kind"), F.col("start")
    return (
        F.when(kind == MARKER, F.array(at(True, F.col("last"))))
        .when(kind == INTERNAL, F.array(at(True, F.col("first")), at(True, F.col("first") - 1)))
        .when(kind == CONTEXT, F.array(at(False, bins(start))))
        .when(kind == LIST, F.array_distinct(F.array(at(False, bins(start - CONTEXT_WINDOW)), at(False, bins(start)))))
        .otherwise(F.array(at(True, F.lit(-2))))
    )


def marked(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text_hash, kind (citation, internal, articles), start, end, said: citations, internal references that a marker stands right
    before, or one token before, and lists of articles with a marker in the 60 characters before them."""
    names = [*keys, "text_hash"]
    found = spans(rows, keys, text)
    met = found.withColumn("cell", F.explode(_cells())).groupBy(*names, "cell").agg(F.collect_set(F.struct("kind", "start", "end", "said")).alias("_m"))
    of = lambda kind: F.filter("_m", lambda x: x["kind"] == kind)
    here = F.filter(of(LIST), lambda x: F.exists(of(CONTEXT), lambda c: (c["start"] >= x["start"] - CONTEXT_WINDOW) & (c["end"] <= x["start"])))
    stays = F.when(F.col("cell.token"), F.concat(of(CITATION), F.when(F.size(of(MARKER)) > 0, of(INTERNAL)).otherwise(F.slice("_m", 1, 0)))).otherwise(here)
    return met.select(*names, F.explode_outer(stays).alias("_x")).where("_x is not null").select(*names, "_x.*").distinct()


def external_numbers(said: Column, existing: Column) -> Column:
    """Numbers of a list of articles that the document lacks; all of them without numbers of its own."""
    numbers = F.regexp_extract_all(said, F.lit(_NUMBER), F.lit(0))
    own = F.coalesce(existing, F.array().cast("array<string>"))
    return F.when(F.size(own) == 0, numbers).otherwise(F.filter(numbers, lambda n: ~F.array_contains(own, n)))


def reference_rows(rows: DataFrame, keys: list[str], text: str, existing: str) -> DataFrame:
    """keys, reference, start, end, external: what a text refers to, an article of a list each.  ``existing`` holds the article numbers
    of the document; it must be the same in all rows of a key."""
    own = rows.groupBy(*keys).agg(F.first(existing, ignorenulls=True).alias("_own")) if keys else None
    found = marked(rows, keys, text).join(own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_own"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    listed = F.transform(external_numbers(F.col("said"), F.col("_own")), lambda n: F.struct(F.concat(F.lit("Article "), n).alias("reference"), F.lit(True).alias("external")))
    number = F.regexp_extract("said", r"\d+|[IVXLCDM]{1,10}", 0)
    outside = (F.size(F.coalesce("_own", F.array().cast("array<string>"))) == 0) | ~F.array_contains(F.coalesce("_own", F.array().cast("array<string>")), number)
    single = F.array(F.struct(F.col("said").alias("reference"), F.when(F.col("kind") == CITATION, F.lit(True)).otherwise(outside).alias("external")))
    each = F.when(F.col("kind") == LIST, listed).otherwise(single)
    return found.select(*keys, "start", "end", F.explode_outer(each).alias("_e")).where("_e is not null").select(*keys, "_e.reference", "start", "end", "_e.external")
