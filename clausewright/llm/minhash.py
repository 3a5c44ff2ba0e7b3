"""Near-duplicate documents by a signature-coordinate inverted join, confirmed on full sets.

1. A scan gives each document its number of distinct shingles, two hashes of the set and a MinHash signature.
   Sets equal in both (128 bits) collapse to one node, so copies of any number cost one posting list entry.
2. Nodes are posted under (coordinate, value).  Two sets as similar as asked for agree in at least
   ``matches`` of the K coordinates (six standard deviations below the expectation at the threshold; a link
   right at the threshold is missed with a chance of 3.5e-8 at 85 % and 1.9e-8 at 80 %, the binomial tail).  Prefix: then they share one of the K - matches + 1 rarest
   coordinate values of each, so only those are posted, and values that a node shares with nobody use up
   the prefix without a posting.  Skip: in a list, members already connected are not counted again.
   Collisions are counted on the signatures; pairs at or above ``matches`` connect.
3. Connected candidates form clusters.  A cluster's texts meet once more, and links are confirmed exactly on
   full sets of shingle hashes.  Breadth-first search from each document over those not yet reached finds
   the components without visiting pairs inside one.  Lists of more members, and clusters of more members or
   shingles, than a task should hold are dealt into blocks, and each pair of blocks is a task: exact, and bounded.

Result: one row a document with its component; no pair list.  Defined results: null and empty texts, and texts
without a word, have no shingles and link with nothing; texts of fewer words than a shingle are one shingle;
null doc_ids take part, and a component's id is its least non-null doc_id (null if it has none); rows repeated
whole are copies of each other.  Texts are read whole, however long.  Only doc_id and text are read, other columns
pass through whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import components
from .storage import map_arrow, settle

COORDINATES = 64
#: Members of a posting list, documents of a cluster and their shingles, that one task takes together (of two blocks each).
LIST_BLOCK, CLUSTER_BLOCK, SHINGLE_BLOCK = 20_000, 4_000, 4_000_000
_rng = np.random.default_rng(64)
_FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)
#: Names that no input column is likely to bear.
_KEY, _MARK, _PLACE = "__near_row_key", "__near_row_mark", "__near_row_place"
#: A row and a set are known by two 64-bit hashes each.
_ROW, _SET = ["row_key", "row_mark"], ["set_key", "set_mark"]
_SETS = "doc_id long, row_key long, row_mark long, n_shingles long, set_key long, set_mark long, signature binary"


def least_matches(percent: int) -> int:
    """Coordinates in which sets of that similarity agree at the least."""
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 6 * math.sqrt(COORDINATES * p * (1 - p))))


def shingle_sets(col: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) a piece at a time."""
    for low, high, data, offsets in ta.pieces(col):
        starts, ends, cuts = ta.word_spans(data, offsets)
        words = ta.span_hashes(data, starts, ends, fold=True)
        whole = ta.windows(words, width)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= width:
                got = np.sort(whole[a : b - width + 1])
                if len(got) > 1:
                    got = got[np.concatenate([[True], got[1:] != got[:-1]])]
            elif b > a:
                got = ta.windows(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                got = np.zeros(0, np.uint64)
            out.append(got)
        yield low, out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, K) minima of K hash orders; every set must have a member."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * _FACTORS[k] + _SHIFTS[k], starts) >> np.uint64(32)
    return out


def set_hashes(members: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, the second from other hashes of its members."""
    other = ta.mix(members ^ _SHIFTS[0])
    pairs = [members.sum(dtype=np.uint64), np.bitwise_xor.reduce(ta.mix(members)), len(members)], [other.sum(dtype=np.uint64), np.bitwise_xor.reduce(ta.mix(other)), len(members)]
    key, mark = (int(ta.windows(np.array(p, np.uint64), 3)[0].astype(np.int64)) for p in pairs)
    return key, mark


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch.column("text"), width):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                signs: list[bytes | None] = [None] * len(sets)
                keys, marks = ([None] * len(sets) for _ in _SET)
                if len(full):
                    for i, s in zip(full.tolist(), signatures([sets[i] for i in full])):
                        signs[i] = s.tobytes()
                        keys[i], marks[i] = set_hashes(sets[i])
                span = slice(low, low + len(sets))
                rows = [batch.column(c)[span] for c in ("doc_id", *_ROW)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(n), pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", *_ROW, "n_shingles", *_SET, "signature"])

    return run


class Forest:
    """Union-find over 64-bit nodes; ``edges`` are the unions that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = min(a, b), max(a, b)
            self.up[high] = low
            self.edges.append((high, low))


def connect(nodes: np.ndarray, near, forest: Forest) -> None:
    """Breadth-first: ``near(i, rest)`` says which of ``rest`` link with i; what is reached isn't asked about again."""
    rest = np.arange(1, len(nodes))
    queue = [0] if len(nodes) else []
    while queue or len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        if not len(rest):
            break
        hit = near(i, rest)
        for j in rest[hit].tolist():
            forest.join(int(nodes[i]), int(nodes[j]))
            queue.append(j)
        rest = rest[~hit]


def _collisions(matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        key, nodes, signs = None, [], []

        def close() -> None:
            if len(nodes) < 2 or len({forest.find(x) for x in nodes}) == 1:
                return
            s = np.frombuffer(b"".join(signs), np.uint32).reshape(len(signs), COORDINATES)
            connect(np.array(nodes), lambda i, rest: (s[rest] == s[i]).sum(1) >= matches, forest)

        for batch in batches:
            for k, node, sign in zip(*(batch.column(c).to_pylist() for c in ("list", "node", "signature"))):
                if k != key:
                    close()
                    key, nodes, signs = k, [], []
                nodes.append(node)
                signs.append(sign)
            if len(forest.edges) > 50_000:
                yield table(forest.edges)
                forest.edges = []
        close()
        if forest.edges:
            yield table(forest.edges)

    return run


def table(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])


def link_cell(nodes: np.ndarray, sets: list[np.ndarray], percent: int, forest: Forest) -> None:
    """Exact links (100 * intersection >= percent * union) among the documents of a cell."""
    if len(nodes) < 2:
        return
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    seen = np.zeros(int(flat.max()) + 1, bool)
    held = {"rest": np.arange(len(nodes)), "flat": flat, "starts": starts}

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        if len(rest) * 2 < len(held["rest"]):  # compact what is still looked through
            held["flat"] = flat[ta.ranges(starts[rest], sizes[rest])]
            held["starts"] = np.cumsum(sizes[rest]) - sizes[rest]
            held["rest"] = rest
        mine = flat[starts[i] : ends[i]]
        seen[mine] = True
        both = np.add.reduceat(seen[held["flat"]], held["starts"], dtype=np.int64)
        seen[mine] = False
        if len(rest) != len(held["rest"]):
            both = both[np.searchsorted(held["rest"], rest)]
        return 100 * both >= percent * (sizes[rest] + sizes[i] - both)

    connect(nodes, near, forest)


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, edges = None, [], [], []

        def close() -> None:
            forest = Forest()
            link_cell(np.array(nodes), sets, percent, forest)
            edges.extend(forest.edges)

        for batch in batches:
            cells, members = batch.column("cell").to_pylist(), batch.column("node").to_pylist()
            for low, got in shingle_sets(batch.column("text"), width):
                for i, s in enumerate(got, low):
                    if cells[i] != key:
                        close()
                        key, nodes, sets = cells[i], [], []
                    nodes.append(members[i])
                    sets.append(s)
            if edges:
                yield table(edges)
                edges = []
        close()
        if edges:
            yield table(edges)

    return run


def _dealt(rows: DataFrame, key: str, parts: Column, out: str) -> DataFrame:
    """Each row with the cells of its group: one, or, of a group of several ``parts``, one for each of them."""
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = F.when(parts <= 1, F.array(F.xxhash64(key))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64(F.col(key), F.least(mine, j), F.greatest(mine, j)))
    )
    return rows.withColumn(out, F.explode(cells))


def _blocks(size: str, block: int) -> Column:
    return F.ceil(F.col(size) / F.lit(block)).cast("int")


def _keys(doc_id: Column) -> list[Column]:
    """Two hashes of a row, its columns hashed in either order."""
    return [F.xxhash64(doc_id, "text").alias("row_key"), F.xxhash64("text", doc_id).alias("row_mark")]


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept for each row of ``docs``; row_key is xxhash64(doc_id, text)."""
    return _with_components(docs, width, percent).drop("component", "row_mark")


def _with_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with component (a number, null without a shingle)."""
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), *_keys(doc_id), "text")
    sets = settle(map_arrow(keyed, _scan(width), _SETS), "sets")
    whole = sets.where("n_shingles > 0").groupBy(*_SET).agg(F.min(F.struct(*_ROW)).alias("row"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"))
    nodes = settle(whole.select(F.monotonically_increasing_id().alias("node"), *_SET, "row.*", "signature", "n_shingles"), "nodes")
    matches = least_matches(percent)
    prefix = COORDINATES - matches + 1

    # coordinate postings, their lengths, and each node's rarest
    tokens = map_arrow(nodes.select("node", "signature"), _tokens, "node long, token long")
    lengths = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(lengths, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("lists"))
    room = F.lit(prefix - COORDINATES) + F.size("lists")  # unshared values come first in the prefix
    posted = shared.where(room > 0).select("node", F.explode(F.slice("lists", F.lit(1), room)).alias("p")).select("node", F.col("p.token").alias("token"))
    posted = settle(posted, "postings")
    sizes = posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    lists = _dealt(posted.join(sizes, "token"), "token", _blocks("size", LIST_BLOCK), "list").select("list", "node")
    lists = lists.join(nodes.select("node", "signature"), "node")
    near = map_arrow(lists.repartition("list").sortWithinPartitions("list"), _collisions(matches), "a long, b long")
    clusters = settle(components(near), "clusters")

    # the texts of each cluster meet, one document a node
    sized = clusters.join(nodes.select("node", *_ROW, "n_shingles"), "node")
    members = sized.groupBy("label").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    parts = F.greatest(_blocks("size", CLUSTER_BLOCK), _blocks("shingles", SHINGLE_BLOCK))
    chosen = _dealt(sized.join(members, "label"), "label", parts, "cell").select(*_ROW, "node", "cell")
    texts = keyed.select(*_ROW, "text")
    once = texts.join(chosen, _ROW).dropDuplicates(["cell", "node"]) if _repeated(sets) else texts.join(chosen.hint("shuffle_hash"), _ROW)
    links = settle(map_arrow(once.repartition("cell").sortWithinPartitions("cell", "node"), _confirm(width, percent), "a long, b long"), "links")
    # a cell gives trees whose edges point to smaller nodes; they still want flattening
    labels = components(links)

    named = nodes.join(labels, "node", "left").select(*_SET, F.coalesce("label", "node").alias("component"))
    placed = sets.join(named, _SET, "left")
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", *_ROW, "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _repeated(sets: DataFrame) -> bool:
    """Whether a row occurs twice as a whole (then one of the two must be chosen)."""
    return not sets.groupBy(*_ROW).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(nodes), COORDINATES)
        tokens = signs.astype(np.int64) | np.arange(COORDINATES, dtype=np.int64)[None, :] << 32
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, COORDINATES)), pa.array(tokens.ravel())], ["node", "token"])


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one a component stays, columns unchanged: that with the least doc_id (null last), of
    several the one with the least hash of doc_id and text, and of rows equal in both the least by all columns."""
    found = settle(_with_components(docs, width, percent), "near")
    # without a shingle a row is a component of its own
    alone = found.where("n_shingles = 0").select(*_ROW)
    best = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", *_ROW)).alias("b")).select("b.row_key", "b.row_mark")
    keep = alone.union(best).distinct().toDF(_KEY, _MARK)
    key, mark = _keys(F.col("doc_id").cast("long"))
    rows = docs.withColumns({_KEY: key, _MARK: mark}).join(keep.hint("shuffle_hash"), [_KEY, _MARK], "left_semi")
    if _repeated(found):
        first = Window.partitionBy(_KEY, _MARK).orderBy(F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in docs.schema])))
        rows = rows.withColumn(_PLACE, F.row_number().over(first)).where(F.col(_PLACE) == 1).drop(_PLACE)
    return rows.drop(_KEY, _MARK)
