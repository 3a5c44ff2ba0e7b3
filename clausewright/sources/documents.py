"""Scans and sinks of texts, tables, organisation charts, task tables and process diagrams.

Every XML scan has an explicit schema: inference takes single children for scalars and numbers for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import deontic_badge, deontic_style, trim_all
from .scratch import Scratch

ORGANIGRAM = (
    "units STRUCT<unit: ARRAY<STRUCT<_id: STRING, parent: ARRAY<STRING>>>>, roles STRUCT<role: ARRAY<STRUCT<_id: STRING, parent: ARRAY<STRING>>>>, "
    "subjects STRUCT<subject: ARRAY<STRUCT<_id: STRING, _uid: STRING, relation: ARRAY<STRUCT<_unit: STRING, _role: STRING>>>>>"
)
TASK = (
    "_id STRING, label STRING, performers STRUCT<performer: ARRAY<STRUCT<unit: STRING, role: STRING>>>, deontic STRUCT<_type: STRING, _modality: STRING>, "
    "conditions STRUCT<condition: ARRAY<STRING>>, exceptions STRUCT<exception: ARRAY<STRUCT<_VALUE: STRING, _description: STRING, _ref: STRING>>>, "
    "`source-ref` STRUCT<_article: STRING, _paragraph: STRING>"
)
# The elements that count as each kind of diagram node.
ACTIVITIES = ["task", "userTask", "serviceTask", "sendTask", "receiveTask", "manualTask", "businessRuleTask", "scriptTask", "callActivity", "subProcess"]
EVENTS = ["startEvent", "endEvent", "intermediateThrowEvent", "intermediateCatchEvent", "boundaryEvent"]
GATEWAYS = ["parallelGateway", "exclusiveGateway", "inclusiveGateway", "eventBasedGateway", "complexGateway"]
DATA_OBJECTS = ["dataObjectReference"]
#: Elements of a batch that leaves the scan of diagrams.
ELEMENTS = 10_000


def decode(content: Column) -> Column:
    """UTF-8, else Latin-1; trimmed."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, file, text of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), decode(F.col("content")).alias("text"))


def pair_files(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Gold and predicted files of one name, with section and run from the predicted path's last folders."""
    parts = F.split(F.col("found_path"), "/")
    run, section = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("default_run")), F.coalesce(F.get(parts, F.size(parts) - 3), F.lit("default_section"))
    met = gold.select("file", F.col("path").alias("gold_path")).join(found.select("file", F.col("path").alias("found_path")), "file")
    return met.select("file", "gold_path", "found_path", section.alias("section"), run.alias("run"))


def with_source_text(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Paired files with ``source``: the first text file (by name) that begins with the same number, or null."""
    number = lambda c: F.regexp_extract(c, r"^([^_]*_)", 1)
    first = texts.where(F.col("file").endswith(".txt")).groupBy(number("file").alias("_n")).agg(F.min("file").alias("source"))
    return pairs.withColumn("_n", number("file")).join(first, "_n", "left").drop("_n")


def organigrams(xml: DataFrame, key: str = "model_id") -> dict[str, DataFrame]:
    """units, roles (name, parent or null, ord, par), bindings (subject, unit, role, ord, uid) of charts in a column ``xml``;
    blank ids are skipped, all parents and all relations with a unit and a role are kept; malformed charts are empty.
    ``ord`` is the place in the chart, ``par`` that of the parent in its element.  Charts are parsed once, when this is called, and what they hold is
    written to the shared folder."""
    bare = F.regexp_replace("xml", r"<(/?)\w+:", "<$1")
    parsed = xml.select(key, F.from_xml(bare, ORGANIGRAM, {"mode": "PERMISSIVE"}).alias("o"))
    relations = "array<struct<_unit:string,_role:string>>"

    def listed(path: str, kind: str) -> Column:
        parents = (lambda x: F.filter(F.transform(x["parent"], trim_all), lambda p: p != "")) if kind != "subject" else lambda x: F.lit(None).cast("array<string>")
        told = (lambda x: (x["_uid"], x["relation"])) if kind == "subject" else lambda x: (F.lit(None).cast("string"), F.lit(None).cast(relations))
        entry = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), F.trim(x["_id"]).alias("name"), parents(x).alias("parents"), told(x)[0].alias("uid"), told(x)[1].alias("relation"))
        return F.coalesce(F.transform(path, entry), F.array().cast(f"array<struct<kind:string,ord:int,name:string,parents:array<string>,uid:string,relation:{relations}>>"))

    # an outer explode, since a plain one has its array's size tested below it, which would parse twice
    every = F.concat(*[listed(f"o.{kind}s.{kind}", kind) for kind in ("unit", "role", "subject")])
    flat = Scratch(xml.sparkSession).write(parsed.select(key, F.explode_outer(every).alias("x")).where("x is not null").select(key, "x.*"))

    def named(kind: str) -> DataFrame:
        rows = flat.where((F.col("kind") == kind) & (F.col("name") != ""))
        return rows.select(key, "name", "ord", F.posexplode_outer("parents").alias("par", "parent")).select(key, "name", "parent", "ord", "par")

    subjects = flat.where("kind = 'subject'").select(key, F.col("ord").alias("_s"), F.col("name").alias("subject"), "uid", F.posexplode("relation").alias("_r", "r"))
    bound = subjects.select(key, "subject", F.trim("r._unit").alias("unit"), F.trim("r._role").alias("role"), F.struct("_s", "_r").alias("ord"), "uid").where("unit <> '' and role <> ''")
    return {"units": named("unit"), "roles": named("role"), "bindings": bound}


def first_relations(bindings: DataFrame, key: str = "model_id") -> DataFrame:
    """key, subject_no, unit, role: the first relation of each subject, if it has a unit and a role, in the chart's order."""
    return bindings.where("ord._r = 0").select(key, F.col("ord._s").alias("subject_no"), "unit", "role")


def first_parents(named: DataFrame, key: str = "model_id") -> DataFrame:
    """key, name, parent, ord: each unit or role once, with the first parent that the chart gives it, or null."""
    return named.where("par is null or par = 0").select(key, "name", "parent", "ord")


def task_elements(xml: DataFrame, key: str = "model_id") -> DataFrame:
    """key, ord, t: every task of task tables in a column ``xml`` as the format nests it (``TASK``)."""
    bare = F.regexp_replace(F.regexp_replace("xml", r"<(/?)\w+:", "<$1"), r"^\s*<\?xml[^>]*\?>", "")
    body = F.regexp_extract_all(bare, F.lit(r"(?s)<task\b.*?</task>"), F.lit(0))
    rows = xml.select(key, F.posexplode(body).alias("ord", "_x"))
    return rows.select(key, "ord", F.from_xml("_x", TASK, {"mode": "PERMISSIVE"}).alias("t"))


def _or_empty(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(f"array<{kind}>"))


_PERFORMER, _EXCEPTION = "struct<unit:string,role:string>", "struct<_VALUE:string,_description:string,_ref:string>"
_blank = lambda c: trim_all(F.coalesce(c, F.lit("")))


def tasks(xml: DataFrame, key: str = "model_id") -> DataFrame:
    """One row a labelled task, as evaluations read it; performers without unit and role are dropped, blank conditions too."""
    people = F.filter(_or_empty("t.performers.performer", _PERFORMER), lambda p: (_blank(p["unit"]) != "") | (_blank(p["role"]) != ""))
    stated = lambda part, field: F.when(F.col(f"t.{part}").isNotNull(), _blank(F.col(f"t.{part}.{field}")))
    return task_elements(xml, key).where(_blank(F.col("t.label")) != "").select(
        key,
        "ord",
        F.col("t._id").alias("task_id"),
        trim_all(F.col("t.label")).alias("label"),
        people.alias("performers"),
        F.lower(stated("deontic", "_type")).alias("deontic_type"),
        F.lower(stated("deontic", "_modality")).alias("deontic_modality"),
        F.filter(F.transform(_or_empty("t.conditions.condition", "string"), _blank), lambda c: c != "").alias("conditions"),
        _or_empty("t.exceptions.exception", _EXCEPTION).alias("exceptions"),
        stated("source-ref", "_article").alias("source_article"),
        stated("source-ref", "_paragraph").alias("source_paragraph"),
    )


def exception_texts(exceptions: Column) -> Column:
    """The description of each exception, else its text; blank ones go."""
    said = F.transform(exceptions, lambda e: F.coalesce(F.nullif(_blank(e["_description"]), F.lit("")), _blank(e["_VALUE"])))
    return F.filter(said, lambda x: x != "")


def described_tasks(xml: DataFrame, key: str = "model_id") -> DataFrame:
    """Every task as the description stage reads it: actors are the distinct roles in order, exceptions their descriptions,
    and what is missing is ``unknown``, ``shall`` or ``UNKNOWN``."""
    roles = F.filter(F.transform(_or_empty("t.performers.performer", _PERFORMER), lambda p: _blank(p["role"])), lambda r: r != "")
    described = F.filter(F.transform(_or_empty("t.exceptions.exception", _EXCEPTION), lambda e: _blank(e["_description"])), lambda x: x != "")
    return task_elements(xml, key).select(
        key,
        "ord",
        F.coalesce("t._id", F.lit("unknown")).alias("task_id"),
        F.array_distinct(roles).alias("actors"),
        F.coalesce("t.deontic._modality", F.lit("shall")).alias("deontic_modality"),
        _blank(F.col("t.label")).alias("label"),
        F.filter(F.transform(_or_empty("t.conditions.condition", "string"), _blank), lambda c: c != "").alias("conditions"),
        described.alias("exceptions"),
        F.coalesce("t.source-ref._article", F.lit("UNKNOWN")).alias("source_article"),
        F.coalesce("t.source-ref._paragraph", F.lit("UNKNOWN")).alias("source_paragraph"),
    )


def task_cards(xml: DataFrame, key: str = "model_id") -> DataFrame:
    """Every task as a page shows it: role else unit of each performer, style and badge of its deontic type (a type without a
    style shows its modality), and ``Art. a §p``."""
    kind = F.lower(F.coalesce("t.deontic._type", F.lit("")))
    name = lambda p: F.coalesce(F.nullif(_blank(p["role"]), F.lit("")), _blank(p["unit"]))
    article, paragraph = _blank(F.col("t.source-ref._article")), _blank(F.col("t.source-ref._paragraph"))
    return task_elements(xml, key).select(
        key,
        "ord",
        F.coalesce("t._id", F.lit("")).alias("task_id"),
        _blank(F.col("t.label")).alias("label"),
        kind.alias("deontic_type"),
        deontic_style(kind).alias("deontic_css"),
        deontic_badge(kind, F.coalesce("t.deontic._modality", F.lit(""))).alias("deontic_badge"),
        F.filter(F.transform(_or_empty("t.performers.performer", _PERFORMER), name), lambda n: n != "").alias("actors"),
        F.concat(F.when(article != "", F.concat(F.lit("Art. "), article)).otherwise(""), F.when(paragraph != "", F.concat(F.lit(" §"), paragraph)).otherwise("")).alias("source"),
    )


def first_performers(xml: DataFrame, key: str = "model_id") -> DataFrame:
    """key, task_no, task_id, label, role, unit: every task with its first performer; no role is empty, no unit ``*``."""
    first = F.get(_or_empty("t.performers.performer", _PERFORMER), 0)
    unit = F.coalesce(F.nullif(_blank(first["unit"]), F.lit("")), F.lit("*"))
    return task_elements(xml, key).select(key, F.col("ord").alias("task_no"), F.coalesce("t._id", F.lit("unknown")).alias("task_id"), _blank(F.col("t.label")).alias("label"), _blank(first["role"]).alias("role"), unit.alias("unit"))


def bpmn_elements(xml: DataFrame, key: str = "model_id") -> DataFrame:
    """Every element of process diagrams in one pass: tag, id, name, the enclosing process and lane, source and target,
    and for lane members the node they refer to.  Null and malformed diagrams give no row.  One diagram is held at a time, and
    its elements leave in batches of ``ELEMENTS``, however many there are."""
    from xml.etree import ElementTree

    text = ["tag", "id", "name", "process_id", "lane", "source", "target", "ref"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                at, place, *columns = zip(*out)
                out.clear()
                return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(place, pa.int64()), *[pa.array(c, pa.string()) for c in columns]], [key, "ord", *text])

            for n in range(batch.num_rows):
                try:
                    root = ElementTree.fromstring(batch.column("xml")[n].as_py() or "")
                except ElementTree.ParseError:
                    continue
                stack, place = [(root, None, None)], 0
                while stack:
                    node, process, lane = stack.pop()
                    tag = node.tag.rpartition("}")[2]
                    if tag == "process":
                        process = node.get("id")
                    if tag == "lane":
                        lane = node.get("name")
                    ref = (node.text or "").strip() if tag == "flowNodeRef" else node.get("processRef")
                    out.append((n, place, tag, node.get("id"), (node.get("name") or "").strip(), process, lane, node.get("sourceRef"), node.get("targetRef"), ref))
                    place += 1
                    stack.extend((child, process, lane) for child in reversed(node))
                    if len(out) >= ELEMENTS:
                        yield made()
            if out:
                yield made()

    kind = xml.schema[key].dataType.simpleString()
    return xml.select(key, "xml").mapInArrow(walk, f"{key} {kind}, ord long, {', '.join(f'{c} string' for c in text)}")


def bpmn_names(xml: DataFrame, key: str, kinds: dict[str, list[str]]) -> DataFrame:
    """key, kind, names: a row a diagram and kind that it has names of, with all of them as ``process_graph.element_names`` lists
    them.  A diagram is known whole once it is parsed, so no element leaves its task.  Null and malformed diagrams give no row."""
    from xml.etree import ElementTree

    at_tag = {tag: kind for kind, tags in kinds.items() for tag in tags}

    def named(root: ElementTree.Element) -> Iterator[tuple[str, list[str]]]:
        found: dict[str, list[str]] = {tag: [] for tag in at_tag}
        gates, out = [], {}
        for node in root.iter():
            tag = node.tag.rpartition("}")[2]
            if tag == "sequenceFlow":
                source = node.get("sourceRef")
                out[source] = out.get(source, 0) + 1
            elif tag in found or tag == "exclusiveGateway":
                name = (node.get("name") or "").strip()
                if name and tag in found:
                    found[tag].append(name)
                elif name and node.get("id") is not None:
                    gates.append((node.get("id"), name))
        for kind, tags in kinds.items():
            yield kind, [name for tag in tags for name in found[tag]]
        yield "conditions", [name for gate, name in gates if out.get(gate, 0) > 1]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kind, names, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                columns = [batch.column(key).take(pa.array(at)), pa.array(kind, pa.string()), pa.array(names, pa.list_(pa.string()))]
                at.clear(), kind.clear(), names.clear()
                return pa.RecordBatch.from_arrays(columns, [key, "kind", "names"])

            for n in range(batch.num_rows):
                try:
                    root = ElementTree.fromstring(batch.column("xml")[n].as_py() or "")
                except ElementTree.ParseError:
                    continue
                for k, some in named(root):
                    if some:
                        at.append(n), kind.append(k), names.append(some)
                        held += len(some)
                if held >= ELEMENTS:
                    yield made()
                    held = 0
            if at:
                yield made()

    return xml.select(key, "xml").mapInArrow(walk, f"{key} {xml.schema[key].dataType.simpleString()}, kind string, names array<string>")


def bpmn_flows(xml: DataFrame, key: str, nodes: list[str]) -> DataFrame:
    """key, pairs: a row a diagram that has any, with the names of the ends of its flows (source, target) as ``process_graph.control_flow``
    lists them; ``nodes`` are the tags that a flow may leave, in order.  No element leaves its task.  Null and malformed diagrams give no row."""
    from xml.etree import ElementTree

    place = {tag: n for n, tag in enumerate(nodes)}

    def listed(root: ElementTree.Element) -> list[dict]:
        first: dict[str, str] = {}
        left: dict[str, list[tuple]] = {}
        flows = []
        for n, node in enumerate(root.iter()):
            tag, at, name = node.tag.rpartition("}")[2], node.get("id"), (node.get("name") or "").strip()
            if name and at is not None:
                first.setdefault(at, name)
                if tag in place:
                    left.setdefault(at, []).append((place[tag], n, name))
            if tag == "sequenceFlow":
                flows.append((n, node.get("sourceRef"), node.get("targetRef")))
        met = sorted((p, m, n, name, first[target]) for n, source, target in flows if target in first for p, m, name in left.get(source, ()))
        return [{"source": x[3], "target": x[4]} for x in met]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string())]))
        for batch in batches:
            at, pairs, held = [], [], 0
            for n in range(batch.num_rows):
                try:
                    some = listed(ElementTree.fromstring(batch.column("xml")[n].as_py() or ""))
                except ElementTree.ParseError:
                    continue
                if some:
                    at.append(n), pairs.append(some)
                    held += len(some)
                if held >= ELEMENTS:
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(pairs, kind)], [key, "pairs"])
                    at, pairs, held = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(pairs, kind)], [key, "pairs"])

    return xml.select(key, "xml").mapInArrow(walk, f"{key} {xml.schema[key].dataType.simpleString()}, pairs array<struct<source:string,target:string>>")


def bpmn_counts(elements: DataFrame, key: str = "model_id") -> DataFrame:
    n = lambda tags: F.count_if(F.col("tag").isin(tags))
    roles = n(["pool", "lane"])
    return elements.groupBy(key).agg(
        n(ACTIVITIES).alias("activities"),
        n(EVENTS).alias("events"),
        n(GATEWAYS).alias("gateways"),
        n(["sequenceFlow"]).alias("edges"),
        F.when(roles > 0, roles).otherwise(n(["participant"])).alias("roles"),
    )


#: Fixed value: the namespace of charts.
ORGANISATION_NS = "http://cpee.org/ns/organisation/1.0"


def organigram_xml(units: DataFrame, roles: DataFrame, subjects: DataFrame, key: str = "model_id") -> DataFrame:
    """key, xml: charts as the scan reads them: units and roles (name, parent, ord, par) with their parents, subjects
    (subject, uid, unit, role, ord) with one relation each, all in the order of ``ord``, in the format's namespace, with an empty ``permissions`` for each
    unit and role."""
    after = lambda column: F.transform(F.array_sort(F.collect_list(F.struct("_o", "x"))), lambda s: s["x"]).alias(column)

    def listed(df: DataFrame, name: str) -> DataFrame:
        parents = F.transform(F.array_sort(F.collect_list(F.when(F.col("parent").isNotNull(), F.struct("par", "parent")))), lambda p: p["parent"])
        one = df.groupBy(key, "ord", "name").agg(parents.alias("parent"))
        return one.select(key, F.struct("ord", "name").alias("_o"), F.struct(F.col("name").alias("_id"), "parent", F.lit("").alias("permissions")).alias("x")).groupBy(key).agg(after(name))

    person = F.struct(F.col("subject").alias("_id"), F.col("uid").alias("_uid"), F.array(F.struct(F.col("unit").alias("_unit"), F.col("role").alias("_role"))).alias("relation"))
    people = subjects.select(key, F.struct("ord", "subject", "uid").alias("_o"), person.alias("x")).groupBy(key).agg(after("subject"))
    met = listed(units, "unit").join(listed(roles, "role"), key, "full_outer").join(people, key, "full_outer")
    return met.select(key, F.to_xml(F.struct(F.lit(ORGANISATION_NS).alias("_xmlns"), F.struct("unit").alias("units"), F.struct("role").alias("roles"), F.struct("subject").alias("subjects")), {"rowTag": "organisation"}).alias("xml"))
