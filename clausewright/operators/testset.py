"""Executable testsets: the calls of a control-flow block, their roles, and the XML around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces and end points of the process engine's format.
DESCRIPTION_NS = "http://cpee.org/ns/description/1.0"
ANNOTATION_NS = "http://cpee.org/ns/annotation/1.0"
PROPERTIES_NS = "http://cpee.org/ns/properties/2.0"
ENDPOINTS = {
    "user": "https-post://cpee.org/services/timeout-user.php",
    "auto": "https-post://cpee.org/services/timeout-auto.php",
    "subprocess": "https-post://cpee.org/flow/start/url/",
    "timeout": "https-post://cpee.org/services/timeout.php",
    "send": "https-post://cpee.org/ing/correlators/message/send/",
    "receive": "https-get://cpee.org/ing/correlators/message/receive/",
}

_local = lambda e: e.tag.rpartition("}")[2]


def _block(text: str | None):
    """The first description element of a block, with or without a namespace; None if there is none."""
    try:
        root = ElementTree.fromstring((text or "").strip().lstrip("﻿"))
    except ElementTree.ParseError:
        return None
    spaced = f"{{{DESCRIPTION_NS}}}description"
    return next(root.iter(spaced), root if _local(root) == "description" else None)


def _inside(call, name: str) -> str:
    return next(((e.text or "").strip() for e in call.iter() if _local(e) == name and e is not call), "")


#: Rows of a batch that leaves a scan of blocks.
ROWS = 10_000


def _rows(names: list[str], kinds: list[pa.DataType], held: list[tuple]) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names)
    held.clear()
    return made


def calls(blocks: DataFrame, key: str = "job_id") -> DataFrame:
    """key, ord, call_id, label, role, path: every call of the control-flow blocks in a column ``xml`` with the elements
    that enclose it; a malformed block has none."""
    names = [key, "ord", "call_id", "label", "role", "path"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kinds = [], [batch.schema.field(key).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            for job, text in zip(batch.column(key).to_pylist(), batch.column("xml").to_pylist()):
                root = _block(text)
                stack = [] if root is None else [(root, [])]
                n = 0
                while stack:
                    node, path = stack.pop()
                    name = _local(node)
                    if name == "call":
                        out.append((job, n, node.get("id", ""), _inside(node, "label"), _inside(node, "role"), path))
                        n += 1
                    if len(node):
                        path = [*path, name]
                        stack.extend((child, path) for child in reversed(node))
                if len(out) >= ROWS:
                    yield _rows(names, kinds, out)
            if out:
                yield _rows(names, kinds, out)

    return blocks.select(key, "xml").mapInArrow(walk, f"{key} {blocks.schema[key].dataType.simpleString()}, ord int, call_id string, label string, role string, path array<string>")


def _settled(mapping: list[tuple], stated: list[tuple], called: list[tuple]) -> Iterator[tuple[str, str]]:
    """Role and unit of each call of a job.  Rows are (task_no or ord, call_id, label, lower-case label, role, unit), sorted by the first."""
    by_id, by_label, first, by_role, by_name, close = {}, {}, {}, {}, {}, {}
    for n, call_id, label, _, role, _ in stated:
        if role and n is not None:
            if call_id:
                by_id[call_id] = role
            if label:
                by_label[label] = role
    for n, _, label, low, role, unit in mapping:
        if n is None:
            continue
        if role:
            by_role[role] = unit
        if label is not None:
            by_name[label] = unit
            first.setdefault(low, role)

    def alike(label: str) -> str | None:
        best, found = None, None
        for n, _, other, _, role, _ in mapping:
            score = None if other is None else SequenceMatcher(None, label.lower(), other.lower()).ratio()
            rank = (-1.0 if score is None else score, float("-inf") if n is None else -n)
            if best is None or rank > best:
                best, found = rank, role
        return found

    for _, call_id, label, low, _, _ in called:
        role = by_id.get(call_id) or by_label.get(label)
        if role is None and label is not None:
            if label not in close:
                close[label] = first[low] if low in first else alike(label)
            role = close[label]
        role = role or ""
        yield role, by_role.get(role) or by_name.get(label) or "*"


def assign_roles(found: DataFrame, mapping: DataFrame, stated: DataFrame, key: str = "job_id") -> DataFrame:
    """found (key, ord, call_id, label) with role and unit.  The role is the stated one of the call's id, else of its label
    (the last of several), else that of the mapping's (key, task_no, label, role, unit) most similar label, first of ties;
    the unit is that of the role, else of the label, else ``*``.  Calls, stated ones and mapping are dealt by job in one shuffle and stream past
    sorted, so one job is held at a time; an equal label is the most similar one, so only labels without one are compared."""
    none = lambda name: F.lit(None).cast("string").alias(name)

    def side(rows: DataFrame, number: int, n: str, call_id, role, unit) -> DataFrame:
        return rows.select(key, F.lit(number).alias("_side"), F.col(n).cast("long").alias("_n"), call_id, "label", F.lower("label").alias("_low"), role, unit)

    alone = stated is found
    every = side(mapping, 0, "task_no", none("call_id"), F.col("role"), F.col("unit"))
    if not alone:
        every = every.unionByName(side(stated, 1, "ord", F.col("call_id"), F.col("role"), none("unit")))
    every = every.unionByName(side(found, 2, "ord", F.col("call_id"), F.col("role") if alone else none("role"), none("unit")))
    dealt = every.repartition(key).sortWithinPartitions(key, "_side", "_n")
    names = [key, "ord", "call_id", "label", "role", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, sides, out, kinds = None, ([], [], []), [], None

        def close() -> None:
            known, said, called = sides
            said = called if alone else said
            # a job without a key has no mapping
            met = _settled(known, said, called) if job is not None else (("", "*") for _ in called)
            out.extend((job, c[0], c[1], c[2], role, unit) for c, (role, unit) in zip(called, met))
            for rows in sides:
                rows.clear()

        for batch in batches:
            kinds = kinds or [batch.schema.field(key).type, pa.int64(), *[pa.string()] * 4]
            columns = [batch.column(c).to_pylist() for c in (key, "_side", "_n", "call_id", "label", "_low", "role", "unit")]
            for k, at, *row in zip(*columns):
                if k != job:
                    close()
                    job = k
                    if len(out) >= ROWS:
                        yield _rows(names, kinds, out)
                sides[at].append(tuple(row))
        close()
        if out:
            yield _rows(names, kinds, out)

    kind = found.schema[key].dataType.simpleString()
    rows = dealt.mapInArrow(run, f"{key} {kind}, ord long, call_id string, label string, role string, unit string")
    return rows.withColumn("ord", F.col("ord").cast(found.schema["ord"].dataType))


def _text(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attributes(node) -> str:
    value = lambda v: _text(v).replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;")
    return "".join(f' {name}="{value(v)}"' for name, v in node.attrib.items() if not name.startswith(f"{{{ANNOTATION_NS}}}"))


def _call(node, pad: str, orgmodel: str | None, form: str | None, role: str) -> str:
    """A call with worklist parameters, indented."""
    node.set("endpoint", "worklist")
    inner = pad + "    "
    element = lambda name, value: f"<{name}>{_text(value)}</{name}>" if value else f"<{name} />"
    said = "".join(f"{inner}  {element(name, value)}" for name, value in (("orgmodel", orgmodel), ("form", form), ("role", role), ("priority", "1"), ("handling", "single")))
    head = (node.text or "") if (node.text or "").strip() else pad + "  "
    return f"<call{_attributes(node)}>{_text(head)}<parameters>{inner}{element('label', _inside(node, 'label'))}{inner}<arguments>{said}{inner}</arguments>{pad}  </parameters>{pad}</call>"


def _written(node, pad: str, orgmodel: str | None, form: str | None, roles: Iterator[str], top: str = "") -> str:
    """An element of the format's namespace without annotations, indented, calls rebuilt; its tail is the caller's."""
    name = _local(node)
    if name == "call":
        return _call(node, pad, orgmodel, form, next(roles, ""))
    head = f"<{name}{top}{_attributes(node)}"
    if not len(node):
        return f"{head}>{_text(node.text)}</{name}>" if node.text else f"{head} />"
    blank = lambda s, other: _text(s) if s and s.strip() else other
    out = [f"{head}>", blank(node.text, pad + "  ")]
    last = len(node) - 1
    for n, child in enumerate(node):
        out += [_written(child, pad + "  ", orgmodel, form, roles), blank(child.tail, pad + "  " if n < last else pad)]
    return "".join([*out, f"</{name}>"])


def _plain(root) -> bool:
    """Whether all elements are of the format's namespace, no attribute of another than annotations, no call inside a call, and none deep."""
    spaced, noted, stack = f"{{{DESCRIPTION_NS}}}", f"{{{ANNOTATION_NS}}}", [(root, 0, False)]
    while stack:
        node, depth, called = stack.pop()
        call = node.tag == spaced + "call"
        if not node.tag.startswith(spaced) or depth > 200 or (called and call) or any(a[0] == "{" and not a.startswith(noted) for a in node.attrib):
            return False
        stack.extend((child, depth + 1, called or call) for child in node)
    return True


def _rebuilt(root, orgmodel: str | None, form: str | None, numbered: Iterator[str]) -> str:
    if _plain(root):
        tail = _text(root.tail) if root.tail else ""
        top = f' xmlns="{DESCRIPTION_NS}"'
        return _written(root, "\n", orgmodel, form, numbered, top) + tail
    tag = lambda n: f"{{{DESCRIPTION_NS}}}{n}"
    for node in list(root.iter()):
        for name in [a for a in node.attrib if a.startswith(f"{{{ANNOTATION_NS}}}")]:
            del node.attrib[name]
    for node in [e for e in root.iter() if _local(e) == "call"]:
        label = _inside(node, "label")
        for child in list(node):
            node.remove(child)
        node.set("endpoint", "worklist")
        parameters = ElementTree.SubElement(node, tag("parameters"))
        ElementTree.SubElement(parameters, tag("label")).text = label
        arguments = ElementTree.SubElement(parameters, tag("arguments"))
        for name, value in (("orgmodel", orgmodel), ("form", form), ("role", next(numbered, "")), ("priority", "1"), ("handling", "single")):
            ElementTree.SubElement(arguments, tag(name)).text = value
    ElementTree.register_namespace("", DESCRIPTION_NS)
    ElementTree.indent(root, space="  ")
    return ElementTree.tostring(root, encoding="unicode")


def enriched(blocks: DataFrame, roles: DataFrame, key: str = "job_id") -> DataFrame:
    """key, xml: each block without annotations, its calls with worklist parameters.  ``blocks`` has key, xml, orgmodel and
    form; ``roles`` is what ``assign_roles`` gives.  A malformed block is null."""
    listed = roles.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role"))), lambda x: x["role"]).alias("_roles"))
    rows = blocks.join(listed, key, "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, known, orgmodel, form in zip(*(batch.column(c).to_pylist() for c in ("xml", "_roles", "orgmodel", "form"))):
                root = _block(text)
                out.append(None if root is None else _rebuilt(root, orgmodel, form, iter(known or [])))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.string())], [key, "xml"])

    return rows.mapInArrow(rebuild, f"{key} {blocks.schema[key].dataType.simpleString()}, xml string")


def worklist_calls(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """The columns of ``rows`` but ``xml``, and ord, label, role, orgmodel, form: the calls of enriched blocks, which are parsed once; a malformed block has none."""
    kept = [f for f in rows.schema if f.name != xml]
    names = ["label", "role", "orgmodel", "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for n, text in enumerate(batch.column(xml).to_pylist()):
                root = None if text is None else _block(text)
                for k, call in enumerate([] if root is None else (e for e in root.iter() if _local(e) == "call")):
                    said = {_local(e): e.text or "" for e in call.iter()}
                    at.append(n)
                    out.append((k, *(said.get(x, "") for x in names)))
            if out:
                held = batch.select([f.name for f in kept]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*held.columns, *[pa.array(c, pa.int32() if n == 0 else pa.string()) for n, c in enumerate(zip(*out))]], [*held.schema.names, "ord", *names])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("ord", T.IntegerType()), *[T.StructField(x, T.StringType()) for x in names]]))


def testset_facts(rows: DataFrame, xml: str) -> DataFrame:
    """The columns of ``rows`` but ``xml``, and worklist, orgmodel, creator, n_endpoints, n_calls of whole testsets, which are parsed once; a malformed one has nulls."""
    kept = [f for f in rows.schema if f.name != xml]
    kinds = {"worklist": T.StringType(), "orgmodel": T.StringType(), "creator": T.StringType(), "n_endpoints": T.IntegerType(), "n_calls": T.LongType()}
    p = f"{{{PROPERTIES_NS}}}"

    def facts(text: str | None) -> tuple:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return (None,) * len(kinds)
        path = lambda x: root.findtext("/".join(p + n for n in x.split("/")), "")
        inner = [e for d in root.findall(p + "description") for e in d if _local(e) == "description"]
        return path("endpoints/worklist"), path("attributes/organisation1"), path("attributes/creator"), sum(map(len, root.findall(p + "endpoints"))), sum(_local(e) == "call" for d in inner for e in d.iter())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
        for batch in batches:
            if batch.num_rows:
                said = zip(*map(facts, batch.column(xml).to_pylist()))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *[pa.array(c, t) for c, t in zip(said, types)]], [*[f.name for f in kept], *kinds])

    return rows.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in kinds.items()]]))


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


# Fixed value: the process engine's document around a block; slots are in braces.
TESTSET = """<?xml version="1.0" encoding="UTF-8"?>
<testset xmlns="{properties}">
  <executionhandler>ruby</executionhandler>
  <dataelements/>
  <endpoints>
    <user>{user}</user>
    <worklist>{worklist}</worklist>
    <auto>{auto}</auto>
    <subprocess>{subprocess}</subprocess>
    <timeout>{timeout}</timeout>
    <send>{send}</send>
    <receive>{receive}</receive>
  </endpoints>
  <attributes>
    <info>Worklist</info>
    <modeltype>CPEE</modeltype>
    <theme>extended</theme>
    <organisation1>{orgmodel}</organisation1>
    <creator>{creator}</creator>
    <author>{creator}</author>
    <design_stage>development</design_stage>
    <design_dir>Templates.dir</design_dir>
  </attributes>
  <description>
{inner}
  </description>
  <transformation>
    <description type="copy"/>
    <dataelements type="none"/>
    <endpoints type="none"/>
  </transformation>
</testset>
"""


def testset_xml(inner: Column, worklist: Column, orgmodel: Column, creator: str, endpoints: dict[str, str] | None = None) -> Column:
    """The whole testset around an enriched block, which is indented by four spaces."""
    fixed = {"properties": PROPERTIES_NS, "creator": creator, **ENDPOINTS, **(endpoints or {})}
    columns = {"worklist": _escaped(worklist), "orgmodel": _escaped(orgmodel), "inner": F.regexp_replace(inner, r"(?m)^", "    ")}
    parts = re.split(r"\{(\w+)\}", TESTSET)
    return F.concat(*[F.lit(part) if n % 2 == 0 else columns[part] if part in columns else F.lit(escape(fixed[part])) for n, part in enumerate(parts)])


def endpoint(base: Column, path: Column, method: str = "") -> Column:
    """scheme[-method]://host/path; https where the base has no scheme."""
    scheme = F.coalesce(F.nullif(F.regexp_extract(base, r"^([A-Za-z][\w+.-]*)://", 1), F.lit("")), F.lit("https"))
    host = F.regexp_extract(base, r"^(?:[A-Za-z][\w+.-]*://)?([^/?#]*)", 1)
    return F.concat(scheme, F.lit(f"-{method}://" if method else "://"), host, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def instance_number(job: Column) -> Column:
    """The first six hex digits of the job's md5 as a number."""
    return F.conv(F.substring(F.md5(job), 1, 6), 16, 10).cast("long")


def instance_uuid(job: Column) -> Column:
    """A UUID made of the job's md5, so that a task that runs twice writes the same."""
    digest = F.md5(F.concat(F.lit("instance "), job))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def worklist_xml(roles: DataFrame, orgmodel: Column, base: str, process: str = "Worklist", key: str = "job_id", instance: Column | None = None) -> DataFrame:
    """key, xml: one task for each distinct (call_id, label, role), the first of each.  Callback ids are random; the instance's UUID is
    ``instance``, or made from the job."""
    # dealt by the job alone, so that neither grouping shuffles texts of tasks
    first = roles.repartition(key).groupBy(key, "call_id", "label", "role").agg(F.min("ord").alias("ord"), F.min_by("unit", "ord").alias("unit"))
    number = instance_number(F.col(key).cast("string")).cast("string")
    rows = first.withColumn("_n", number).withColumn("_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
    element = lambda name, value: F.concat(F.lit(f"    <{name}>"), _escaped(value), F.lit(f"</{name}>\n"))
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"'))
    callback = F.concat(F.lit(base), "_n", F.lit("/callbacks/"), "_id", F.lit("/"))
    head = [attribute("callback_id", F.col("_id")), attribute("cpee_callback", callback), attribute("cpee_instance", F.col("_n")), attribute("cpee_base", F.lit(base)), attribute("instance_uuid", instance_uuid(F.col(key).cast("string")) if instance is None else instance), attribute("cpee_label", F.col("label")), attribute("cpee_activity", F.col("call_id")), attribute("orgmodel", orgmodel)]
    body = [element("process", F.concat(F.lit(f"{process} ("), "_n", F.lit(")"))), element("label", F.col("label")), element("role", F.col("role")), element("unit", F.col("unit"))]
    task = F.concat(F.lit("  <task"), *head, F.lit(">\n"), *body, F.lit('    <user uid="test">Tester</user>\n  </task>\n'))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", task.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(key).agg(F.concat(F.lit('<?xml version="1.0"?>\n<tasks>\n'), listed, F.lit("</tasks>")).alias("xml"))
