"""A declarative chain of edits, run as one plan.

A specification maps edit names to parameters. It is checked and put in the fixed order of
execution before anything is planned; the edits then compose into one DataFrame plan per table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from quillmend import schema
from quillmend.functions import patterns
from quillmend.operators import _shared as s
from quillmend.operators import clean, convert, fill, media, report, values as edit
from quillmend.functions.text import ASCII_SPACE

# Order of execution. Record edits come first, then edits of whole batches.
RECORD_EDITS = ("create_values", "replace", "copy", "displace", "explode", "merge", "convert",
                "order_values", "properties_visibility", "fill_data", "fill_values", "remove",
                "thumbnails", "media_remove", "media_order")
BATCH_EDITS = ("explode_item", "page_manifest", "media_html", "media_source", "media_type",
               "media_visibility", "trim_values", "specify_datatypes", "clean_empty_values",
               "clean_languages", "clean_language_codes", "deduplicate_values")
CLEANING = ("trim_values", "specify_datatypes", "clean_empty_values", "clean_languages",
            "clean_language_codes", "deduplicate_values")
ITEM_EDITS = ("media_remove", "media_order", "explode_item", "page_manifest")
MEDIA_EDITS = ("media_html", "media_source", "media_type", "media_visibility")
NUMBERING_EDITS = ("copy", "displace", "explode", "merge", "order_values", "explode_item")
GAP_EDITS = ("replace", "remove", "trim_values", "deduplicate_values")
KINDS = ("items", "media", "item_sets", "annotations")


@dataclass(frozen=True)
class Edit:
    name: str
    params: dict


# ---------------------------------------------------------------- specification

def _visibility(params: Mapping) -> bool | None:
    value = params.get("visibility")
    if value is None or value == "":
        return None
    return bool(int(value)) if isinstance(value, str) else bool(value)


def _number(value) -> int | None:
    return int(value) if value not in (None, "") and int(value) else None


def _text(params: Mapping, name: str) -> str:
    return params.get(name) or ""


def _filters(params: Mapping, names: tuple[str, ...]) -> dict:
    found = {}
    for name in names:
        if name == "visibility":
            found[name] = _visibility(params)
        elif name == "languages":
            found[name] = patterns.split_list(s.as_list(params.get(name)))
        elif name == "datatypes":
            found[name] = [item for item in s.as_list(params.get(name)) if item]
        else:
            found[name] = _text(params, name)
    return found


def _create_values(p):
    # A value without payload is no error in a chain: the edit is left out.
    main = schema.DEFAULT_TYPES.main(_text(p, "datatype"))
    payload = p.get("value_resource_id") if main == "resource" else _text(p, "value").strip(ASCII_SPACE)
    prop = p.get("properties") or p.get("property")
    if not (prop and p.get("datatype") and payload):
        return None
    visible = _visibility(p)
    return dict(property=prop, datatype=p["datatype"], value=_text(p, "value"),
                uri_label=_text(p, "uri_label"), value_resource_id=_number(p.get("value_resource_id")),
                language=_text(p, "language"), visibility=True if visible is None else visible)


def _replace(p):
    if not (p.get("mode") and p.get("properties")):
        return None
    return dict(mode=s.choice("mode", p["mode"], edit.MODES), properties=s.as_list(p["properties"]),
                part=s.choice("value_part", _text(p, "value_part").strip() or "value", edit.PARTS),
                language=_text(p, "language").strip(ASCII_SPACE),
                language_clear=bool(p.get("language_clear")), **_from_to(p))


def _from_to(p):
    return dict(from_=_text(p, "from"), to=_text(p, "to"),
                prepend=_text(p, "prepend").lstrip(ASCII_SPACE),
                append=_text(p, "append").rstrip(ASCII_SPACE))


def _transfer(p):
    sources = [name for name in s.as_list(p.get("from")) if name != p.get("to")]
    if not (sources and p.get("to")):
        return None
    return dict(from_=sources, to=p["to"], datatype=p.get("datatype") or None,
                max_values=_number(p.get("max_values")),
                **_filters(p, ("datatypes", "languages", "visibility", "contains", "match")))


def _explode(p):
    if not (p.get("properties") and p.get("separator")):
        return None
    return dict(properties=s.as_list(p["properties"]), separator=p["separator"],
                contains=_text(p, "contains"), match=_text(p, "match"),
                max_values=_number(p.get("max_values")))


def _merge(p):
    return dict(properties=s.as_list(p["properties"])) if p.get("properties") else None


def _convert(p):
    if not (p.get("from") and p.get("to") and p.get("properties")) or p["from"] == p["to"]:
        return None
    site = p.get("uri_base_site") or ""
    base = p.get("uri_base") or ""
    kinds = tuple(schema.DEFAULT_TYPES.main(p[side]) for side in ("from", "to"))
    needed = {("resource", "uri"): base, ("uri", "resource"): base,
              ("uri", "literal"): p.get("literal_value"),
              ("literal", "resource"): p.get("resource_properties")}
    if not needed.get(kinds, True):
        return None
    return dict(from_=p["from"], to=p["to"], properties=s.as_list(p["properties"]),
                literal_value=p.get("literal_value") or None,
                strip_html=bool(p.get("literal_extract_html_text")),
                only_tagged=bool(p.get("literal_html_only_tagged_string")),
                preprocess=p.get("resource_value_preprocess") or "full",
                identifier_properties=s.as_list(p.get("resource_properties")),
                extract_label=bool(p.get("uri_extract_label")),
                uri_label=p.get("uri_label") or None, uri_base=base or None,
                uri_is_api=site == "api", uri_language=_text(p, "uri_language"),
                contains=_text(p, "contains"))


def _order_values(p):
    languages = patterns.split_list(s.as_list(p.get("languages")))
    if not (languages and p.get("properties")):
        return None
    return dict(languages=languages, properties=s.as_list(p["properties"]))


def _properties_visibility(p):
    visible = _visibility(p)
    if visible is None or not p.get("properties"):
        return None
    return dict(visible=visible, properties=s.as_list(p["properties"]),
                **_filters(p, ("datatypes", "languages", "contains")))


def _fill_data(p):
    owner = p.get("owner")
    if owner is None or not str(owner).strip().isdigit():
        return None
    return dict(owner_id=int(owner) or None)


def _fill_values(p):
    if p.get("mode") not in fill.MODES or not p.get("properties"):
        return None
    try:
        fill.precise_type(p["mode"], s.as_list(p.get("datatypes")), p.get("datatype") or None)
    except ValueError:
        return None
    return dict(mode=p["mode"], properties=s.as_list(p["properties"]),
                datatypes=s.as_list(p.get("datatypes")), datatype=p.get("datatype") or None,
                language=_text(p, "language"), update_language=p.get("update_language") or "keep",
                featured_subject=bool(p.get("featured_subject")))


def _remove(p):
    if not p.get("properties"):
        return None
    keep, most = _number(p.get("keep_max_values")), _number(p.get("max_values"))
    if keep and most:
        return None
    return dict(properties=s.as_list(p["properties"]), keep_max_values=keep, max_values=most,
                **_filters(p, ("datatypes", "languages", "visibility", "equal", "contains", "match")))


def _thumbnails(p):
    asset = _number(p.get("asset"))
    if p.get("mode") not in media.THUMBNAIL_MODES:
        return None
    if not asset and p["mode"] not in ("remove_primary", "delete"):
        return None
    return dict(mode=p["mode"], asset=asset)


def _media_remove(p):
    mode = p.get("mode")
    types, extensions = s.as_list(p.get("mediatypes")), patterns.split_list(s.as_list(p.get("extensions")))
    if mode not in media.REMOVE_MODES or (mode == "media_type" and not types) or (
            mode == "media_extension" and not extensions):
        return None
    return dict(mode=mode, media_types=types, extensions=extensions)


def _media_order(p):
    if p.get("order") not in media.ORDERS:
        return None
    return dict(order=p["order"], media_types=s.as_list(p.get("mediatypes")),
                extensions=patterns.split_list(s.as_list(p.get("extensions"))))


def _explode_item(p):
    return dict(mode=p["mode"]) if p.get("mode") in media.EXPLODE_MODES else None


def _page_manifest(p):
    if p.get("mode") not in media.PAGE_MODES:
        return None
    return dict(mode=p["mode"], skip_existing=p.get("process") == "skip")


def _media_text(p):
    params = _from_to(p)
    # Only these modes have nothing to do without a text.
    idle = p.get("mode") in ("raw", "raw_i", "html", "regex") and not "".join(params.values())
    if not p.get("mode") or idle:
        return None
    return dict(mode=p["mode"], **params)


def _media_type(p):
    source, target = _text(p, "from").strip().lower(), _text(p, "to").strip().lower()
    try:
        media.checked_media_type(target)
    except ValueError:
        return None
    return dict(from_=source, to=target) if source else None


def _media_visibility(p):
    visible = _visibility(p)
    if visible is None:
        return None
    return dict(visible=visible, media_types=s.as_list(p.get("media_types")),
                ingesters=s.as_list(p.get("ingesters")), renderers=s.as_list(p.get("renderers")))


CHECKS = {
    "create_values": _create_values, "replace": _replace, "copy": _transfer,
    "displace": _transfer, "explode": _explode, "merge": _merge, "convert": _convert,
    "order_values": _order_values, "properties_visibility": _properties_visibility,
    "fill_data": _fill_data, "fill_values": _fill_values, "remove": _remove,
    "thumbnails": _thumbnails, "media_remove": _media_remove, "media_order": _media_order,
    "explode_item": _explode_item, "page_manifest": _page_manifest, "media_html": _media_text,
    "media_source": _media_text, "media_type": _media_type, "media_visibility": _media_visibility,
}


def normalise(spec: Mapping) -> list[Edit]:
    """The complete edits of a specification, cleaned, in order of execution."""
    if "explode_pdf" in spec:
        # Rendering is left to other tools; the edit plans the pages to render.
        spec = {**spec, "page_manifest": spec["explode_pdf"]}
        del spec["explode_pdf"]
    unknown = set(spec) - set(CHECKS) - {"cleaning"}
    if unknown:
        raise ValueError(f"unknown edits: {sorted(unknown)}")
    cleaning = spec.get("cleaning") or {}
    edits = []
    for name in (*RECORD_EDITS, *BATCH_EDITS):
        if name == "clean_language_codes":
            properties = cleaning.get("clean_language_codes_properties")
            if cleaning.get(name) and properties:
                edits.append(Edit(name, dict(
                    from_=cleaning.get("clean_language_codes_from") or None,
                    to=cleaning.get("clean_language_codes_to") or None,
                    properties=s.as_list(properties))))
        elif name in CLEANING:
            if cleaning.get(name):
                edits.append(Edit(name, {}))
        elif spec.get(name):
            params = CHECKS[name](spec[name])
            if params is not None:
                edits.append(Edit(name, params))
    return edits


def audit(spark, edits: list[Edit]) -> DataFrame:
    """The applied edits as a table."""
    rows = [(i + 1, e.name, json.dumps(e.params, ensure_ascii=False, sort_keys=True))
            for i, e in enumerate(edits)]
    return spark.createDataFrame(rows, "step INT, edit STRING, params STRING")


# ---------------------------------------------------------------- counts

class EditCounts:
    """What each edit added, changed and removed, observed while the tables of the chain are written:
    nothing is computed again for it.

    Rows carry a print of what they said before an edit. A task that is run again after an
    executor was lost may be counted again; `report.changes` compares two stored tables exactly.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._steps, self._last = spark, [], {}

    def start(self, t: dict) -> None:
        for name in ("values", "resources", "media"):
            if name in t:
                observed, seen = self._observed(t[name])
                t[name] = observed.withColumn(s.WAS, s.printed(observed, name))
                self._last[name] = seen

    def _observed(self, df: DataFrame, *more) -> tuple[DataFrame, Observation]:
        seen = Observation(f"edit-{uuid.uuid4().hex}")
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen

    def step(self, number: int, edit_name: str, t: dict) -> None:
        for name in _edited_tables(edit_name):
            if name == "pages":
                t[name], seen = self._observed(t[name])
                self._steps.append((number, edit_name, name, None, seen))
                continue
            now = s.printed(t[name], name)
            observed, seen = self._observed(
                t[name], F.count_if(F.col(s.WAS).isNull()).alias("added"), F.count_if(F.col(s.WAS) != now).alias("changed"))
            t[name] = observed.withColumn(s.WAS, now)
            self._steps.append((number, edit_name, name, self._last[name], seen))
            self._last[name] = seen

    def table(self) -> DataFrame:
        """(step, edit, table, added, changed, removed), once every returned table was written."""
        rows = []
        for number, edit_name, name, before, after in self._steps:
            found = after.get
            if before is None:
                rows.append((number, edit_name, name, found["rows"], 0, 0))
            else:
                kept = found["rows"] - found["added"]
                rows.append((number, edit_name, name, found["added"], found["changed"], before.get["rows"] - kept))
        return self._spark.createDataFrame(
            rows, "step INT, edit STRING, table STRING, added BIGINT, changed BIGINT, removed BIGINT")


def _edited_tables(name: str) -> tuple[str, ...]:
    if name == "explode_item":
        return ("resources", "media", "values")
    if name == "page_manifest":
        return ("pages",)
    if name in ("fill_data", "thumbnails"):
        return ("resources",)
    return ("media",) if name in (*MEDIA_EDITS, *ITEM_EDITS) else ("values",)


# ---------------------------------------------------------------- execution

def run_pipeline(tables: Mapping[str, DataFrame], spec: Mapping, *, sel=None,
                 kind: str | None = None, count_edits: bool = False,
                 types: schema.DataTypes = schema.DEFAULT_TYPES) -> dict[str, DataFrame]:
    """Apply a specification to the tables ``values``, ``resources`` and ``media``.

    Optional tables: ``authority``, ``places``, ``vocab``, ``annotation_values``,
    ``page_counts``. `sel` picks records, `kind` limits them to one kind: items take every edit,
    media those of values and media files, other kinds those of values. Adds the tables
    ``audit``, ``counts`` and, when asked for, ``pages``. With `count_edits` it adds ``edit_counts``,
    an :class:`EditCounts` that is filled when the tables are written.

    A selection by kind or by a table of ids is joined once: rows carry their mark through all edits.
    Value edits touch only properties a record had before the first edit. Positions are closed
    up once, at the end. The groups of values are measured first (one job on two columns): where
    none is hot, all numbering is done by plain windows on one partitioning. An edit of a table
    with hot groups reads its input twice; the lineage is cut between two such edits, so that
    no step is computed more than twice however long the chain is.
    """
    if kind is not None:
        s.choice("kind", kind, KINDS)
    t = dict(tables)
    before = t["values"]
    edits = [e for e in normalise(spec) if _in_reach(e.name, kind)]
    if s.group_rows(before) is None:
        group, record = s.largest_record(before)
        before = t["values"] = s.stamp(before, group)
        names = {e.name for e in edits}
        if record <= s.BLOCK_ROWS and names & {*NUMBERING_EDITS, *GAP_EDITS} and "explode_item" not in names:
            # Every record fits in one task: dealt by records once, no edit shuffles the rows again.
            t["values"] = s.stamp(before.repartition("resource_id"), group)
    sel = _selection(t["resources"], sel, kind)
    by = "id" if kind == "media" else "item_id"
    if isinstance(sel, DataFrame):
        _mark_tables(t, edits, sel, by)
    gated = any(e.name in ("create_values", "copy", "displace") for e in edits[:-1])
    if gated:
        t["values"] = t["values"].withColumn(s.GATE, F.lit(True))
    counts = EditCounts(before.sparkSession) if count_edits else None
    if counts is not None:
        counts.start(t)
    links_stay = not any(_makes_links(e, types) for e in edits)
    gaps, read_twice = False, False
    with s.chain(before):
        for number, step in enumerate(edits, 1):
            if gated and step.name in BATCH_EDITS:
                t["values"], gated = t["values"].drop(s.GATE), False
            gaps |= step.name in GAP_EDITS
            if _reads_twice(step, t["values"]):
                t["values"] = _single_read(t["values"], read_twice)
                read_twice = True
            _apply(step, t, sel, by, types, before if links_stay else None)
            if counts is not None:
                counts.step(number, step.name, t)
        t["values"] = t["values"].drop(s.GATE, s.MARK, s.WAS)
        if gaps:
            if not s.is_small(t["values"]):
                t["values"] = _single_read(t["values"], read_twice)
            t["values"] = s.close_up(t["values"])
    for name in ("resources", "media"):
        if name in t:
            t[name] = t[name].drop(s.MARK, s.WAS)
    t["audit"] = audit(before.sparkSession, edits)
    t["counts"] = report.changes(before, t["values"])
    if counts is not None:
        t["edit_counts"] = counts
    return t


def _mark_tables(t: dict, edits: list[Edit], sel: DataFrame, by: str) -> None:
    """Mark the selected rows of the tables that edits change."""
    names = {e.name for e in edits}
    if names - set(MEDIA_EDITS):
        values = t["values"]
        hot = [] if s.is_small(values) else s.hot_records(values)
        t["values"] = s.stamp(s.mark(values, sel, "resource_id", hot), s.group_rows(values))
    if names & {"fill_data", "thumbnails", "explode_item"}:
        t["resources"] = s.mark(t["resources"], sel, "id")
    if names & {*MEDIA_EDITS, *ITEM_EDITS}:
        t["media"] = s.mark(t["media"], sel, by)


def _reads_twice(step: Edit, values: DataFrame) -> bool:
    numbers = step.name in NUMBERING_EDITS or step.params.get("max_values") or step.params.get(
        "keep_max_values") or (step.name == "deduplicate_values" and s.MARK in values.columns)
    return step.name == "explode_item" or bool(numbers and not s.is_small(values))


def _makes_links(step: Edit, types: schema.DataTypes) -> bool:
    """The edit may add links to records that no value pointed to."""
    kind = {"create_values": "datatype", "convert": "to"}.get(step.name)
    return kind is not None and types.main(step.params[kind]) == "resource"


def _single_read(values: DataFrame, read_twice: bool) -> DataFrame:
    """Values that an edit may read twice although an edit before it did so too. The stored
    table is measured again: it may hold no hot group after all."""
    return s.measure_groups(s.cut_lineage(values)) if read_twice else values


def _in_reach(name: str, kind: str | None) -> bool:
    if kind in (None, "items"):
        return True
    return name not in ITEM_EDITS and (kind == "media" or name not in MEDIA_EDITS)


def _selection(resources: DataFrame, sel, kind: str | None):
    if kind is None:
        return sel
    chosen, condition = s.selected(resources, sel, "id")
    return chosen.where(condition & (F.col("resource_name") == kind)).select(
        F.col("id").alias("resource_id"))


def _apply(step: Edit, t: dict, sel, by: str, types: schema.DataTypes, linked: DataFrame | None) -> None:
    p, v, r, m = step.params, t["values"], t["resources"], t.get("media")
    name = step.name
    if name == "create_values":
        t["values"] = edit.create_values(v, r, **p, sel=sel, types=types)
    elif name == "replace":
        t["values"] = edit.replace(v, **p, sel=sel, renumber=False, types=types)
    elif name == "copy":
        t["values"] = edit.copy_values(v, **p, sel=sel, types=types)
    elif name == "displace":
        t["values"] = edit.displace_values(v, **p, sel=sel, types=types)
    elif name == "explode":
        t["values"] = edit.explode_values(v, **p, sel=sel)
    elif name == "merge":
        t["values"] = edit.merge_values(v, **p, sel=sel)
    elif name == "convert":
        t["values"] = convert.convert(v, r, **p, places=t.get("places"), vocab=t.get("vocab"),
                                      sel=sel, types=types)
    elif name == "order_values":
        t["values"] = edit.order_values(v, **p, sel=sel)
    elif name == "properties_visibility":
        t["values"] = edit.set_visibility(v, **p, sel=sel, types=types)
    elif name == "fill_data":
        t["resources"] = media.set_owner(r, **p, sel=sel)
    elif name == "fill_values":
        t["values"] = fill.fill_values(v, t.get("authority"), **p, sel=sel)
    elif name == "remove":
        t["values"] = edit.remove_values(v, **p, sel=sel, renumber=False, types=types)
    elif name == "thumbnails":
        t["resources"] = media.set_thumbnail(r, **p, sel=sel)
    elif name == "media_remove":
        t["media"] = media.remove_media(m, **p, sel=sel)
    elif name == "media_order":
        t["media"] = media.order_media(m, **p, sel=sel)
    elif name == "explode_item":
        t["resources"], t["media"], t["values"] = media.explode_items(r, m, v, **p, sel=sel)
    elif name == "page_manifest":
        t["pages"] = media.page_manifest(m, t["page_counts"], **p, sel=sel)
    elif name == "media_html":
        t["media"] = media.edit_media_html(m, **p, by=by, sel=sel)
    elif name == "media_source":
        t["media"] = media.edit_media_source(m, **p, by=by, sel=sel)
    elif name == "media_type":
        t["media"] = media.set_media_type(m, **p, by=by, sel=sel)
    elif name == "media_visibility":
        t["media"] = media.set_media_visibility(m, **p, by=by, sel=sel)
    elif name == "trim_values":
        t["values"] = clean.trim_values(v, sel=sel, renumber=False)
    elif name == "specify_datatypes":
        t["values"] = clean.specify_datatypes(v, r, sel=sel, linked=linked)
    elif name == "clean_empty_values":
        t["values"] = clean.clean_empty_values(v, sel=sel)
    elif name == "clean_languages":
        t["values"] = clean.clean_languages(v, sel=sel)
    elif name == "clean_language_codes":
        t["values"] = clean.clean_language_codes(v, **p, sel=sel)
    else:
        t["values"] = clean.deduplicate_values(
            v, annotation_values=t.get("annotation_values"), sel=sel, renumber=False)
