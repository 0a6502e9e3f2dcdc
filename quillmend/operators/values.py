"""Edits of the values of records: create, replace, copy, move, split, merge, order, remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmend import schema
from quillmend.functions import patterns, text
from quillmend.operators import _shared as s

# Parts of a value a replacement can rewrite, and replacement modes.
PARTS = ("value", "literal", "uri", "uri_label")
MODES = ("raw", "raw_i", "html", "unicode", "regex", "basename", "filename", "remove")


# ---------------------------------------------------------------- create

def create_values(values: DataFrame, resources: DataFrame, property: str, datatype: str, *,
                  value: str = "", uri_label: str = "", value_resource_id: int | None = None,
                  language: str = "", visibility: bool = True, sel=None,
                  types: schema.DataTypes = schema.DEFAULT_TYPES) -> DataFrame:
    """Append one value to a property of every selected record."""
    if not property or not datatype:
        raise ValueError("property and datatype are required")
    main = types.main(datatype)
    payload, label = value.strip(text.ASCII_SPACE), uri_label.strip(text.ASCII_SPACE)
    if not (value_resource_id if main == "resource" else payload):
        raise ValueError(f"a {main} value needs a payload")
    language = language.strip(text.ASCII_SPACE)
    new = {
        "property": F.lit(property),
        "type": F.lit(datatype),
        "lang": F.lit(language or None) if main == "literal" else F.lit(None),
        "value": F.lit({"literal": payload, "uri": label or None, "resource": None}[main]),
        "uri": F.lit(payload if main == "uri" else None),
        "value_resource_id": F.lit(value_resource_id if main == "resource" else None),
        "is_public": F.lit(bool(visibility)),
    }
    targets, condition = s.selected(resources, sel, "id")
    targets = targets.where(condition).select(F.col("id").alias("resource_id"))
    present = values.where(F.col("property") == property).groupBy("resource_id").agg(
        (F.max("pos") + 1).alias("_next"), (F.count(F.lit(1)) > F.count("pos")).alias("_loose"),
        *_gate_fact(values))
    added = targets.join(present, "resource_id", "left")
    # Behind values without a position, a new one has none either: unsaved rows come last.
    new["pos"] = F.when(F.coalesce(F.col("_loose"), F.lit(False)), F.lit(None)).otherwise(
        F.coalesce(F.col("_next"), F.lit(0)))
    if s.GATE in values.columns:
        new[s.GATE] = F.coalesce(F.col("_gate"), F.lit(False))
    if s.MARK in values.columns:
        new[s.MARK] = F.lit(True)
    return s.stamp(values.unionByName(_conform(added, values, new)), s.grown(values, 1, 1))


def _gate_fact(values: DataFrame) -> list[Column]:
    return [F.max(s.GATE).alias("_gate")] if s.GATE in values.columns else []


def _conform(df: DataFrame, like: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns of `like`, from `new`, else from `df`, else null, with the types of `like`."""
    def pick(field) -> Column:
        if field.name in new:
            c = new[field.name]
        elif field.name in df.columns:
            c = F.col(field.name)
        else:
            c = F.lit(None)
        return c.cast(field.dataType).alias(field.name)

    return df.select(*[pick(field) for field in like.schema.fields])


# ---------------------------------------------------------------- replace

def replace(values: DataFrame, mode: str, properties, *, part: str = "value", from_: str = "",
            to: str = "", prepend: str = "", append: str = "", language: str = "",
            language_clear: bool = False, sel=None, renumber: bool = True,
            types: schema.DataTypes = schema.DEFAULT_TYPES) -> DataFrame:
    """Rewrite one part of the values, then prepend, append, set or clear the language, then
    trim and drop the rows left empty (a label left empty is only cleared)."""
    s.choice("part", part, PARTS)
    s.choice("mode", mode, MODES)
    marked, condition = s.scope(values, properties, sel)
    is_uri = part in ("uri", "uri_label")
    column = "uri" if part == "uri" else "value"
    condition = condition & _part_guard(part, types)

    edited = text.rewrite(text.trim(F.coalesce(F.col(column), F.lit(""))), mode, from_, to)
    if prepend or append:
        edited = F.concat(F.lit(prepend), text.trim(edited), F.lit(append))
    if part == "uri_label":
        edited = text.blank_to_null(edited)
    else:
        edited = text.trim(edited)
    changes = {column: F.when(condition, edited).otherwise(F.col(column))}
    if language_clear or language:
        code = None if language_clear else language
        changes["lang"] = F.when(condition, F.lit(code)).otherwise(F.col("lang"))
    result = marked.withColumn("_hit", F.coalesce(condition, F.lit(False))).withColumns(changes)
    if part == "uri_label":
        return result.select(*values.columns)
    result = result.where(~F.col("_hit") | (F.col(column) != "")).select(*values.columns)
    return s.close_up(result) if renumber else result


def _part_guard(part: str, types: schema.DataTypes) -> Column:
    """Rows that have the part."""
    if part == "literal":
        return F.col("type") == "literal"
    main = types.main_column(F.col("type"))
    if part == "value":
        return (main == "literal") & text.is_blank(F.col("uri")) & F.col(
            "value_resource_id").isNull()
    return (main == "uri") & F.col("uri").isNotNull() & F.col("value_resource_id").isNull()


# ---------------------------------------------------------------- copy and displace

def copy_values(values: DataFrame, from_, to: str, *, datatype: str | None = None,
                max_values: int | None = None, sel=None,
                types: schema.DataTypes = schema.DEFAULT_TYPES, **flt) -> DataFrame:
    """Append the matching values of the source properties to the target property."""
    marked, hit = _transfer_rows(values, from_, to, max_values, sel, types, flt)
    # A matching row is followed by its copy, so the table is read once.
    both = marked.withColumn("_copy", F.explode(
        F.when(hit, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    moved = s.as_new(_moved(both, values.columns, F.col("_copy"), to, datatype), F.col("_from") != "")
    result = _append_in_order(moved, values, from_, to, F.col("property") == to, copies=True)
    return s.stamp(result, _transfer_bound(values, from_))


def displace_values(values: DataFrame, from_, to: str, *, datatype: str | None = None,
                    max_values: int | None = None, sel=None,
                    types: schema.DataTypes = schema.DEFAULT_TYPES, **flt) -> DataFrame:
    """Move the matching values of the source properties to the end of the target property."""
    marked, hit = _transfer_rows(values, from_, to, max_values, sel, types, flt)
    moved = _moved(marked, values.columns, hit, to, datatype)
    sources = s.as_list(from_)
    affected = F.lit(True) if s.ALL in sources else F.col("property").isin([*sources, to])
    result = _append_in_order(moved, values, from_, to, affected)
    return s.stamp(result, _transfer_bound(values, from_))


def _moved(rows: DataFrame, columns: list[str], moves: Column, to: str,
           datatype: str | None) -> DataFrame:
    """Rows with their new property, and in ``_from`` the one they came from (blank: stayed)."""
    marked = rows.withColumn("_moves", moves)
    new = {"property": F.lit(to)}
    if datatype:
        new["type"] = F.lit(datatype)
    return marked.select(
        *[F.when(F.col("_moves"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
          for c in columns],
        F.when(F.col("_moves"), F.col("property")).otherwise(F.lit("")).alias("_from"))


def _transfer_bound(values: DataFrame, from_) -> int | None:
    """A target property may receive one group per source."""
    sources = s.as_list(from_)
    return s.grown(values, None if s.ALL in sources else len(sources) + 1)


def _transfer_rows(values, from_, to, max_values, sel, types, flt) -> tuple[DataFrame, Column]:
    sources = [name for name in s.as_list(from_) if name != to]
    if not sources or not to:
        raise ValueError("a source property and another target property are required")
    if max_values is not None and max_values < 0:
        raise ValueError("max_values must be positive")
    unknown = set(flt) - {"datatypes", "languages", "visibility", "contains", "match"}
    if unknown:
        raise TypeError(f"unknown filters: {sorted(unknown)}")
    marked, condition = s.scope(values, sources, sel)
    hit = condition & (F.col("property") != to) & s.matches(
        payload=s.literal_payload(types), **flt)
    if not max_values:
        return marked, F.coalesce(hit, F.lit(False))
    columns = [*marked.columns, "_within"]
    marked = s.divert(marked.withColumn("_within", F.lit(False)), hit,
                      lambda rows: s.first_rows(rows.drop("_within"), max_values), columns)
    return marked, F.col("_within")


def _append_in_order(rows: DataFrame, values: DataFrame, from_, to: str,
                     affected: Column, copies: bool = False) -> DataFrame:
    """Place the rows of the affected properties: their own first, then those that came from
    each source, sources in the given order or, for all, in the order of their first saved
    identifier. Copies lose the identifier of their source once they are in order."""
    columns = list(values.columns)
    sources = s.as_list(from_)
    own = F.col("_from") == ""
    listed = F.array(*[F.lit(name) for name in sources])
    small = s.is_small(values)
    first, lead = None, [F.when(own, 0).otherwise(F.array_position(listed, F.col("_from")))]
    if s.ALL in sources:
        first = s.saved(values).groupBy("resource_id", F.col("property").alias("_from")).agg(
            F.min("value_id").alias("_first"))
        lead = [F.when(own, 0).otherwise(1), F.col("_first").asc_nulls_last(), F.col("_from")]

    def known(table: DataFrame) -> DataFrame:
        return table.join(first, ["resource_id", "_from"], "left")

    def number(part: DataFrame) -> DataFrame:
        if small and first is not None:
            part = known(part)
        part = part.withColumn("_source", F.col("_from"))
        numbered = s.running_start(
            part, s.GROUP, {"_from": F.col("_source"), "_block": s.row_block()}, s.row_order(),
            "_at", small=small, lead_order=lead, block_order=[*lead, F.col("_block")],
            with_facts=known if first is not None else None)
        numbered = numbered.withColumn(
            "pos", F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("pos")))
        if copies:
            numbered = numbered.withColumn("value_id", F.when(F.col("_source") == "", F.col("value_id")))
        return _open_where_saved(numbered, values, to) if s.GATE in columns else numbered

    return s.divert(rows, affected, number, columns)


def _open_where_saved(rows: DataFrame, values: DataFrame, to: str) -> DataFrame:
    """In a chain of edits, rows that reached a property the record did not have at first stay
    closed to the following edits."""
    present = s.saved(values).where(F.col("property") == to).select(
        "resource_id").distinct().withColumn("_present", F.lit(True))
    return rows.join(present, "resource_id", "left").withColumn(
        s.GATE, F.when(F.col("_source") == "", F.col(s.GATE))
        .otherwise(F.coalesce(F.col("_present"), F.lit(False))))


# ---------------------------------------------------------------- explode and merge

def explode_values(values: DataFrame, properties, separator: str, *, contains: str = "",
                   match: str = "", max_values: int | None = None, sel=None) -> DataFrame:
    """Split literals on a separator, one row per non-blank trimmed piece, in place."""
    separator = patterns.unescape_separator(separator)
    if not separator:
        raise ValueError("a separator is required")
    if not contains and not match:
        contains = separator
    marked, condition = s.scope(values, properties, sel)
    hit = condition & (F.col("type") == "literal") & s.matches(
        contains=contains, match=match, payload=F.col("value"))
    pieces = F.filter(F.transform(text.split_parts(F.col("value"), separator, max_values or None),
                                  text.trim), lambda piece: piece != "")
    # The pieces are counted before they are made: the rows shuffle unsplit, and a group is no
    # larger than it was.
    pieces = F.when(hit, pieces).otherwise(F.array(F.col("value")))
    numbered = s.running_start(
        marked.withColumn("_pieces", pieces), s.GROUP, {"_block": s.row_block()}, s.row_order(),
        "_at", small=s.is_small(values), weight=F.size("_pieces"))
    split = numbered.select("*", F.posexplode("_pieces").alias("_i", "_piece")).withColumns({
        "value": F.col("_piece"),
        "value_id": F.when(F.col("_i") == 0, F.col("value_id")),
        "_at": F.col("_at") + F.col("_i"),
    })
    split = s.as_new(split, F.col("_i") > 0)
    if s.in_chain() and s.is_small(values):
        # The edits that follow need to know: one job on the texts to split.
        most = marked.where(hit).groupBy(*s.GROUP).agg(F.sum(F.size(pieces)).alias("n")).agg(
            F.max("n")).first()[0]
        bound = s.grown(values, 1, most or 0)
    else:
        bound = s.grown(values, max_values if max_values and max_values > 0 else None)
    return s.placed(split, values.columns, bound)


def merge_values(values: DataFrame, properties, *, sel=None) -> DataFrame:
    """Pair the values of a property (first with second, third with fourth...) into labelled
    uris. A property is left as it is unless every pair holds exactly one web address (or the
    same one twice), no two uris, and no uri that has a label."""
    marked, condition = s.scope(values, properties, sel)
    merge = _merge_small if s.is_small(values) else _merge_blocks
    merged = s.divert(marked, condition, lambda rows: merge(rows, values.columns), values.columns)
    return s.stamp(merged, s.group_rows(values))


def _pair_facts() -> dict[str, Column]:
    """What the judgement of a pair needs to know of a row: its web address or text, whether it
    is a uri, and whether that uri has a label."""
    is_uri = F.col("type") == "uri"
    plain = F.col("value_resource_id").isNull() & F.col("uri").isNull()
    return {
        "_main": F.when(is_uri, F.col("uri")).when(plain, F.col("value")),
        "_is_uri": is_uri,
        "_labelled": is_uri & text.has_text(F.col("uri")) & text.has_text(F.col("value")),
    }


def _is_sound(a: Column, b: Column) -> Column:
    """Two rows (with their facts) that can become one labelled uri."""
    url_a, url_b = text.is_http_url(a["_main"]), text.is_http_url(b["_main"])
    sound = (b["_is_uri"].isNotNull() & ~(a["_is_uri"] & b["_is_uri"])
             & ~(a["_labelled"] | b["_labelled"])
             & ((url_a & url_b & (a["_main"] == b["_main"])) | (url_a != url_b)))
    return F.coalesce(sound, F.lit(False))


def _pair_as_uri(a: Column, b: Column, position: Column) -> dict[str, Column]:
    first_is_url = text.is_http_url(a["_main"])
    return {
        "pos": position,
        "type": F.lit("uri"),
        "lang": F.lit(None).cast("string"),
        "value": F.when(first_is_url, b["_main"]).otherwise(a["_main"]),
        "uri": F.when(first_is_url, a["_main"]).otherwise(b["_main"]),
        "value_resource_id": F.lit(None).cast("long"),
        "is_public": F.coalesce(a["is_public"], F.lit(False)),
        "value_annotation_id": F.lit(None).cast("long"),
    }


def _merge_small(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs within one window per property."""
    group = Window.partitionBy(*s.GROUP)
    ordered = group.orderBy(*s.row_order())
    facts = F.struct("_main", "_is_uri", "_labelled", "is_public")
    paired = (rows.withColumns(_pair_facts())
              .withColumn("_a", facts)
              .withColumns({"_at": (F.row_number().over(ordered) - 1).cast("long"),
                            "_b": F.lead("_a").over(ordered)}))
    even = F.col("_at") % 2 == 0
    judged = paired.withColumn("_all_sound", F.col("_hit") & F.min(
        F.when(even, _is_sound(F.col("_a"), F.col("_b")))).over(group))
    kept_at = F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("pos"))
    merged = _pair_as_uri(F.col("_a"), F.col("_b"), F.floor(F.col("_at") / 2))
    return judged.where(~F.col("_all_sound") | even).select(*[
        F.when(F.col("_all_sound"), merged[name]).otherwise(
            kept_at if name == "pos" else F.col(name)).alias(name)
        if name in merged else F.col(name) for name in columns])


def _merge_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs as groups of two rows, judged per block of pairs: no task holds a hot property."""
    numbered = s.running_start(
        rows.select(*columns, "_hit"), s.GROUP, {"_block": s.row_block()}, s.row_order(), "_at")
    rest = [name for name in columns if name not in s.GROUP]
    payload = F.struct("_at", "_main", "_is_uri", "_labelled", "_hit", *rest)
    pairs = (numbered.withColumns(_pair_facts()).withColumn("_pair", F.floor(F.col("_at") / 2))
             .groupBy(*s.GROUP, "_pair")
             .agg(F.sort_array(F.collect_list(payload)).alias("_rows"))
             .withColumn("_block", F.floor(F.col("_pair") / s.BLOCK_ROWS)))
    a, b = F.get("_rows", F.lit(0)), F.get("_rows", F.lit(1))
    pairs = pairs.withColumn("_sound", a["_hit"] & _is_sound(a, b))
    # The verdict of a property: per block of pairs, then over the few blocks, then back to the
    # blocks, so that the join key is never one hot property.
    verdict = (pairs.groupBy(*s.GROUP, "_block").agg(F.min("_sound").alias("_sound"))
               .withColumn("_all_sound",
                           F.min("_sound").over(Window.partitionBy(*s.GROUP)))
               .drop("_sound"))
    judged = pairs.drop("_sound").join(verdict, [*s.GROUP, "_block"])
    merged = _pair_as_uri(a, b, F.col("_pair"))
    one = F.struct(*[merged.get(name, a[name]).alias(name) for name in rest])
    as_before = F.transform("_rows", lambda row: F.struct(
        *[(F.when(row["_hit"], row["_at"]).otherwise(row["pos"]) if name == "pos" else row[name])
          .alias(name) for name in rest]))
    return judged.select(*s.GROUP, F.inline(
        F.when(F.col("_all_sound"), F.array(one)).otherwise(as_before)))


# ---------------------------------------------------------------- order and visibility

def order_values(values: DataFrame, languages, properties, *, sel=None) -> DataFrame:
    """Put literals in the listed languages first, in list order; the other languages follow in
    the order they first appear, with all other rows as one group."""
    languages = patterns.split_list(s.as_list(languages))
    if not languages:
        raise ValueError("at least one language is required")
    marked, condition = s.scope(values, properties, sel)

    plain = (F.col("type") != "literal") | text.is_blank(F.col("lang"))
    language = F.when(plain, F.lit("")).otherwise(F.col("lang"))
    listed = F.array_position(F.array(*[F.lit(code) for code in languages]), F.col("_lang"))
    lead = [F.when(listed > 0, listed).otherwise(len(languages) + 1), F.col("_seen"), F.col("_lang")]
    same_language = Window.partitionBy(*s.GROUP, "_lang")

    def reorder(rows: DataFrame) -> DataFrame:
        if s.is_small(values):
            # Numbered first, so that all three windows share one shuffle.
            rows = s.running_start(rows.withColumn("_lang", language), s.GROUP, {}, s.row_order(),
                                   "_now", small=True)
            rows = rows.withColumn("_seen", F.min("_now").over(same_language))
            numbered = s.running_start(rows, s.GROUP, {}, [F.col("_now")], "_at", small=True,
                                       lead_order=lead)
        else:
            first_seen = F.struct(F.col("pos").isNull().alias("unplaced"), "pos",
                                  F.col("value_id").isNull().alias("unsaved"), "value_id", s.content())
            numbered = s.running_start(
                rows, s.GROUP, {"_lang": language, "_block": s.row_block()}, s.row_order(), "_at",
                block_facts={"_first": F.min(first_seen)},
                with_facts=lambda pieces: pieces.withColumn(
                    "_seen", F.min("_first").over(same_language)),
                block_order=[*lead, F.col("_block")])
        return numbered.withColumn(
            "pos", F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("pos")))

    return s.stamp(s.divert(marked, condition, reorder, values.columns), s.group_rows(values))


def set_visibility(values: DataFrame, visible: bool, properties, *, sel=None,
                   types: schema.DataTypes = schema.DEFAULT_TYPES, datatypes=(), languages=(),
                   contains: str = "") -> DataFrame:
    """Make the matching values public or private."""
    marked, condition = s.scope(values, properties, sel)
    hit = condition & s.matches(datatypes=datatypes, languages=languages, contains=contains,
                                payload=s.literal_payload(types))
    return marked.withColumn(
        "is_public", F.when(hit, F.lit(bool(visible))).otherwise(F.col("is_public"))
    ).select(*values.columns)


# ---------------------------------------------------------------- remove

def remove_values(values: DataFrame, properties, *, keep_max_values: int | None = None,
                  max_values: int | None = None, sel=None, renumber: bool = True,
                  types: schema.DataTypes = schema.DEFAULT_TYPES, **flt) -> DataFrame:
    """Delete the matching values; without any filter, whole properties. `max_values` deletes
    only the first (negative: last) ones, `keep_max_values` spares them."""
    if keep_max_values and max_values:
        raise ValueError("keep_max_values and max_values exclude each other")
    unknown = set(flt) - {"datatypes", "languages", "visibility", "equal", "contains", "match"}
    if unknown:
        raise TypeError(f"unknown filters: {sorted(unknown)}")
    marked, condition = s.scope(values, properties, sel)
    hit = condition & s.matches(payload=s.main_payload(types),
                                main=types.main_column(F.col("type")), **flt)
    limit = keep_max_values or max_values
    whole = renumber and s.is_small(values)
    if keep_max_values and not whole and not s.in_chain():
        # Only matching rows arrive, and those beyond the limit go.
        kept = s.divert(marked, hit, lambda rows: s.only_first(rows, limit), values.columns)
    elif limit:
        spared = F.col("_within") if keep_max_values else ~F.col("_within")
        kept = s.divert(
            marked, hit, lambda rows: s.first_rows(rows, limit).where(~F.col("_hit") | spared),
            values.columns, whole=whole)
    else:
        kept = marked.where(~F.coalesce(hit, F.lit(False))).select(*values.columns)
    return s.close_up(kept) if renumber else kept
