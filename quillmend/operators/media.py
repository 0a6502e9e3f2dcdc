"""Edits of records and of their media files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmend.functions import patterns, text
from quillmend.operators import _shared as s

# Thumbnail modes, removal modes, orders, metadata modes, page selection modes.
THUMBNAIL_MODES = ("fill", "append", "append_no_primary", "append_no_primary_no_thumbnail",
                   "replace", "remove", "remove_primary", "delete")
REMOVE_MODES = ("all", "media_type", "media_extension")
ORDERS = (
    "title", "source", "basename", "mediatype", "extension",
    "mediatype/title", "mediatype/source", "mediatype/basename",
    "title/mediatype", "source/mediatype", "basename/mediatype",
    "extension/title", "extension/source", "extension/basename",
    "title/extension", "source/extension", "basename/extension",
)
EXPLODE_MODES = ("append", "update", "replace", "none")
PAGE_MODES = ("all", "first", "last")
HTML_MODES = ("raw", "raw_i", "html", "unicode", "regex", "remove")
SOURCE_MODES = (*HTML_MODES, "basename", "filename")

# Fixed value: shape of a media type.
MEDIA_TYPE = (r"^(application|audio|font|example|image|message|model|multipart|text|video|x-[\w-]+)"
              r"/([\w\.+-]+)(;[\w\.+-]+=[\w\.+-]+){0,3}$")

# An item with more media than this is sorted by several tasks, between borders taken from so many
# of its media.
ITEM_ROWS = 1 << 17
SAMPLED = 1024


# ---------------------------------------------------------------- records

def set_owner(resources: DataFrame, owner_id: int | None, *, sel=None) -> DataFrame:
    """Set the owner of the selected records; 0 or None clears it."""
    marked, condition = s.selected(resources, sel, "id")
    owner = F.lit(int(owner_id) if owner_id else None)
    return marked.withColumn(
        "owner_id", F.when(condition, owner.cast(resources.schema["owner_id"].dataType))
        .otherwise(F.col("owner_id"))).select(*resources.columns)


def set_thumbnail(resources: DataFrame, mode: str, asset: int | None = None, *,
                  sel=None) -> DataFrame:
    """Set or clear the thumbnail of the selected records."""
    s.choice("mode", mode, THUMBNAIL_MODES)
    if not asset and mode not in ("remove_primary", "delete"):
        raise ValueError(f"mode {mode} needs an asset")
    current = F.col("thumbnail_id")
    none = current.isNull() | (current == 0)
    no_primary = F.col("primary_media_id").isNull() | (F.col("primary_media_id") == 0)
    when = {
        "fill": F.lit(True),
        "append": none,
        "append_no_primary": no_primary,
        "append_no_primary_no_thumbnail": no_primary & none,
        "replace": ~none,
        "remove": current == F.lit(asset),
        "remove_primary": ~no_primary,
        "delete": F.lit(True),
    }[mode]
    clears = mode in ("remove", "remove_primary", "delete")
    marked, condition = s.selected(resources, sel, "id")
    new = F.lit(None if clears else int(asset)).cast(resources.schema["thumbnail_id"].dataType)
    return marked.withColumn(
        "thumbnail_id", F.when(condition & when, new).otherwise(current)).select(*resources.columns)


# ---------------------------------------------------------------- flat edits of media

def remove_media(media: DataFrame, mode: str, *, media_types=(), extensions=(),
                 sel=None) -> DataFrame:
    """Detach media from the selected items."""
    s.choice("mode", mode, REMOVE_MODES)
    hit = F.lit(True)
    if mode == "media_type":
        hit = F.col("media_type").isin(_needed(media_types, "media_types"))
    elif mode == "media_extension":
        hit = F.col("extension").isin(_needed(patterns.split_list(s.as_list(extensions)), "extensions"))
    marked, condition = s.selected(media, sel, "item_id")
    return marked.where(~F.coalesce(condition & hit, F.lit(False))).select(*media.columns)


def _needed(items, name: str) -> list[str]:
    items = s.as_list(items)
    if not items:
        raise ValueError(f"{name} must hold at least one entry")
    return items


def _media_key(by: str) -> str:
    return s.choice("by", by, ("item_id", "id"))


def edit_media_html(media: DataFrame, mode: str, *, from_: str = "", to: str = "",
                    prepend: str = "", append: str = "", by: str = "item_id",
                    sel=None) -> DataFrame:
    """Edit the text of the media that hold html."""
    s.choice("mode", mode, HTML_MODES)
    marked, condition = s.selected(media, sel, _media_key(by))
    hit = condition & (F.col("ingester") == "html") & ~text.is_blank(F.col("html"))
    edited = text.trim(F.concat(F.lit(prepend), text.rewrite(F.col("html"), mode, from_, to),
                                F.lit(append)))
    return marked.withColumn("html", F.when(hit, edited).otherwise(F.col("html"))
                             ).select(*media.columns)


def edit_media_source(media: DataFrame, mode: str, *, from_: str = "", to: str = "",
                      prepend: str = "", append: str = "", by: str = "item_id",
                      sel=None) -> DataFrame:
    """Edit the source of media; a blank result is null."""
    s.choice("mode", mode, SOURCE_MODES)
    marked, condition = s.selected(media, sel, _media_key(by))
    source = F.coalesce(F.col("source"), F.lit(""))
    edited = text.blank_to_null(text.trim(F.concat(
        F.lit(prepend), text.rewrite(source, mode, from_, to), F.lit(append))))
    return marked.withColumn("source", F.when(condition, edited).otherwise(F.col("source"))
                             ).select(*media.columns)


def checked_media_type(name: str) -> str:
    name = name.strip().lower()
    if not re.match(MEDIA_TYPE, name, re.A):
        raise ValueError(f"not a media type: {name!r}")
    return name


def valid_media_type(c: Column) -> Column:
    return F.coalesce(c.rlike(MEDIA_TYPE), F.lit(False))


def set_media_type(media: DataFrame, from_: str, to: str, *, by: str = "item_id",
                   sel=None) -> DataFrame:
    """Replace one media type by another."""
    from_, to = from_.strip().lower(), checked_media_type(to)
    if not from_:
        raise ValueError("a media type to replace is required")
    marked, condition = s.selected(media, sel, _media_key(by))
    hit = condition & (F.col("media_type") == from_)
    return marked.withColumn("media_type", F.when(hit, F.lit(to)).otherwise(F.col("media_type"))
                             ).select(*media.columns)


def set_media_visibility(media: DataFrame, visible: bool, *, media_types=(), ingesters=(),
                         renderers=(), by: str = "item_id", sel=None) -> DataFrame:
    """Make the matching media public or private."""
    marked, condition = s.selected(media, sel, _media_key(by))
    for column, wanted in (("media_type", media_types), ("ingester", ingesters),
                           ("renderer", renderers)):
        if [item for item in s.as_list(wanted) if item]:
            condition = condition & F.col(column).isin([i for i in s.as_list(wanted) if i])
    return marked.withColumn("is_public", F.when(condition, F.lit(bool(visible)))
                             .otherwise(F.col("is_public"))).select(*media.columns)


# ---------------------------------------------------------------- order

def order_media(media: DataFrame, order: str, *, media_types=(), extensions=(),
                sel=None, item_rows: int = ITEM_ROWS) -> DataFrame:
    """Renumber the media of each selected item in the given order."""
    s.choice("order", order, ORDERS)
    main, _, sub = order.partition("/")
    media_types, extensions = s.as_list(media_types), patterns.split_list(s.as_list(extensions))
    marked, condition = s.selected(media, sel, "item_id")
    chosen = marked.where(condition)
    # What the sort needs to know of an item: its size, and whether the second criterion says anything.
    facts = chosen.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_size"), F.max(F.length(_field(sub or main)) > 0).alias("_two"))
    keyed = _sort_keys(chosen.join(facts, "item_id", "left"), main, sub, media_types, extensions)
    placed = _number_items(keyed, item_rows).withColumn("position", F.col("_at") + 1)
    rest = marked.where(~F.coalesce(condition, F.lit(False)))
    return placed.select(*media.columns).unionByName(rest.select(*media.columns))


def _field(name: str) -> Column:
    column = {"title": "title", "source": "source", "basename": "source",
              "mediatype": "media_type", "extension": "extension"}[name]
    c = F.coalesce(F.col(column), F.lit(""))
    return text.basename(c) if name == "basename" else c


def _list_hits(name: str, media_types: list[str], extensions: list[str]) -> list[Column]:
    """One condition per list entry; an entry without a slash names a main media type."""
    kind = _field("mediatype")
    if name == "mediatype":
        return [kind == entry if "/" in entry else text.main_media_type(kind) == entry
                for entry in media_types]
    if name == "extension":
        return [_field("extension") == entry for entry in extensions]
    return []


def _rank(hits: list[Column]) -> Column:
    """Number of the first entry a row meets, after all entries when it meets none."""
    rank = F.when(F.lit(False), 0)
    for i, hit in enumerate(hits):
        rank = rank.when(hit, i)
    return rank.otherwise(len(hits))


def _sort_keys(media: DataFrame, main: str, sub: str, media_types, extensions) -> DataFrame:
    """Columns _k1, _k2, _k3 that sort the media of an item; ties keep the present order."""
    none = F.lit("")
    main_hits = _list_hits(main, media_types, extensions)
    rank = _rank(main_hits)
    listed = rank < len(main_hits)
    # One criterion: listed entries first, in the list's order, the others in natural order.
    single = (F.lpad(rank.cast("string"), 6, "0"),
              F.when(listed, none).otherwise(text.natural_key(_field(main))), none)
    if not sub:
        return media.withColumns(dict(zip(("_k1", "_k2", "_k3"), single)))

    first, second = _field(main), _field(sub)
    by_kind = {"mediatype", "extension"}
    if main in by_kind and sub in ("source", "basename"):
        second = text.strip_extension(second) if sub == "source" else text.filename(second)
    elif sub in by_kind and main in ("source", "basename"):
        first = text.strip_extension(first) if main == "source" else text.filename(first)
    first, second = F.lower(first), F.lower(second)
    sub_hits = _list_hits(sub, media_types, extensions)
    if main_hits:
        double = (F.lpad(rank.cast("string"), 6, "0"), F.when(listed, none).otherwise(first), second)
    elif sub_hits:
        # Entry by entry: the media that meets it comes before the one that does not.
        double = (first, F.concat(*[F.when(hit, "0").otherwise("1") for hit in sub_hits]), second)
    else:
        double = (first, second, none)
    # An item whose second criterion is blank everywhere is sorted by the first alone.
    two = F.coalesce(F.col("_two"), F.lit(False))
    return media.withColumns({f"_k{i + 1}": F.when(two, double[i]).otherwise(single[i]) for i in range(3)})


def _number_items(keyed: DataFrame, item_rows: int) -> DataFrame:
    """Number the media of each item from 0, in one lazy plan.

    An item of more than `item_rows` media is cut at borders: the media of the smallest hashes are
    a sample of it, and every so many of the sample, in order, is a border. Hashes do not change
    when a task is run again, so borders do not either. Pieces are numbered in parallel and shifted
    by the sizes of those before them.
    """
    order = [F.col("_k1"), F.col("_k2"), F.col("_k3"), F.col("position").asc_nulls_last(), F.col("id")]
    key = F.struct("_k1", "_k2", "_k3", F.col("position").isNull().alias("unplaced"), "position", "id")
    by_hash = Window.partitionBy("item_id").orderBy(F.xxhash64("id"), "id")
    sample = (keyed.where(F.col("_size") > item_rows).select("item_id", "_size", key.alias("_key"), "id")
              .withColumn("_nth", F.row_number().over(by_hash)).where(F.col("_nth") <= SAMPLED))
    # About two pieces for every `item_rows`, as far as the sample goes.
    step = F.greatest(F.lit(1), F.floor(SAMPLED * item_rows / (2 * F.col("_size"))))
    borders = (sample.groupBy("item_id", "_size").agg(F.array_sort(F.collect_list("_key")).alias("_all"))
               .select("item_id", F.filter("_all", lambda b, i: (i + 1) % step == 0).alias("_borders")))
    cut = keyed.join(borders, "item_id", "left").withColumn("_key", key)
    block = F.when(F.col("_borders").isNull(), 0).otherwise(F.size(F.filter("_borders", lambda b: b < F.col("_key"))))
    return s.running_start(cut.withColumn("_piece", block).drop("_borders", "_key"), ["item_id"],
                           {"_block": F.col("_piece")}, order, "_at")


# ---------------------------------------------------------------- explode items

def explode_items(resources: DataFrame, media: DataFrame, values: DataFrame, mode: str, *,
                  sel=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One item per media: the first media keeps the item, each other gets a copy of it.

    `mode` says what the items receive of the values of their media: all appended, those of the
    properties the media has, only those, or none. Media keep their values. New items take the
    ids above the largest one.
    """
    s.choice("mode", mode, EXPLODE_MODES)
    marked, condition = s.selected(resources, sel, "id")
    items = marked.where(condition & (F.col("resource_name") == "items")).select(
        F.col("id").alias("item_id"))
    attached = media.select("item_id", F.col("id").alias("media_id"), "position").join(
        items, "item_id", "left_semi")
    place = F.struct(F.col("position").isNull().alias("unplaced"), "position", "media_id")
    first = attached.groupBy("item_id").agg(F.min(place).alias("_first"))
    top = resources.select(F.max("id")).scalar()
    stays = F.col("media_id") == F.col("_first.media_id")
    pairs = attached.join(first, "item_id").select(
        "item_id", "media_id", stays.alias("_stays"),
        F.when(stays, F.col("item_id")).otherwise(F.col("media_id") + top).alias("_new_id"))

    new_resources = _exploded_resources(resources, pairs)
    new_media = _exploded_media(media, pairs)
    # The values of several media may meet in one property of an item.
    new_values = s.stamp(_exploded_values(values, pairs, mode), None)
    return new_resources, new_media, new_values


def _chosen(columns, still: Column) -> dict[str, Column]:
    """Marks of a selection: new items are not in it."""
    return {s.MARK: F.col(s.MARK) & still} if s.MARK in columns else {}


def _exploded_resources(resources, pairs) -> DataFrame:
    """An item meets one pair for each of its media, so one join makes the items."""
    joined = resources.join(pairs.withColumnRenamed("item_id", "id"), "id", "left")
    joined = s.as_new(joined, ~F.coalesce("_stays", F.lit(True)))
    primary = resources.schema["primary_media_id"].dataType
    return joined.withColumns({
        "id": F.coalesce("_new_id", "id"),
        "primary_media_id": F.coalesce(F.col("media_id").cast(primary), "primary_media_id"),
        **_chosen(resources.columns, F.coalesce("_stays", F.lit(True))),
    }).select(*resources.columns)


def _exploded_media(media, pairs) -> DataFrame:
    moved = media.join(pairs.select(F.col("media_id").alias("id"), "_new_id", "_stays"), "id", "left")
    return moved.withColumns({
        "position": F.when(F.col("_new_id").isNotNull(), F.lit(1)).otherwise(F.col("position"))
        .cast(media.schema["position"].dataType),
        "item_id": F.coalesce("_new_id", "item_id"),
        **_chosen(media.columns, F.coalesce("_stays", F.lit(True))),
    }).select(*media.columns)


def _exploded_values(values, pairs, mode: str) -> DataFrame:
    """One join expands the values: those of an item meet one pair for each media, those of a media
    meet its own pair and both stay and pass on. What passes on is placed by arithmetic, behind as
    many values as the item has of that property."""
    columns = values.columns
    record = F.struct(F.col("item_id").alias("resource_id"), F.lit(False).alias("_passes"))
    passing = F.struct(F.col("media_id").alias("resource_id"), F.lit(True).alias("_passes"))
    roles = pairs.select("*", F.inline(F.array(record) if mode == "none" else F.array(record, passing)))
    placed = values
    if mode == "append":
        placed = s.running_start(values, s.GROUP, {"_block": s.row_block()}, s.row_order(), "_at",
                                 small=s.is_small(values))
    stay, own, given = F.lit("stay"), F.lit("own"), F.lit("given")
    parts = (F.when(F.col("_passes").isNull(), F.array(stay))
             .when(F.col("_passes"), F.array(stay, given))
             .otherwise(F.array() if mode == "replace" else F.array(own)))
    rows = placed.join(roles, "resource_id", "left").withColumn("_part", F.explode(parts.cast("array<string>")))
    if mode in ("append", "update"):
        # What the item has of the property before a given value; whether the media has some itself.
        asks, whose = ("given", "item_id") if mode == "append" else ("own", "media_id")
        sizes = values.groupBy(F.struct(*s.GROUP).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
        rows = s.lookup(rows.withColumn("_hit", F.col("_part") == asks),
                        F.struct(F.col(whose).alias("resource_id"), "property"), sizes, "_group")
    pos = F.col("pos")
    if mode == "update":
        rows = rows.where(F.col("_n").isNull())
    elif mode == "append":
        pos = F.when(F.col("_part") == "own", F.col("_at")).when(
            F.col("_part") == "given", F.col("_at") + F.coalesce("_n", F.lit(0))).otherwise(pos)
    stays = F.col("_part") == "stay"
    rows = s.as_new(rows, ~(stays | ((F.col("_part") == "own") & F.col("_stays"))))
    return rows.withColumns({
        "value_id": F.when(stays | ((F.col("_part") == "own") & F.col("_stays")), F.col("value_id")),
        "resource_id": F.when(stays, F.col("resource_id")).otherwise(F.col("_new_id")),
        "pos": pos,
        **({s.MARK: F.when(stays, F.col(s.MARK)).otherwise(F.col("_stays"))} if s.MARK in columns else {}),
    }).select(*columns)


# ---------------------------------------------------------------- pages

def pages_without_count(media: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Pdf media for which :func:`page_manifest` plans no page because their count is not known."""
    known = page_counts.where("page_count IS NOT NULL").select(F.col("media_id").alias("id"))
    return (media.where(F.col("media_type") == "application/pdf").join(known, "id", "left_anti")
            .select("item_id", F.col("id").alias("media_id"), "source"))


def page_manifest(media: DataFrame, page_counts: DataFrame, *, mode: str = "all",
                  skip_existing: bool = False, sel=None) -> DataFrame:
    """One row per page of the pdf media of an item: the image to create, its name and its
    position after the media the item has. Pages whose image exists can be left out; they still
    take a position."""
    s.choice("mode", mode, PAGE_MODES)
    marked, condition = s.selected(media, sel, "item_id")
    attached = marked.where(condition)
    documents = attached.where(F.col("media_type") == "application/pdf").select(
        "item_id", F.col("id").alias("media_id"), "position", "source")
    if mode != "all":
        place = F.struct(F.col("position").isNull().alias("unplaced"), "position", "media_id")
        pick = F.min if mode == "first" else F.max
        chosen = documents.groupBy("item_id").agg(pick(place).alias("_pick")).select(
            "item_id", F.col("_pick.media_id").alias("media_id"))
        documents = documents.join(chosen, ["item_id", "media_id"], "left_semi")
    counted = documents.join(page_counts.select("media_id", "page_count"), "media_id")
    order = [F.col("position").asc_nulls_last(), F.col("media_id")]
    block = F.coalesce(F.floor(F.col("position") / s.BLOCK_ROWS), F.lit(1 << 40)).cast("long")
    started = s.running_start(counted, ["item_id"], {"_block": block}, order, "_before",
                              weight=F.col("page_count").cast("long"))
    sizes = attached.groupBy("item_id").agg(F.count(F.lit(1)).alias("_size"))
    stem = F.regexp_replace(text.basename(F.coalesce("source", F.lit(""))), r"(?<=.)\.pdf\z", "")
    pages = (started.where(F.col("page_count") > 0).join(sizes, "item_id")
             .withColumn("page", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))))
             .select("item_id", "media_id", "page",
                     F.concat(text.ascii_name(text.sanitize_name(stem)), F.lit("."),
                              F.format_string("%04d", F.col("page")), F.lit(".jpg")).alias("source"),
                     (F.col("_size") + F.col("_before") + F.col("page")).alias("position")))
    if not skip_existing:
        return pages
    images = attached.where(F.col("media_type") == "image/jpeg").select("item_id", "source").distinct()
    return pages.join(images, ["item_id", "source"], "left_anti").select(*pages.columns)
