"""Every operator as a named query over the test tables, with the same result as plain SQL.

`QUERIES` maps a name to a function of (spark, folder of the tables). `ORACLES` maps a name to
SQL for another engine; the curation tables are common table expressions of that SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import quillmend as q
from quillmend.functions import text
from quillmend.operators._shared import shared_folder
from quillmend.operators.media import valid_media_type
from quillmend.sources import fixtures as fx
from quillmend.sources.session import configure
from quillmend.sources.tables import property_terms, with_positions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The curation tables of one folder, each planned when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name == "page_counts":
            return fx.page_counts(self.media)
        if name in ("documents", "pages", "customer", "events", "orders", "nation"):
            return fx.table(self.spark, self.folder, name)
        return getattr(fx, name)(self.spark, self.folder)


def query(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
    if sql is not None:
        ORACLES[name] = with_views(sql)


# ---------------------------------------------------------------- views of the other engine

VIEWS = {
    "fx_resources": """
SELECT doc_id + 1 AS id, 'items' AS resource_name, NULLIF(CAST(doc_id % 7 AS INT), 0) AS owner_id,
       CAST(doc_id % 4 AS INT) AS resource_class_id, CAST(NULL AS INT) AS resource_template_id,
       CASE WHEN doc_id % 3 = 0 THEN CAST(100 + doc_id % 2 AS INT) END AS thumbnail_id,
       p.page_id + 20000000 AS primary_media_id,
       source || ' ' || CAST(doc_id AS STRING) AS title, doc_id % 10 <> 0 AS is_public
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id * 4
UNION ALL
SELECT page_id + 20000000, 'media', 1, NULL, NULL, NULL, NULL, 'Page ' || CAST(page_id AS STRING), page_id % 3 <> 0 FROM pages
UNION ALL
SELECT CAST(r_regionkey AS BIGINT) + 30000000, 'item_sets', 1, NULL, NULL, NULL, NULL, r_name, TRUE FROM region""",
    "fx_media": """
SELECT page_id + 20000000 AS id, CAST(FLOOR(page_id / 4.0) AS BIGINT) + 1 AS item_id, CAST(page_id % 4 + 1 AS BIGINT) AS position,
       'Page ' || CAST((page_id * 7) % 12 AS STRING) AS title, url AS source,
       CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' ELSE 'text/html' END AS media_type,
       CASE page_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' ELSE 'html' END AS extension,
       CASE page_id % 4 WHEN 3 THEN 'html' WHEN 2 THEN 'upload' ELSE 'url' END AS ingester,
       CASE page_id % 4 WHEN 3 THEN 'html' ELSE 'file' END AS renderer,
       page_id % 3 <> 0 AS is_public, html
FROM pages""",
    "fx_values": """
SELECT value_id, doc_id + 1 AS resource_id, property,
       row_number() OVER (PARTITION BY doc_id, property ORDER BY value_id) - 1 AS pos,
       type, lang, value, uri, value_resource_id, doc_id % 11 <> 0 AS is_public,
       CASE WHEN doc_id % 32 = 0 AND value_id % 20 = 5 THEN CAST(40000000 + doc_id AS BIGINT) END AS value_annotation_id
FROM (
SELECT doc_id*20 AS value_id, doc_id, 'dcterms:title' AS property, 'literal' AS type, lang, text AS value, CAST(NULL AS STRING) AS uri, CAST(NULL AS BIGINT) AS value_resource_id FROM d
UNION ALL SELECT doc_id*20+1, doc_id, 'dcterms:title', 'literal', 'en', 'Title ' || n, NULL, NULL FROM d
UNION ALL SELECT doc_id*20+2, doc_id, 'dcterms:title', 'literal', 'de', 'Titel ' || n, NULL, NULL FROM d WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id*20+3, doc_id, 'dcterms:description', 'literal', CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END, text, NULL, NULL FROM d
UNION ALL SELECT doc_id*20+4, doc_id, 'dcterms:source', 'literal', NULL, CASE WHEN doc_id % 5 = 0 THEN '  ' || source || chr(9) || chr(160) ELSE source END, NULL, NULL FROM d
UNION ALL SELECT doc_id*20+5, doc_id, 'dcterms:source', 'literal', NULL, source, NULL, NULL FROM d WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id*20+6, doc_id, 'dcterms:source', 'literal', NULL, upper(source), NULL, NULL FROM d WHERE doc_id % 8 = 0
UNION ALL SELECT doc_id*20+7, doc_id, 'dcterms:subject', 'literal', lang, source || ';' || lang || '; ;kw' || CAST(doc_id % 13 AS STRING), NULL, NULL FROM d
UNION ALL SELECT doc_id*20+8, doc_id, 'dcterms:identifier', 'literal', NULL, 'doc-' || lpad(n, 8, '0'), NULL, NULL FROM d
UNION ALL SELECT doc_id*20+9, doc_id, 'dcterms:isPartOf', 'literal', NULL, 'files/doc-' || lpad(CAST(CAST(FLOOR(doc_id / 2.0) AS BIGINT) AS STRING), 8, '0') || '.pdf', NULL, NULL FROM d
UNION ALL SELECT doc_id*20+10, doc_id, 'dcterms:relation', 'resource', NULL, NULL, NULL, 30000000 + doc_id % 5 FROM d
UNION ALL SELECT doc_id*20+11, doc_id, 'dcterms:references', 'uri', NULL, CASE WHEN doc_id % 2 = 1 THEN 'Ref ' || n END, url, NULL FROM d JOIN pages ON page_id = doc_id
UNION ALL SELECT doc_id*20+12, doc_id, 'dcterms:creator', 'literal', NULL, 'Name ' || CAST(doc_id % 97 AS STRING), NULL, NULL FROM d
UNION ALL SELECT doc_id*20+13, doc_id, 'dcterms:creator', 'literal', NULL, 'https://example.org/p/' || CAST(doc_id % 97 AS STRING), NULL, NULL FROM d WHERE doc_id % 5 <> 1
UNION ALL SELECT doc_id*20+14, doc_id, 'dcterms:spatial', 'valuesuggest:geonames:geonames', NULL, CASE WHEN doc_id % 3 <> 0 THEN 'Old label' END, 'https://www.geonames.org/' || CAST(1000 + doc_id % 25 AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '/x.html' ELSE '' END, NULL FROM d
UNION ALL SELECT doc_id*20+15, doc_id, 'dcterms:coverage', 'literal', NULL, n_name, NULL, NULL FROM d JOIN nation ON n_nationkey = doc_id % 25
UNION ALL SELECT doc_id*20+16, doc_id, 'dcterms:abstract', 'literal', lang, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN '   ' ELSE text END, NULL, NULL FROM d
UNION ALL SELECT doc_id*20+17, doc_id, 'dcterms:alternative', 'literal', NULL, CASE WHEN doc_id % 2 = 0 THEN 'cafÃ© ' ELSE 'café ' END || n, NULL, NULL FROM d
) AS stacked""",
    "fx_annotation_value": """
SELECT doc_id*20 + k AS id, doc_id + 1 AS annotation_id,
       CASE WHEN doc_id % 16 = 4 OR k = 4 THEN 'body' ELSE 'target' END AS field, CAST(1 AS SMALLINT) AS ordinal
FROM documents CROSS JOIN (SELECT 4 AS k UNION ALL SELECT 5 AS k) s
WHERE doc_id % 16 IN (4, 8)""",
    "fx_authority": """
SELECT 'valuesuggest:geonames:geonames' AS datatype, 'https://www.geonames.org/' || CAST(1000 + n_nationkey AS STRING) AS uri,
       'name' AS kind, CAST(NULL AS STRING) AS lang, n_name AS label, 3 AS priority FROM nation
UNION ALL
SELECT 'valuesuggest:geonames:geonames', 'https://www.geonames.org/' || CAST(1000 + n_nationkey AS STRING),
       'official', 'fr', 'FR ' || n_name, 1 FROM nation WHERE n_nationkey % 2 = 0
UNION ALL
SELECT 'valuesuggest:geonames:geonames', 'https://www.geonames.org/' || CAST(2000 + n_nationkey AS STRING),
       'name', NULL, n_name, 3 FROM nation WHERE n_nationkey % 5 = 0""",
    "fx_places": """
SELECT CAST(1000 + n_nationkey AS BIGINT) AS geoname_id, n_name AS toponym, r_name AS country,
       CAST(n_nationkey AS DOUBLE) + 0.5 AS lat, CAST(n_nationkey AS DOUBLE) - 12.25 AS lon
FROM nation JOIN region ON n_regionkey = r_regionkey""",
}


def with_views(sql: str) -> str:
    """Put the views a statement uses in front of it."""
    used = ["d AS (SELECT *, CAST(doc_id AS STRING) AS n FROM documents)"]
    used += [f"{name} AS ({body})" for name, body in VIEWS.items() if name in sql]
    body = sql.strip()
    join = ",\n" if body.startswith("WITH ") else "\n"
    return "WITH " + ",\n".join(used) + join + body.removeprefix("WITH ")


COLUMNS = ("value_id", "resource_id", "property", "pos", "type", "lang", "value", "uri",
           "value_resource_id", "is_public", "value_annotation_id")
RESOURCE_COLUMNS = ("id", "resource_name", "owner_id", "resource_class_id", "resource_template_id",
                    "thumbnail_id", "primary_media_id", "title", "is_public")
MEDIA_COLUMNS = ("id", "item_id", "position", "title", "source", "media_type", "extension",
                 "ingester", "renderer", "is_public", "html")

ASCII_SET = "(' ' || chr(9) || chr(10) || chr(13) || chr(11))"
UNICODE_SET = "(" + " || ".join(f"chr({code})" for code in (
    9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)) + ")"


def select(changes: dict[str, str], columns=COLUMNS, source: str = "fx_values",
           where: str = "TRUE") -> str:
    listed = ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in columns)
    return f"SELECT {listed} FROM {source} WHERE {where}"


def renumbered(sql: str, order: str = "pos, value_id") -> str:
    listed = ", ".join(
        f"row_number() OVER (PARTITION BY resource_id, property ORDER BY {order}) - 1 AS pos"
        if c == "pos" else c for c in COLUMNS)
    return f"SELECT {listed} FROM ({sql}) AS edited"


def case(condition: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


def trimmed(expression: str) -> str:
    return f"trim({expression}, {ASCII_SET})"


# ---------------------------------------------------------------- replace

def _replace_sql(prop: str, expression: str, column: str = "value", more: str = "TRUE",
                 extra: dict | None = None) -> str:
    hit = f"(property = '{prop}' AND {more})"
    edited = select({column: case(hit, trimmed(expression), column), **(extra or {})})
    return renumbered(f"SELECT * FROM ({edited}) AS e WHERE NOT ({hit} AND {column} = '')")


V = trimmed("value")
query("replace_raw",
      lambda t: q.replace(t.values, "raw", ["dcterms:description"], from_="the", to="THE"),
      _replace_sql("dcterms:description", f"replace({V}, 'the', 'THE')"))
query("replace_raw_i",
      lambda t: q.replace(t.values, "raw_i", ["dcterms:description"], from_="THE", to="$x\\1"),
      _replace_sql("dcterms:description", f"regexp_replace({V}, 'THE', '$x\\\\1', 'gi')"))
query("replace_regex",
      lambda t: q.replace(t.values, "regex", ["dcterms:identifier"], from_=r"~(\d+)(\d)\b~",
                          to=r"<$1|\2>", append=" ."),
      _replace_sql("dcterms:identifier",
                   f"regexp_replace({V}, '(\\d+)(\\d)\\b', '<\\1|\\2>', 'g') || ' .'"))
query("replace_html",
      lambda t: q.replace(t.values, "html", ["dcterms:alternative"], from_="café", to="tea"),
      _replace_sql("dcterms:alternative",
                   f"replace(replace({V}, 'café', 'tea'), 'caf&eacute;', 'tea')"))
query("replace_unicode",
      lambda t: q.replace(t.values, "unicode", ["dcterms:alternative"]),
      _replace_sql("dcterms:alternative", "'café ' || CAST(resource_id - 1 AS STRING)"))
query("replace_basename",
      lambda t: q.replace(t.values, "basename", ["dcterms:references"], part="uri"),
      _replace_sql("dcterms:references",
                   "regexp_extract(regexp_replace(uri, '/+$', ''), '([^/]*)$', 1)", column="uri"))
query("replace_filename",
      lambda t: q.replace(t.values, "filename", ["dcterms:isPartOf"]),
      _replace_sql("dcterms:isPartOf",
                   f"regexp_replace(regexp_extract({V}, '([^/]*)$', 1), '\\.[^.]*$', '')"))
query("replace_remove",
      lambda t: q.replace(t.values, "remove", ["dcterms:abstract"]),
      _replace_sql("dcterms:abstract", "''"))
query("replace_remove_prepend",
      lambda t: q.replace(t.values, "remove", ["dcterms:abstract"], prepend="X"),
      _replace_sql("dcterms:abstract", "'X'"))
query("replace_prepend_append",
      lambda t: q.replace(t.values, "raw", ["dcterms:abstract"], prepend="[", append="]"),
      _replace_sql("dcterms:abstract", f"'[' || {V} || ']'"))
query("replace_language",
      lambda t: q.replace(t.values, "raw", ["dcterms:title"], language="xx"),
      _replace_sql("dcterms:title", V,
                   extra={"lang": case("property = 'dcterms:title'", "'xx'", "lang")}))
query("replace_language_clear",
      lambda t: q.replace(t.values, "raw", "all", part="literal", language_clear=True),
      renumbered(select({"lang": case("type = 'literal'", "NULL", "lang"),
                         "value": case("type = 'literal'", V, "value")},
                        where=f"NOT (type = 'literal' AND coalesce({V}, '') = '')")))
query("replace_uri_label",
      lambda t: q.replace(t.values, "raw", ["dcterms:references"], part="uri_label",
                          from_="Ref ", to="See: "),
      select({"value": case("property = 'dcterms:references'",
                            f"nullif(replace(coalesce({V}, ''), 'Ref ', 'See: '), '')", "value")}))
query("replace_selected_records",
      lambda t: q.replace(t.values, "raw", "all", from_="e", to="E",
                          sel=t.resources.where("resource_name = 'items' AND is_public").select("id")),
      renumbered(f"""SELECT * FROM ({select({
          "value": case("sel AND type = 'literal'", f"replace({V}, 'e', 'E')", "value")},
          columns=(*COLUMNS, "sel"),
          source="(SELECT v.*, coalesce(r.is_public, FALSE) AS sel FROM fx_values v LEFT JOIN "
                 "(SELECT id, is_public FROM fx_resources WHERE resource_name = 'items') r "
                 "ON r.id = v.resource_id)")}) AS e
          WHERE NOT (sel AND type = 'literal' AND value = '')"""))

# ---------------------------------------------------------------- create, copy, displace

NEXT = ("(SELECT resource_id, max(pos) + 1 AS nxt FROM fx_values WHERE property = '{0}' "
        "GROUP BY resource_id)")


def _create_sql(prop: str, kind: str, value: str, uri: str, link: str, lang: str, public: str,
                where: str = "TRUE") -> str:
    return f"""{select({})} UNION ALL
        SELECT CAST(NULL AS BIGINT), r.id, '{prop}', coalesce(n.nxt, 0), '{kind}', {lang}, {value},
               {uri}, CAST({link} AS BIGINT), {public}, CAST(NULL AS BIGINT)
        FROM fx_resources r LEFT JOIN {NEXT.format(prop)} n ON n.resource_id = r.id WHERE {where}"""


query("create_values",
      lambda t: q.create_values(t.values, t.resources, "dcterms:title", "literal",
                                value=" New title ", language="fr"),
      _create_sql("dcterms:title", "literal", "'New title'", "NULL", "NULL", "'fr'", "TRUE"))
query("create_uri",
      lambda t: q.create_values(t.values, t.resources, "dcterms:references", "uri",
                                value="https://example.org/", uri_label="Example",
                                visibility=False),
      _create_sql("dcterms:references", "uri", "'Example'", "'https://example.org/'", "NULL",
                  "NULL", "FALSE"))
query("create_link",
      lambda t: q.create_values(t.values, t.resources, "dcterms:hasPart", "resource:itemset",
                                value_resource_id=30000001,
                                sel=t.resources.where("resource_name = 'items'")),
      _create_sql("dcterms:hasPart", "resource:itemset", "NULL", "NULL", "30000001", "NULL", "TRUE",
                  "resource_name = 'items'"))


def _transfer_sql(sources: list[str], to: str, condition: str, copy: bool, limit: int | None = None,
                  kind: str | None = None) -> str:
    listed = ", ".join(f"'{name}'" for name in sources)
    rank = "CASE property " + " ".join(
        f"WHEN '{name}' THEN {i + 1}" for i, name in enumerate(sources)) + " END"
    within = (f"AND hit_rank <= {limit}" if limit else "")
    hit = f"(hit {within})"
    marked = f"""(SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (
                    PARTITION BY resource_id, property ORDER BY pos) AS hit_rank
                  FROM (SELECT *, coalesce(property IN ({listed}) AND ({condition}), FALSE) AS hit
                        FROM fx_values) AS h)"""
    new_type = f"'{kind}'" if kind else "type"
    moved = select({"value_id": "CAST(NULL AS BIGINT)" if copy else "value_id",
                    "property": f"'{to}'", "type": new_type}, source=marked, where=hit)
    moved = moved.replace("SELECT ", f"SELECT {rank} AS rnk, ", 1)
    stay = select({}, source=marked, where="TRUE" if copy else f"NOT {hit}")
    stay = stay.replace("SELECT ", "SELECT 0 AS rnk, ", 1)
    return renumbered(f"{stay} UNION ALL {moved}", order="rnk, pos, value_id")


query("copy_values",
      lambda t: q.copy_values(t.values, ["dcterms:coverage", "dcterms:creator"], "dcterms:title"),
      _transfer_sql(["dcterms:coverage", "dcterms:creator"], "dcterms:title", "TRUE", True))
query("copy_max",
      lambda t: q.copy_values(t.values, ["dcterms:title"], "dcterms:alternative", max_values=2,
                              languages=["en", "de"], datatype="html"),
      _transfer_sql(["dcterms:title"], "dcterms:alternative", "lang IN ('en', 'de')", True, 2, "html"))
query("copy_all_properties",
      lambda t: q.copy_values(t.values, "all", "dcterms:description", match="/[aeiou]{2}/i"),
      renumbered(f"""
        SELECT 0 AS rnk, CAST(0 AS BIGINT) AS first_id, {', '.join(COLUMNS)} FROM fx_values
        UNION ALL
        SELECT 1, min(value_id) OVER (PARTITION BY resource_id, property),
               CAST(NULL AS BIGINT), resource_id, 'dcterms:description', pos, type, lang, value, uri,
               value_resource_id, is_public, value_annotation_id
        FROM fx_values WHERE property <> 'dcterms:description' AND type = 'literal'
             AND regexp_matches(value, '(?i)[aeiou]{{2}}')""", order="rnk, first_id, pos, value_id"))
query("displace_values",
      lambda t: q.displace_values(t.values, ["dcterms:source", "dcterms:coverage"],
                                  "dcterms:subject", contains="s"),
      _transfer_sql(["dcterms:source", "dcterms:coverage"], "dcterms:subject",
                    "type = 'literal' AND contains(value, 's')", False))
query("displace_max",
      lambda t: q.displace_values(t.values, ["dcterms:title"], "dcterms:description", max_values=1,
                                  visibility=True),
      _transfer_sql(["dcterms:title"], "dcterms:description", "is_public", False, 1))

# ---------------------------------------------------------------- explode, merge, order


def _explode_sql(parts: str) -> str:
    pieces = f"""SELECT v.*, i, {trimmed('parts[i]')} AS piece
        FROM (SELECT *, {parts} AS parts FROM fx_values
              WHERE property = 'dcterms:subject' AND contains(value, ';')) v,
             unnest(range(1, len(parts) + 1)) AS t(i)"""
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY value_id ORDER BY i) AS k
                 FROM ({pieces}) AS p WHERE piece <> ''"""
    split = select({"value_id": case("k = 1", "value_id", "NULL"), "value": "piece",
                    "pos": "row_number() OVER (PARTITION BY resource_id, property ORDER BY pos, i) - 1"},
                   source=f"({ranked}) AS r")
    rest = select({}, where="NOT (property = 'dcterms:subject' AND contains(value, ';')) OR value IS NULL")
    return f"{split} UNION ALL {rest}"


PARTS = "string_split(value, ';')"
query("explode_values",
      lambda t: q.explode_values(t.values, ["dcterms:subject"], ";"), _explode_sql(PARTS))
query("explode_limit_pos",
      lambda t: q.explode_values(t.values, ["dcterms:subject"], ";", max_values=2),
      _explode_sql(f"[{PARTS}[1], array_to_string({PARTS}[2:], ';')]"))
query("explode_limit_neg",
      lambda t: q.explode_values(t.values, ["dcterms:subject"], ";", max_values=-2),
      _explode_sql(f"[array_to_string({PARTS}[:-2], ';'), {PARTS}[-1]]"))
BLANK_LINES = trimmed("string_split(value, chr(10))[i]")
query("explode_escaped_separator",
      lambda t: q.explode_values(t.values, ["dcterms:description"], "\\n"),
      f"""WITH v AS (SELECT *, coalesce(property = 'dcterms:description' AND contains(value, chr(10)), FALSE) AS hit FROM fx_values),
               p AS (SELECT *, i, {BLANK_LINES} AS piece FROM v, unnest(range(1, len(string_split(value, chr(10))) + 1)) AS t(i) WHERE hit),
               k AS (SELECT *, row_number() OVER (PARTITION BY value_id ORDER BY i) AS k FROM p WHERE piece <> '')
          {select({"value_id": case("k = 1", "value_id", "NULL"), "value": "piece", "pos": "k - 1"}, source="k")}
          UNION ALL {select({}, source="v", where="NOT hit")}""")
query("explode_match",
      lambda t: q.explode_values(t.values, ["dcterms:title"], " ", match=r"/^Tit(le|el) \d/"),
      renumbered(f"""
        SELECT v.* REPLACE (CASE WHEN i = 1 THEN value_id END AS value_id,
                            string_split(value, ' ')[i] AS value, pos * 10 + i AS pos)
        FROM (SELECT * FROM fx_values WHERE property = 'dcterms:title'
              AND regexp_matches(value, '^Tit(le|el) \\d')) v, unnest(range(1, 3)) AS t(i)
        UNION ALL
        SELECT v.* REPLACE (pos * 10 + 1 AS pos) FROM fx_values v
        WHERE NOT (property = 'dcterms:title' AND coalesce(regexp_matches(value, '^Tit(le|el) \\d'), FALSE))"""))
query("merge_values",
      lambda t: q.merge_values(t.values, ["dcterms:creator"]),
      f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY resource_id) AS n,
                            value LIKE 'https://%' AS url
                     FROM fx_values WHERE property = 'dcterms:creator'),
               p AS (SELECT resource_id, pos // 2 AS pair, min(value_id) AS value_id,
                            max(CASE WHEN url THEN value END) AS u,
                            max(CASE WHEN NOT url THEN value END) AS l, bool_and(is_public) AS is_public
                     FROM c WHERE n % 2 = 0 GROUP BY resource_id, pos // 2)
          {select({}, where="property <> 'dcterms:creator'")}
          UNION ALL {select({}, source='c', where='n % 2 = 1')}
          UNION ALL SELECT value_id, resource_id, 'dcterms:creator', pair, 'uri', NULL, l, u,
                           CAST(NULL AS BIGINT), is_public, CAST(NULL AS BIGINT) FROM p""")
query("order_values",
      lambda t: q.order_values(t.values, ["fr", "de"], ["dcterms:title", "dcterms:description"]),
      f"""WITH g AS (SELECT *, CASE WHEN type <> 'literal' OR coalesce(lang, '') = '' THEN '' ELSE lang END AS grp
                     FROM fx_values),
               k AS (SELECT *, CASE grp WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS rnk,
                            min(pos) OVER (PARTITION BY resource_id, property, grp) AS seen FROM g)
          {select({"pos": "CASE WHEN property IN ('dcterms:title', 'dcterms:description') THEN row_number() OVER ("
                          "PARTITION BY resource_id, property ORDER BY rnk, CASE WHEN rnk = 3 THEN seen END, pos) - 1 "
                          "ELSE pos END"}, source='k')}""")
query("values_visibility",
      lambda t: q.set_visibility(t.values, False, "all", datatypes=["literal"],
                                 languages=["fr", "en"], contains="e"),
      select({"is_public": case("type = 'literal' AND lang IN ('fr', 'en') AND contains(value, 'e')",
                                "FALSE", "is_public")}))

# ---------------------------------------------------------------- remove

query("remove_property", lambda t: q.remove_values(t.values, ["dcterms:description"]),
      select({}, where="property <> 'dcterms:description'"))
query("remove_filtered",
      lambda t: q.remove_values(t.values, ["dcterms:title", "dcterms:subject"], languages=["en"],
                                contains="Title", visibility=True),
      renumbered(select({}, where="NOT coalesce(property IN ('dcterms:title', 'dcterms:subject') AND lang = 'en' "
                                  "AND contains(value, 'Title') AND is_public, FALSE)")))
query("remove_match",
      lambda t: q.remove_values(t.values, "all", match="#^https?://.*[02468]$#"),
      renumbered(select({}, where="""NOT coalesce(regexp_matches(CASE WHEN type = 'literal' THEN value
          WHEN type <> 'resource' THEN uri END, '^https?://.*[02468]$'), FALSE)""")))
query("remove_equal",
      lambda t: q.remove_values(t.values, ["dcterms:relation", "dcterms:coverage"], equal="30000002"),
      select({}, where="NOT (property = 'dcterms:relation' AND value_resource_id = 30000002)"))
for name, options, keep in (
        ("remove_max", dict(max_values=1), "NOT (property = 'dcterms:title' AND up <= 1)"),
        ("remove_max_last", dict(max_values=-1), "NOT (property = 'dcterms:title' AND down <= 1)"),
        ("remove_keep", dict(keep_max_values=2), "NOT (property = 'dcterms:title' AND up > 2)"),
        ("remove_keep_last", dict(keep_max_values=-1), "NOT (property = 'dcterms:title' AND down > 1)")):
    query(name, lambda t, options=options: q.remove_values(t.values, ["dcterms:title"], **options),
          renumbered(select({}, where=keep, source="""(SELECT *,
              row_number() OVER (PARTITION BY resource_id, property ORDER BY pos) AS up,
              row_number() OVER (PARTITION BY resource_id, property ORDER BY pos DESC) AS down
              FROM fx_values)""")))

# ---------------------------------------------------------------- convert


def _convert_sql(prop: str, hit: str, changes: dict[str, str], source: str = "fx_values") -> str:
    fresh = {"value": "NULL", "uri": "NULL", "value_resource_id": "NULL", **changes}
    found = f"(property = '{prop}' AND coalesce({hit}, FALSE))"
    return select({c: case(found, e, c) for c, e in fresh.items()}, source=source)


LINKED = ("(SELECT v.*, r.resource_name AS kind, r.title FROM fx_values v "
          "LEFT JOIN fx_resources r ON r.id = v.value_resource_id)")
PLACED = ("(SELECT v.*, p.geoname_id, p.toponym, p.country, p.lat, p.lon FROM fx_values v LEFT JOIN fx_places p "
          "ON p.geoname_id = TRY_CAST(regexp_extract(v.uri, 'geonames\\.org/(\\d+)', 1) AS BIGINT))")

query("convert_literal_to_html",
      lambda t: q.convert(t.values, None, "literal", "html", ["dcterms:abstract"]),
      _convert_sql("dcterms:abstract", f"{V} <> ''", {"type": "'html'", "value": "value"}))
query("convert_literal_only_tagged",
      lambda t: q.convert(q.replace(t.values, "raw", ["dcterms:title"], from_="Title ", to="<b>",
                                    append=">"),
                          None, "literal", "html", ["dcterms:title"], only_tagged=True),
      _convert_sql("dcterms:title", "value LIKE '<%'", {"type": "'html'", "value": "value"},
                   source=f"({_replace_sql('dcterms:title', f'''replace({V}, 'Title ', '<b>') || '>' ''')})"))
query("convert_html_to_literal",
      lambda t: q.convert(q.copy_values(t.values, ["dcterms:alternative"], "dcterms:x", datatype="html"),
                          None, "html", "literal", ["dcterms:x"], strip_html=True),
      f"""{select({})} UNION ALL {select({"value_id": "CAST(NULL AS BIGINT)", "property": "'dcterms:x'"},
                                         where="property = 'dcterms:alternative'")}""")
query("convert_literal_to_vocab",
      lambda t: q.convert(t.values, None, "literal", "customvocab:1", ["dcterms:coverage"],
                          vocab=t.nation.where("n_nationkey < 9").select("n_name")),
      _convert_sql("dcterms:coverage", "value IN (SELECT n_name FROM nation WHERE n_nationkey < 9)",
                   {"type": "'customvocab:1'", "value": "value"}))
query("convert_literal_to_coordinates",
      lambda t: q.convert(
          q.convert(t.values, None, "valuesuggest:geonames:geonames", "literal", ["dcterms:spatial"],
                    literal_value="uri"),
          None, "literal", "geography:coordinates", ["dcterms:spatial"], places=t.places),
      _convert_sql("dcterms:spatial", "geoname_id IS NOT NULL",
                   {"type": "'geography:coordinates'", "lang": "NULL",
                    "value": "CAST(lat AS STRING) || ',' || CAST(lon AS STRING)"}, PLACED))
query("convert_literal_to_link",
      lambda t: q.convert(t.values, t.resources, "literal", "resource:item", ["dcterms:isPartOf"],
                          preprocess="filename", identifier_properties=["dcterms:identifier"]),
      _convert_sql("dcterms:isPartOf", "target IS NOT NULL",
                   {"type": "'resource:item'", "value_resource_id": "target"},
                   """(SELECT v.*, i.target FROM fx_values v LEFT JOIN (
                       SELECT value AS ident, min(resource_id) AS target FROM fx_values
                       WHERE property = 'dcterms:identifier' GROUP BY value) i
                       ON i.ident = regexp_replace(regexp_extract(v.value, '([^/]*)$', 1), '\\.pdf$', ''))"""))
query("convert_literal_to_uri",
      lambda t: q.convert(t.values, None, "literal", "uri", ["dcterms:creator"], uri_label="Profile",
                          contains="https://"),
      _convert_sql("dcterms:creator", "contains(value, 'https://')",
                   {"type": "'uri'", "uri": "value", "value": "'Profile'"}))
query("convert_literal_to_uri_label",
      lambda t: q.convert(t.values, None, "literal", "uri", ["dcterms:title"], extract_label=True),
      _convert_sql("dcterms:title", "string_split(value, ' ')[1] <> ''",
                   {"type": "'uri'", "uri": "string_split(value, ' ')[1]",
                    "value": f"nullif({trimmed('''substr(value, length(string_split(value, ' ')[1]) + 2)''')}, '')"}))
query("convert_link_to_link",
      lambda t: q.convert(t.values, t.resources, "resource", "resource:itemset", ["dcterms:relation"]),
      _convert_sql("dcterms:relation", "kind = 'item_sets'",
                   {"type": "'resource:itemset'", "value_resource_id": "value_resource_id"}, LINKED))
query("convert_link_to_literal",
      lambda t: q.convert(t.values, t.resources, "resource", "literal", ["dcterms:relation"]),
      _convert_sql("dcterms:relation", "title IS NOT NULL", {"type": "'literal'", "value": "title"}, LINKED))
query("convert_link_to_uri",
      lambda t: q.convert(t.values, t.resources, "resource", "uri", "all",
                          uri_base="https://example.org/s/main/"),
      _convert_sql("dcterms:relation", "kind IS NOT NULL",
                   {"type": "'uri'", "value": "title",
                    "uri": "'https://example.org/s/main/item-set/' || CAST(value_resource_id AS STRING)"}, LINKED))
query("convert_uri_to_link",
      lambda t: q.convert(
          q.convert(t.values, t.resources, "resource", "uri", ["dcterms:relation"],
                    uri_base="https://example.org/api/", uri_is_api=True),
          t.resources, "uri", "resource:itemset", "all", uri_base="https://example.org/"),
      _convert_sql("dcterms:relation", "kind = 'item_sets'",
                   {"type": "'resource:itemset'", "value_resource_id": "value_resource_id"}, LINKED))
query("convert_uri_to_uri",
      lambda t: q.convert(t.values, None, "uri", "valuesuggest:idref:person", ["dcterms:references"]),
      select({"type": case("property = 'dcterms:references'", "'valuesuggest:idref:person'", "type")}))
query("convert_uri_to_place",
      lambda t: q.convert(t.values, None, "valuesuggest:geonames:geonames", "place",
                          ["dcterms:spatial"], places=t.places),
      _convert_sql("dcterms:spatial", "geoname_id IS NOT NULL",
                   {"type": "'place'", "uri": "uri", "value": """'{"geonameId":' || CAST(geoname_id AS STRING)
                    || ',"toponym":"' || toponym || '","country":"' || country || '","latitude":'
                    || CAST(lat AS STRING) || ',"longitude":' || CAST(lon AS STRING) || '}'"""}, PLACED))
query("convert_uri_to_coordinates",
      lambda t: q.convert(t.values, None, "valuesuggest:geonames:geonames", "literal",
                          ["dcterms:spatial"], literal_value="coordinates", places=t.places),
      _convert_sql("dcterms:spatial", "geoname_id IS NOT NULL",
                   {"type": "'geography:coordinates'", "lang": "NULL",
                    "value": "CAST(lat AS STRING) || ',' || CAST(lon AS STRING)"}, PLACED))


def _place_names(t: Tables) -> DataFrame:
    """Places with a row for each of their names."""
    names = [("name", "NULL", "toponym", "TRUE"), ("official", "'fr'", "'FR ' || toponym", "geoname_id % 2 = 0"),
             ("alternate", "'fr'", "'Autre ' || toponym", "geoname_id % 3 = 0"), ("alternate", "'de'", "'DE ' || toponym", "TRUE")]
    return t.spark.sql(" UNION ALL ".join(
        f"SELECT geoname_id, '{kind}' AS kind, {lang} AS lang, {name} AS toponym, country, lat, lon FROM {{places}} WHERE {where}"
        for kind, lang, name, where in names), places=t.places)


query("convert_uri_to_place_language",
      lambda t: q.convert(t.values, None, "valuesuggest:geonames:geonames", "place",
                          ["dcterms:spatial"], places=_place_names(t), uri_language="fra"),
      _convert_sql("dcterms:spatial", "geoname_id IS NOT NULL",
                   {"type": "'place'", "uri": "uri", "value": """'{"geonameId":' || CAST(geoname_id AS STRING)
                    || ',"toponym":"' || CASE WHEN geoname_id % 2 = 0 THEN 'FR ' WHEN geoname_id % 3 = 0 THEN 'Autre ' ELSE '' END || toponym
                    || '","country":"' || country || '","latitude":' || CAST(lat AS STRING) || ',"longitude":'
                    || CAST(lon AS STRING) || '}'"""}, PLACED))
for option, hit, expression in (
        ("label_uri", "TRUE", "coalesce(value || ' (' || uri || ')', uri)"),
        ("uri_label", "TRUE", "coalesce(uri || ' (' || value || ')', uri)"),
        ("label_or_uri", "TRUE", "coalesce(value, uri)"),
        ("label", "value IS NOT NULL", "value"),
        ("uri", "TRUE", "uri")):
    query(f"convert_uri_to_literal_{option}",
          lambda t, option=option: q.convert(t.values, None, "uri", "literal", ["dcterms:references"],
                                             literal_value=option),
          _convert_sql("dcterms:references", hit, {"type": "'literal'", "value": expression}))

# ---------------------------------------------------------------- fill

SPATIAL = "property = 'dcterms:spatial'"
BEST = ("(SELECT v.*, a.label FROM fx_values v LEFT JOIN (SELECT uri AS u, arg_min(label, priority) AS label "
        "FROM fx_authority WHERE {0} GROUP BY uri) a "
        "ON a.u = regexp_extract(v.uri, '^https://www\\.geonames\\.org/\\d+'))")
BY_NAME = BEST.format("kind = 'name'")
BY_FRENCH = BEST.format("TRUE")

query("fill_label_missing",
      lambda t: q.fill_values(t.values, t.authority, "label_missing", ["dcterms:spatial"],
                              [fx.GEONAMES]),
      select({"value": case(f"{SPATIAL} AND value IS NULL AND label IS NOT NULL", "label", "value"),
              "uri": "nullif(uri, '')"}, source=BY_NAME))
query("fill_label_all",
      lambda t: q.fill_values(t.values, t.authority, "label_all", "all", [fx.GEONAMES], language="fr",
                              update_language="update"),
      select({"value": case(f"{SPATIAL} AND label IS NOT NULL", "label", "value"),
              "lang": case(f"{SPATIAL} AND label IS NOT NULL", "'fr'", "lang")}, source=BY_FRENCH))
BLANKED = "CASE WHEN property = 'dcterms:spatial' AND value_id % 3 = 0 THEN '' ELSE uri END"
query("fill_blank_uri",
      lambda t: q.fill_values(
          t.values.withColumn("uri", F.expr(BLANKED)), t.authority, "label_missing", ["dcterms:spatial"], [fx.GEONAMES]),
      select({"value": case(f"{SPATIAL} AND value_id % 3 <> 0 AND value IS NULL AND label IS NOT NULL", "label", "value"),
              "uri": f"nullif({BLANKED}, '')"}, source=BY_NAME))
query("fill_label_from_literal",
      lambda t: q.fill_values(
          q.convert(t.values, None, fx.GEONAMES, "literal", ["dcterms:spatial"], literal_value="uri"),
          t.authority, "label_missing", ["dcterms:spatial"], ["literal"], datatype=fx.GEONAMES),
      select({"value": case(f"{SPATIAL} AND label IS NOT NULL", "label", "value")}, source=BY_NAME))
query("fill_label_remove",
      lambda t: q.fill_values(t.values, None, "label_remove", "all", [fx.GEONAMES],
                              update_language="remove"),
      select({"value": case(SPATIAL, "NULL", "value")}))

NAMED = ("(SELECT v.*, a.found FROM fx_values v LEFT JOIN (SELECT label, min(uri) AS found FROM fx_authority "
         "GROUP BY label HAVING count(DISTINCT uri) = 1) a ON a.label = v.value)")
for mode in ("uri_missing", "uri_all"):
    query(f"fill_{mode}",
          lambda t, mode=mode: q.fill_values(t.values, t.authority, mode,
                                             ["dcterms:coverage", "dcterms:spatial"],
                                             ["literal", fx.GEONAMES], datatype=fx.GEONAMES),
          select({"type": case("property = 'dcterms:coverage' AND found IS NOT NULL",
                               f"'{fx.GEONAMES}'", "type"),
                  "uri": case("property = 'dcterms:coverage' AND found IS NOT NULL", "found", "uri")},
                 source=NAMED))

# ---------------------------------------------------------------- records and media


def _resources_sql(changes: dict[str, str]) -> str:
    return select(changes, RESOURCE_COLUMNS, "fx_resources")


def _media_sql(changes: dict[str, str], where: str = "TRUE") -> str:
    return select(changes, MEDIA_COLUMNS, "fx_media", where)


query("fill_owner", lambda t: q.set_owner(t.resources, 7),
      _resources_sql({"owner_id": "CAST(7 AS INT)"}))
query("clear_owner",
      lambda t: q.set_owner(t.resources, 0, sel=t.resources.where("resource_name = 'items'")),
      _resources_sql({"owner_id": case("resource_name = 'items'", "NULL", "owner_id")}))
for mode, when, asset in (
        ("fill", "TRUE", "100"),
        ("append", "thumbnail_id IS NULL", "100"),
        ("append_no_primary", "primary_media_id IS NULL", "100"),
        ("append_no_primary_no_thumbnail", "primary_media_id IS NULL AND thumbnail_id IS NULL", "100"),
        ("replace", "thumbnail_id IS NOT NULL", "100"),
        ("remove", "thumbnail_id = 100", "NULL"),
        ("remove_primary", "primary_media_id IS NOT NULL", "NULL"),
        ("delete", "TRUE", "NULL")):
    query(f"thumbnails_{mode}", lambda t, mode=mode: q.set_thumbnail(t.resources, mode, 100),
          _resources_sql({"thumbnail_id": case(when, f"CAST({asset} AS INT)", "thumbnail_id")}))

query("media_remove_all", lambda t: q.remove_media(
    t.media, "all", sel=t.resources.where("NOT is_public").select("id")),
      _media_sql({}, "item_id NOT IN (SELECT id FROM fx_resources WHERE NOT is_public)"))
query("media_remove_media_type",
      lambda t: q.remove_media(t.media, "media_type", media_types=["application/pdf", "image/png"]),
      _media_sql({}, "media_type NOT IN ('application/pdf', 'image/png')"))
query("media_remove_media_extension",
      lambda t: q.remove_media(t.media, "media_extension", extensions=["jpg=html"]),
      _media_sql({}, "extension NOT IN ('jpg', 'html')"))

NATURAL_TITLE = "CAST(regexp_extract(title, '\\d+') AS INT)"
BASE = "regexp_extract(regexp_replace(source, '/+$', ''), '([^/]*)$', 1)"
WHOLE = "lower(regexp_replace(source, '\\.[^./]+$', ''))"


def natural(key: str) -> str:
    """Runs of digits behind the length of their length and their length; those that begin with zero
    as they are, with an end."""
    return f"""array_to_string(list_transform(regexp_extract_all(translate(regexp_replace({key}, '^0+([0-9])', '\\1'),
        'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[0-9]+|[^0-9]+'), lambda run: CASE
        WHEN run LIKE '0%' THEN run || chr(1)
        WHEN regexp_matches(run, '^[1-9]') THEN CAST(length(CAST(length(run) AS VARCHAR)) AS VARCHAR) || CAST(length(run) AS VARCHAR) || run
        ELSE run END), '')"""


STEM = f"lower(regexp_replace({BASE}, '\\.[^.]*$', ''))"
for name, order, options, keys in (
        ("title", "title", {}, NATURAL_TITLE),
        ("mediatype", "mediatype", {}, "media_type"),
        ("extension", "extension", {}, "extension"),
        ("mediatype_list", "mediatype", dict(media_types=["text", "image/png"]),
         "CASE WHEN media_type LIKE 'text/%' THEN 0 WHEN media_type = 'image/png' THEN 1 ELSE 2 END, media_type"),
        ("extension_list", "extension", dict(extensions=["pdf", "html"]),
         "CASE extension WHEN 'pdf' THEN 0 WHEN 'html' THEN 1 ELSE 2 END, extension"),
        ("mediatype_title", "mediatype/title", {}, "media_type, lower(title)"),
        ("mediatype_title_list", "mediatype/title", dict(media_types=["image"]),
         "CASE WHEN media_type LIKE 'image/%' THEN 0 ELSE 1 END, "
         "CASE WHEN media_type LIKE 'image/%' THEN '' ELSE media_type END, lower(title)"),
        ("title_mediatype", "title/mediatype", {}, "lower(title), media_type"),
        ("title_mediatype_list", "title/mediatype", dict(media_types=["text", "image/png"]),
         "lower(title), CASE WHEN media_type LIKE 'text/%' THEN 0 ELSE 1 END, "
         "CASE WHEN media_type = 'image/png' THEN 0 ELSE 1 END, media_type"),
        ("extension_basename", "extension/basename", {}, f"extension, {STEM}"),
        ("extension_title", "extension/title", {}, "extension, lower(title)"),
        ("title_extension", "title/extension", {}, "lower(title), extension"),
        ("basename", "basename", {}, natural(BASE)),
        ("basename_mediatype", "basename/mediatype", {}, f"{STEM}, media_type"),
        ("mediatype_basename", "mediatype/basename", {}, f"media_type, {STEM}"),
        ("source", "source", {}, natural("source")),
        ("source_mediatype", "source/mediatype", {}, f"{WHOLE}, media_type"),
        ("source_extension", "source/extension", {}, f"{WHOLE}, extension"),
        ("mediatype_source", "mediatype/source", {}, f"media_type, {WHOLE}"),
        ("extension_source", "extension/source", {}, f"extension, {WHOLE}"),
        ("basename_extension_list", "basename/extension", dict(extensions=["png"]),
         f"{STEM}, CASE WHEN extension = 'png' THEN 0 ELSE 1 END, extension")):
    query(f"media_order_{name}",
          lambda t, order=order, options=options: q.order_media(t.media, order, **options),
          _media_sql({"position": f"row_number() OVER (PARTITION BY item_id ORDER BY {keys}, position)"}))

query("media_html",
      lambda t: q.edit_media_html(t.media, "raw", from_="<p>", to="<p class='x'>", append="<!-- -->"),
      _media_sql({"html": case("ingester = 'html' AND html <> ''",
                               trimmed("replace(html, '<p>', '<p class=''x''>') || '<!-- -->'"), "html")}))
query("media_html_regex",
      lambda t: q.edit_media_html(t.media, "regex", from_=r"~<(/?)h(\d)~", to="<${1}H$2"),
      _media_sql({"html": case("ingester = 'html' AND html <> ''",
                               trimmed("regexp_replace(html, '<(/?)h(\\d)', '<\\1H\\2', 'g')"), "html")}))
query("media_source_raw",
      lambda t: q.edit_media_source(t.media, "raw", from_="http", to="HTTP"),
      _media_sql({"source": "replace(source, 'http', 'HTTP')"}))
query("media_source_basename", lambda t: q.edit_media_source(t.media, "basename"),
      _media_sql({"source": f"nullif({BASE}, '')"}))
query("media_source_remove", lambda t: q.edit_media_source(t.media, "remove"),
      _media_sql({"source": "CAST(NULL AS STRING)"}))
query("media_type", lambda t: q.set_media_type(t.media, "text/html", "application/xhtml+xml"),
      _media_sql({"media_type": case("media_type = 'text/html'", "'application/xhtml+xml'", "media_type")}))
query("media_visibility",
      lambda t: q.set_media_visibility(t.media, True, media_types=["image/png", "text/html"],
                                       renderers=["file"]),
      _media_sql({"is_public": case("media_type IN ('image/png', 'text/html') AND renderer = 'file'",
                                    "TRUE", "is_public")}))

# ---------------------------------------------------------------- explode items, pages

PAIRS = """pairs AS (
    SELECT item_id, id AS media_id, rn = 1 AS first_one,
           CASE WHEN rn = 1 THEN item_id ELSE id + (SELECT max(id) FROM fx_resources) END AS new_id
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position, id) AS rn FROM fx_media
          WHERE item_id IN (SELECT id FROM fx_resources WHERE resource_name = 'items')) AS m)"""
# Values of media: each media gets its title and source as values, so that there is something to pass on.
MEDIA_VALUES = """all_values AS (
    SELECT * FROM fx_values
    UNION ALL SELECT 900000000 + id * 2, id, 'dcterms:title', 0, 'literal', 'en', title, NULL, NULL, is_public, NULL FROM fx_media
    UNION ALL SELECT 900000000 + id * 2 + 1, id, 'dcterms:format', 0, 'literal', NULL, media_type, NULL, NULL, is_public, NULL FROM fx_media)"""


def _with_media_values(t: Tables) -> DataFrame:
    own = t.media.select("id", "is_public", F.inline(F.array(
        F.struct(F.lit(0).alias("k"), F.lit("dcterms:title").alias("property"),
                 F.lit("en").alias("lang"), F.col("title").alias("value")),
        F.struct(F.lit(1).alias("k"), F.lit("dcterms:format").alias("property"),
                 F.lit(None).cast("string").alias("lang"), F.col("media_type").alias("value")))))
    return t.values.unionByName(own.select(
        (F.lit(900000000) + F.col("id") * 2 + F.col("k")).alias("value_id"),
        F.col("id").alias("resource_id"), "property", F.lit(0).cast("long").alias("pos"),
        F.lit("literal").alias("type"), "lang", "value", F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("long").alias("value_resource_id"), "is_public",
        F.lit(None).cast("long").alias("value_annotation_id")))


def _explode_item_sql(mode: str) -> str:
    given = """SELECT 1 AS part, NULL AS value_id, p.new_id AS resource_id, v.property, v.pos, v.type, v.lang, v.value,
                      v.uri, v.value_resource_id, v.is_public, v.value_annotation_id
               FROM all_values v JOIN pairs p ON p.media_id = v.resource_id"""
    if mode == "none":
        given += " WHERE FALSE"
    owned_where = {
        "append": "TRUE", "none": "TRUE", "replace": "p.media_id IS NULL",
        "update": """NOT EXISTS (SELECT 1 FROM all_values m WHERE m.resource_id = p.media_id
                                 AND m.property = v.property)"""}[mode]
    owned = f"""SELECT 0 AS part, CASE WHEN coalesce(p.first_one, TRUE) THEN v.value_id END AS value_id,
                       coalesce(p.new_id, v.resource_id) AS resource_id, v.property, v.pos, v.type, v.lang, v.value,
                       v.uri, v.value_resource_id, v.is_public, v.value_annotation_id
                FROM all_values v LEFT JOIN pairs p ON p.item_id = v.resource_id WHERE {owned_where}"""
    return f"WITH {PAIRS}, {MEDIA_VALUES} {renumbered(f'{owned} UNION ALL {given}', 'part, pos')}"


for mode in ("append", "update", "replace", "none"):
    query(f"explode_item_{mode}",
          lambda t, mode=mode: q.explode_items(t.resources, t.media, _with_media_values(t), mode)[2],
          _explode_item_sql(mode))
query("explode_item_records",
      lambda t: q.explode_items(t.resources, t.media, t.values, "none")[0],
      f"""WITH {PAIRS} SELECT coalesce(p.new_id, r.id) AS id, resource_name, owner_id, resource_class_id,
              resource_template_id, thumbnail_id, coalesce(p.media_id, r.primary_media_id) AS primary_media_id,
              title, is_public
          FROM fx_resources r LEFT JOIN pairs p ON p.item_id = r.id""")
query("explode_item_media",
      lambda t: q.explode_items(t.resources, t.media, t.values, "none")[1],
      f"""WITH {PAIRS} SELECT m.id, coalesce(p.new_id, m.item_id) AS item_id,
              CASE WHEN p.new_id IS NULL THEN m.position ELSE 1 END AS position, m.title, m.source,
              m.media_type, m.extension, m.ingester, m.renderer, m.is_public, m.html
          FROM fx_media m LEFT JOIN pairs p ON p.media_id = m.id""")

query("pages_without_count",
      lambda t: q.pages_without_count(t.media, t.page_counts.where("media_id % 3 <> 0")),
      """SELECT item_id, id AS media_id, source FROM fx_media
         WHERE media_type = 'application/pdf' AND id % 3 = 0""")

PAGE_NAME = ("regexp_replace(regexp_replace(regexp_extract(regexp_replace(source, '/+$', ''), '([^/]*)$', 1), "
             "'(.)\\.pdf$', '\\1'), '[^A-Za-z0-9.@~+:\\[\\]_-]+', '_', 'g')")
query("page_manifest",
      lambda t: q.page_manifest(t.media, t.page_counts),
      f"""SELECT item_id, media_id, CAST(page AS INT) AS page,
                 {PAGE_NAME} || '.' || lpad(CAST(page AS STRING), 4, '0') || '.jpg' AS source,
                 size + before + page AS position
          FROM (SELECT item_id, id AS media_id, source, id % 5 AS page_count,
                       coalesce(sum(id % 5) OVER (PARTITION BY item_id ORDER BY position, id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                       (SELECT count(*) FROM fx_media s WHERE s.item_id = m.item_id) AS size
                FROM fx_media m WHERE media_type = 'application/pdf') AS c,
               unnest(range(1, page_count + 1)) AS t(page)""")
query("page_manifest_skip_existing",
      lambda t: _page_skip(t),
      f"""SELECT item_id, media_id, CAST(page AS INT) AS page,
                 {PAGE_NAME} || '.' || lpad(CAST(page AS STRING), 4, '0') || '.jpg' AS source,
                 4 + page AS position
          FROM (SELECT item_id, id AS media_id, source, id % 5 AS page_count FROM fx_media
                WHERE media_type = 'application/pdf') AS c, unnest(range(1, page_count + 1)) AS t(page)
          WHERE page <> 1""")


def _page_skip(t: Tables) -> DataFrame:
    """The jpeg of each item takes the name of the first page of its last pdf."""
    first = q.page_manifest(t.media, t.page_counts, mode="last").where("page = 1").select(
        "item_id", F.col("source").alias("_name"))
    media = t.media.join(first, "item_id", "left").withColumn("source", F.when(
        F.col("media_type") == "image/jpeg", F.coalesce("_name", "source")).otherwise(F.col("source")))
    return q.page_manifest(media.drop("_name"), t.page_counts, mode="last", skip_existing=True)


# ---------------------------------------------------------------- cleaning

UNI = {c: f"nullif(trim({c}, {UNICODE_SET}), '')" for c in ("value", "lang", "uri")}
TRIMMED = f"""SELECT * FROM ({select(UNI)}) AS e
    WHERE value IS NOT NULL OR uri IS NOT NULL OR value_resource_id IS NOT NULL"""
query("trim_values", lambda t: q.trim_values(t.values), renumbered(TRIMMED))
query("clean_empty", lambda t: q.clean_empty_values(t.values),
      select({"value": "nullif(value, '')", "uri": "nullif(uri, '')"}))
query("clean_languages", lambda t: q.clean_languages(t.values), select({"lang": "nullif(lang, '')"}))
query("clean_language_codes",
      lambda t: q.clean_language_codes(t.values, "fr", "fra", ["dcterms:title", "dcterms:subject"]),
      select({"lang": case("lang = 'fr' AND property IN ('dcterms:title', 'dcterms:subject')", "'fra'", "lang")}))
query("clean_language_codes_blank",
      lambda t: q.clean_language_codes(t.values, "", "und", "all",
                                       sel=t.resources.where("is_public").select("id")),
      select({"lang": case("coalesce(lang, '') = '' AND resource_id IN (SELECT id FROM fx_resources WHERE is_public)",
                           "'und'", "lang")}))
query("clean_language_codes_remove", lambda t: q.clean_language_codes(t.values, "de", "", "all"),
      select({"lang": case("lang = 'de'", "NULL", "lang")}))
query("specify_datatypes", lambda t: q.specify_datatypes(t.values, t.resources),
      select({"type": case("type = 'resource' AND kind IS NOT NULL",
                           "CASE kind WHEN 'item_sets' THEN 'resource:itemset' WHEN 'items' THEN 'resource:item' "
                           "WHEN 'media' THEN 'resource:media' ELSE 'resource:annotation' END", "type")},
             source=LINKED))


def _dedup_sql(source: str, fold: bool = True, extra: str = "") -> str:
    keys = ", ".join(f"lower({c})" if fold else c for c in ("type", "lang", "value", "uri"))
    return renumbered(f"""SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY resource_id, property, value_resource_id, {keys}, is_public, value_annotation_id {extra}
        ORDER BY value_id) AS rn FROM ({source}) AS s) AS r WHERE rn = 1""")


query("dedup_values_measured", lambda t: q.deduplicate_values(q.measure_groups(t.values)),
      _dedup_sql(select({})))
query("dedup_values", lambda t: q.deduplicate_values(t.values), _dedup_sql(select({})))
query("dedup_values_case_sensitive", lambda t: q.deduplicate_values(t.values, case_sensitive=True),
      _dedup_sql(select({}), fold=False))
query("dedup_values_annotated",
      lambda t: q.deduplicate_values(t.values, annotation_values=t.annotation_values),
      _dedup_sql("SELECT v.*, a.field, a.ordinal FROM fx_values v LEFT JOIN fx_annotation_value a ON a.id = v.value_id",
                 extra=", lower(field), ordinal"))

# ---------------------------------------------------------------- reports, chains, streams, sources

query("facet_values", lambda t: q.facets(t.media, "ingester"),
      "SELECT DISTINCT ingester FROM fx_media")
query("changed_rows",
      lambda t: q.changes(t.values, q.trim_values(t.values, renumber=False)),
      f"""SELECT 0 AS added, (SELECT count(*) FROM fx_values) - (SELECT count(*) FROM ({TRIMMED}) AS a) AS removed,
                 (SELECT count(*) FROM ({TRIMMED}) AS a JOIN fx_values v USING (value_id)
                  WHERE a.value IS DISTINCT FROM v.value OR a.lang IS DISTINCT FROM v.lang
                     OR a.uri IS DISTINCT FROM v.uri) AS changed""")

query("changed_rows_unsaved",
      lambda t: q.changes(t.values.withColumn("value_id", F.lit(None).cast("long")),
                          t.values.where("property <> 'dcterms:title'").withColumn(
                              "value_id", F.lit(None).cast("long"))),
      """SELECT 0 AS added, (SELECT count(*) FROM fx_values WHERE property = 'dcterms:title') AS removed,
                0 AS changed""")

LARGE = """SELECT o_orderkey * 10 + k AS value_id, o_custkey AS resource_id,
               CASE k WHEN 0 THEN 'ex:status' WHEN 1 THEN 'ex:priority' WHEN 2 THEN 'ex:month' ELSE 'ex:list' END AS property,
               CASE k WHEN 0 THEN o_orderstatus
                      WHEN 1 THEN CASE WHEN o_orderkey % 7 = 0 THEN '  ' || lower(o_orderpriority) || ' ' ELSE o_orderpriority END
                      WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 7)
                      ELSE o_orderstatus || ';' || o_orderpriority || ';' || substr(CAST(o_orderdate AS STRING), 1, 7) END AS value
           FROM orders CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) AS s"""
PLACED = ("value_id", "resource_id", "property", "pos", "value")


def _large(t: Tables) -> DataFrame:
    return fx.values_large(t.spark, t.folder)


def _placed(values: DataFrame) -> DataFrame:
    return with_positions(values).select(*PLACED)


def _created(values: DataFrame) -> DataFrame:
    records = values.select(F.col("resource_id").alias("id")).distinct()
    return q.create_values(values, records, "ex:status", "literal", value="NEW")


CREATED = f"""WITH large AS ({LARGE}), added AS (
    SELECT * FROM large UNION ALL SELECT DISTINCT NULL, resource_id, 'ex:status', 'NEW' FROM large)
SELECT value_id, resource_id, property, value,
       row_number() OVER (PARTITION BY resource_id, property ORDER BY value_id NULLS LAST) - 1 AS pos FROM added"""
COPIED = f"""WITH large AS ({LARGE}), both_ AS (
    SELECT value_id, resource_id, property, value, 0 AS part, value_id AS place FROM large
    UNION ALL SELECT NULL, resource_id, 'ex:list', value, 1, value_id FROM large WHERE property = 'ex:status')
SELECT value_id, resource_id, property, value,
       row_number() OVER (PARTITION BY resource_id, property ORDER BY part, place) - 1 AS pos FROM both_"""

# Tables without positions, as a database gives them: numbered in blocks and, where the sizes of
# groups are known, in one window, with the same result.
query("create_unpositioned", lambda t: _placed(_created(_large(t))), CREATED)
query("create_unpositioned_measured", lambda t: _placed(_created(q.measure_groups(_large(t)))), CREATED)
query("copy_unpositioned", lambda t: _placed(q.copy_values(_large(t), ["ex:status"], "ex:list")), COPIED)
query("copy_unpositioned_measured",
      lambda t: _placed(q.copy_values(q.measure_groups(_large(t)), ["ex:status"], "ex:list")), COPIED)


def _unsaved(t: Tables) -> DataFrame:
    """Values without identifiers and positions, in three languages, some twice."""
    return t.spark.sql("""
        SELECT CAST(NULL AS BIGINT) AS value_id, c_nationkey AS resource_id, 'ex:segment' AS property, CAST(NULL AS BIGINT) AS pos,
               'literal' AS type, element_at(array('fr', 'de', 'en'), CAST(c_custkey % 3 + 1 AS INT)) AS lang,
               c_mktsegment AS value, CAST(NULL AS STRING) AS uri, CAST(NULL AS BIGINT) AS value_resource_id, true AS is_public,
               CAST(NULL AS BIGINT) AS value_annotation_id FROM {customer} WHERE c_nationkey IS NOT NULL""", customer=t.customer)


UNSAVED = """SELECT c_nationkey AS resource_id, ['fr', 'de', 'en'][CAST(c_custkey % 3 + 1 AS INT)] AS lang, c_mktsegment AS value
             FROM customer WHERE c_nationkey IS NOT NULL"""
# Texts of one language are interchangeable here, so positions are compared with languages alone.
for name, prepared in (("", lambda values: values), ("_measured", q.measure_groups)):
    query(f"order_unpositioned{name}",
          lambda t, prepared=prepared: q.order_values(prepared(_unsaved(t)), ["de"], "all").where("lang = 'de'").select(
              "resource_id", "pos", "lang"),
          f"""SELECT CAST(resource_id AS BIGINT) AS resource_id, row_number() OVER (PARTITION BY resource_id ORDER BY value) - 1 AS pos, lang
              FROM ({UNSAVED}) AS u WHERE lang = 'de'""")
    query(f"dedup_unsaved{name}",
          lambda t, prepared=prepared: q.deduplicate_values(prepared(_unsaved(t))).select("resource_id", "lang", "value"),
          f"SELECT DISTINCT CAST(resource_id AS BIGINT) AS resource_id, lang, value FROM ({UNSAVED}) AS u")
query("property_terms",
      lambda t: property_terms(
          t.values.select("value_id", F.when(F.col("property") == "dcterms:title", 1).otherwise(2).alias("property_id")),
          t.spark.createDataFrame([(1, "dcterms:title")], "id INT, term STRING")),
      """SELECT value_id, CASE WHEN property = 'dcterms:title' THEN property ELSE 'property:2' END AS property
         FROM fx_values""")

INCOMPLETE = {
    "convert": {"from": "uri", "to": "literal", "properties": ["dcterms:references"]},
    "fill_values": {"mode": "label_all", "properties": ["dcterms:spatial"], "datatypes": ["literal"]},
    "replace": {"mode": "raw", "from": "Title", "to": "Heading", "properties": ["dcterms:title"]},
}
query("ordered_edits_incomplete",
      lambda t: q.run_pipeline({"values": t.values, "resources": t.resources}, INCOMPLETE)["values"],
      select({"value": "CASE WHEN property = 'dcterms:title' THEN replace(trim(value), 'Title', 'Heading') ELSE value END"}))

EDITS = {
    "replace": {"mode": "raw", "from": "Title", "to": "Heading", "properties": ["dcterms:title"]},
    "copy": {"from": ["dcterms:coverage"], "to": "dcterms:spatial"},
    "explode": {"properties": ["dcterms:subject"], "separator": ";"},
    "remove": {"properties": ["dcterms:description", "dcterms:abstract"]},
    "fill_data": {"owner": 3},
    "media_type": {"from": "image/png", "to": "image/webp"},
    "cleaning": {"trim_values": True, "specify_datatypes": True, "deduplicate_values": True},
}


def _ordered(t: Tables) -> dict[str, DataFrame]:
    return q.run_pipeline({"values": t.values, "resources": t.resources, "media": t.media}, EDITS)


def _ordered_parts() -> tuple[str, str]:
    """The values when the edits before cleaning are done, and when cleaning has only duplicates left."""
    title = f"replace({V}, 'Title', 'Heading')"
    replaced = select({"value": case("property = 'dcterms:title'", trimmed(title), "value"),
                       "pos": "pos * 10"},
                      where=f"property NOT IN ('dcterms:description', 'dcterms:abstract', 'dcterms:subject') "
                            f"AND NOT (property = 'dcterms:title' AND {V} = '')")
    copied = select({"value_id": "CAST(NULL AS BIGINT)", "property": "'dcterms:spatial'", "pos": "CAST(100 AS BIGINT)"},
                    where="property = 'dcterms:coverage'")
    pieces = f"""SELECT CASE WHEN i = 1 THEN value_id END AS value_id, resource_id, property, i AS pos, type, lang,
                        {trimmed("string_split(value, ';')[i]")} AS value, uri, value_resource_id, is_public,
                        value_annotation_id
                 FROM fx_values, unnest(range(1, 5)) AS t(i) WHERE property = 'dcterms:subject' AND i <> 3"""
    every = f"{replaced} UNION ALL {copied} UNION ALL {pieces}"
    kinds = {"type": case("type = 'resource'", "'resource:itemset'", "type"), **UNI}
    return every, f"SELECT * FROM ({select(kinds, source=f'({every}) AS a')}) AS c WHERE coalesce(value, uri) IS NOT NULL OR value_resource_id IS NOT NULL"


def _ordered_sql() -> str:
    clean = _ordered_parts()[1]
    keys = ", ".join(f"lower({c})" for c in ("type", "lang", "value", "uri"))
    return renumbered(f"""SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY resource_id, property, value_resource_id, {keys}, is_public, value_annotation_id
        ORDER BY value_id NULLS LAST, pos) AS rn FROM ({clean}) AS s) AS r WHERE rn = 1""")


query("ordered_edits", lambda t: _ordered(t)["values"], _ordered_sql())


def _edit_counts(t: Tables) -> DataFrame:
    """Counts of each edit, from one run of the chain that writes its tables."""
    done = q.run_pipeline({"values": t.values, "resources": t.resources, "media": t.media}, EDITS, count_edits=True)
    folder = f"{shared_folder(t.spark)}/edits-{_unique()}"
    for name in ("values", "resources", "media"):
        done[name].write.parquet(f"{folder}/{name}")
    return done["edit_counts"].table()


def _edit_counts_sql() -> str:
    every, clean = _ordered_parts()
    heading = trimmed(f"replace({V}, 'Title', 'Heading')")
    trims = " OR ".join(f"{UNI[c]} IS DISTINCT FROM {c}" for c in ("value", "lang", "uri"))
    left = f"(coalesce({UNI['value']}, {UNI['uri']}) IS NOT NULL OR value_resource_id IS NOT NULL)"

    def n(source: str, where: str) -> str:
        return f"(SELECT count(*) FROM {source} WHERE {where})"

    rows = (
        (1, "replace", "values", "0", n("fx_values", f"property = 'dcterms:title' AND {heading} <> '' AND value IS DISTINCT FROM {heading}"),
         n("fx_values", f"property = 'dcterms:title' AND {heading} = ''")),
        (2, "copy", "values", n("fx_values", "property = 'dcterms:coverage'"), "0", "0"),
        (3, "explode", "values", "2 * " + n("fx_values", "property = 'dcterms:subject'"), n("fx_values", "property = 'dcterms:subject'"), "0"),
        (4, "fill_data", "resources", "0", n("fx_resources", "owner_id IS DISTINCT FROM 3"), "0"),
        (5, "remove", "values", "0", "0", n("fx_values", "property IN ('dcterms:description', 'dcterms:abstract')")),
        (6, "media_type", "media", "0", n("fx_media", "media_type = 'image/png'"), "0"),
        (7, "trim_values", "values", "0", n("every_row", f"{left} AND ({trims})"), n("every_row", f"NOT {left}")),
        (8, "specify_datatypes", "values", "0", n("every_row", "type = 'resource'"), "0"),
        (9, "deduplicate_values", "values", "0", "0", f"(SELECT count(*) FROM ({clean}) AS c) - (SELECT count(*) FROM final_row)"))
    lines = " UNION ALL ".join(
        f"SELECT CAST({step} AS INT) AS step, '{edit}' AS edit, '{name}' AS \"table\", CAST({a} AS BIGINT) AS added, "
        f"CAST({c} AS BIGINT) AS changed, CAST({r} AS BIGINT) AS removed" for step, edit, name, a, c, r in rows)
    return f"WITH every_row AS ({every}), final_row AS ({_ordered_sql()}) {lines}"


query("edit_counts", _edit_counts, _edit_counts_sql())

# What the records lacked at first stays closed: only old references are rewritten, and no title that was copied to a new property.
GATED = {
    "create_values": {"properties": "dcterms:references", "datatype": "literal", "value": "Ref new"},
    "copy": {"from": ["dcterms:coverage"], "to": "ex:place"},
    "convert": {"from": "literal", "to": "html", "properties": ["dcterms:references", "ex:place"]},
}
query("ordered_edits_gate",
      lambda t: q.run_pipeline({"values": t.values, "resources": t.resources.where("resource_name = 'items'")}, GATED)["values"],
      f"""WITH had AS (SELECT DISTINCT resource_id FROM fx_values WHERE property = 'dcterms:references'),
               added AS (SELECT CAST(NULL AS BIGINT) AS value_id, r.id AS resource_id, 'dcterms:references' AS property,
                                CAST(CASE WHEN h.resource_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS pos,
                                CASE WHEN h.resource_id IS NULL THEN 'literal' ELSE 'html' END AS type, CAST(NULL AS STRING) AS lang,
                                'Ref new' AS value, CAST(NULL AS STRING) AS uri, CAST(NULL AS BIGINT) AS value_resource_id, TRUE AS is_public,
                                CAST(NULL AS BIGINT) AS value_annotation_id
                         FROM fx_resources r LEFT JOIN had h ON h.resource_id = r.id WHERE r.resource_name = 'items')
          {select({})} UNION ALL SELECT * FROM added
          UNION ALL {select({"value_id": "CAST(NULL AS BIGINT)", "property": "'ex:place'"}, where="property = 'dcterms:coverage'")}""")


def _audited(t: Tables) -> DataFrame:
    """The edits of the chain above with their parameters, and how many rows they left."""
    done = q.run_pipeline({"values": t.values, "resources": t.resources.where("resource_name = 'items'")}, GATED)
    left = done["values"].groupBy("property").agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("property").isin("dcterms:references", "ex:place"))
    touched = done["audit"].withColumn("property", F.explode(F.array(F.lit("dcterms:references"), F.lit("ex:place")))).where(
        F.contains("params", "property"))
    return touched.join(left, "property").select("step", "edit", "property", "rows")


query("edit_audit", _audited,
      """WITH n AS (SELECT 'dcterms:references' AS property, count(*) FILTER (WHERE property = 'dcterms:references') + (
                        SELECT count(*) FROM fx_resources WHERE resource_name = 'items') AS "rows" FROM fx_values
                    UNION ALL SELECT 'ex:place', count(*) FILTER (WHERE property = 'dcterms:coverage') FROM fx_values),
              a AS (SELECT * FROM (VALUES (1, 'create_values', 'dcterms:references'), (2, 'copy', 'ex:place'),
                    (3, 'convert', 'dcterms:references'), (3, 'convert', 'ex:place')) AS v(step, edit, property))
         SELECT CAST(step AS INT) AS step, edit, property, "rows" FROM a JOIN n USING (property)""")


def _chosen_edits(t: Tables, **selection) -> DataFrame:
    """The edits above for some records, on a table without sizes of groups."""
    return q.run_pipeline({"values": t.values, "resources": t.resources, "media": t.media}, EDITS, **selection)["values"]


query("ordered_edits_items", lambda t: _chosen_edits(t, kind="items"), _ordered_sql())
query("ordered_edits_id_list",
      lambda t: _chosen_edits(t, sel=t.documents.where("doc_id % 3 = 1").select(F.col("doc_id") + 1)),
      f"""WITH edited AS ({_ordered_sql()})
          SELECT {", ".join(COLUMNS)} FROM edited WHERE resource_id % 3 = 2
          UNION ALL {renumbered(select({}, where="resource_id % 3 <> 2"))}""")
query("ordered_edits_media_kind",
      lambda t: q.run_pipeline({"values": t.values, "resources": t.resources, "media": t.media}, EDITS, kind="media")["media"],
      _media_sql({"media_type": case("media_type = 'image/png'", "'image/webp'", "media_type")}))
query("ordered_edits_records", lambda t: _ordered(t)["resources"],
      _resources_sql({"owner_id": "CAST(3 AS INT)"}))
query("ordered_edits_media", lambda t: _ordered(t)["media"],
      _media_sql({"media_type": case("media_type = 'image/png'", "'image/webp'", "media_type")}))


def _saved_records(documents: DataFrame) -> DataFrame:
    """Documents as records on their way to the store."""
    def entry(prop: str, kind: str, value, link=None):
        return F.struct(
            F.lit(prop).alias("property"), F.lit(kind).alias("type"),
            F.concat(F.lit(" "), F.col("lang")).alias("lang"),
            (F.lit(None) if value is None else value).cast("string").alias("value"),
            F.lit("").alias("uri"),
            (F.lit(None) if link is None else link).cast("long").alias("value_resource_id"),
            F.lit(True).alias("is_public"))

    return documents.select(
        F.col("doc_id").alias("record_id"), (F.col("doc_id") + 1).alias("resource_id"),
        F.array(
            entry("dcterms:title", "literal", F.concat(F.lit(" \t"), F.col("source"), F.lit("\xa0"))),
            entry("dcterms:title", "literal", F.col("source")),
            entry("dcterms:title", "literal", F.upper("source")),
            entry("dcterms:description", "literal", F.col("text")),
            entry("dcterms:relation", "resource", None, F.lit(30000000) + F.col("doc_id") % 7),
        ).alias("values"))


def _stream_clean(t: Tables) -> DataFrame:
    folder = f"{shared_folder(t.spark)}/on-write-{_unique()}"
    # A pattern that matches one name: a plain path may be no single file, a filter of names sees no folder.
    stream = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.folder}/[d]ocuments.parquet")
    q.start_cleaning(_saved_records(stream), t.resources, q.parquet_sink(f"{folder}/out"),
                     f"{folder}/state", deduplicate=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select(
        "record_id", F.posexplode("values").alias("at", "v")).select("record_id", "at", "v.*")


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


query("stream_clean", _stream_clean,
      f"""SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 AS INT) AS at, property,
                 type, lang, value, CAST(NULL AS STRING) AS uri, value_resource_id, is_public
          FROM (SELECT *, row_number() OVER (PARTITION BY record_id, property, type, value, value_resource_id ORDER BY k) AS rn
                FROM (SELECT doc_id AS record_id, k,
                             CASE WHEN k < 4 THEN 'dcterms:title' WHEN k = 4 THEN 'dcterms:description' ELSE 'dcterms:relation' END AS property,
                             CASE WHEN k < 5 THEN 'literal' WHEN doc_id % 7 < 5 THEN 'resource:itemset' ELSE 'resource' END AS type,
                             lang, nullif(CASE k WHEN 1 THEN source WHEN 2 THEN source WHEN 3 THEN upper(source)
                                         WHEN 4 THEN trim(text, {UNICODE_SET}) END, '') AS value,
                             CASE WHEN k = 5 THEN 30000000 + doc_id % 7 END AS value_resource_id, TRUE AS is_public
                      FROM documents, unnest(range(1, 6)) AS t(k)) AS a) AS b
          WHERE rn = 1""")
query("jsonld_round_trip", lambda t: q.from_jsonld(q.to_jsonld(t.values)), select({}))
query("jsonld_round_trip_parts",
      lambda t: q.from_jsonld(q.to_jsonld(_unplaced(t.values), part_rows=2)),
      select({"value_id": "CASE WHEN value_id % 3 <> 0 THEN value_id END", "pos": "CASE WHEN resource_id % 2 <> 0 THEN pos * 2 END",
              "is_public": "CASE WHEN value_id % 7 <> 0 THEN is_public END"}))


def _unplaced(values: DataFrame) -> DataFrame:
    """Values of which some lack position, identifier or visibility."""
    return values.withColumns({
        "pos": F.when(F.col("resource_id") % 2 != 0, F.col("pos") * 2),
        "is_public": F.when(F.col("value_id") % 7 != 0, F.col("is_public")),
        "value_id": F.when(F.col("value_id") % 3 != 0, F.col("value_id"))})


def _pending(t: Tables) -> DataFrame:
    """Edits of every fifth record: another title, the language notes of a term it did not have,
    and records that are new."""
    row = "struct('{}' AS property, 0L AS pos, 'literal' AS type, CAST(NULL AS STRING) AS lang, '{}' || doc_id AS value)"
    return t.spark.sql(f"""
        SELECT CAST(NULL AS BIGINT) AS value_id, doc_id + if(doc_id % 15 = 0, 50000000, 1) AS resource_id,
               inline(array({row.format("dcterms:title", "Pending ")}, {row.format("ex:note", "Note ")})),
               CAST(NULL AS STRING) AS uri, CAST(NULL AS BIGINT) AS value_resource_id, true AS is_public,
               CAST(NULL AS BIGINT) AS value_annotation_id
        FROM {{documents}} WHERE doc_id % 5 = 0""", documents=t.documents)


query("jsonld_overlay",
      lambda t: q.from_jsonld(q.overlay(q.to_jsonld(t.values, part_rows=2), q.to_jsonld(_pending(t)))),
      f"""WITH pending AS (
              SELECT CAST(NULL AS BIGINT) AS value_id, doc_id + CASE WHEN doc_id % 15 = 0 THEN 50000000 ELSE 1 END AS resource_id,
                     p.property, CAST(0 AS BIGINT) AS pos, 'literal' AS type, CAST(NULL AS STRING) AS lang,
                     p.label || CAST(doc_id AS STRING) AS value, CAST(NULL AS STRING) AS uri, CAST(NULL AS BIGINT) AS value_resource_id,
                     TRUE AS is_public, CAST(NULL AS BIGINT) AS value_annotation_id
              FROM documents, (VALUES ('dcterms:title', 'Pending '), ('ex:note', 'Note ')) AS p(property, label) WHERE doc_id % 5 = 0)
          {select({}, where="NOT (property = 'dcterms:title' AND resource_id IN (SELECT resource_id FROM pending))")}
          UNION ALL SELECT * FROM pending""")


def _written_back(t: Tables) -> DataFrame:
    """The table after an edit of every seventh record was written back into its files."""
    folder = f"{shared_folder(t.spark)}/buckets-{_unique()}"
    q.write_buckets(t.values, folder, 16)
    chosen = t.documents.where("doc_id % 7 = 0").select(F.col("doc_id") + 1)
    edited = q.set_visibility(q.read_buckets(t.spark, folder), False, ["dcterms:title"], sel=chosen)
    q.write_changed(q.remove_values(edited, ["dcterms:abstract"], sel=chosen), folder)
    return q.read_buckets(t.spark, folder)


query("write_changed", _written_back,
      select({"is_public": case("(resource_id - 1) % 7 = 0 AND property = 'dcterms:title'", "FALSE", "is_public")},
             where="NOT ((resource_id - 1) % 7 = 0 AND property = 'dcterms:abstract')"))


def _place_xml(t: Tables) -> DataFrame:
    """Customers as place records."""
    return t.spark.sql("""
        SELECT 'https://sws.geonames.org/' || c_custkey || '/' AS uri,
               '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
               || 'xmlns:gn="http://www.geonames.org/ontology#" '
               || 'xmlns:wgs84_pos="http://www.w3.org/2003/01/geo/wgs84_pos#">'
               || '<gn:Feature rdf:about="https://sws.geonames.org/' || c_custkey || '/">'
               || '<gn:name> ' || c_name || ' </gn:name>'
               || '<gn:alternateName xml:lang="de">DE ' || c_name || '</gn:alternateName>'
               || CASE WHEN c_custkey % 2 = 0
                       THEN '<gn:officialName xml:lang="fr">FR ' || c_name || '</gn:officialName>' ELSE '' END
               || '<gn:countryCode>' || CASE WHEN c_nationkey < 5 THEN 'n' || c_nationkey ELSE 'zz' END || '</gn:countryCode>'
               || '<wgs84_pos:lat>' || c_nationkey || '.5</wgs84_pos:lat><wgs84_pos:long>-1.25</wgs84_pos:long>'
               || '</gn:Feature></rdf:RDF>' AS xml
        FROM {customer}""", customer=t.customer)


query("parse_places",
      lambda t: q.parse_places(_place_xml(t), t.nation.select(
          F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), "n_name"), "fr"),
      """SELECT CAST(c_custkey AS BIGINT) AS geoname_id,
                CASE WHEN c_custkey % 2 = 0 THEN 'FR ' ELSE '' END || c_name AS toponym,
                CASE WHEN c_nationkey < 5 THEN n_name ELSE 'zz' END AS country,
                c_nationkey + CAST(0.5 AS DOUBLE) AS lat, CAST(-1.25 AS DOUBLE) AS lon
         FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey > 0""")
query("parse_authority_places", lambda t: q.parse_authority(_place_xml(t), fx.GEONAMES),
      """SELECT 'valuesuggest:geonames:geonames' AS datatype,
                'https://sws.geonames.org/' || CAST(c_custkey AS STRING) || '/' AS uri, kind,
                CASE kind WHEN 'official' THEN 'fr' WHEN 'alternate' THEN 'de' END AS lang,
                CASE kind WHEN 'official' THEN 'FR ' WHEN 'alternate' THEN 'DE ' ELSE '' END || c_name AS label,
                CAST(0 AS INT) AS priority
         FROM customer, (SELECT unnest(['name', 'official', 'alternate']) AS kind) AS k
         WHERE kind <> 'official' OR c_custkey % 2 = 0""")


def _heading_xml(t: Tables) -> DataFrame:
    """Customers as MARC-like records; the heading of every third stands under the second tag."""
    return t.spark.sql("""
        SELECT 'https://www.idref.fr/' || c_custkey AS uri,
               '<record><datafield tag="900"><subfield code="b">x</subfield><subfield code="a">'
               || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END
               || '</subfield></datafield><datafield tag="901"><subfield code="a">Alt ' || c_name
               || '</subfield></datafield></record>' AS xml
        FROM {customer}""", customer=t.customer)


query("parse_authority_headings",
      lambda t: q.parse_authority(_heading_xml(t), "valuesuggest:idref:person"),
      """SELECT 'valuesuggest:idref:person' AS datatype, 'https://www.idref.fr/' || CAST(c_custkey AS STRING) AS uri,
                'heading' AS kind, CAST(NULL AS STRING) AS lang,
                CASE i WHEN 0 THEN c_name ELSE 'Alt ' || c_name END AS label, CAST(i AS INT) AS priority
         FROM customer, unnest(range(0, 2)) AS t(i) WHERE i = 1 OR c_custkey % 3 <> 0""")
BROKEN = """CASE c_custkey % 5 WHEN 0 THEN '<record><datafield tag="900">' WHEN 1 THEN NULL WHEN 2 THEN '<record/>' ELSE xml END"""


def _broken_xml(t: Tables) -> DataFrame:
    """Of five records one is cut off, one missing and one empty."""
    key = F.regexp_extract("uri", r"(\d+)$", 1).cast("long").alias("c_custkey")
    return _heading_xml(t).select("uri", "xml", key).select("uri", F.expr(BROKEN).alias("xml"))


query("parse_authority_broken",
      lambda t: q.parse_authority(_broken_xml(t), "valuesuggest:idref:person"),
      """SELECT 'valuesuggest:idref:person' AS datatype, 'https://www.idref.fr/' || CAST(c_custkey AS STRING) AS uri,
                'heading' AS kind, CAST(NULL AS STRING) AS lang,
                CASE i WHEN 0 THEN c_name ELSE 'Alt ' || c_name END AS label, CAST(i AS INT) AS priority
         FROM customer, unnest(range(0, 2)) AS t(i) WHERE c_custkey % 5 > 2 AND (i = 1 OR c_custkey % 3 <> 0)""")
query("parse_authority_rejects",
      lambda t: q.authority_rejects(_broken_xml(t), "valuesuggest:idref:person").select("uri", "reason"),
      """SELECT 'https://www.idref.fr/' || CAST(c_custkey AS STRING) AS uri,
                CASE c_custkey % 5 WHEN 0 THEN 'no XML' WHEN 1 THEN 'no record' ELSE 'no label' END AS reason
         FROM customer WHERE c_custkey % 5 < 3""")
query("fill_headings",
      lambda t: q.fill_values(
          t.customer.select(
              F.col("c_custkey").cast("long").alias("value_id"), F.col("c_custkey").cast("long").alias("resource_id"),
              F.lit("dcterms:creator").alias("property"), F.lit(0).cast("long").alias("pos"),
              F.lit("valuesuggest:idref:person").alias("type"), F.lit(None).cast("string").alias("lang"),
              F.lit(None).cast("string").alias("value"),
              F.concat(F.lit("https://www.idref.fr/"), F.col("c_custkey").cast("string"), F.lit(".xml")).alias("uri"),
              F.lit(None).cast("long").alias("value_resource_id"), F.lit(True).alias("is_public"),
              F.lit(None).cast("long").alias("value_annotation_id")),
          q.parse_authority(_heading_xml(t), "valuesuggest:idref:person"), "label_missing", "all",
          ["valuesuggest:idref:person"]),
      """SELECT CAST(c_custkey AS BIGINT) AS value_id, CAST(c_custkey AS BIGINT) AS resource_id,
                'dcterms:creator' AS property, CAST(0 AS BIGINT) AS pos, 'valuesuggest:idref:person' AS type,
                CAST(NULL AS STRING) AS lang, CASE WHEN c_custkey % 3 = 0 THEN 'Alt ' ELSE '' END || c_name AS value,
                'https://www.idref.fr/' || CAST(c_custkey AS STRING) || '.xml' AS uri,
                CAST(NULL AS BIGINT) AS value_resource_id, TRUE AS is_public, CAST(NULL AS BIGINT) AS value_annotation_id
         FROM customer""")
def _ascii_name_sql(column: str) -> str:
    marked, plain, joined = text._accent_rules()
    outer = "' /\\?<>:*%|\"`&;' || chr(39) || chr(160)"
    name = f"trim(regexp_replace({column}, '<[^>]*>', '', 'g'), {outer})"
    name = f"translate({name}, '({{)}}', '[[]]')"
    name = f"regexp_replace({name}, '[\\x00-\\x1F\\x7F/\\\\?<>:*%|\"''`&;#+^$\\s]', ' ', 'g')"
    name = f"right(regexp_replace({name}, '\\s+', ' ', 'g'), 180)"
    name = f"translate({name}, '{marked}', '{plain}')"
    for letter, pair in joined:
        name = f"replace({name}, '{letter}', '{pair}')"
    name = f"regexp_replace({name}, '[^A-Za-z0-9\\[\\]_\\-.#~@+:]', '_', 'g')"
    return f"right(regexp_replace({name}, '_+', '_', 'g'), 180)"


query("names_to_ascii",
      lambda t: t.documents.select("doc_id", text.ascii_name(text.sanitize_name(F.col("text"))).alias("name")),
      f"SELECT doc_id, {_ascii_name_sql('text')} AS name FROM documents")
query("natural_order",
      lambda t: t.pages.select("page_id", text.natural_key(F.col("url")).alias("sort_key")),
      f"SELECT page_id, {natural('url')} AS sort_key FROM pages")
query("tags_stripped", lambda t: t.pages.select("page_id", text.strip_tags(F.col("html")).alias("plain")),
      "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
query("media_types_valid",
      lambda t: t.media.select("id", F.explode(F.array(
          "media_type", F.concat("media_type", F.lit("; q=1")), F.concat("media_type", F.lit(";q=1;v=b.c")),
          F.upper("media_type"), "extension", F.concat(F.lit("x-own/"), "extension"), "source")).alias("name")).select(
              "id", "name", valid_media_type(F.col("name")).alias("valid")),
      """SELECT id, name, regexp_matches(name, '^(application|audio|font|example|image|message|model|multipart|text|video|x-[\\w-]+)/'
             || '[\\w.+-]+(;[\\w.+-]+=[\\w.+-]+){0,3}$') AS valid
         FROM (SELECT id, unnest([media_type, media_type || '; q=1', media_type || ';q=1;v=b.c', upper(media_type), extension,
                                  'x-own/' || extension, source]) AS name FROM fx_media) AS m""")


# ---------------------------------------------------------------- flagship

def curation_report(t: Tables) -> DataFrame:
    """Trim, split subjects, make links precise, deduplicate; then values per property and
    language."""
    stored = q.measure_groups(t.values)
    with q.chain(stored):
        values = q.trim_values(stored, renumber=False)
        values = q.explode_values(values, ["dcterms:subject"], ";")
        values = q.specify_datatypes(values, t.resources, linked=stored)
        values = q.deduplicate_values(values, renumber=False)
    return values.groupBy("property", "type", "lang").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("is_public")).alias("n_public"),
        F.sum(F.length("value")).alias("n_chars"))


query("curation_report", curation_report, f"""
    WITH c AS ({TRIMMED}),
         e AS (SELECT * FROM c WHERE property <> 'dcterms:subject'
               UNION ALL SELECT value_id, resource_id, property, pos, type, lang,
                                {trimmed("string_split(value, ';')[i]")} AS value, uri, value_resource_id, is_public,
                                value_annotation_id
               FROM c, unnest(range(1, 5)) AS t(i) WHERE property = 'dcterms:subject' AND i <> 3),
         k AS (SELECT property, CASE WHEN type = 'resource' THEN 'resource:itemset' ELSE type END AS type, lang,
                      value, is_public, row_number() OVER (
                   PARTITION BY resource_id, property, value_resource_id, lower(type), lower(lang), lower(value),
                                lower(uri), is_public, value_annotation_id ORDER BY value_id, pos) AS rn FROM e)
    SELECT property, type, lang, count(*) AS n_values, count(*) FILTER (WHERE is_public) AS n_public,
           CAST(sum(length(value)) AS BIGINT) AS n_chars
    FROM k WHERE rn = 1 GROUP BY property, type, lang""")
