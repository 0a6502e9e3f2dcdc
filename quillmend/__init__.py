"""Bulk metadata curation on Spark: DataFrame-to-DataFrame edits of an entity-attribute-value
table of statements, of the records they describe and of their media files."""

from quillmend.operators.clean import (clean_empty_values, clean_language_codes, clean_languages,
                                       deduplicate_values, specify_datatypes, trim_values)
from quillmend.operators.convert import convert
from quillmend.operators.fill import fill_values
from quillmend.operators.media import (edit_media_html, edit_media_source, explode_items,
                                       order_media, page_manifest, pages_without_count, remove_media, set_media_type,
                                       set_media_visibility, set_owner, set_thumbnail)
from quillmend.operators._shared import chain, measure_groups
from quillmend.operators.report import changes, facets
from quillmend.operators.values import (copy_values, create_values, displace_values,
                                        explode_values, merge_values, order_values, remove_values,
                                        replace, set_visibility)
from quillmend.plans.edits import normalise, run_pipeline
from quillmend.schema import DataTypes
from quillmend.sources.jsonld import from_jsonld, overlay, read_jsonld, to_jsonld, write_jsonld
from quillmend.sources.tables import (property_terms, read_buckets, read_tables, with_positions, write_buckets,
                                      write_changed, write_tables)
from quillmend.sources.xml_records import authority_rejects, parse_authority, parse_place_names, parse_places, place_rejects
from quillmend.streaming.on_write import (clean_on_write, clean_values_on_write, parquet_sink,
                                          start_cleaning)

__all__ = [name for name in dir() if not name.startswith("_")]
