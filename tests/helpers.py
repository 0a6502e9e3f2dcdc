from __future__ import annotations

from quillmend import schema


def table(spark, data, **defaults):
    """A values table: ids and positions follow the given order unless stated."""
    counters, out = {}, []
    for i, given in enumerate(data):
        row = dict(value_id=i + 1, resource_id=1, property="p", type="literal", lang=None, value=None,
                   uri=None, value_resource_id=None, is_public=True, value_annotation_id=None)
        row.update(defaults)
        row.update(given)
        key = (row["resource_id"], row["property"])
        row.setdefault("pos", counters.get(key, 0))
        counters[key] = counters.get(key, 0) + 1
        out.append(tuple(row[name] for name in schema.VALUES.names))
    return spark.createDataFrame(out, schema.VALUES)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def shown(df, *names):
    ordered = df.orderBy("resource_id", "property", "pos") if "pos" in df.columns else df
    return [tuple(r[n] for n in names) for r in ordered.collect()]
