"""JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(x: Column) -> Column:
    """JSON text with sorted keys and no white space (O9.10, O9.13); null if it can't be parsed."""
    return F.to_json(F.try_parse_json(x))


def json_hash(x: Column) -> Column:
    return F.sha2(canonical_json(x), 256)


def set_hash(values: Column) -> Column:
    """SHA-256 of the sorted distinct values as a JSON list (O4.16)."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(values))), 256)


def has_value(x: Column) -> Column:
    """A JSON value counts if it is text that isn't blank, a list with an item or an object (O10.12); scalars don't."""
    kind = F.schema_of_variant(F.try_parse_json(x))
    text = F.try_variant_get(F.try_parse_json(x), "$", "string")
    filled_list = F.size(F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")) > 0
    hit = F.when(kind.startswith("STRING"), F.trim(text) != "").when(kind.startswith("ARRAY"), filled_list).when(kind.startswith("OBJECT"), F.lit(True))
    return F.coalesce(hit, F.lit(False))


def informative_fields(x: Column) -> Column:
    """How many values of a JSON object are neither null, blank text nor an empty list (O4.13); 0 for anything else."""
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v: F.try_variant_get(v, "$", "string")
    hit = lambda v: F.when(v.isNull() | (kind(v) == "VOID"), False).when(kind(v) == "STRING", F.trim(text(v)) != "").when(kind(v).startswith("ARRAY"), text(v) != "[]").otherwise(True)
    return F.coalesce(F.size(F.filter(F.map_values(F.from_json(x, "map<string,variant>")), hit)), F.lit(0))


#: The fields of a summary's answer. ``string?`` may be null but not left out.
SUMMARY = {
    "summary": "string", "advertisement_information": [{"source_ref": "string", "title": "string?", "facts": ["string"]}], "forum_information": [{"snippet": "string"}],
    "unverified_claims": ["string"], "sources": ["string"],
}
_KINDS = {"string": "STRING", "number": "(BIGINT|DECIMAL.*|DOUBLE)", "boolean": "BOOLEAN", "null": "VOID"}


def follows(x: Column, schema: dict | list | str) -> Column:
    """Is it JSON of exactly this form (O10.17)? A dict is an object with all of its fields and no others, a list of one form is
    a list of such items, a text is a kind: string, number, boolean; with ``?`` null will do as well. Null and broken JSON don't follow."""
    return F.coalesce(_follows(F.try_parse_json(x), schema), F.lit(False))


def _follows(v: Column, schema: dict | list | str) -> Column:
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    if isinstance(schema, str):
        names = _KINDS[schema.rstrip("?")] + ("|VOID" if schema.endswith("?") else "")
        return kind.rlike(f"^({names})$")
    if isinstance(schema, list):
        return kind.startswith("ARRAY") & F.coalesce(F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda item: _follows(item, schema[0])), F.lit(False))
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    ok = kind.startswith("OBJECT") & (F.size(fields) == len(schema))
    for name, inner in schema.items():
        ok = ok & F.map_contains_key(fields, name) & _follows(F.try_element_at(fields, F.lit(name)), inner)
    return F.coalesce(ok, F.lit(False))


def _child(v: Column, part: Column) -> Column:
    """What stands under a part of a path: a key of an object, a place of a list."""
    is_list = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    return F.when(is_list, F.get(F.try_variant_get(v, "$", "array<variant>"), part.try_cast("int"))).otherwise(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), part))


def get_path(x: Column, path: Column) -> Column:
    """The value under a path such as ``a.0.b`` as JSON text (O10.11); null where there is none, or ``x`` or ``path`` is null."""
    return F.to_json(F.aggregate(F.split(path, r"\."), F.try_parse_json(x), _child))


def set_path(x: Column, path: Column, value: Column) -> Column:
    """JSON ``x`` with the JSON ``value`` under a path such as ``a.0.b``, all else as it was (O10.11).

    The path may differ from row to row; parts lead through objects and lists. The last part may name a new key of an object;
    null where a part before it isn't there, a place lies outside its list, or something other than an object or a list stands on
    the way. The result has its keys in order.
    """
    parts = F.split(path, r"\.")
    start = F.struct(F.try_parse_json(x).alias("at"), F.array().cast("array<variant>").alias("above"))
    down = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, lambda acc, p: F.struct(_child(acc["at"], p).alias("at"), F.array_append(acc["above"], acc["at"]).alias("above")))
    way = F.array_append(down["above"], down["at"])  # what each part stands in

    def put(inner: Column, i: Column) -> Column:
        box, part = F.get(way, i), F.get(parts, i)
        kind = F.coalesce(F.schema_of_variant(box), F.lit(""))
        items, fields = F.try_variant_get(box, "$", "array<variant>"), F.try_variant_get(box, "$", "map<string,variant>")
        place = part.try_cast("int")
        as_list = F.to_variant_object(F.transform(items, lambda e, k: F.when(k == place, inner).otherwise(e)))
        others = F.filter(F.map_entries(fields), lambda e: e["key"] != part)
        as_object = F.to_variant_object(F.map_from_entries(F.array_append(others, F.struct(part.alias("key"), inner.alias("value")))))
        there = inner.isNotNull()  # else the way was lost further down
        return F.when(there & kind.startswith("ARRAY") & (place >= 0) & (place < F.size(items)), as_list).when(there & kind.startswith("OBJECT"), as_object)

    built = F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), F.try_parse_json(value), put)
    return F.to_json(built)


def advert(source: Column, title: Column, description: Column, at: Column) -> Column:
    """One entry of a summary's payload, its fields in order of their names; long texts are cut as the payload asks."""
    return F.struct(F.substring(description, 1, 4000).alias("description"), at.alias("scraped_at"), source.alias("source_ref"), F.substring(title, 1, 500).alias("title"))


def summary_hash(adverts: Column, provider: str, model: str, prompt_version: str, revision: Column) -> Column:
    """SHA-256 of a summary's whole input as JSON with sorted keys and no white space (O9.12)."""
    payload = F.struct(adverts.alias("advertisements"), F.array().cast("array<string>").alias("forum_snippets"))
    envelope = F.struct(F.lit(model).alias("model"), payload.alias("payload"), F.lit(prompt_version).alias("prompt_version"), F.lit(provider).alias("provider"), revision.alias("record_content_revision"))
    return F.sha2(F.to_json(envelope, {"ignoreNullFields": "false"}), 256)
