"""What a document holds where the typed parse has nothing.

The typed parse gives NULL for a value of the wrong type, so afterwards it cannot be told
from one that was never there. Beside it the document is parsed once more, without a schema,
into a VARIANT, and both are compared field by field.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receiptlake.schema import RECEIPT

WHOLE = "$"
_ENTRY = "struct<field: string, pos: int, declared: string, found: string>"


def _entry(field: str, declared: T.DataType, value: Column, pos: Column | None = None) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        (F.lit(None) if pos is None else pos).cast("int").alias("pos"),
        F.lit(declared.simpleString()).alias("declared"),
        F.schema_of_variant(value).alias("found"),
    )


def _lost(field: str, declared: T.DataType, typed: Column, value: Column, pos: Column | None = None) -> Column:
    """An entry if there is a value that the typed parse did not take, else NULL."""
    there = value.isNotNull() & ~F.is_variant_null(value)
    return F.when(typed.isNull() & there, _entry(field, declared, value, pos))


def _below(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _inside(name: str, kind: T.StructType, typed: Column, value: Column) -> Column:
    """Entries for the fields of a nested document."""
    checks = [_lost(f"{name}.{f.name}", f.dataType, typed[f.name], _below(value, f.name)) for f in kind]
    return F.when(typed.isNotNull(), F.array(*checks))


def _elements(name: str, kind: T.StructType, typed: Column, value: Column) -> Column:
    """Entries for the fields of each element of a list."""

    def of(element: Column, pos: Column) -> Column:
        own = F.get(typed, pos)
        checks = [
            _lost(f"{name}[].{f.name}", f.dataType, own[f.name], _below(element, f.name), pos) for f in kind
        ]
        # An element that is no document has no typed fields.
        whole = F.when(own.isNull() & ~F.is_variant_null(element), _entry(f"{name}[]", kind, element, pos))
        return F.when(own.isNull(), F.array(whole)).otherwise(F.array(*checks))

    elements = F.try_variant_get(value, "$", "array<variant>")
    return F.when(typed.isNotNull() & elements.isNotNull(), F.flatten(F.transform(elements, of)))


def parse_diagnostics(df: DataFrame, schema: T.StructType = RECEIPT) -> DataFrame:
    """Documents (column ``json``) to a row for each value that the typed parse loses or does
    not know, after the other columns of ``df``:

    - field (``OFD.Name``, ``Items[].Quantity``), pos (of the element, else NULL), the
      declared type and the one found, for a value of a type that was not taken;
    - a field that is not declared, with declared NULL;
    - field ``$`` with found ``malformed`` for text that is no JSON by the letter (or names a
      field twice), of which the typed parse may still have read a part, with the type found
      if it is no document, and with ``missing`` if there is no text.

    Documents without such values give no row. Both parses stand in one generator, so a
    document is parsed once by each, however many fields are compared.
    """
    others = [c for c in df.columns if c != "json"]
    if clash := set(others) & {"typed", "fields", "shape", "field", "pos", "declared", "found"}:
        raise ValueError(f"rename input columns called like those of the diagnostics: {sorted(clash)}")
    both = F.transform(
        F.array(F.try_parse_json("json")),
        lambda v: F.struct(
            F.try_variant_get(v, "$", "map<string,variant>").alias("fields"),
            F.when(v.isNotNull(), F.schema_of_variant(v)).alias("shape"),
        ),
    )
    # Lists of one each: the generator has both side by side.
    parsed = F.arrays_zip(F.array(F.from_json("json", schema)).alias("typed"), both.alias("found"))
    keep = [F.col(f"`{c}`") for c in others]
    rows = df.select(*keep, F.col("json").isNull().alias("missing"), F.inline(parsed))
    return _compared(rows, keep, schema)


def _compared(rows: DataFrame, keep: list[Column], schema: T.StructType) -> DataFrame:
    fields, shape, typed = F.col("found.fields"), F.col("found.shape"), F.col("typed")
    top, nested = [], []
    for f in schema:
        value = F.element_at(fields, F.lit(f.name))
        top.append(_lost(f.name, f.dataType, typed[f.name], value))
        if isinstance(f.dataType, T.StructType):
            nested.append(_inside(f.name, f.dataType, typed[f.name], value))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            nested.append(_elements(f.name, f.dataType.elementType, typed[f.name], value))
    unknown = F.transform(
        F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in schema.names])),
        lambda name: F.struct(
            name.alias("field"),
            F.lit(None).cast("int").alias("pos"),
            F.lit(None).cast("string").alias("declared"),
            F.schema_of_variant(F.element_at(fields, name)).alias("found"),
        ),
    )
    none = F.array().cast(f"array<{_ENTRY}>")
    entries = [F.array(*top), *nested, unknown]
    inside = F.concat(*[F.coalesce(e.cast(f"array<{_ENTRY}>"), none) for e in entries])
    problem = F.when(F.col("missing"), "missing").when(shape.isNull(), "malformed").otherwise(shape)
    whole = F.struct(
        F.lit(WHOLE).alias("field"),
        F.lit(None).cast("int").alias("pos"),
        F.lit("struct").alias("declared"),
        problem.alias("found"),
    )
    found = F.when(fields.isNull(), F.array(whole)).otherwise(F.filter(inside, lambda e: e.isNotNull()))
    return rows.select(*keep, F.inline(found))
