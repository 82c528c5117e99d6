"""Reading free-form JSON: VARIANT columns whose keys and shapes vary."""

from pyspark.sql import Column, SparkSession, functions as F

from .text import col, number_in_text, split_list, strip

_END = "\u0002end-of-value\u0002"


def parse_strict(text) -> Column:
    """Whole text is one JSON value, else null.

    ``try_parse_json`` stops after the first value, so the text is wrapped in an
    array with an end mark that must come back as the second element. Of a key that is given twice
    the last value counts, a setting of the session.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = col(text)
    mark = F.lit(f',"{_END}"]'.replace("\u0002", "\\u0002"))
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, mark)), F.lit("$"), "array<variant>")
    # As a lambda's variable the parsed text is one value; named three times it would be parsed three times.
    ended = lambda x: (F.size(x) == 2) & (F.try_variant_get(F.get(x, F.lit(1)), F.lit("$"), "string") == _END)
    return F.get(F.transform(F.filter(F.array(items), ended), lambda x: F.get(x, F.lit(0))), F.lit(0))


def once(value, name: str) -> Column:
    """A generated column: later filters stay above it, so an expensive value is not computed again for each of them."""
    return F.explode(F.array(value)).alias(name)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as a lambda's variable it is one value, named twice it is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fields(v, *keys) -> Column:
    """Struct of the named values of an object, null for anything else.

    All keys are read in one pass. A path such as ``$.key`` costs an exception inside the engine wherever the key is
    missing, many times the price of the look-up.
    """
    return F.try_variant_get(col(v), F.lit("$"), "struct<" + ",".join(f"`{k}`:variant" for k in keys) + ">")


def first(found: Column, *keys) -> Column:
    """Value of the first key that ``fields`` found (a JSON null counts as existing)."""
    return F.coalesce(*[found[k] for k in keys]) if len(keys) > 1 else found[keys[0]]


def get(v, *keys) -> Column:
    """Value of the first key that exists (a JSON null counts as existing)."""
    return F.coalesce(*[fields(v, k)[k] for k in keys]) if len(keys) > 1 else fields(v, keys[0])[keys[0]]


def text_of(v) -> Column:
    return F.try_variant_get(col(v), F.lit("$"), "string")


def as_array(v) -> Column:
    return F.try_variant_get(col(v), F.lit("$"), "array<variant>")


def as_map(v) -> Column:
    return F.try_variant_get(col(v), F.lit("$"), "map<string,variant>")


def is_object(v) -> Column:
    return fields(v, "_").isNotNull()


def is_array(v) -> Column:
    return F.coalesce(F.schema_of_variant(col(v)).startswith("ARRAY"), F.lit(False))


def is_text(v) -> Column:
    return F.coalesce(F.schema_of_variant(col(v)) == "STRING", F.lit(False))


def is_number(v) -> Column:
    return F.coalesce(F.schema_of_variant(col(v)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def is_null(v) -> Column:
    """Missing key or JSON null."""
    return col(v).isNull() | F.is_variant_null(col(v))


def filled(text: Column) -> Column:
    """Trimmed text, null where nothing is left; an expensive text is computed once, inside a lambda too."""
    return F.get(F.filter(F.array(strip(text)), lambda x: x != ""), F.lit(0))


def truthy_text(v) -> Column:
    """Text of the value; '' and 0 and false and empty containers count as missing."""
    def told(v):
        text = text_of(v)
        doubtful = text.isin("", "0", "0.0", "false", "[]", "{}")
        return F.when(~doubtful | (is_text(v) != (text == "")), text)

    return let(col(v), told)


def first_truthy(v, *keys) -> Column:
    return let(fields(v, *keys), lambda found: truthy_of(found, *keys))


def truthy_of(found: Column, *keys) -> Column:
    """First value of those that ``fields`` found that is not empty, as text."""
    return F.coalesce(*[truthy_text(found[k]) for k in keys])


def string_list(v) -> Column:
    """Null -> [], text is split, a list keeps its non-blank items, other scalar -> [text]."""
    empty = F.array().cast("array<string>")
    items = F.filter(F.transform(as_array(v), lambda x: strip(text_of(x))), lambda x: x != "")
    return (
        F.when(is_null(v), empty)
        .when(is_text(v), split_list(text_of(v)))
        .otherwise(F.coalesce(items, F.filter(F.array(strip(text_of(v))), lambda x: x != "")))
    )


def number_value(v) -> Column:
    return F.when(is_number(v), F.try_variant_get(col(v), F.lit("$"), "double")).otherwise(number_in_text(text_of(v)))


def compound_refs(v, role: str) -> Column:
    """Scalar, list of scalars or list of objects -> array of compounds."""
    def compound(label, name, smiles):
        return F.struct(filled(label).alias("label"), filled(name).alias("name"), filled(smiles).alias("smiles"), F.lit(role).alias("role"))

    nothing = F.lit(None).cast("string")

    def one(x):
        def from_object(found):
            return compound(truthy_of(found, "label", "compound_label", "id"), truthy_of(found, "name", "compound_name"), text_of(found["smiles"]))

        def from_text(text):
            return F.when(strip(text) != "", compound(text, nothing, nothing))

        both = F.struct(fields(x, "label", "compound_label", "id", "name", "compound_name", "smiles").alias("found"), text_of(x).alias("text"))
        return let(both, lambda b: F.when(b["found"].isNotNull(), from_object(b["found"])).otherwise(from_text(b["text"])))

    scalar = ~is_null(v) & ~is_object(v)  # an array is taken before this is asked
    items = F.coalesce(as_array(v), F.when(scalar, F.array(col(v))))
    refs = F.filter(F.transform(items, one), lambda c: c.isNotNull())
    kind = "array<struct<label:string,name:string,smiles:string,role:string>>"
    return F.coalesce(refs.cast(kind), F.array().cast(kind))


def payload_rows(v, *wrappers) -> Column:
    """Answer payload -> array of row values, looking inside the wrapper keys."""
    v = col(v)
    inside = let(fields(v, *wrappers), lambda found: F.coalesce(*[found[k] for k in wrappers], v))
    return let(inside, lambda rows: F.coalesce(as_array(rows), F.when(is_object(rows), F.array(rows))))

