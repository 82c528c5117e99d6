"""Scalar and array normalisers as Column expressions (no Python in the tasks)."""

from pyspark.sql import Column, functions as F

# The characters that count as whitespace in Unicode text handling.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def normalize_label(c) -> Column:
    """Null becomes '', whitespace is removed, the rest lower-cased."""
    return F.lower(F.translate(F.coalesce(col(c), F.lit("")), WHITESPACE, ""))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def empty_to_null(c) -> Column:
    """'' counts as missing, whitespace does not."""
    return F.nullif(col(c), F.lit(""))


def split_list(c) -> Column:
    """Text with ';' or ',' between the items -> array of non-empty strings."""
    parts = F.split(strip(c), f"(?U){_WS}*[;,]{_WS}*")
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def number_in_text(c) -> Column:
    """First number in the text, thousands commas removed; null when there is none."""
    digits = F.regexp_extract(F.replace(col(c), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return digits.try_cast("double")


def bounded_percent(c) -> Column:
    return F.when(col(c).between(0, 100), col(c))


def round4(c) -> Column:
    """Round to four places with plain IEEE steps, so every engine agrees."""
    return F.floor(col(c) * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def plain_number(c) -> Column:
    """25.0 -> '25', 2.5 -> '2.5': at most four decimals, no trailing zeros; very large and very small
    values keep the engine's own notation."""
    text = col(c).try_cast("decimal(28,4)").cast("string")
    size = F.abs(col(c))
    plain = (size < 1e20) & ((size >= 1e-4) | (size == 0))
    return F.when(plain, F.regexp_replace(text, r"\.?0+$", "")).otherwise(col(c).cast("string"))


def strip_annotations(c, charges: bool = True, isotopes: bool = True) -> Column:
    """Drop brackets, and inside them leading isotope digits / a trailing charge."""
    lead = r"\d*" if isotopes else ""
    tail = r"(?:[+-]\d*)?" if charges else ""
    return F.regexp_replace(col(c), rf"\[{lead}([^\]]*?){tail}\]", "$1")


def skeleton(c) -> Column:
    """Longest '.'-separated fragment without annotations (first of equal length)."""
    parts = F.split(strip_annotations(c), r"\.")
    ranked = F.transform(parts, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def page_context(page) -> Column:
    return F.coalesce(F.concat(F.lit("page "), col(page).cast("string")), F.lit("document"))


def safe_name(c) -> Column:
    return F.regexp_replace(col(c), r"[^A-Za-z0-9._-]", "_")


def truncate_text(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def compound_key(x: Column) -> Column:
    """Key used when records are matched with a benchmark: label, name, then smiles."""
    raw = F.coalesce(empty_to_null(x["label"]), empty_to_null(x["name"]), empty_to_null(x["smiles"]))
    return normalize_label(raw)


def compound_keys(compounds) -> Column:
    keys = F.transform(col(compounds), compound_key)
    return F.array_sort(F.filter(keys, lambda k: k != ""))


def participant_key(x: Column) -> Column:
    return normalize_label(F.coalesce(empty_to_null(x["label"]), empty_to_null(x["name"])))


def participant_ref(x: Column) -> Column:
    return F.coalesce(empty_to_null(x["label"]), empty_to_null(x["name"]), F.lit("<unlabelled>"))


def display_names(compounds) -> Column:
    names = F.transform(
        col(compounds),
        lambda x: F.coalesce(empty_to_null(x["label"]), empty_to_null(x["name"]), F.lit("?")),
    )
    return F.array_join(names, ", ")


def signature_key(x: Column) -> Column:
    """Key used when candidates are grouped: normalised label, else trimmed lower name."""
    return F.coalesce(
        empty_to_null(normalize_label(x["label"])),
        empty_to_null(F.lower(strip(F.coalesce(x["name"], F.lit(""))))),
    )


def signature_keys(compounds) -> Column:
    keys = F.transform(col(compounds), signature_key)
    return F.array_sort(F.filter(keys, lambda k: k.isNotNull()))


# Fixed value: the word for "yield" in the one-line summary of the review page.
YIELD_WORD = "收率"


def condition_summary(reagents, solvents, temperature_c, time, yield_pct) -> Column:
    """One line: reagents, solvents, temperature, time and yield joined by ' · '."""
    dot = " · "
    return F.concat_ws(
        dot,
        empty_to_null(F.array_join(col(reagents), dot)),
        empty_to_null(F.array_join(col(solvents), dot)),
        F.concat(plain_number(temperature_c), F.lit(" °C")),
        empty_to_null(time),
        F.concat(F.lit(YIELD_WORD + " "), plain_number(yield_pct), F.lit("%")),
    )


def _ordinal(id_col) -> Column:
    tail = F.element_at(F.split(col(id_col), ":"), -1)
    return F.when(F.size(F.split(col(id_col), ":")) >= 3, tail.try_cast("int"))


def participant_field_path(participant_id, role, record) -> Column:
    """``rid:reactant:1`` -> ``reactants.0.smiles``; null when outside the record.

    ``record`` maps the four list columns of the record to Columns.
    """
    i = _ordinal(participant_id) - 1

    def path(root, suffix):
        inside = (i >= 0) & (i < F.size(record[root]))
        return F.when(inside, F.concat(F.lit(root + "."), i.cast("string"), F.lit(suffix)))

    role = col(role)
    return (
        F.when(role == "reactant", path("reactants", ".smiles"))
        .when(role == "product", path("products", ".smiles"))
        .when(role == "reagent", path("reagents", ""))
        .when(role == "solvent", path("solvents", ""))
    )


def condition_field_path(condition_id, kind, first_index: int = 1) -> Column:
    """Editable path of one condition.

    Stored contexts number reagents and solvents from 1, synthesised ones from 0;
    ``first_index`` says which, the path is always 0-based.
    """
    tail = F.element_at(F.split(col(condition_id), ":"), -1).try_cast("int") - first_index
    kind = col(kind)
    return (
        F.when(kind == "temperature", F.lit("temperature_c"))
        .when(kind == "time", F.lit("time"))
        .when(kind == "yield", F.lit("yield_pct"))
        .when(kind == "reagent", F.concat(F.lit("reagents."), tail.cast("string")))
        .when(kind == "solvent", F.concat(F.lit("solvents."), tail.cast("string")))
    )
