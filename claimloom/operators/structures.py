"""Structure dictionary and structure comparison.

Parsing a structure needs a domain library, so the caller supplies it.  Each
distinct structure text is parsed once, and every rule reads the dictionary.
"""

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import structure_hash
from ..functions.text import blank_to_null, col, skeleton, strip_annotations
from ..schemas import STRUCTURE_DICTIONARY
from .ranking import spread_key

Parser = Callable[[pd.Series], pd.DataFrame] | Mapping[str, Callable[[Column], Column]] | DataFrame


def structure_dictionary(structures: DataFrame, parser: Parser, column: str = "smiles") -> DataFrame:
    """Distinct structure texts -> raw, iso, noniso, n_unspecified, ok.

    ``parser`` is a pandas function over the distinct texts returning ``iso``,
    ``noniso`` and ``n_unspecified`` (null where a text does not parse), a mapping
    of the same names to Column functions, or a ready-made dictionary table.
    """
    if isinstance(parser, DataFrame):
        return parser
    raw = structures.select(F.col(column).alias("raw")).filter(blank_to_null("raw").isNotNull()).distinct()
    if isinstance(parser, Mapping):
        parsed = raw.select("raw", *[parser[n](F.col("raw")).alias(n) for n in ("iso", "noniso", "n_unspecified")])
        return parsed.withColumn("n_unspecified", F.col("n_unspecified").cast("int")).withColumn(
            "ok", F.col("iso").isNotNull()
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = parser(batch["raw"]).reset_index(drop=True)
            out.insert(0, "raw", batch["raw"].reset_index(drop=True))
            out["ok"] = out["iso"].notna()
            yield out[["raw", "iso", "noniso", "n_unspecified", "ok"]]

    return raw.mapInPandas(run, schema=STRUCTURE_DICTIONARY)


def with_parsed(rows: DataFrame, dictionary: DataFrame | Mapping, text: str, names: Mapping[str, str], *by) -> DataFrame:
    """Add the parsed forms of a text column, ``names``: field of the dictionary -> new column; null where nothing parses.

    A dictionary is joined on; blank texts match nothing and are spread by the columns ``by``. A parser of Column
    functions stands for its own dictionary: it is applied where the rows lie, so that no text is collected, made distinct or joined.
    """
    if isinstance(dictionary, Mapping):
        given = blank_to_null(text).isNotNull()
        return rows.select("*", *[F.when(given, dictionary[f](F.col(text))).alias(n) for f, n in names.items()])
    known = dictionary.select(F.col("raw").alias("_raw"), *[F.col(f).alias(n) for f, n in names.items()])
    return rows.withColumn("_text", spread_key(text, *by)).join(known, F.col("_text") == F.col("_raw"), "left").drop("_text", "_raw")


def canonicalise(structures: DataFrame, dictionary: DataFrame | Mapping, column: str = "smiles") -> DataFrame:
    """Add ``canonical`` and ``n_unspecified``; both null where nothing parses. ``dictionary`` as in ``with_parsed``."""
    if isinstance(dictionary, Mapping):
        parsed = with_parsed(structures, dictionary, column, {"iso": "canonical", "n_unspecified": "n_unspecified"})
        return parsed.withColumn("n_unspecified", F.col("n_unspecified").cast("int"))
    lookup = dictionary.select(
        F.col("raw").alias("_raw"), F.col("iso").alias("canonical"), "n_unspecified"
    )
    return structures.join(lookup, F.col(column) == F.col("_raw"), "left").drop("_raw")


def structure_hashes(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("raw", structure_hash("iso").alias("structure_hash"))


def comparison_level(
    a, b, iso_a, iso_b, noniso_a, noniso_b, normalization: str = "none", stereo_class=None
) -> tuple[Column, Column]:
    """(level, detail) of two structures whose parsed forms are already joined on.

    ``stereo_class`` is a Column with the finer class of two structures that
    differ only in stereo; without one the answer is ``stereo_only``.
    """
    a, b, iso_a, iso_b = col(a), col(b), col(iso_a), col(iso_b)
    noniso_a, noniso_b = col(noniso_a), col(noniso_b)
    blank_a, blank_b = blank_to_null(a).isNull(), blank_to_null(b).isNull()
    keep = {"strip_charge": (True, False), "strip_isotopes": (False, True)}.get(normalization)
    same_normalised = F.lit(False)
    if keep:
        charges, isotopes = keep
        same_normalised = strip_annotations(noniso_a, charges, isotopes) == strip_annotations(
            noniso_b, charges, isotopes
        )
    unparsed = F.concat_ws(
        "; ",
        F.when(iso_a.isNull(), F.concat(F.lit("Cannot parse A: "), a)),
        F.when(iso_b.isNull(), F.concat(F.lit("Cannot parse B: "), b)),
    )
    stereo = col(stereo_class) if stereo_class is not None else F.lit("stereo_only")
    stripped = {"strip_charge": "formal charges", "strip_isotopes": "isotope labels"}.get(normalization, "")
    ladder = [
        (blank_a & blank_b, F.lit("uncomparable"), F.lit("Both inputs are None or empty")),
        (blank_a, F.lit("missing_one_side"), F.lit("Only B side provided")),
        (blank_b, F.lit("missing_one_side"), F.lit("Only A side provided")),
        (iso_a.isNull() | iso_b.isNull(), F.lit("uncomparable"), unparsed),
        (iso_a == iso_b, F.lit("identical"), F.lit("Canonical isomeric SMILES are equal")),
        (noniso_a == noniso_b, stereo, F.concat(F.lit("Same connectivity ("), noniso_a, F.lit("), stereo differs"))),
        (same_normalised, F.lit("identical"), F.lit(f"Identical after stripping {stripped}")),
        (
            skeleton(noniso_a) == skeleton(noniso_b), F.lit("charge_salt_isotope_differs"),
            F.concat(F.lit("Same skeleton ("), skeleton(noniso_a), F.lit("), charge/salt/isotope differs")),
        ),
    ]
    level = detail = None
    for test, name, text in ladder:
        level = F.when(test, name) if level is None else level.when(test, name)
        detail = F.when(test, text) if detail is None else detail.when(test, text)
    different = F.concat(F.lit("Different connectivity: A="), noniso_a, F.lit(", B="), noniso_b)
    return level.otherwise("connectivity_differs"), detail.otherwise(different)


def compare_structures(
    pairs: DataFrame, dictionary: DataFrame | Mapping, a: str = "smiles_a", b: str = "smiles_b",
    normalization: str = "none", stereo_class: str | None = None,
) -> DataFrame:
    """Add ``level``, ``detail`` and ``comparable`` to a table of structure pairs."""
    joined = with_parsed(pairs, dictionary, a, {"iso": "_iso_a", "noniso": "_noniso_a"}, *pairs.columns)
    joined = with_parsed(joined, dictionary, b, {"iso": "_iso_b", "noniso": "_noniso_b"}, *pairs.columns)
    level, detail = comparison_level(
        a, b, "_iso_a", "_iso_b", "_noniso_a", "_noniso_b", normalization, stereo_class
    )
    out = joined.withColumn("level", level).withColumn("detail", detail)
    out = out.withColumn("comparable", ~F.col("level").isin("uncomparable", "missing_one_side"))
    return out.select(*pairs.columns, "level", "detail", "comparable")
