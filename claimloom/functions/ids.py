"""Content hashes and stable ids."""

from pyspark.sql import Column, functions as F

from .text import col

SEP = "\u001f"
NULL_MARK = "\u001e"
ID_DIGITS = 32  # hex digits, 128 bits: no two tasks of a document share an id
# Id prefix of each task channel.
TASK_PREFIXES = {"text": "tx", "table": "tt", "structure": "st", "adjudication": "ad"}


def content_text(*cols) -> Column:
    """Columns joined so that null, '' and shifted values stay distinct."""
    return F.concat_ws(SEP, *[F.coalesce(col(c).cast("string"), F.lit(NULL_MARK)) for c in cols])


def content_hash(*cols) -> Column:
    return F.sha2(content_text(*cols), 256)


def stable_id(prefix, *cols) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit("-"), F.substring(content_hash(*cols), 1, ID_DIGITS))


def record_hash(record_fields) -> Column:
    """SHA-256 over the serialised record; field order is the order given."""
    return F.sha2(F.to_json(F.struct(*record_fields), {"ignoreNullFields": "false"}), 256)


def task_id(kind, key) -> Column:
    """``prefix-`` and 32 hex digits of the hash of ``kind|key``."""
    kind = col(kind)
    prefixes = F.create_map(*[F.lit(v) for pair in TASK_PREFIXES.items() for v in pair])
    digest = F.sha2(F.concat(kind, F.lit("|"), col(key)), 256)
    return F.concat(prefixes[kind], F.lit("-"), F.substring(digest, 1, ID_DIGITS))


def structure_hash(canonical) -> Column:
    return F.substring(F.sha2(col(canonical), 256), 1, 16)


def document_id(content) -> Column:
    return F.substring(F.sha2(col(content), 256), 1, 16)


def member_hash(c) -> Column:
    """60-bit number per value; xor over a set gives an order-free digest."""
    return F.conv(F.substring(F.sha2(col(c), 256), 1, 15), 16, 10).cast("bigint")
