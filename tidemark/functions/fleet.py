"""Column expressions on image references, quantities, object URIs and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An image reference ends in ":tag"; the name in front may hold colons itself.
IMAGE = r"^(.+):([\w.-]+)$"
# An HTTP status line.
STATUS_LINE = r"(?m)^HTTP/[0-9.]*\s([0-9]{3})(?:\s|$)"
# Factors of resource suffixes. Lower-case letters are binary (memory settings).
FACTORS = {
    "m": "0.001",
    "": "1",
    "K": "1000",
    "M": "1000000",
    "G": "1000000000",
    "T": "1000000000000",
    "P": "1000000000000000",
    "E": "1000000000000000000",
    "Ki": str(2**10),
    "Mi": str(2**20),
    "Gi": str(2**30),
    "Ti": str(2**40),
    "Pi": str(2**50),
    "Ei": str(2**60),
    "k": str(2**10),
    "g": str(2**30),
    "t": str(2**40),
}
QUANTITY = r"^([0-9]+(?:\.[0-9]+)?)([A-Za-z]*)$"


def image_parts(ref: Column) -> Column:
    """Struct of registry, repository and tag: the tag follows the last colon, the registry is all
    before the first slash, empty without a slash. Null without a colon."""
    name = F.regexp_extract(ref, r"(?s)^(.*):([^:]*)$", 1)
    registry = F.when(name.contains("/"), F.substring_index(name, "/", 1)).otherwise(F.lit(""))
    repository = F.when(name.contains("/"), F.regexp_replace(name, r"^[^/]*/", "")).otherwise(name)
    return F.when(
        ref.contains(":"),
        F.struct(
            registry.alias("registry"),
            repository.alias("repository"),
            F.substring_index(ref, ":", -1).alias("tag"),
        ),
    )


def image_name(ref: Column) -> Column:
    """What stands before the tag; null when the text is no image reference."""
    return F.when(ref.rlike(IMAGE), F.regexp_extract(ref, IMAGE, 1))


def image_tag(ref: Column) -> Column:
    return F.when(ref.rlike(IMAGE), F.regexp_extract(ref, IMAGE, 2))


def quantity(raw: Column) -> Column:
    """Amount in base units (cores, bytes) as decimal(38,3); null for what is no quantity."""
    amount = F.regexp_extract(raw, QUANTITY, 1)
    suffix = F.regexp_extract(raw, QUANTITY, 2)
    factor = F.lit(None).cast("decimal(22,3)")
    for name, size in FACTORS.items():
        factor = F.when(suffix == name, F.lit(size).cast("decimal(22,3)")).otherwise(factor)
    value = F.try_multiply(amount.try_cast("decimal(18,3)"), factor)
    return F.when(raw.rlike(QUANTITY), value.try_cast("decimal(38,3)"))


# Units of memory settings of applications, in powers of 1024; without a unit they are mebibytes.
MEMORY_UNITS = {"b": 0, "k": 1, "kb": 1, "": 2, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4, "p": 5, "pb": 5}
MEMORY = r"^\s*([0-9]+)([a-zA-Z]*)\s*$"


def spark_memory(raw: Column) -> Column:
    """Bytes of an application's memory setting, such as ``512m``: whole numbers with binary units in any case; null for
    anything else. ``quantity`` reads container resources, where ``m`` is a thousandth."""
    amount = F.regexp_extract(raw, MEMORY, 1).try_cast("decimal(20,0)")
    unit = F.lower(F.regexp_extract(raw, MEMORY, 2))
    factor = F.lit(None).cast("decimal(18,0)")
    for name, power in MEMORY_UNITS.items():
        factor = F.when(unit == name, F.lit(str(1024**power)).cast("decimal(18,0)")).otherwise(factor)
    return F.when(raw.rlike(MEMORY), F.try_multiply(amount, factor))


def uri_parts(uri: Column) -> Column:
    """Struct of bucket and key; one trailing slash is dropped, a missing key is empty."""
    trimmed = F.regexp_replace(uri, "/$", "")
    pieces = F.split(trimmed, "/")
    return F.struct(
        F.coalesce(F.get(pieces, F.lit(2)), F.lit("")).alias("bucket"),
        F.array_join(F.slice(pieces, 4, F.greatest(F.size(pieces), F.lit(1))), "/").alias("key"),
    )


def http_status(response: Column) -> Column:
    """Status code of the first status line in a response text; null without one."""
    return F.regexp_extract(response, STATUS_LINE, 1).try_cast("int")


def status_class(code: Column) -> Column:
    """What a bucket check concludes from the code."""
    return (
        F.when(code == 200, F.lit("exists"))
        .when(code == 404, F.lit("missing"))
        .otherwise(F.lit("unknown"))
    )
