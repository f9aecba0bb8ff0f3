"""Image manifests, releases, configuration drift and capacity over a fleet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fleet import image_name, image_tag, quantity
from tidemark.operators.joins import lookup

MANIFEST_KEYS = ["type", "name", "container"]


def parse_manifest(df: DataFrame, column: str = "manifest", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per item of a comma-joined list of ``type name container image``."""
    items = F.split(F.regexp_replace(F.col(column), ",+$", ""), ",")
    fields = F.split(F.trim(F.col("item")), r"\s+")
    names = [*MANIFEST_KEYS, "image"]
    return (
        df.select(*keep, F.explode(items).alias("item"))
        .filter(F.trim("item") != "")
        .select(*keep, *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])
    )


def image_mismatch(
    declared: DataFrame, running: DataFrame, keys: list[str] | tuple[str, ...] = tuple(MANIFEST_KEYS)
) -> DataFrame:
    """Declared images that run in another version or not at all."""
    actual = running.select(*keys, F.col("image").alias("running_image"))
    problem = F.when(F.col("running_image").isNull(), F.lit("missing")).otherwise(F.lit("mismatch"))
    return (
        declared.join(actual, list(keys), "left")
        .filter(~F.col("image").eqNullSafe(F.col("running_image")))
        .select(*keys, "image", "running_image", problem.alias("problem"))
    )


def retag(df: DataFrame, releases: DataFrame, ref: str = "image_ref") -> DataFrame:
    """Give image references the released tag of their name; ``changed`` marks those that differ.

    ``releases`` holds one reference per name in column ``image_ref``.
    """
    released = releases.select(
        image_name(F.col("image_ref")).alias("__name"), image_tag(F.col("image_ref")).alias("__tag")
    ).filter(F.col("__name").isNotNull())
    changed = F.col("__tag").isNotNull() & (F.col("__tag") != image_tag(F.col(ref)))
    fresh = F.concat("__name", F.lit(":"), "__tag")
    return (
        df.withColumn("__name", image_name(F.col(ref)))
        .join(lookup(released), "__name", "left")
        .withColumn("changed", changed)
        .withColumn("new_ref", F.when(F.col("changed"), fresh).otherwise(F.col(ref)))
        .drop("__name", "__tag")
    )


def _joined(registry: Column, repository: Column) -> Column:
    """Name of an image from its two parts, with one slash between them."""
    slash = F.lit("/")
    head = F.regexp_replace(registry, "/+$", "")
    return F.concat(head, slash, F.regexp_replace(repository, "^/+", ""))


def retag_nodes(df: DataFrame, releases: DataFrame, node: str = "image") -> DataFrame:
    """Structured references (``registry``, ``repository``, ``tag``; each may be null) with the released tag of their
    name; ``changed`` marks those that differ.

    The name is the registry alone without a repository, else registry and repository; if that has no release, the
    repository alone is looked up too, which is also the name without a registry. Without a tag nothing changes.
    """
    released = lookup(
        releases.select(
            image_name(F.col("image_ref")).alias("__name"), image_tag(F.col("image_ref")).alias("__tag")
        ).filter(F.col("__name").isNotNull())
    )
    part = F.col(node)
    full = F.coalesce(_joined(part["registry"], part["repository"]), part["registry"])
    named = df.withColumns({"__full": full, "__short": part["repository"]})
    for column in ("__full", "__short"):
        found = released.withColumnsRenamed({"__name": column, "__tag": f"{column}_tag"})
        named = named.join(found, column, "left")
    # the repository's own release is applied last, so it wins over that of the full name
    fresh = F.coalesce("__short_tag", "__full_tag")
    changed = F.coalesce(part["tag"] != fresh, F.lit(False))
    tag = F.when(changed, fresh).otherwise(part["tag"])
    return (
        named.withColumn("changed", changed)
        .withColumn(node, part.withField("tag", tag))
        .drop("__full", "__short", "__full_tag", "__short_tag")
    )


# A default that only points to a file is not compared.
SKIP_PREFIX, SKIP_SUFFIX = "see ", " values.yaml file"


def _compared(default) -> bool:
    pointer = isinstance(default, str) and default.startswith(SKIP_PREFIX) and default.endswith(
        SKIP_SUFFIX
    )
    return not pointer


def _differs(value: Column, default) -> Column:
    """Whether a scalar variant is another value than the default. Numbers compare by value, whole ones exactly."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    if isinstance(default, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == default)
    elif isinstance(default, int):
        whole = F.lit(str(default)).cast("decimal(38,0)")
        exact = F.try_variant_get(value, "$", "decimal(38,0)") == whole
        # a fraction would be rounded to the whole number, so both forms have to agree
        same = (kind.rlike("^(BIGINT|DECIMAL)") & exact & (number == float(default))) | (
            (kind == "DOUBLE") & (number == float(default))
        )
    elif isinstance(default, float):
        same = (kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")) & (number == default)
    elif isinstance(default, str):
        same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == default)
    elif default is None:
        same = kind == "VOID"
    else:  # a scalar never equals a list or an object
        same = F.lit(False)
    return ~F.coalesce(same, F.lit(False))


def _is_container(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")


def _findings(value: Column, schema: dict, path: Column) -> list[Column]:
    """Array-valued expressions of ``struct(path, expected, actual)``, one per place in the schema."""
    out = []
    for key, prop in schema.get("properties", {}).items():
        child = F.try_variant_get(value, f"$['{key}']", "variant")
        at = F.concat(path, F.lit(key))
        # "null" in JSON is a present value, which a variant shows as a non-null void.
        if "default" in prop:
            if _compared(prop["default"]):
                finding = F.struct(
                    at.alias("path"),
                    F.lit(json.dumps(prop["default"])).alias("expected"),
                    F.to_json(child).alias("actual"),
                )
                hit = child.isNotNull() & ~_is_container(child) & _differs(child, prop["default"])
                out.append(F.when(hit, F.array(finding)))
        if prop.get("properties") or prop.get("items"):
            out += _findings(child, prop, F.concat(at, F.lit(".")))
    items = schema.get("items")
    if isinstance(items, dict) and items:
        elements = F.try_variant_get(value, "$", "array<variant>")

        def per_item(item: Column, i: Column) -> Column:
            place = F.concat(path, F.lit("["), i.cast("string"), F.lit("]."))
            return _together(_findings(item, items, place))

        if _findings(F.lit(None), items, path):
            out.append(F.flatten(F.transform(elements, per_item)))
    return out


FINDING = "array<struct<path:string,expected:string,actual:string>>"


def _together(findings: list[Column]) -> Column:
    none = F.array().cast(FINDING)
    return F.concat(*[F.coalesce(f, none) for f in findings]) if findings else none


def config_drift(
    actual: DataFrame, schema: dict, doc_id: str = "doc_id", document: str = "json"
) -> DataFrame:
    """Values of JSON documents that differ from the declared defaults, one row per path.

    ``schema`` is one JSON schema with ``properties``, ``items`` and ``default``. Keys it does not know
    are ignored, a list's elements all follow ``items``. The schema drives the expressions, so a
    document of any depth is read in one pass without a join.
    """
    value = F.try_parse_json(F.col(document))
    parsed = actual.select(doc_id, value.alias("__doc"))
    found = _together(_findings(F.col("__doc"), schema, F.lit("")))
    return parsed.select(doc_id, F.explode(found).alias("f")).select(doc_id, "f.*")


def with_quantity(df: DataFrame, column: str, new: str) -> DataFrame:
    return df.withColumn(new, quantity(F.col(column)))


def profile_capacity(df: DataFrame) -> DataFrame:
    """Cores and memory per sizing profile, split by optional and temporary containers, with totals
    (``optional`` and ``temporary`` null) per profile and over all (``profile`` null too)."""
    return df.groupingSets(
        [("profile", "optional", "temporary"), ("profile",), ()], "profile", "optional", "temporary"
    ).agg(
        F.sum(F.col("cpu") * F.col("n")).alias("cpu"),
        F.sum(F.col("mem_mi") * F.col("n")).alias("mem_mi"),
        F.sum("n").alias("containers"),
    )
