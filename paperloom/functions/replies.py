"""Reading model replies that should be one JSON object but often are not quite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.functions.text import filled, let, strip

# Figure stages and the ones kept for display.
FIGURE_STAGES = ("problem", "solution", "methodology", "experiments", "conclusion", "none")
KEPT_STAGES = ("problem", "solution", "methodology", "conclusion")

FENCE = r"(?i)^```(?:json)?\s*|\s*```$"
OUTER_OBJECT = r"(?s)\{.*\}"


def _whole_json(text: Column) -> Column:
    """Variant for `text` when all of it is one JSON value, else null.

    The JSON reader stops after the first value, so trailing words would pass
    unnoticed.  Text that parses both as the sole item of a list and as the sole
    value of an object has nothing before or after it.
    """

    def read(t: Column) -> Column:
        as_value = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return let(
            F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))),
            lambda item: F.when(
                item.isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull(),
                F.variant_get(as_value, "$.v", "variant"),
            ),
        )

    return let(text, read)


def is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def loose_json(reply: Column) -> Column:
    """Variant object from a reply: as is, without a code fence, or from the outermost braces.

    An empty reply is an empty object.  Null means the reply is missing or unusable,
    which includes JSON that is not an object.
    """

    def unfenced(t: Column) -> Column:
        return F.when(t.startswith("```"), strip(F.regexp_replace(t, FENCE, ""))).otherwise(t)

    def read(t: Column) -> Column:
        inner = _whole_json(filled(F.regexp_extract(t, OUTER_OBJECT, 0)))
        doc = F.when(reply == "", F.parse_json(F.lit("{}"))).otherwise(F.coalesce(_whole_json(t), inner))
        return let(doc, lambda d: F.when(is_object(d), d))

    return F.when(reply.isNotNull(), let(let(strip(reply), unfenced), read))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def text_field(doc: Column, path: str, default: Column | str) -> Column:
    """Trimmed string field; the default when it is missing."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return strip(F.coalesce(F.try_variant_get(doc, path, "string"), fallback))


def stage_of(assignments: Column, figure_key: Column) -> Column:
    """Stage from a ``map<string,string>``; anything unknown is ``none``."""
    raw = F.lower(strip(F.try_element_at(assignments, figure_key)))
    return F.when(raw.isin(*FIGURE_STAGES), raw).otherwise(F.lit("none"))


def reply_score(doc: Column, dimension: str) -> Column:
    """``struct(value, usable)`` for one dimension of a scoring reply.

    A missing dimension or score counts 0; a number outside 0-100 is clamped; a
    dimension that is no object or a score that is no number makes it unusable.
    """
    part = F.variant_get(doc, f"$['{dimension}']", "variant")
    raw = F.variant_get(part, "$.score", "variant")
    number = F.try_variant_get(part, "$.score", "double")
    usable = part.isNull() | (is_object(part) & (raw.isNull() | number.isNotNull()))
    return F.struct(
        (clamp(F.coalesce(number, F.lit(0.0)), 0.0, 100.0) / 100.0).alias("value"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )
