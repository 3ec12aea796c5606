"""Analysis requests and the structured replies to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.binding import bind
from reviewloom.functions.text import strip

# The four fields of a reply and the records stored when there is none.
REPLY_FIELDS = ("aspect", "sentiment", "summary", "recommendation")
UNPARSED = {
    "aspect": "Parsing Error",
    "sentiment": "mixed",
    "summary": "Could not parse Gemini JSON. Raw response: ",
    "recommendation": "Inspect raw output.",
}
FAILED = {
    "aspect": "AI Generation Error",
    "sentiment": "mixed",
    "summary": "Error generating summary: ",
    "recommendation": "Rerun pipeline.",
}
LENIENT = "struct<" + ", ".join(f"{field}: string" for field in REPLY_FIELDS) + ", broken: string>"
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"

REQUEST_HEAD = "Customer feedback of a gym chain is grouped by topic. Keywords of this topic: "
REQUEST_SAMPLES = "\nReviews of this topic:\n- "
REQUEST_TASK = (
    "\nName the aspect or issue, say whether opinion is positive, negative or mixed, summarise what "
    "customers expect and recommend improvements. Answer only with a JSON object holding the string "
    'fields "aspect", "sentiment", "summary" and "recommendation".'
)


def unfence(reply: Column) -> Column:
    """Body of a reply without the code fence around it."""

    def without_open(body: Column) -> Column:
        rest = strip(F.substr(body, F.lit(len(FENCE_OPEN) + 1)))
        return F.when(F.startswith(body, F.lit(FENCE_OPEN)), rest).otherwise(body)

    def without_close(body: Column) -> Column:
        rest = strip(F.substr(body, F.lit(1), F.length(body) - len(FENCE_CLOSE)))
        return F.when(F.endswith(body, F.lit(FENCE_CLOSE)), rest).otherwise(body)

    return bind(bind(strip(reply), without_open), without_close)


def _fallback(template: dict[str, str], detail: Column) -> Column:
    return F.struct(
        *(
            (F.concat(F.lit(text), F.coalesce(detail, F.lit(""))) if field == "summary" else F.lit(text)).alias(field)
            for field, text in template.items()
        )
    )


def parse_reply(reply: Column, error: Column | None = None) -> Column:
    """Struct of the four fields: a missing key reads as '', a JSON null as null.

    Anything but a JSON object becomes the parse-error record; a failed call
    (``error`` set) becomes the call-error record.
    """
    def field_of(value: Column, field: str) -> Column:
        # a JSON null yields a variant null here, a missing key yields SQL null
        return bind(
            F.try_variant_get(value, f"$.{field}", "variant"),
            lambda found: F.when(found.isNull(), F.lit("")).otherwise(F.try_variant_get(found, "$", "string")),
        )

    def fields_of(value: Column) -> Column:
        is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
        fields = F.struct(*(field_of(value, field).alias(field) for field in REPLY_FIELDS))
        return F.when(is_object, fields).otherwise(_fallback(UNPARSED, reply))

    def read(body: Column) -> Column:
        # repeated keys and bare NaN are no JSON for the parser above, but common readers take them: the last value counts
        lenient = bind(
            F.from_json(body, LENIENT, {"columnNameOfCorruptRecord": "broken"}),
            lambda found: F.when(
                found["broken"].isNull() & F.startswith(body, F.lit("{")),
                F.struct(*(F.coalesce(found[field], F.lit("")).alias(field) for field in REPLY_FIELDS)),
            ),
        )
        return bind(
            F.try_parse_json(body),
            lambda value: F.when(value.isNull(), F.coalesce(lenient, _fallback(UNPARSED, reply))).otherwise(fields_of(value)),
        )

    parsed = bind(unfence(reply), read)
    if error is None:
        return parsed
    return F.when(error.isNotNull(), _fallback(FAILED, error)).otherwise(parsed)


def analysis_request(keywords: Column, samples: Column) -> Column:
    """Prompt text of one topic."""
    return F.concat(
        F.lit(REQUEST_HEAD), keywords, F.lit(REQUEST_SAMPLES), F.array_join(samples, "\n- "), F.lit(REQUEST_TASK)
    )
