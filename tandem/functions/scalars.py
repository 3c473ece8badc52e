"""Scalar transforms and identities as Column expressions.

Cells follow the loose typing of the systems that are reconciled: null and the empty string are alike for identities,
numbers in strings are read leniently, and what cannot be read stays as it is. Nothing here raises on user data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

_BLANK = "[\\s ﻿]+"


def kind_of(data_type: DataType) -> str:
    """What transforms go by: string, boolean, number or other."""
    kinds = {StringType: "string", BooleanType: "boolean", NumericType: "number"}
    return next((k for t, k in kinds.items() if isinstance(data_type, t)), "other")


def text(c: Column, kind: str = "string") -> Column:
    """The cell as a string; null becomes the empty string, numbers take their shortest form."""
    return F.coalesce(number_string(c.cast("double")) if kind == "number" else c.cast("string"), F.lit(""))


def js_trim(c: Column) -> Column:
    """Drops white space of any kind, no-break spaces and byte order marks at both ends."""
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def js_number(c: Column) -> Column:
    """The number a string stands for (blank: 0, hexadecimal: its value), null where it is none."""
    t = js_trim(c.cast("string"))
    decimal = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    whole = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double"))
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(decimal, whole))


def number_string(c: Column) -> Column:
    """A double in its shortest decimal form: no exponent from 1e-6 up to under 1e21, no point in whole numbers, no sign before zero.

    Fifteen digits tell whether so many suffice, then sixteen; numbers under 1e-307 may show more than they need.
    """
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    plain = F.when(whole, c.cast("decimal(38,0)").cast("string"))
    tries = [F.format_string(f"%.{p}e", F.abs(c)) for p in (14, 15, 16)]
    said = F.coalesce(*[F.when(t.try_cast("double") == F.abs(c), t) for t in tries[:2]], tries[2])
    zeros = lambda many: F.repeat(F.lit("0"), many)

    def shown(x: Column) -> Column:
        digits, n = x["digits"], x["n"]
        k = F.length(digits)
        power = F.concat(F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
        head = F.concat(F.left(digits, F.lit(1)), F.when(k > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
        return (
            F.when((n > 21) | (n < -5), F.concat(head, power)).when(n <= 0, F.concat(F.lit("0."), zeros(-n), digits)).when(k <= n, F.concat(digits, zeros(n - k)))
            .otherwise(F.concat(F.left(digits, n), F.lit("."), F.substr(digits, n + 1)))
        )

    parts = F.transform(F.array(said), lambda t: F.struct(F.regexp_replace(F.regexp_replace(F.substring_index(t, "e", 1), "[.]", ""), "0+$", "").alias("digits"), (F.substring_index(t, "e", -1).try_cast("int") + 1).alias("n")))
    text_ = F.transform(parts, shown)[0]
    return F.coalesce(plain, F.when(F.isnan(c) | (F.abs(c) == float("inf")), c.cast("string")).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), text_)))


def identity(c: Column) -> Column:
    return c


def lowercase(c: Column) -> Column:
    return F.lower(js_trim(c))


def domain(c: Column) -> Column:
    """The host of a URL in lower case without a leading www.; what is no URL is put in lower case."""
    url = F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("http://"), c))
    host = F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.when(c == "", c).otherwise(F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lower(c)))


def number(c: Column, kind: str = "string") -> Column:
    """A finite number or null; the empty string is null."""
    if kind == "boolean":
        return c.cast("int").cast("double")
    n = js_number(c) if kind == "string" else c.cast("double")
    return F.when((c.cast("string") != "") & (F.abs(n) < float("inf")), n)


def boolean(c: Column, kind: str = "string") -> Column:
    """Of a string: whether it is true, 1 or yes; of a number: whether it is one other than 0."""
    if kind == "boolean":
        return c
    if kind == "number":
        return (c != 0) & ~F.isnan(c.cast("double"))
    return F.lower(c).isin("true", "1", "yes") if kind == "string" else c.isNotNull()


def yes_no(c: Column, kind: str = "string") -> Column:
    """Either way by what comes in: yes, true and 1 become true, a boolean becomes yes or no."""
    if kind == "boolean":
        return F.when(c, "yes").when(~c, "no")
    return F.lower(c).isin("yes", "true", "1") if kind == "string" else c


def true_false(c: Column, kind: str = "string") -> Column:
    """Either way by what comes in: the word true becomes true, a boolean becomes its word."""
    if kind == "boolean":
        return F.when(c, "true").when(~c, "false")
    return F.lower(c) == "true" if kind == "string" else c


def _moment(c: Column) -> Column:
    """The time that a text names; a date alone is midnight UTC, a time without a zone one of the session's."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(c, F.lit("T00:00:00Z")))).otherwise(F.try_to_timestamp(c))


def _iso(moment: Column) -> Column:
    """A time in ISO form with milliseconds, UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(c: Column, kind: str = "string") -> Column:
    """A date or time in ISO form with milliseconds, UTC; numbers are milliseconds; unreadable text is left alone."""
    if kind == "number":
        return _iso(F.timestamp_millis(c.cast("long")))
    return F.coalesce(_iso(_moment(c)), c) if kind == "string" else c


def epoch_millis(c: Column, kind: str = "string") -> Column:
    """Either way by what comes in: an ISO text becomes milliseconds since 1970, a number becomes ISO text."""
    if kind == "number":
        return _iso(F.timestamp_millis(c.cast("long")))
    return F.unix_millis(_moment(c)) if kind == "string" else c


def phone(c: Column) -> Column:
    """Digits and plus signs only."""
    return F.regexp_replace(js_trim(c), "[^0-9+]", "")


def _strings(f: Callable[[Column], Column]) -> Callable[[Column, str], Column]:
    """A transform of strings that leaves other values alone."""
    return lambda c, kind="string": f(c) if kind == "string" else c


#: Transforms by the names used in field rules, called with the column and its kind; users may add their own.
TRANSFORMS: dict[str, Callable[[Column, str], Column]] = {
    "identity": _strings(identity), "lowercase": _strings(lowercase), "trim": _strings(js_trim), "domain": _strings(domain), "phone": _strings(phone),
    "number": number, "boolean": boolean, "yes-no": yes_no, "true-false": true_false, "iso-date": iso_date, "epoch-millis": epoch_millis,
}


def content_hash(fields: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """16 hex digits that tell whether the fields of a record have changed; names in order, null like empty."""
    parts = [F.concat(F.lit(f"{name}="), text(fields[name], (kinds or {}).get(name, "string"))) for name in sorted(fields)]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def natural_key(fields: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """Key over all fields, null unless every one holds a string or number that is not blank; fields called domain are reduced to the host."""
    kinds = kinds or {}
    if any(kinds.get(name, "string") not in ("string", "number") for name in fields):
        return F.lit(None).cast("string")
    host = lambda c: F.regexp_replace(domain(js_trim(c)), r"^www\.", "")
    values = [F.nullif((host if name == "domain" else lowercase)(F.nullif(text(c, kinds.get(name, "string")), F.lit(""))), F.lit("")) for name, c in fields.items()]
    parts = [F.concat(F.lit(f"{name}:"), v) for name, v in zip(fields, values)]
    present = values[0].isNotNull()
    for v in values[1:]:
        present &= v.isNotNull()
    return F.when(present, F.concat_ws("|", *parts))


def event_key(system: Column, event_id: Column, *parts: Column) -> Column:
    """The system and its event id, or a hash of what the event says where it has no id."""
    return F.coalesce(F.concat(system, F.lit(":"), event_id.cast("string")), F.sha2(F.concat_ws(":", system, *(text(p) for p in parts)), 256))


def association_id(*parts: Column) -> Column:
    """A stable id in UUID form for an edge."""
    h = F.sha2(F.concat_ws(":", *(text(p) for p in parts)), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))


def canonical_id(system: Column, kind: Column, source_id: Column) -> Column:
    """A deterministic new id."""
    return F.sha2(F.concat_ws(":", system, kind, source_id), 256)


def backoff_millis(attempts: Column, base: int = 500, most: int = 60_000) -> Column:
    """Delay before the next attempt: doubles with each, up to a limit."""
    return F.least(F.lit(most), base * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(attempts, F.lit(40)) - 1))).cast("long")


def clamped_interval(minutes: Column, default: int = 30, most: int = 43_200) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.round(F.coalesce(minutes, F.lit(default))))).cast("int")


def slug(label: Column) -> Column:
    """Lower-case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(js_trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def plain_name(label: Column) -> Column:
    """Letters and digits in lower case without a final s, for pairing names."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]", ""), "s$", "")


def fingerprint(c: Column, digits: int = 12) -> Column:
    return F.left(F.sha2(c, 256), F.lit(digits))


def type_group(native: Column) -> Column:
    """The logical group of a native type; the types of each are fixed values."""
    return (
        F.when(native.isin("int", "integer", "long", "double", "number", "currency"), "number")
        .when(native.isin("date", "datetime", "dateTime"), "date").when(native.isin("bool", "boolean"), "boolean")
        .when(native.isin("enumeration", "picklist", "multipicklist"), "enum").otherwise("string")
    )


#: Names that no natural key may have, parts of such names, and the text of a refused duplicate.
_NO_KEYS = ("id", "type", "industry", "website", "annualrevenue", "revenue")
_NO_KEY_PARTS = "modified|activity|created|updated|timestamp|description|notes?|ownerid|recordtype|status|stage|pipeline|amount|employee|count|isdeleted"
_DUPLICATE = r"(?i)propertyName=([^,}]+),\s*value=([^}]+)\}\s*on\s*\S+\.\s*(\S+)\s*already has that value"


def allowed_natural_key(field: Column) -> Column:
    """Whether a field may be part of a natural key: ids of other systems may, own ids and what changes often may not."""
    key = F.lower(F.regexp_replace(field, "[^A-Za-z0-9]", ""))
    outside = F.contains(key, F.lit("external")) & key.endswith("id")
    return (key != "") & (outside | ~(key.isin(*_NO_KEYS) | key.rlike(_NO_KEY_PARTS)))


def vendor_message(body: Column) -> Column:
    """The message of an error body: of the object, or of the first one of an array."""
    return F.coalesce(F.get_json_object(body, "$[0].message"), F.get_json_object(body, "$.message"))


def duplicate_conflict(message: Column) -> Column:
    """(property, value, holder) of a write refused because another record holds a unique value; null for other messages."""
    part = lambda i: F.regexp_extract(message, _DUPLICATE, i)
    return F.when(message.rlike(_DUPLICATE), F.struct(part(1).alias("property"), part(2).alias("value"), part(3).alias("holder")))


def error_class(status: Column, body: Column) -> Column:
    """What a refused write means: a duplicate, a field's value, a vanished record, or what the status tells; the first that holds."""
    message = vendor_message(body)
    gone = F.lower(F.trim(message)) == "resource not found"
    return (
        F.when(duplicate_conflict(message).isNotNull(), "duplicate_value").when(F.get_json_object(body, "$.errors[0].message").isNotNull(), "field_errors")
        .when(gone | (status == 404), "not_found").when(message.rlike("(?i)was not one of the allowed options|was not a valid (long|integer|number)"), "invalid_value")
        .when(message.isNotNull(), "vendor_message").when(status == 400, "invalid_record").when(status == 401, "unauthenticated").when(status == 403, "forbidden")
        .when(status == 415, "request_format").when(status == 429, "rate_limited").when(status >= 500, "server_error").otherwise("failed")
    )


def retries(error: Column) -> Column:
    """Whether a later attempt may succeed without anybody's help."""
    return error.isin("request_format", "rate_limited", "server_error", "failed")


def finding_key(*parts: Column) -> Column:
    """A key over several columns, null like empty, joined by a control character."""
    return F.concat_ws("\x00", *(text(p) for p in parts))
