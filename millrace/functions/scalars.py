"""Column functions with exact text, number and time semantics. All stay in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the inputs.
ACCESS_KEY = "[0-9]{44}"
EMISSION = r"(?U)Emissão:\s*(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})"
QUANTITY_LABEL = "Qtde.:"
UNIT_PRICE_LABEL = "Vl. Unit.:"

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def bare_double(bare: Column) -> Column:
    """A finite decimal number without space around it, or null. Casts alone would also read 1d, inf and nan. The text is looked at once."""
    number = F.regexp_substr(bare, F.lit(NUMBER)).try_cast("double")
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def finite(number: Column) -> Column:
    """Null instead of an infinity. ``number`` is looked at several times and so should be a column."""
    return F.when((number < float("inf")) & (number > float("-inf")), number)


def perhaps_infinite(text: Column) -> Column:
    """A decimal number, perhaps in white space or beyond what a double holds, or null.

    Text that begins and ends as a number does, which almost all does, is only cast: what a cast reads beyond numbers ends in a letter, has an x in it, or begins or ends in space.
    Other text is stripped and held against the pattern. ``text`` is looked at several times and so should be a column.
    """
    plain = F.contains(F.lit("0123456789.+-"), F.substring(text, 1, 1)) & F.contains(F.lit("0123456789."), F.right(text, F.lit(1))) & ~F.contains(text, F.lit("x")) & ~F.contains(text, F.lit("X"))
    return F.when(plain, text.try_cast("double")).otherwise(bare_double(strip(text)))


def number_of(text: Column) -> Column:
    """A finite decimal number, perhaps in white space, or null. ``text`` is looked at several times and so should be a column."""
    number = perhaps_infinite(text)
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def strict_double(text: Column) -> Column:
    """A finite decimal number, or null. Rejects grouping, type suffixes, NaN and infinities."""
    return number_of(text.cast("string"))


def access_key(text: Column) -> Column:
    """The first 44 digits in a row, or null."""
    return F.regexp_substr(text, F.lit(ACCESS_KEY))


def emission_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, EMISSION, 1), F.lit(""))


def day_first_timestamp(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` as a timestamp without zone; null for impossible dates and other forms."""
    ordered = F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$2-$1 $4")
    return F.when(ordered.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), ordered.try_cast("timestamp_ntz"))


def comma_text(text: Column, *labels: str, thousands: bool = False) -> Column:
    """Labels removed, decimal comma turned into a point, stripped."""
    return strip(point_text(text, *labels, thousands=thousands))


def point_text(text: Column, *labels: str, thousands: bool = False) -> Column:
    """Labels removed, decimal comma turned into a point."""
    for label in labels:
        text = F.replace(text, F.lit(label), F.lit(""))
    if thousands:
        text = F.when(F.contains(text, F.lit(",")), F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    return F.replace(text, F.lit(","), F.lit("."))


def comma_double(text: Column, *labels: str, thousands: bool = False) -> Column:
    """A number with a decimal comma. ``1.234,56`` fails (null) unless ``thousands`` is set."""
    return bare_double(comma_text(text, *labels, thousands=thousands))


def comma_failed(text: Column, *labels: str, thousands: bool = False) -> Column:
    """Whether the text holds something that isn't a number. An empty or null text fails nothing."""
    bare = comma_text(text, *labels, thousands=thousands)
    return F.coalesce(bare != "", F.lit(False)) & bare_double(bare).isNull()


def euro_thousands(value: Column) -> Column:
    return F.concat(F.lit("€"), F.format_number(value, 2), F.lit(" mil euros"))


def reais(value: Column) -> Column:
    return F.format_string("R$ %.2f", value)


def timestamp_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def valid_utf8(data: Column) -> Column:
    """Bytes as text; null where they aren't UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


#: JSON as its standard has it, whatever the session's settings.
STRICT = {"mode": "PERMISSIVE"} | {
    f"allow{x}": "false" for x in ("SingleQuotes", "UnquotedFieldNames", "NonNumericNumbers", "NumericLeadingZeros", "Comments", "BackslashEscapingAnyCharacter", "UnquotedControlChars")
}


def object_keys(text: Column) -> Column:
    """The keys of a JSON object, repeated ones too; null for everything else.

    The parser reads one value and ignores what follows it. As an element of an array of one, and of one of two, the text must be exactly one value: text that closes the
    array itself gives both the same length.
    """
    size = lambda end: F.size(F.from_json(F.concat(F.lit("["), text, F.lit(end)), "array<string>", STRICT))
    return F.when((size("]") == 1) & (size(",0]") == 2), F.json_object_keys(text))


def name_based_id(space: uuid.UUID, name: Column) -> Column:
    """The UUID of version 5 that ``name`` has in a name space."""
    digest = F.sha1(F.concat(F.lit(space.bytes), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    last = F.concat(variant, F.substring(digest, 18, 3))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), last, F.substring(digest, 21, 12))
