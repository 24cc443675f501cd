"""Text expressions: dict literals, addresses, markup, trimming, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP_TYPE = T.MapType(T.StringType(), T.StringType())
ADDRESS_PARTS = ["line1", "city", "state", "country", "zipcode"]

# Tokens of a dict literal: a quoted string in either style, or what stands between strings.
_TOKEN = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""
# Between strings: words that Python spells differently, tuples, a comma before a closing bracket, keys without quotes.
_BETWEEN = [
    (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\(", "["), (r",?\s*\)", "]"), (r",\s*([\]}])", "$1"),
    (r"([{,]\s*)(-?[0-9][0-9.eE+-]*|true|false|null)(\s*:)", '$1"$2"$3'), (r"\s+", " "),
]
# Inside a string, without its doubled backslashes: escapes that JSON spells differently.
_ESCAPES = [
    (r"\\'", "'"), (r"\\x([0-9a-fA-F]{2})", r"\\u00$1"), (r"\\a", r"\\u0007"), (r"\\v", r"\\u000b"), (r"\\\r?\n", ""),
    (r'\\([^"bfnrtuU])', r"\\\\$1"), (r'(?<!\\)"', r'\\"'), (r"\t", r"\\t"), (r"\n", r"\\n"), (r"\r", r"\\r"),
]


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _wide(text: Column) -> Column:
    r"""Eight-digit escapes ``\U`` as the two four-digit ones that JSON has for them."""

    def pair(part: Column) -> Column:
        code = F.conv(F.substring(part, 1, 8), 16, 10).cast("bigint")
        above = code - 0x10000
        high, low = F.lit(0xD800) + F.shiftright(above, 10), F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        four = lambda v: F.concat(F.lit("\\u"), F.lpad(F.hex(v), 4, "0"))
        return F.concat(F.when(above < 0, four(code)).otherwise(F.concat(four(high), four(low))), F.substring(part, 9, 1 << 30))

    parts = F.split(text, r"\\U", -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), pair)
    return F.when(text.contains("\\U"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


def literal_to_json(text: Column) -> Column:
    """The JSON text of a literal of strings, numbers, None, True, False, lists, tuples and dicts, as ``repr`` writes them."""

    def token(t: Column) -> Column:
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        spelled = lambda part: _wide(_replaced(part, _ESCAPES))
        # A doubled backslash is the same in JSON, and without them every backslash begins its own escape.
        string = F.when(inner.contains("\\"), F.array_join(F.transform(F.split(inner, r"\\\\", -1), spelled), "\\\\"))
        string = string.otherwise(_replaced(inner, _ESCAPES[-4:]))
        quoted = F.length(t).__gt__(1) & (t.startswith("'") | t.startswith('"'))
        return F.when(quoted, F.concat(F.lit('"'), string, F.lit('"'))).otherwise(_replaced(t, _BETWEEN))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), token), "")


def dict_literal(text: Column) -> Column:
    """Dict-literal or JSON-object text to ``map<string,string>``; bad text gives an empty map.

    Texts that the JSON reader takes as they are (it knows both quote styles) go straight to it;
    others are spelled as JSON first. Values other than strings come as their JSON text.
    """
    plain = ~text.rlike(r"None|True|False|\\|\(")
    read = F.coalesce(F.when(plain, F.from_json(text, MAP_TYPE)), F.from_json(literal_to_json(text), MAP_TYPE))
    return F.coalesce(read, F.from_json(F.lit("{}"), MAP_TYPE))


def parse_address(text: Column) -> Column:
    """Address dict text to a struct of five strings; bad text gives null parts."""
    bag = dict_literal(text)
    return F.struct(*[F.try_element_at(bag, F.lit(p)).alias(p) for p in ADDRESS_PARTS])


def join_parts(parts: list[Column], sep: str = ", ") -> Column:
    """Join the parts that are neither null nor empty."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, sep)


def address_line(text: Column) -> Column:
    address = parse_address(text)
    return join_parts([address.getField(p) for p in ADDRESS_PARTS])


def clean_text(text: Column) -> Column:
    """Null to ``''``; tags out (never across a line break); white space collapsed; lower case."""
    without_tags = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?d)<.*?>", "")
    return F.lower(F.trim(F.regexp_replace(without_tags, r"(?U)[\s\x1c-\x1f]+", " ")))


def strip(text: Column) -> Column:
    """Null to ``''`` and all white space off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_quotes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, '"', ""), r"(?U)^\s+|\s+$", "")


def first_braces(text: Column) -> Column:
    """The first ``{`` to the last ``}``, over several lines; an error when there is none."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(text.isNull() | (block != ""), F.nullif(block, F.lit(""))).otherwise(
        F.raise_error(F.lit("no {...} block in the text"))
    )


def match_key(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))
