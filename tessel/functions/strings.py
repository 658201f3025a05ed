"""String functions with PostgreSQL meaning. Each notes where Spark's own function differs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown(x: Column) -> Column:
    """A value as output functions show it: booleans as t and f (a cast to text spells them out)."""
    return F.when(F.typeof(x) == "boolean", F.left(x.cast("string"), F.lit(1))).otherwise(x.cast("string"))


def concat(*parts: Column) -> Column:
    """Nulls are skipped; all null gives the empty string (Spark's concat gives null)."""
    return F.concat_ws("", *map(shown, parts))


def float_to_text(x: Column) -> Column:
    """double precision as text: no needless zeros, an exponent below 1e-4 and from 1e15 on, Infinity and NaN by name."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("string").try_cast("decimal(38,22)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    digits = F.regexp_replace(F.regexp_extract(x.cast("string"), r"^(-?\d+(?:\.\d+)?)E", 1), r"\.0$", "")
    power = F.regexp_extract(x.cast("string"), r"E(-?\d+)$", 1)
    signed = F.concat(F.when(F.startswith(power, F.lit("-")), F.lit("-")).otherwise(F.lit("+")), F.lpad(F.replace(power, F.lit("-"), F.lit("")), F.greatest(F.lit(2), F.char_length(F.replace(power, F.lit("-"), F.lit("")))), F.lit("0")))
    size = F.abs(x)
    special = F.when(F.isnan(x), F.lit("NaN")).when(size == float("inf"), F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
    return special.when(x == 0, F.when(F.startswith(x.cast("string"), F.lit("-")), F.lit("-0")).otherwise(F.lit("0"))).when((size >= 1e-4) & (size < 1e15), plain).otherwise(F.concat(digits, F.lit("e"), signed))


def timestamp_to_text(x: Column, zone: bool = False) -> Column:
    """Fractions of a second without needless zeros; with a time zone the session's offset (of whole hours) follows."""
    whole = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    part = F.regexp_replace(F.date_format(x, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, part, F.replace(F.date_format(x, "xxx"), F.lit(":00"), F.lit(""))) if zone else F.concat(whole, part)


def bytea_to_text(x: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(x)))


def to_text(x: Column, kind: str) -> Column:
    """x::text for the named SQL type; types that Spark spells alike are cast."""
    forms = {"double precision": float_to_text, "timestamp": timestamp_to_text, "timestamptz": lambda c: timestamp_to_text(c, True), "bytea": bytea_to_text, "bpchar": lambda c: F.rtrim(c.cast("string"), F.lit(" "))}
    return forms.get(kind, lambda c: c.cast("string"))(x)


def concat_strict(*parts: Column) -> Column:
    """The || operator: null if any part is."""
    return F.concat(*(p.cast("string") for p in parts))


def substr(text: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """Positions before 1 use up the count (Spark counts them from the end). A negative count gives null here, as an error can't be a column."""
    start = start if isinstance(start, Column) else F.lit(start)
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.substring(text, first, F.char_length(text))
    count = count if isinstance(count, Column) else F.lit(count)
    return F.when(count >= 0, F.substring(text, first, F.greatest(F.lit(0), start + count - first)))


def split_part(text: Column, separator: str, n: int) -> Column:
    if n == 0:
        raise ValueError("field position must not be zero")
    if separator == "":
        return F.when(F.lit(n in (1, -1)), text).otherwise(F.when(text.isNotNull(), F.lit("")))
    return F.split_part(text, F.lit(separator), F.lit(n))


def string_to_array(text: Column, delimiter: str | None, null_text: str | None = None) -> Column:
    """A null delimiter parts characters, an empty one nothing; the empty string gives an empty array."""
    if delimiter is None:
        parts = F.split(text, "")
    elif delimiter == "":
        parts = F.array(text)
    else:
        parts = F.split(text, re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", delimiter))
    out = F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), parts)
    return out if null_text is None else F.transform(out, lambda x: F.when(x != null_text, x))


def strpos(text: Column, part: Column | str) -> Column:
    return F.locate(part, text) if isinstance(part, str) else F.position(part, text)


def btrim(text: Column, chars: str = " ") -> Column:
    return F.btrim(text, F.lit(chars))


def ltrim(text: Column, chars: str = " ") -> Column:
    return F.ltrim(text, F.lit(chars))


def rtrim(text: Column, chars: str = " ") -> Column:
    return F.rtrim(text, F.lit(chars))


def replace(text: Column, what: str, by: str) -> Column:
    return F.replace(text, F.lit(what), F.lit(by)) if what else text


def ascii(text: Column) -> Column:
    """The first character's code point, 0 for the empty string."""
    return F.ascii(text)


def quote_ident(text: Column) -> Column:
    plain = text.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(text: Column) -> Column:
    """Null becomes the word NULL, as %L does."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(text.isNull(), F.lit("NULL")).otherwise(F.when(text.contains("\\"), F.concat(F.lit(" E"), quoted)).otherwise(quoted))


_SPEC = re.compile(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL%])")


def format(template: str, *args: Column) -> Column:
    """%s, %I and %L with positions (%2$s), widths (%10s, %-10s) and %%; the template is read once, on the driver."""
    parts, at, turn = [], 0, 0
    for m in _SPEC.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[4] == "%":
            parts.append(F.lit("%"))
            continue
        turn = int(m[1]) if m[1] else turn + 1
        if turn > len(args):
            raise ValueError("too few arguments for format()")
        value = args[turn - 1].cast("string")
        shown = {"s": F.coalesce(value, F.lit("")), "I": quote_ident(value), "L": quote_literal(value)}[m[4]]
        if m[3]:
            width = F.greatest(F.lit(int(m[3])), F.char_length(shown))
            shown = F.rpad(shown, width, F.lit(" ")) if m[2] else F.lpad(shown, width, F.lit(" "))
        parts.append(shown)
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def convert_to(text: Column, encoding: str) -> Column:
    return F.encode(text, {"UTF8": "UTF-8", "LATIN1": "ISO-8859-1", "SQL_ASCII": "US-ASCII"}.get(encoding.upper(), encoding))


def like_escape(text: Column, pattern: str, escape: str | None = None) -> Column:
    return text.like(pattern) if escape is None else F.like(text, F.lit(pattern), F.lit(escape))


#: Escapes and bracket expressions whose Java spelling differs.
_ESCAPES = {"m": r"(?<!\w)(?=\w)", "M": r"(?<=\w)(?!\w)", "y": r"\b", "Y": r"\B", "A": r"\A", "Z": r"\z"}
_CLASSES = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{Nd}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s", "blank": r" \t", "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": "0-9A-Fa-f"}


def java_pattern(pattern: str) -> str:
    """A POSIX (ARE) pattern in Java's dialect: $ is the very end, [:class:] and word escapes are translated, and [ and && inside
    brackets are plain characters."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            out.append(_ESCAPES.get(pattern[at + 1], pattern[at : at + 2]))
            at += 2
        elif pattern.startswith(("[[:<:]]", "[[:>:]]"), at):
            out.append(_ESCAPES["m" if pattern[at + 3] == "<" else "M"])
            at += 7
        elif c == "[":
            end = at + 1 + pattern.startswith("^", at + 1)
            end += pattern.startswith("]", end)  # a first ] is a member
            inside = [pattern[at:end].replace("]", r"\]")]
            while end < len(pattern) and pattern[end] != "]":
                named = re.match(r"\[:(\w+):\]", pattern[end:])
                if named:
                    inside.append(_CLASSES[named[1]])
                    end += named.end()
                elif pattern[end] == "\\" and end + 1 < len(pattern):
                    inside.append(pattern[end : end + 2])
                    end += 2
                else:
                    inside.append("\\" + pattern[end] if pattern[end] in "[&" else pattern[end])
                    end += 1
            if end >= len(pattern):
                raise ValueError("brackets [] not balanced")
            out.append("".join(inside) + "]")
            at = end + 1
        else:
            out.append(r"\z" if c == "$" else c)
            at += 1
    return "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The ~ operator: a search in which . takes line breaks and ^ $ are the string's ends."""
    return text.rlike(f"(?{'i' if ignore_case else ''}s){java_pattern(pattern)}")
