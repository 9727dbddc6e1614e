"""HTML to text: entities, then tags, then white space.

References are resolved inside the JVM, in one pass: a text is cut at its references, each is looked up, and the pieces are put
together. The names are those of Python's ``html.entities``, a sorted literal that is searched by bisection.
"""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import collapse_spaces, strip_tags

#: What counts as a reference: a number, or up to 32 characters that could be a name.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NAMES = sorted(html5)
#: Names that count without a semicolon, also at the front of other text; the longest comes first.
_OPEN_NAMES = sorted((name for name in _NAMES if not name.endswith(";")), key=lambda name: (-len(name), name))
_MOST_DIGITS = 7  # more are beyond the last code point


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _named(name: Column) -> Column:
    """The text of a name, as it is or from its longest front part that is one; otherwise the reference itself."""
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(len(_NAMES).bit_length()))])
    names = _strings(_NAMES)
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(names, at + step - 1) <= name, at + step).otherwise(at))
    front = F.regexp_extract(name, "^(?:" + "|".join(_OPEN_NAMES) + ")", 0)
    exact = F.get(_strings([n + "\n" + html5[n] for n in _NAMES]), at - 1)
    open_texts = F.element_at(F.from_json(F.lit(json.dumps({n: html5[n] for n in _OPEN_NAMES})), "map<string,string>"), front)
    return F.when(F.startswith(exact, F.concat(name, F.lit("\n"))), F.substring(exact, F.length(name) + 2, F.length(exact))).when(
        front != "", F.concat(open_texts, F.substring(name, F.length(front) + 1, F.length(name)))).otherwise(F.concat(F.lit("&"), name))


def _numbered(number: Column) -> Column:
    """The text of a code point: replaced below 256 as browsers do, nothing for non-characters, U+FFFD where there is none."""
    low = _strings([html.unescape(f"&#{n};") for n in range(256)])
    nothing = (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE) | number.between(0xFDD0, 0xFDEF)
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number < 256, F.get(low, number.cast("int"))).when(
        (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(nothing, F.lit("")).otherwise(character)


def _resolved(reference: Column) -> Column:
    body = F.substring(reference, F.lit(2), F.length(reference))
    digits = lambda front: F.regexp_replace(body, f"^{front}0*|;$", "")
    decimal, hexadecimal = digits("#"), digits("#[xX]")

    def number(text: Column, base: int) -> Column:
        value = F.conv(F.when(text == "", F.lit("0")).otherwise(text), base, 10).cast("bigint")
        return F.when(F.length(text) > _MOST_DIGITS, F.lit("\ufffd")).otherwise(_numbered(value))

    return (F.when(body.rlike("^#[xX]"), number(hexadecimal, 16)).when(F.startswith(body, F.lit("#")), number(decimal, 10))
            .otherwise(_named(body)))


def unescape(text: Column) -> Column:
    """Resolve HTML5 character references, exactly one pass, as ``html.unescape`` does. A number with more
    digits than any code point has is U+FFFD."""
    between = F.split(text, REFERENCE, -1)
    resolved = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _resolved)
    whole = F.array_join(F.zip_with(between, resolved, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def clean_html(text: Column) -> Column:
    """HTML cleaner: unescape, drop tags, collapse white space, trim."""
    return F.trim(collapse_spaces(strip_tags(unescape(text))))
