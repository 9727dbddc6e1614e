"""Which cleaner a source gets. Cleaners are plain ``Column -> Column``
functions, so a job can register its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.html import clean_html
from textloom.functions.text import clean_plain

Cleaner = Callable[[Column], Column]

CLEANERS: dict[str, Cleaner] = {
    "html": clean_html,
    "plain": clean_plain,
    "none": lambda text: text,
}
# Fixed value: sources whose key starts like this hold HTML.
HTML_KEY_PREFIX = "stackoverflow"


def cleaner_name(source_key: Column) -> Column:
    """Default cleaner of a source, from its key."""
    return F.when(F.startswith(source_key, F.lit(HTML_KEY_PREFIX)), "html").otherwise("plain")


def clean_by_name(text: Column, name: Column, cleaners: dict[str, Cleaner] | None = None) -> Column:
    """Apply to each row the cleaner called ``name``; rows of the other cleaners
    enter as NULL, so a costly cleaner sees only its own rows."""
    result = F.lit(None).cast("string")
    for key, cleaner in (cleaners or CLEANERS).items():
        mine = name == key
        result = F.when(mine, cleaner(F.when(mine, text))).otherwise(result)
    return result
