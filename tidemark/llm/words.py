"""Native word splitting: the words of a text as a Spark column."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: every ASCII character that is neither a digit nor a lower-case letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept. All-ASCII values take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


#: What separates words before A-Z are lower-cased.
_CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cased_words(text: Column) -> Column:
    """The words of ``text`` as they are written; ``ascii_lower`` of each is ``word_array``'s."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _CASED_SEPARATORS), "")


def once(value: Column) -> Column:
    """``value``, computed where it is selected: other expressions are put off, so that below an explode
    they are computed for each exploded row."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def word_array(text: Column) -> Column:
    """The words of ``text``, in order; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")
