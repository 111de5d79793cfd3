"""Text expressions: trimming, organisation paths, tags, literal patterns, banned words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..schema import ORG_SEPARATOR, TAG_MAX

_SPACE = r"[\s\x{FEFF}]"


def trim_unicode(col: Column) -> Column:
    """Strip Unicode white space and the byte order mark from both ends."""
    return F.regexp_replace(col, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def org_path(col: Column) -> Column:
    """`a > b >> c` becomes `a>b>c`: every level trimmed, empty levels dropped."""
    levels = F.transform(F.split(col, ORG_SEPARATOR), trim_unicode)
    return F.array_join(F.filter(levels, lambda level: level != ""), ORG_SEPARATOR)


def org_prefixes(path: Column) -> Column:
    """The path itself and every organisation above it, topmost first; none for a blank path."""
    levels = F.split(path, ORG_SEPARATOR)
    return F.when(
        path != "",
        F.transform(F.sequence(F.lit(1), F.size(levels)),
                    lambda n: F.array_join(F.slice(levels, F.lit(1), n), ORG_SEPARATOR)),
    ).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text))


def nfkc(col: Column) -> Column:
    """Normalised; ASCII texts, which stay as they are, are not sent to Python."""
    ascii_ = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_, col).otherwise(_nfkc(F.when(~ascii_, col)))


@F.arrow_udf(ArrayType(StringType()))
def _nfkc_each(lists: pa.Array) -> pa.Array:
    values = [None if text is None else unicodedata.normalize("NFKC", text) for text in lists.flatten().to_pylist()]
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.string()), mask=lists.is_null())


def nfkc_each(texts: Column) -> Column:
    """`nfkc` of every text of a list, at one call a list; a list of ASCII texts is not sent to Python."""
    beyond = F.exists(texts, lambda text: F.octet_length(text) != F.char_length(text))
    return F.coalesce(_nfkc_each(F.when(beyond, texts)), texts)


def tag(col: Column) -> Column:
    """Canonical spelling of a short word: NFKC, single spaces, no separators at the ends."""
    return tag_of_normal(nfkc(F.coalesce(col, F.lit(""))))


def tag_of_normal(col: Column) -> Column:
    """`tag` of a text that is normalised already."""
    spaced = F.regexp_replace(col, rf"(?U){_SPACE}+", " ")
    return F.regexp_replace(spaced, r"^[ ·,，;；]+|[ ·,，;；]+$", "")


def fits_tag(col: Column) -> Column:
    return (col != "") & (F.char_length(col) <= TAG_MAX)


def squeeze(col: Column) -> Column:
    """NFKC, lower case, no white space: how gold words are compared."""
    return F.regexp_replace(F.lower(nfkc(col)), rf"(?U){_SPACE}", "")


def literal_pattern(word: str) -> str:
    """Pattern for `word` as written; a Latin letter or digit at an end does not continue into another."""
    lead = r"(?<![a-z0-9])" if re.match(r"[A-Za-z0-9]", word) else ""
    tail = r"(?![a-z0-9])" if re.search(r"[A-Za-z0-9]\Z", word) else ""
    return lead + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", word) + tail


def matches(col: Column, pattern: str) -> Column:
    return col.rlike("(?iu)" + pattern)


def matches_any(col: Column, patterns) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | matches(col, pattern)
    return found


def contains_ci(col: Column, text: str) -> Column:
    """Case-insensitive contains; `%` and `_` in `text` stand for themselves."""
    return F.contains(F.lower(col), F.lower(F.lit(text)))


def starts_ci(col: Column, text: str) -> Column:
    return F.startswith(F.lower(col), F.lower(F.lit(text)))


def name_in(columns, names) -> Column:
    """Any of the columns contains any of the names; a NULL column contains nothing."""
    found = F.lit(False)
    for name in names:
        for col in columns:
            found = found | F.coalesce(contains_ci(col, name), F.lit(False))
    return found


def words_in(col: Column, banned, allowed=()) -> Column:
    """The banned words that occur in the text once the allowed phrases are masked out, in list order."""
    masked = col
    for phrase in allowed:
        masked = F.replace(masked, F.lit(phrase), F.lit(""))
    words = F.array(*[F.lit(word) for word in banned])
    return F.filter(words, lambda word: F.contains(masked, word))


def dots(*parts: Column) -> Column:
    """Join the parts that are present with a middle dot."""
    return F.array_join(F.filter(F.array(*parts), lambda part: part.isNotNull() & (part != "")), " · ")


def text_field(variant: Column, name: str) -> Column:
    """A field of a VARIANT object where it is a text; NULL where it is missing or anything else."""
    value = F.try_variant_get(variant, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, f"$.{name}", "string"))
