"""Rule-based tagging (X1-X9): each rule maps a document row to an array of
tags with built-in expressions; a script is a list of rules whose arrays are
concatenated and exploded into (id, tag) rows.  No per-row Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[], Column]

YEAR_PATTERN = r"[\(\.+](20[0-9]{2})[\)\.+]"  # fixed value
CODE_PATTERN = r"([A-Z]{4})-[0-9]{3} (.*)"  # fixed value
EXIF_DATE_FORMAT = "yyyy:MM:dd HH:mm:ss"  # fixed value
# The tag texts that the rules below write ("genre.", "year.", "author.",
# "studio.", "actress.", "Aperture.f/", "Year.", "Month.") are fixed values.



def _empty() -> Column:
    return F.array().cast("array<string>")


def _when(cond: Column, tags: Column) -> Column:
    return F.when(cond, tags).otherwise(_empty())


def tag_genre(col: str = "genre") -> Column:
    """Genre.<lower genre> when the field is present."""
    return _when(F.col(col).isNotNull(), F.array(F.concat(F.lit("genre."), F.lower(F.col(col)))))


def tag_year(col: str = "name") -> Column:
    """X3: '(20XX)' or '.20XX.' in the name -> year.<y>."""
    y = F.regexp_extract(F.col(col), YEAR_PATTERN, 1)
    return _when(F.col(col).isNotNull() & (y != ""), F.array(F.concat(F.lit("year."), y)))


def tag_author(name: str = "name", ext: str = "extension") -> Column:
    """X4: 'Title - Author' PDF name -> author.<second dash-separated part, trimmed>."""
    second = F.trim(F.try_element_at(F.split(F.col(name), "-"), F.lit(2)))
    return _when(F.col(name).contains("-") & (F.col(ext) == "pdf") & second.isNotNull(),
                 F.array(F.concat(F.lit("author."), second)))


def tag_code_and_names(col: str = "name") -> Column:
    """X5: 'AAAA-000 n1,n2' -> studio.AAAA plus actress.<n> per listed name."""
    code = F.regexp_extract(F.col(col), CODE_PATTERN, 1)
    names = F.regexp_extract(F.col(col), CODE_PATTERN, 2)
    tags = F.concat(F.array(F.concat(F.lit("studio."), code)),
                    F.transform(F.split(names, ","), lambda n: F.concat(F.lit("actress."), n)))
    return _when(F.col(col).rlike(CODE_PATTERN), tags)


def tag_last_folder(col: str = "path") -> Column:
    """Last directory segment -> studio.<segment>."""
    return _when(F.col(col) != "", F.array(F.concat(F.lit("studio."), F.substring_index(F.col(col), "/", -1))))


def tag_aperture(col: str = "exif_fnumber") -> Column:
    """Rational 'n d' -> Aperture.f/<n/d as float text, ',' for '.'>; NaN -> 0,0."""
    parts = F.split(F.col(col), " ")
    q = F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("float"),
                     F.try_element_at(parts, F.lit(2)).try_cast("float")).cast("float")
    text = F.when(F.isnan(q) | q.isNull(), F.lit("0,0")).otherwise(F.replace(q.cast("string"), F.lit("."), F.lit(",")))
    return _when(F.col(col).isNotNull(), F.array(F.concat(F.lit("Aperture.f/"), text)))


def tag_year_month(col: str = "exif_datetime") -> Column:
    """EXIF date text -> Month.<full month name>, Year.<yyyy>."""
    ts = F.try_to_timestamp(F.col(col), F.lit(EXIF_DATE_FORMAT))
    return _when(ts.isNotNull(), F.array(F.concat(F.lit("Month."), F.date_format(ts, "MMMM")),
                                         F.concat(F.lit("Year."), F.date_format(ts, "yyyy"))))


def tag_constant(tag: str) -> Column:
    """The same tag on every document."""
    return F.array(F.lit(tag))


# Registered scripts: name -> rule factories.
SCRIPTS: dict[str, list[Rule]] = {
    "genre": [tag_genre],
    "year": [tag_year],
    "author": [tag_author],
    "code_names": [lambda: tag_code_and_names("code_name")],
    "last_folder": [tag_last_folder],
    "aperture": [tag_aperture],
    "year_month": [tag_year_month],
}


def apply_script(df: DataFrame, rules: list[Rule] | str, id_col: str = "id") -> DataFrame:
    """Run a script (list of rules, or a registered name) and rebuild the
    tag rows of each document from the record: (id, tag), duplicates removed."""
    if isinstance(rules, str):
        rules = SCRIPTS[rules]
    arrays = [r() for r in rules]
    tags = F.array_distinct(F.concat(*arrays)) if len(arrays) > 1 else F.array_distinct(arrays[0])
    return df.select(F.col(id_col).alias("id"), F.explode(tags).alias("tag"))
