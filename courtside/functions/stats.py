"""Number expressions: cells of a statistics table, lenient casts, ratios.

Ratios keep full precision; only ``format_cell`` rounds, for display.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TRUE_WORDS
from .text import SPACES, clean_text, col

NUMBER = r"-?\d+(?:\.\d+)?"


def _spaced(c: Column, tidied: bool) -> Column:
    """Single spaces, trimmed; ``tidied`` says that the text is so already."""
    return c if tidied else F.btrim(F.regexp_replace(c, SPACES, " "))


def _tidy(c: Column | str, tidied: bool = False) -> Column:
    """Single spaces, trimmed, commas as points; a blank cell stays an empty text.

    As there is no condition in it, an expression that uses it several times computes it once.
    """
    return F.replace(_spaced(col(c).cast("string"), tidied), F.lit(","), F.lit("."))


def _decimal_point(c: Column | str) -> Column:
    return F.nullif(_tidy(c), F.lit(""))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; NULL without one, as casting an empty text raises and catches an error per row."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def parse_number(c: Column | str, tidied: bool = False) -> Column:
    """First signed number in a cell; a comma is a decimal point."""
    return _found(_tidy(c, tidied), NUMBER).try_cast("double")


def _made_attempted(text: Column) -> Column:
    """A tidy text and the shots in it; the match is found once, its marks part the numbers."""
    match = F.when(text.contains("/"), _found(text, rf"{NUMBER}\s*/\s*{NUMBER}\s*\({NUMBER}\)"))
    return F.struct(text.alias("text"), match.alias("match"))


def _shots(found: Column) -> Column:
    match = found["match"]
    rest = F.substring_index(match, "/", -1)
    return F.struct(
        F.coalesce(F.substring_index(match, "/", 1).try_cast("double"), _found(found["text"], NUMBER).try_cast("double")).alias("made"),
        F.substring_index(rest, "(", 1).try_cast("double").alias("attempted"),
        F.substring_index(F.substring_index(rest, "(", -1), ")", 1).try_cast("double").alias("pct"),
    )


def parse_made_attempted(c: Column | str) -> Column:
    """``12/26 (46.2)`` -> struct(12, 26, 46.2); a lone number is the made count."""
    return _shots(_made_attempted(_tidy(c)))


def parse_all_made_attempted(c: Column | str) -> Column:
    """As ``parse_made_attempted`` for an array of cells whose white space is single already."""
    return F.transform(F.transform(col(c), lambda cell: _made_attempted(_tidy(cell, True))), _shots)


def parse_rebounds(c: Column | str, tidied: bool = False) -> Column:
    """``7+30 37`` -> struct(7, 30, 37); a lone number is the total."""
    text = _spaced(col(c), tidied)
    match = F.when(text.contains("+"), _found(text, r"-?\d+\s*\+\s*-?\d+\s+-?\d+"))
    rest = F.btrim(F.substring_index(match, "+", -1))
    return F.struct(
        F.substring_index(match, "+", 1).try_cast("bigint").alias("offensive"),
        F.substring_index(rest, " ", 1).try_cast("bigint").alias("defensive"),
        F.coalesce(F.substring_index(rest, " ", -1).try_cast("bigint"), _found(text, r"-?\d+").try_cast("bigint")).alias("total"),
    )


def minutes_decimal(c: Column | str, tidied: bool = False) -> Column:
    """``36:54`` -> 36.9; a plain number is taken as minutes."""
    text = _tidy(c, tidied)
    minutes, seconds = (_found(text, "^([^:]*):(.*)$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(minutes + seconds / F.lit(60.0), _found(text, "^[^:]+$").try_cast("double"))


def to_float(c: Column | str) -> Column:
    """Lenient: blank or unreadable counts as 0."""
    return F.coalesce(_decimal_point(c).try_cast("double"), F.lit(0.0))


def to_int(c: Column | str) -> Column:
    return F.coalesce(to_int_or_null(c), F.lit(0).cast("bigint"))


def to_int_or_null(c: Column | str) -> Column:
    """Truncates towards zero; unreadable text is NULL."""
    return _decimal_point(c).try_cast("double").try_cast("bigint")


def to_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(clean_text(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def game_pct(made: Column | str, attempted: Column | str) -> Column:
    """Percentage 0-100 of one game; no attempts give 0, a missing count NULL."""
    made, attempted = col(made), col(attempted)
    return F.when(attempted == 0, F.when(made.isNotNull(), F.lit(0.0))).otherwise(
        100.0 * made / F.nullif(attempted, F.lit(0))
    )


def field_goals(two_made, three_made, two_att, three_att, points_pct=None) -> Column:
    """struct(made, attempted, pct): two- and three-point shots together; when the
    percentage cannot be computed the one printed with the points is used."""
    zero = F.lit(0)
    made = F.coalesce(col(two_made), zero) + F.coalesce(col(three_made), zero)
    attempted = F.coalesce(col(two_att), zero) + F.coalesce(col(three_att), zero)
    pct = game_pct(made, attempted)
    if points_pct is not None:
        pct = F.coalesce(pct, col(points_pct))
    return F.struct(
        made.cast("bigint").alias("made"), attempted.cast("bigint").alias("attempted"), pct.alias("pct")
    )


def season_pct(made: Column | str, attempted: Column | str) -> Column:
    """Ratio 0-1 over a season; NULL without attempts."""
    made, attempted = col(made), col(attempted)
    return F.when(attempted > 0, made / attempted)


def per_game(total: Column | str, games: Column | str) -> Column:
    total, games = col(total), col(games)
    return F.when(games > 0, total / games).otherwise(F.lit(0.0))


def win_pct(wins: Column | str, games: Column | str) -> Column:
    wins, games = col(wins), col(games)
    return F.when(games > 0, 100.0 * wins / games).otherwise(F.lit(0.0))


def record_text(wins: Column | str, losses: Column | str) -> Column:
    return F.concat(col(wins).cast("string"), F.lit("-"), col(losses).cast("string"))


def height_weight(c: Column | str) -> Column:
    """``1.91 / 100kg`` -> struct(191, 100.0); a height below 3 is in metres."""
    text = _decimal_point(c)
    height = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    weight = F.regexp_extract(text, r"(?i)/?\s*(\d+(?:\.\d+)?)\s*kg", 1).try_cast("double")
    cm = F.bround(F.when(height < 3, height * 100).otherwise(height)).cast("bigint")
    return F.struct(cm.alias("height_cm"), weight.alias("weight_kg"))


def age(birth: Column | str, reference: Column | str) -> Column:
    """Completed years on the reference date."""
    birth, ref = col(birth).cast("date"), col(reference).cast("date")
    had_birthday = (F.month(ref) * 100 + F.dayofmonth(ref)) >= (
        F.month(birth) * 100 + F.dayofmonth(birth)
    )
    return (F.year(ref) - F.year(birth) - F.when(had_birthday, 0).otherwise(1)).cast("bigint")


def format_cell(c: Column | str, kind: str) -> Column:
    """Display text of a cell; ``kind`` is date, pct, number, bool or text."""
    c = col(c)
    if kind == "date":
        shown = F.date_format(c.cast("date"), "dd/MM/yyyy")
    elif kind == "pct":
        shown = F.concat(
            F.format_string("%.1f", F.when((c <= 1) & (c > 0), c * 100).otherwise(c).cast("double")),
            F.lit("%"),
        )
    elif kind == "number":
        value = c.cast("double")
        shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
            F.format_string("%.1f", value)
        )
    elif kind == "bool":
        shown = F.when(c.cast("boolean"), F.lit("Sim")).otherwise(F.lit("Não"))
        shown = F.when(c.isNotNull(), shown)
    elif kind == "text":
        shown = F.nullif(c.cast("string"), F.lit(""))
    else:
        raise ValueError(f"unknown cell kind: {kind}")
    return F.coalesce(F.when(c.isNotNull(), shown), F.lit("-"))


def display_name(*names: Column | str) -> Column:
    """The first name that is not blank."""
    return F.coalesce(*[clean_text(n) for n in names])
