"""Text expressions.

A blank input gives NULL.  Everything stays in built-in expressions; only
``strip_accents_exact`` crosses to Python (Arrow batches), for text that holds
characters which decompose into several letters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import METRIC_WORDS

# white space by Unicode, which Java's \s alone does not know, and the separators 1C-1F
SPACES = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.btrim(col(c).cast("string")), F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.nullif(F.btrim(F.regexp_replace(col(c), SPACES, " ")), F.lit(""))


def _folded(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Arguments for ``translate``: letters with a one-character base form, then
    the combining marks, which have no counterpart and are dropped."""
    letters, bases, marks = [], [], []
    for code in range(0x80, 0x30000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        base = _folded(ch)
        if base == "":
            marks.append(ch)
        elif len(base) == 1 and base != ch:
            letters.append(ch)
            bases.append(base)
    return "".join(letters + marks), "".join(bases)


def strip_accents(c: Column | str) -> Column:
    """Base letters without marks, for all letters whose base form is one character."""
    source, target = _fold_table()
    return F.translate(col(c), source, target)


@F.pandas_udf(T.StringType())
def strip_accents_exact(values: pd.Series) -> pd.Series:
    """Full compatibility decomposition, including ligatures and fractions."""
    return values.map(_folded, na_action="ignore")


def fold(c: Column | str) -> Column:
    """Lower case, no accents, single spaces: the form in which names compare."""
    return strip_accents(F.lower(clean_text(c)))


def slugify(c: Column | str) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def identity_key(c: Column | str) -> Column:
    """Letters and digits only, so that spacing, case and accents do not matter.

    White space goes with all other characters, so it is not made single first.
    """
    return F.nullif(F.regexp_replace(strip_accents(F.lower(col(c))), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def norm_name(c: Column | str) -> Column:
    """A name as words: starter mark dropped, punctuation turned into spaces."""
    words = F.regexp_replace(fold(F.replace(col(c), F.lit("(T)"), F.lit(""))), "[^a-z0-9]+", " ")
    return F.nullif(F.btrim(words), F.lit(""))


def title_from_slug(c: Column | str) -> Column:
    """Hyphens to spaces; each run of letters starts with a capital."""
    runs = F.regexp_extract_all(F.replace(col(c), F.lit("-"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return clean_text(F.array_join(F.transform(runs, F.initcap), ""))


def url_path(c: Column | str) -> Column:
    """Path of a URL by the generic syntax; tolerates characters a strict parser rejects."""
    path = F.regexp_extract(col(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def url_unquote(c: Column | str) -> Column:
    """Percent-decoding in which a plus stays a plus; undecodable text is kept."""
    c = col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def image_key(c: Column | str) -> Column:
    """File name of an image without the size suffix that thumbnails carry."""
    name = F.lower(F.element_at(F.split(url_unquote(url_path(c)), "/"), -1))
    return F.nullif(F.regexp_replace(name, r"-\d+x\d+(?=\.[a-z0-9]+$)", ""), F.lit(""))


def segment_after(c: Column | str, folder: str) -> Column:
    """The decoded path segment that follows ``folder``."""
    found = F.regexp_extract(url_path(c), rf"(?:^|/){folder}/([^/]+)", 1)
    return F.nullif(url_unquote(found), F.lit(""))


def team_slug_from_url(c: Column | str) -> Column:
    return segment_after(c, "equipes")


def player_slug_from_url(c: Column | str) -> Column:
    return slugify(segment_after(c, "atletas"))


def abs_url(c: Column | str, base: str) -> Column:
    """Join a link to the site's base address."""
    c, base = blank_to_null(c), base.rstrip("/")
    scheme = base.split("//", 1)[0]
    return (
        F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), c)
        .when(c.startswith("//"), F.concat(F.lit(scheme), c))
        .when(c.rlike("^[/?#]"), F.concat(F.lit(base), c))
        .otherwise(F.concat(F.lit(base + "/"), c))
    )


def season_path(c: Column | str) -> Column:
    """``2009-10`` -> ``2009-2010``; two digits are read in the start's century."""
    c = clean_text(c)
    start = F.split_part(c, F.lit("-"), F.lit(1)).try_cast("bigint")
    end_text = F.regexp_extract(c, "^[^-]*-(.*)$", 1)
    end = end_text.try_cast("bigint")
    two_digit = F.floor(start / 100).cast("bigint") * 100 + end
    full = F.when(
        F.length(end_text) == 2,
        F.when(two_digit < start, two_digit + 100).otherwise(two_digit),
    ).otherwise(end)
    return F.when(
        c.contains("-"), F.concat(start.cast("string"), F.lit("-"), full.cast("string"))
    ).otherwise(c)


def season_label(season_id: Column | str, first_year: int = 2008) -> Column:
    """Season 1 starts in ``first_year``; the label is ``YYYY-YY``."""
    start = col(season_id).cast("bigint") + F.lit(first_year - 1)
    return F.concat(
        start.cast("string"), F.lit("-"), F.substring((start + 1).cast("string"), 3, 2)
    )


def iso_date(c: Column | str) -> Column:
    """``D/M/YYYY`` -> ``YYYY-MM-DD``; any other text stays as it is."""
    c = clean_text(c)
    parts = F.split(c, "/")

    def two(i: int) -> Column:
        part = F.element_at(parts, i)
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    return F.when(
        F.size(parts) == 3,
        F.concat(F.element_at(parts, 3), F.lit("-"), two(2), F.lit("-"), two(1)),
    ).otherwise(c)


def parse_jersey(c: Column | str) -> Column:
    """The number behind ``#``."""
    return F.nullif(F.regexp_extract(clean_text(c), r"#\s*(\d+)", 1), F.lit(""))


def name_and_jersey(c: Column | str) -> Column:
    """``Name #4`` -> struct(name, jersey_number)."""
    c = clean_text(c)
    jersey = F.nullif(F.regexp_extract(c, r"#\s*(\d+)\s*$", 1), F.lit(""))
    name = F.when(jersey.isNull(), c).otherwise(clean_text(F.regexp_replace(c, r"#\s*\d+\s*$", "")))
    return F.struct(name.alias("name"), jersey.alias("jersey_number"))


def starter_flag(c: Column | str) -> Column:
    """struct(name without the starter mark, 0/1)."""
    c = clean_text(c)
    return F.struct(
        clean_text(F.replace(c, F.lit("(T)"), F.lit(""))).alias("name"),
        c.contains("(T)").cast("int").alias("is_starter"),
    )


def abbr(c: Column | str) -> Column:
    """First word in capitals, else the text without spaces."""
    c = clean_text(c)
    capitals = F.filter(
        F.split(c, " "), lambda w: (w == F.upper(w)) & (w != F.lower(w))
    )
    return F.coalesce(F.get(capitals, F.lit(0)), F.replace(c, F.lit(" "), F.lit("")))


def metric_words() -> list[tuple[str, str]]:
    """(word, metric), longest word first."""
    pairs = [(word, metric) for metric, words in METRIC_WORDS.items() for word in words]
    return sorted(pairs, key=lambda p: -len(p[0]))


def metric_from_text(c: Column | str) -> Column:
    """The metric named by a text: the longest listed word found as a whole word.

    All listed words are found in one pass; the one that ranks first decides.
    """
    ranked = metric_words()
    words = "|".join(word for word, _ in ranked)
    found = F.regexp_extract_all(
        fold(c), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({words})(?![\p{{L}}\p{{N}}_])"), F.lit(1)
    )
    rank = F.create_map(*[F.lit(x) for i, (word, _) in enumerate(ranked) for x in (word, i)])
    best = F.array_min(F.transform(found, lambda w: rank[w]))
    return F.get(F.array(*[F.lit(metric) for _, metric in ranked]), best)
