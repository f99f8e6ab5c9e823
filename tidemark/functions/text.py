"""Token and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Small word lists of the caption rules.
FILLERS = ("um", "uh", "hmm", "mm", "erm", "uh-huh", "umm", "uhh")
I_FORMS = ("i", "i'm", "i've", "i'll", "i'd")


def norm(t: Column) -> Column:
    """Lower case, word characters, apostrophes and spaces only."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)[^\w' ]", ""))


def norm_token(raw: Column) -> Column:
    """Caption form of a spoken token: plain apostrophes, word characters and - $ / % ', and a capital I in its forms."""
    t = F.regexp_replace(raw, "[’‘]", "'")
    t = F.lower(F.regexp_replace(t, r"(?U)[^\w'\-$/%]", ""))
    return F.when(t.isin(*I_FORMS), F.concat(F.lit("I"), F.substring(t, 2, 100))).otherwise(t)


def is_question(raw: Column) -> Column:
    return F.rtrim(raw).endswith("?")


def natural_key(name: Column) -> Column:
    """Sort key under which runs of digits compare as numbers: each is written as its length and its digits."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    one = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(r)).cast("string"), 4, "0"), digits(r))).otherwise(F.concat(F.lit("1"), r))
    return F.transform(runs, one)


def batch_date(name: Column, order: str = "DMY") -> Column:
    """Date of a folder name: Y-M-D first, else D M Y (or M D Y) with : / . _ - between; two-digit years are 20xx."""
    iso, other = r"^\s*(\d{4})[-:/._](\d{1,2})[-:/._](\d{1,2})(?!\d)", r"^\s*(\d{1,2})[-:/._](\d{1,2})[-:/._](\d{4}|\d{2})(?!\d)"
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    first, second = (1, 2) if order.upper().startswith("D") else (2, 1)
    year = F.when(F.length(part(other, 3)) == 2, F.concat(F.lit("20"), part(other, 3))).otherwise(part(other, 3))
    text = F.when(name.rlike(iso), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))).when(name.rlike(other), F.concat_ws("-", year, part(other, second), part(other, first)))
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def title_key(name: Column) -> Column:
    """Name without extension and `(instrumental...)`, spaces squeezed, lower case."""
    t = F.regexp_replace(F.lower(name), r"\.[a-z0-9]{1,4}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\(?\binstrumental\b[^)]*\)?", " "), r"\s+", " "))


def is_instrumental(name: Column) -> Column:
    return F.lower(name).contains("instrumental")
