"""Answer normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.functions.columns import col

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def remove_articles(x) -> Column:
    """English articles standing alone become spaces."""
    return F.regexp_replace(col(x), r"(?U)\b(a|an|the)\b", " ")


def fix_spaces(x) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def remove_punctuation(x) -> Column:
    return F.translate(col(x), PUNCTUATION, "")


def normalise_answer(x) -> Column:
    return fix_spaces(remove_articles(remove_punctuation(F.lower(col(x)))))


def capitals(x) -> Column:
    """The text in capitals, letter by letter; letters that lower-casing doesn't give back stay (as ß, whose capitals are
    SS), so that the text differs from what it was in case alone."""
    # with a blank behind, as the optimizer takes lower(upper(c)) for lower(c)
    comes_back = lambda c: F.lower(F.concat(F.upper(c), F.lit(" "))) == F.concat(F.lower(c), F.lit(" "))
    return F.array_join(F.transform(F.split(col(x), ""), lambda c: F.when(comes_back(c), F.upper(c)).otherwise(c)), "")
