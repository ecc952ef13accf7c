"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One run of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Key of a row in folds: the remainder of crc32 over the id written as text.
FOLDS = 5


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def fold(key: str = "doc_id") -> Column:
    """0 to 4; a null id is in fold 0 as an empty text would be."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978
                + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with only the columns that are not named."""
    return df.select([F.col(f"`{c}`") for c in df.columns if c not in names])


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` for tables that may have columns named like its own, which begin with ``_``.

    Such columns have other names while it works and their own in its result; arguments that
    name one follow. A column named ``into`` is left to the operator, which replaces it.
    """
    shape = signature(operator)

    @wraps(operator)
    def safe(*args, **kwargs) -> DataFrame:
        given = shape.bind(*args, **kwargs)
        given.apply_defaults()
        first = next(iter(shape.parameters))
        docs, into = given.arguments[first], given.arguments["into"]
        clashing = [c for c in docs.columns if c.startswith("_") and c != into]
        if not clashing:
            return operator(*args, **kwargs)
        prefix = "own"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "x"
        away = {c: f"{prefix}{i}" for i, c in enumerate(clashing)}
        back = {new: c for c, new in away.items()}
        for name in ("key", "text", "stratum"):
            if name in given.arguments:
                given.arguments[name] = away.get(given.arguments[name], given.arguments[name])
        given.arguments[first] = docs.select(
            [F.col(f"`{c}`").alias(away.get(c, c)) for c in docs.columns])
        found = operator(*given.args, **given.kwargs)
        return found.select([F.col(f"`{c}`").alias(back.get(c, c)) for c in found.columns])

    return safe
