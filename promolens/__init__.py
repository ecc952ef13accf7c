"""Campaign, discount and cart analytics as plain Spark DataFrame plans."""

from promolens.params import ReportParams
from promolens.vocabulary import DEFAULT_VOCABULARY, Vocabulary

__all__ = ["DEFAULT_VOCABULARY", "ReportParams", "Vocabulary"]
