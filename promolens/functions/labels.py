from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.vocabulary import DEFAULT_VOCABULARY, DiscountRule, Vocabulary


def _first_match(branches: list[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first true branch, else ``default``."""
    return reduce(lambda rest, branch: F.when(branch[0], branch[1]).otherwise(rest),
                  reversed(branches), default)


def _lookup(key: Column, table: tuple[tuple[str, str], ...], default: Column) -> Column:
    labels: dict[str, list[str]] = {}
    for value, label in table:
        labels.setdefault(label, []).append(value)
    return _first_match([(key.isin(values), F.lit(label)) for label, values in labels.items()],
                        default)


def segment_label(tier: Column, overridden: Column | None = None,
                  vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Customer segment of a tier; an overridden customer gets the override label."""
    label = _lookup(tier, vocab.tier_segments, F.lit(vocab.unclassified))
    if overridden is None:
        return label
    return F.when(overridden, F.lit(vocab.override_segment)).otherwise(label)


def tier_group(tier: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    return _lookup(tier, vocab.tier_groups, F.lit(vocab.unclassified))


def pack_part(pack_id: Column, index: int) -> Column:
    """``index``-th ``_`` part of a pack id, NULL when the id has fewer parts."""
    return F.get(F.split(pack_id, "_"), F.lit(index))


def pack_mode(pack_id: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Mode label of a pack id; unknown modes pass through."""
    part = pack_part(pack_id, 1)
    return _lookup(part, vocab.pack_modes, part)


def slot_of(hour: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Day-part of an hour; a missing hour falls in the last day-part."""
    return _first_match([(hour.between(first, last), F.lit(label))
                         for label, first, last in vocab.slots], F.lit(vocab.other_slot))


def cart_value_bucket(value: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Value bucket; a shared bound belongs to the lower bucket, negatives to none."""
    branches = [(value.between(low, high), F.lit(label))
                for label, low, high in vocab.cart_buckets]
    last_bound = vocab.cart_buckets[-1][2]
    return _first_match(branches, F.when(value > last_bound, F.lit(vocab.over_bucket)))


def offer_discount_type(offer_type: Column, applied: Column, discount_type: Column,
                        benefit_type: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Discount label of an offer line: the first matching rule wins."""

    def matches(rule: DiscountRule) -> Column:
        test = offer_type == rule.offer_type
        if rule.applied is not None:
            test &= applied.isin(*rule.applied)
        if rule.discount_type is not None:
            test &= discount_type == rule.discount_type
        if rule.benefit_type is not None:
            test &= benefit_type == rule.benefit_type
        return test

    return _first_match([(matches(rule), F.lit(rule.label)) for rule in vocab.discount_rules],
                        F.lit(vocab.other_discount))
