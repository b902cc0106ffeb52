"""Column expressions shared by the operators; every one of them stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double percentage, NULL when whole is zero."""
    return F.try_divide(as_col(part).cast("double") * F.lit(100.0), as_col(whole).cast("double"))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def any_present(columns: Sequence[str]) -> Column:
    """True when at least one of the columns has a value."""
    return any_of(F.col(c).isNotNull() for c in columns)


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    """True when one of the words occurs anywhere inside the text."""
    text = as_col(text)
    return text.contains(words[0]) if len(words) == 1 else text.rlike("|".join(re.escape(w) for w in words))


def like_any(text: Column | str, patterns: Sequence[str]) -> Column:
    text = as_col(text)
    return any_of(text.like(p) for p in patterns)


def cases(pairs: Sequence[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """First condition that holds decides; plain strings stand for literals."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    head, *rest = pairs
    out = F.when(head[0], lit(head[1]))
    for condition, value in rest:
        out = out.when(condition, lit(value))
    return out.otherwise(lit(default))


def first_label(text: Column | str, rules: Mapping[str, Sequence[str]], default: Column | str | None) -> Column:
    """Label of the first rule, in declared order, with a keyword inside the text."""
    return cases([(contains_any(text, words), label) for label, words in rules.items()], default)


def all_labels(text: Column | str, rules: Mapping[str, Sequence[str]]) -> Column:
    """Every label with a keyword inside the text, in declared order."""
    return F.array_compact(F.array(*[F.when(contains_any(text, w), F.lit(label)) for label, w in rules.items()]))


def band(value: Column | str, bounds: Sequence[tuple[float, str]], otherwise: str, inclusive: bool = True) -> Column:
    """Label by the first lower bound reached; bounds run from high to low."""
    value = as_col(value)
    reached = (lambda b: value >= F.lit(b)) if inclusive else (lambda b: value > F.lit(b))
    return cases([(reached(b), label) for b, label in bounds], otherwise)


def lookup(key: Column | str, mapping: Mapping[str, str], default: Column | str | None) -> Column:
    """Constant map lookup with a default."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(table, as_col(key)), fallback)


def or_unknown(*columns: Column | str) -> Column:
    """First present value, else the label Unknown."""
    return F.coalesce(*[as_col(c) for c in columns], F.lit("Unknown"))


def qualified(*parts: Column | str) -> Column:
    return F.concat_ws(".", *[as_col(p) for p in parts])


def redact(values: Column | str, keep: int = 3) -> Column:
    """The first few values, each replaced by a marker that shows only its length."""
    return F.transform(
        F.slice(as_col(values), 1, keep),
        lambda v: F.concat(F.lit("<redacted:"), F.length(v).cast("string"), F.lit(">")),
    )


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp read in UTC."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def digest(*keys: Column | str) -> Column:
    """Repeatable pseudo-random text for a row key."""
    return F.md5(F.concat_ws(":", *[as_col(k).cast("string") for k in keys]))


def stacked(names: Sequence[str], *rows: Sequence[Column | str]) -> Column:
    """Generator with one output row per given tuple; plain strings stand for literals."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.inline(F.array(*[F.struct(*[value(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]))
