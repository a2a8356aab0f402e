"""Key extraction from route strings.

``winner`` and ``attempts[].provider`` are either ``model@provider`` or a bare
provider name. Two rules read a provider out of them and they differ on
``a@b@c``: the winner rule takes the *second* ``@`` part (``b``), the attempt
rule the text after the *last* ``@`` (``c``). Both are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed labels the queries report for missing values.
FAILED = "(failed)"
UNKNOWN = "(unknown)"


def provider_key(winner: Column) -> Column:
    """Who served. Null winner (every attempt failed) is ``(failed)``."""
    return (F.when(winner.contains("@"), F.split_part(winner, F.lit("@"), F.lit(2)))
             .otherwise(F.coalesce(winner, F.lit(FAILED))))


def model_key(winner: Column, model: Column) -> Column:
    """What ran. Falls back to the requested model, skipping blanks."""
    return (F.when(winner.contains("@"), F.split_part(winner, F.lit("@"), F.lit(1)))
             .otherwise(F.coalesce(F.nullif(model, F.lit("")), winner, F.lit(FAILED))))


def attempt_provider(provider: Column) -> Column:
    """Provider of one attempt, the text after the last ``@``."""
    return F.substring_index(F.coalesce(provider, F.lit(UNKNOWN)), "@", -1)


def route_label(model: Column, provider: Column) -> Column:
    """``model@provider`` row key of a (model, provider) pair."""
    return F.concat_ws("@", model, provider)
