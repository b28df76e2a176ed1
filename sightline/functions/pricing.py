"""Cost of an answer from its usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import constants as K


def price_of(model: Column, provider: Column, custom: Column | None = None) -> Column:
    """Struct (input_per_mtok, output_per_mtok, per_search): custom, else model, else provider default."""

    def price(values) -> Column:
        names = ("input_per_mtok", "output_per_mtok", "per_search")
        return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(values, names)])

    by_model = F.create_map(*[c for m, v in K.MODEL_PRICES.items() for c in (F.lit(m), price(v))])
    defaults = {p: K.MODEL_PRICES[m] for p, m in K.PROVIDER_DEFAULT_MODEL.items()}
    defaults.update({p: (0, 0, 0) for p in K.FREE_PROVIDERS})
    by_provider = F.create_map(*[c for p, v in defaults.items() for c in (F.lit(p), price(v))])
    choices = [F.try_element_at(by_model, model), F.try_element_at(by_provider, provider)]
    return F.coalesce(*([custom] if custom is not None else []), *choices)


def estimate_cost(price: Column, input_tokens: Column, output_tokens: Column, searches: Column) -> Column:
    zero = F.lit(0)
    return (
        F.coalesce(input_tokens, zero) / F.lit(1e6) * price["input_per_mtok"]
        + F.coalesce(output_tokens, zero) / F.lit(1e6) * price["output_per_mtok"]
        + F.coalesce(searches, zero) * price["per_search"]
    )


def exact_sum(amount: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows."""
    return F.coalesce(F.sum(amount.cast("decimal(20,9)")), F.lit(0)).cast("double")
