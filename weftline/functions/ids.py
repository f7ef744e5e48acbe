"""Deterministic name-based ids."""

from pyspark.sql import Column, functions as F


def det_id(namespace: str, *parts: Column) -> Column:
    """A version-5-shaped id of the namespace and parts; a null part counts as empty."""
    h = F.sha1(F.concat_ws("::", F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    variant = F.substring(F.lit("89ab"), 1 + (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
