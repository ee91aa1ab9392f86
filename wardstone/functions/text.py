"""Text, time and JSON functions that the normalizers and reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(*cols: Column) -> Column:
    """The first that is not null; blanks and zeros count as values."""
    return F.coalesce(*cols)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def whole(c: Column, default: int = 0) -> Column:
    """Integer, or the default where the text isn't one."""
    return F.coalesce(F.expr("try_cast(null as bigint)"), c.try_cast("bigint"), F.lit(default))


def port(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(0, 65535), n).otherwise(0)


def basename(c: Column) -> Column:
    return F.regexp_replace(c, r"^.*[\\/]", "")


def key_values(c: Column) -> Column:
    """map of ``key=value`` pairs; quoted values may hold blanks. Of repeated keys the last counts."""
    pattern = r"""([A-Za-z0-9_.-]+)=(?:"([^"]*)"|'([^']*)'|([^\s"']*))"""
    part = lambda i: F.regexp_extract_all(c, F.lit(pattern), F.lit(i))
    keys = part(1)
    values = F.transform(F.arrays_zip(part(2).alias("a"), part(3).alias("b"), part(4).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"]))
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.element_at(values, i + 1).alias("v"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 2, F.greatest(F.size(keys), F.lit(1))), x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def contains_fold(c: Column, part: str) -> Column:
    return F.lower(c).contains(part.lower())


def milliseconds(c: Column) -> Column:
    return F.date_trunc("millisecond", c)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def duration_seconds(value: str) -> int:
    """Seconds of ``10s``, ``5m`` or ``2h``."""
    if not value[:-1].isdigit() or value[-1:] not in ("s", "m", "h"):
        raise ValueError(f"not a duration: {value!r}")
    return int(value[:-1]) * {"s": 1, "m": 60, "h": 3600}[value[-1]]
