"""Random draws as column expressions: the same numbers for the same key and seed, wherever a row is computed.

A uniform number is 52 bits of an md5.  Gamma numbers come from rejection (the cube of a shifted normal number is
accepted or not), of which a row makes ``TRIES`` and takes the first that is accepted; beta numbers from two gammas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tries per draw.  Each is accepted with a chance over 0.95, so all fail with one below 1e-15; then the last stands.
TRIES = 12


def uniform(key: Column, *parts: Column | str | int) -> Column:
    """A number between 0 and 1, both excluded."""
    text = F.concat_ws(":", key, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / float(2**52)


def normal(key: Column, *parts: Column | str | int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, "r", *parts))) * F.cos(2 * F.pi() * uniform(key, "a", *parts))


def gamma(shape: Column, key: Column, name: str) -> Column:
    """A draw from the gamma distribution with scale 1; shapes below 1 by way of shape + 1."""
    raised = F.when(shape < 1, shape + 1).otherwise(shape)
    d = raised - 1 / 3.0
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: F.struct(normal(key, name, t).alias("x"), uniform(key, "u", name, t).alias("u"))
    )
    cubes = F.transform(tries, lambda p: F.struct(p["x"].alias("x"), p["u"].alias("u"), F.pow(1 + p["x"] / F.sqrt(9 * d), F.lit(3)).alias("v")))
    good = F.filter(
        cubes, lambda p: (p["v"] > 0) & (F.log(p["u"]) < p["x"] * p["x"] / 2 + d - d * p["v"] + d * F.log(F.greatest(p["v"], F.lit(1e-300))))
    )
    drawn = d * F.abs(F.coalesce(F.get(good, F.lit(0)), F.element_at(cubes, -1))["v"])
    return F.when(shape < 1, drawn * F.pow(uniform(key, "s", name), 1 / shape)).otherwise(drawn)


def beta(a: Column, b: Column, key: Column) -> Column:
    x, y = gamma(a, key, "a"), gamma(b, key, "b")
    return x / (x + y)


def sql_uniform(key: str, *parts: str) -> str:
    text = " || ':' || ".join([key, *parts])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {2**52}.0::DOUBLE)"


def sql_gamma(shape: str, key: str, name: str) -> str:
    """The same draw in SQL, for shapes of 1 or more."""
    t = "CAST(t AS VARCHAR)"
    d = f"({shape} - 1.0::DOUBLE / 3)"
    x = f"(sqrt(-2 * ln({sql_uniform(key, _q('r'), _q(name), t)})) * cos(2 * pi() * {sql_uniform(key, _q('a'), _q(name), t)}))"
    cubes = f"list_transform(list_transform(range(0, {TRIES}), lambda t: [{x}, {sql_uniform(key, _q('u'), _q(name), t)}]), lambda p: [p[1], p[2], (1 + p[1] / sqrt(9 * {d})) ** 3])"
    good = f"list_filter({cubes}, lambda p: p[3] > 0 AND ln(p[2]) < p[1] * p[1] / 2 + {d} - {d} * p[3] + {d} * ln(greatest(p[3], 1e-300::DOUBLE)))"
    return f"({d} * abs(coalesce(({good})[1], ({cubes})[{TRIES}])[3]))"


def sql_beta(a: str, b: str, key: str) -> str:
    x, y = sql_gamma(a, key, "a"), sql_gamma(b, key, "b")
    return f"({x} / ({x} + {y}))"


def _q(text: str) -> str:
    return f"'{text}'"
