"""Column functions that any SQL engine can repeat exactly: a counter-based random generator, and complex numbers as pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of the generator, a prime; x ** 5 permutes its residues.
P = 2147483647


def _fifth(r: Column) -> Column:
    square = r * r % P
    return square * square % P * r % P


def random_int(seed, step, k) -> Column:
    """A number of 0 to P - 1, a function of three whole numbers below 2 ** 31."""
    as_column = lambda x: x.cast("long") if isinstance(x, Column) else F.lit(int(x)).cast("long")
    r = (as_column(seed) * 48271 + as_column(step) * 69621 + as_column(k) * 16807 + 12345) % P
    return _fifth((_fifth(r) * 48271 + 11) % P)


def random_unit(seed, step, k) -> Column:
    """The same between 0 and 1."""
    return random_int(seed, step, k).cast("double") / F.lit(float(P))


def random_int_sql(seed: str, step: str, k: str) -> str:
    """random_int() as SQL text."""
    five = lambda r: f"(((({r})*({r})%{P})*(({r})*({r})%{P}))%{P}*({r})%{P})"
    r = f"((CAST({seed} AS BIGINT)*48271+CAST({step} AS BIGINT)*69621+CAST({k} AS BIGINT)*16807+12345)%{P})"
    return f"(SELECT {five('b')} FROM (SELECT ({five('a')}*48271+11)%{P} AS b FROM (SELECT {r} AS a)))"


def cmul(a: Column, b: Column) -> Column:
    """Product of complex numbers, structs of re and im."""
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def cdiv(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return F.struct(((a["re"] * b["re"] + a["im"] * b["im"]) / size).alias("re"), ((a["im"] * b["re"] - a["re"] * b["im"]) / size).alias("im"))


def pair(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)
