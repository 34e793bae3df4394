"""Scalar helpers of importers and exporters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_case(name: str) -> str:
    """snake_case to CamelCase."""
    return "".join(part[:1].upper() + part[1:] for part in re.split(r"[_\s]+", name) if part)


def tensor_name(name: str, taken: set[str] | frozenset[str] = frozenset()) -> str:
    """A legal tensor name: dots become underscores, the first letter upper case (or X_ before it), and a
    number is added while the name is taken."""
    fixed = re.sub(r"\W", "_", name)
    fixed = fixed[:1].upper() + fixed[1:]
    if not fixed[:1].isupper():
        fixed = f"X_{fixed}"
    out, k = fixed, 2
    while out in taken:
        out, k = f"{fixed}_{k}", k + 1
    return out


def padded(values: Column, size: int, fill: float = 0) -> Column:
    """The array cut or filled up to size, as polygons with a fixed number of vertices are."""
    return F.slice(F.concat(F.coalesce(values, F.array()), F.array_repeat(F.lit(fill), size)), 1, size)


def points(x: Column, y: Column) -> Column:
    return F.array(x, y)


def layer_sum(*layers: Column) -> Column:
    """The element-wise sum of 16-bit unsigned layers, wrapping around."""
    total = layers[0]
    for layer in layers[1:]:
        total = F.zip_with(total, layer, lambda a, b: a + b)
    return F.transform(total, lambda v: F.pmod(v, F.lit(65536)))


def decoded(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def camel_snake_pairs(names: list[str]) -> dict[str, str]:
    """New names by old, without clashes."""
    taken: set[str] = set()
    out = {}
    for name in names:
        out[name] = tensor_name(camel_case(name), taken)
        taken.add(out[name])
    return out
