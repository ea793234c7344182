"""Attributes of a table declared one by one: given values are literals, computed ones are expressions over columns and other attributes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """``value`` is a literal or, if computed, SQL text; ``type`` is a Spark type name, or None to keep what the value gives."""

    name: str
    value: Any = None
    type: str | None = None
    description: str | None = None
    computed: bool = False
    dependencies: tuple[str, ...] = ()


class Kit:
    """An immutable set of attributes by name; a name that is added again replaces the former attribute."""

    def __init__(self, attributes: tuple[Attribute, ...] = ()):
        self.held = {a.name: a for a in attributes}

    def add(self, name: str, value: Any = None, **more) -> "Kit":
        if not name:
            raise ValueError("an attribute needs a name")
        if not more.get("description"):
            more["description"] = f"Attribute {name}"
        more["dependencies"] = tuple(more.get("dependencies") or ()) if more.get("computed") else ()
        return Kit((*(a for a in self.held.values() if a.name != name), Attribute(name, value, **more)))

    def add_from(self, given: dict) -> "Kit":
        """From a mapping with name, value, type, description, computed and dependencies; only the name must be there."""
        return self.add(given.get("name"), given.get("value"), **{k: given[k] for k in ("type", "description", "computed", "dependencies") if k in given})

    def update(self, name: str, value: Any) -> "Kit":
        old = self.get(name)
        return Kit(tuple(replace(a, value=value) if a is old else a for a in self.held.values()))

    def get(self, name: str) -> Attribute:
        if name not in self.held:
            raise KeyError(name)
        return self.held[name]

    def dependencies(self, name: str) -> list[str]:
        return list(self.held[name].dependencies) if name in self.held else []

    def order(self) -> list[str]:
        """Names so that each follows the attributes it depends on, else as added; a circle is refused."""
        out, waiting = [], list(self.held)
        while waiting:
            ready = [n for n in waiting if not set(self.held[n].dependencies) & set(waiting)]
            if not ready:
                raise ValueError(f"circle: {', '.join(sorted(waiting))}")
            out.append(ready[0])
            waiting.remove(ready[0])
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """df with a column for each attribute, its description as the column's comment."""
        for name in self.order():
            a = self.held[name]
            value = F.expr(a.value) if a.computed else F.lit(a.value)
            df = df.withColumn(name, value.cast(a.type) if a.type else value).withMetadata(name, {"comment": a.description})
        return df
