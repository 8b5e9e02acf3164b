"""Attribute masking (M1-M8)."""

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mmspark.functions.hashing import fnv1a32, utf8_view


def xify_front(s: Column) -> Column:
    """Every byte but the blank becomes x."""
    return F.regexp_replace(utf8_view(s), "[^ ]", "x")


def email(s: Column) -> Column:
    """Three groups of four letters from the hash of the value."""

    def part(h: Column) -> Column:
        return F.concat(*(F.chr(F.lit(65) + F.pmod(F.floor(h / F.lit(26**i)), F.lit(26))) for i in range(4)))

    h = fnv1a32(s)
    return F.concat(part(h), F.lit("."), part(F.shiftright(h, 8)), F.lit("@"), part(F.shiftright(h, 16)), F.lit(".invalid"))


def credit_card(s: Column) -> Column:
    """All digits but the last four become x."""
    return F.regexp_replace(s, "[0-9](?=(?:[^0-9]*[0-9]){4})", "x")


def phone(s: Column) -> Column:
    """As credit_card; also other bytes that do not belong to a phone number become x."""
    return F.regexp_replace(utf8_view(credit_card(s)), "[^0-9x() .-]", "x")


class Strategies:
    """Named masks; installing a name again replaces it."""

    def __init__(self):
        self._by_name: dict[str, Callable[[Column], Column]] = {}

    def install(self, name: str, mask: Callable[[Column], Column]) -> None:
        self._by_name[name] = mask

    def find(self, name: str) -> Callable[[Column], Column] | None:
        return self._by_name.get(name)

    def clear(self) -> None:
        self._by_name.clear()

    def names(self) -> list[str]:
        return sorted(self._by_name)


def default_strategies() -> Strategies:
    found = Strategies()
    for name, mask in (("xifyFront", xify_front), ("email", email), ("creditCard", credit_card), ("phone", phone)):
        found.install(name, mask)
    return found


@dataclass(frozen=True)
class Rule:
    path: str
    type: str
    roles: tuple[str, ...] = ()

    def applies_to(self, role: str) -> bool:
        return not self.roles or role in self.roles


@dataclass(frozen=True)
class MaskingConfig:
    collections: dict[str, tuple[Rule, ...]] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> "MaskingConfig":
        given = json.loads(text).get("collections", {})
        return cls({name: tuple(Rule(r["path"], r["type"], tuple(r.get("roles", ()))) for r in c.get("rules", ()) if r.get("path") and r.get("type")) for name, c in given.items()})


def apply_masks(df: DataFrame, config: MaskingConfig, collection: str, role: str, strategies: Strategies | None = None, strict: bool = False) -> DataFrame:
    """Rules of the collection in order; the role is known at plan time, so other columns stay untouched in the plan."""
    strategies = strategies or default_strategies()
    for rule in config.collections.get(collection, ()):
        mask = strategies.find(rule.type)
        if mask is None and strict:
            raise ValueError(f"unknown masking type: {rule.type}")
        if mask is None or not rule.applies_to(role):
            continue
        head, _, tail = rule.path.partition(".")
        if rule.path in df.columns:
            df = df.withColumn(rule.path, mask(F.col(f"`{rule.path}`")))
        elif tail and head in df.columns:
            df = df.withColumn(head, F.col(head).withField(tail, mask(F.col(rule.path))))
    return df
