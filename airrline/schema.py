"""Receptor schemas and sequence-matching options."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

METHODS = ("exact", "lev", "hamm", "regex")
NAME_TYPES = ("index", "pattern")


@dataclass(frozen=True)
class ReceptorSchema:
    """The columns that define a receptor, and the loci it is made of (none, one, or a pair)."""

    features: tuple[str, ...]
    chains: tuple[str, ...] = ()


def make_receptor_schema(features: str | Iterable[str], chains: str | Iterable[str] | None = None) -> ReceptorSchema:
    f = (features,) if isinstance(features, str) else tuple(features)
    ch = () if chains is None else (chains,) if isinstance(chains, str) else tuple(chains)
    if not f or not all(isinstance(x, str) and x for x in f):
        raise ValueError("features: at least one column name is needed")
    if len(set(f)) < len(f):
        raise ValueError("features: names repeat")
    if not all(isinstance(x, str) and x for x in ch):
        raise ValueError("chains: locus names must be strings")
    return ReceptorSchema(f, ch)


def as_receptor_schema(schema) -> ReceptorSchema:
    """A schema from a schema, a name, a list of names, or a mapping with ``features`` and ``chains``."""
    if isinstance(schema, ReceptorSchema):
        return schema
    if isinstance(schema, Mapping):
        if set(schema) != {"features", "chains"}:
            raise ValueError("a receptor schema has exactly `features` and `chains`")
        return make_receptor_schema(schema["features"], schema["chains"] or None)
    return make_receptor_schema(schema)


def assert_receptor_schema(schema) -> ReceptorSchema:
    try:
        return as_receptor_schema(schema)
    except (TypeError, KeyError) as e:
        raise ValueError(f"not a receptor schema: {schema!r}") from e


def test_receptor_schema(schema) -> bool:
    try:
        assert_receptor_schema(schema)
    except ValueError:
        return False
    return True


test_receptor_schema.__test__ = False  # not a test, whatever its name


def imd_receptor_features(schema: ReceptorSchema) -> tuple[str, ...]:
    return schema.features


def imd_receptor_chains(schema: ReceptorSchema) -> tuple[str, ...]:
    return schema.chains


@dataclass(frozen=True)
class SeqOptions:
    query_col: str
    patterns: tuple[str, ...]
    method: str = "exact"
    max_dist: int | None = None
    name_type: str = "index"


def make_seq_options(query_col: str, patterns: str | Iterable[str], method: str = "exact", max_dist: int | None = None, name_type: str = "index") -> SeqOptions:
    p = (patterns,) if isinstance(patterns, str) else tuple(patterns)
    if not query_col or not p or not all(isinstance(x, str) for x in p):
        raise ValueError("`query_col` and at least one text pattern are needed")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if name_type not in NAME_TYPES:
        raise ValueError(f"name_type must be one of {NAME_TYPES}")
    if max_dist is not None and (isinstance(max_dist, bool) or not isinstance(max_dist, int) or max_dist < 0):
        raise ValueError("max_dist must be a whole number, 0 or more")
    return SeqOptions(query_col, p, method, max_dist, name_type)


def check_seq_options(options: SeqOptions, mode: str, columns: Iterable[str]) -> SeqOptions:
    """Validate options against their use (``filter`` or ``mutate``) and the table's columns."""
    if mode == "filter" and options.method in ("lev", "hamm") and options.max_dist is None:
        raise ValueError("filtering by distance needs `max_dist`")
    if options.query_col not in set(columns):
        raise ValueError(f"query column {options.query_col!r} is not in the data")
    return options


def pattern_columns(options: SeqOptions, prefix: str) -> list[str]:
    """One column name for each pattern; patterns whose names would clash are refused."""
    if options.name_type == "index":
        return [f"{prefix}{i}" for i in range(1, len(options.patterns) + 1)]
    names = [prefix + re.sub("[^A-Za-z0-9]", "_", p) for p in options.patterns]
    if len(set(names)) < len(names):
        raise ValueError("two patterns give one column name; use name_type='index'")
    return names
