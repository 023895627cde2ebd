"""Identifier case and number, and naming conventions of a mapping."""

from __future__ import annotations

import copy
import re

from graphloom.model import RESERVED, MappingConfig, NamingConvention, Schema

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+")


def split_identifier(name: str) -> list[str]:
    """Words of snake, kebab, dotted, spaced, camel and Pascal case; acronyms stay whole."""
    return _WORDS.findall(name)


def pluralize(word: str) -> str:
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(s|x|z|ch|sh)$", word) else "s") if word else word


def singularize(word: str) -> str:
    if len(word) > 3 and word.endswith("ies"):
        return word[:-3] + "y"
    if re.search(r"(s|x|z|ch|sh)es$", word):
        return word[:-2]
    return word[:-1] if re.search(r"[^s]s$", word) else word


def convert(name: str, style: str) -> str:
    """name in snake, camel or pascal case; as it is for preserve or where it has no word."""
    words = [w.lower() for w in split_identifier(name)]
    if style == "preserve" or not words:
        return name
    if style == "snake":
        return "_".join(words)
    heads = [w[:1].upper() + w[1:] for w in words]
    if style == "pascal":
        return "".join(heads)
    if style == "camel":
        return "".join([words[0], *heads[1:]])
    raise ValueError(f"unknown case {style!r}")


def apply_convention(config: MappingConfig, convention: NamingConvention, schema: Schema | None = None) -> MappingConfig:
    """A copy of the mapping with the convention written into its names. Renames made by hand and
    reserved attributes stay; edges keep naming source tables."""
    out = copy.deepcopy(config)
    out.naming_convention = convention
    for mapping in out.collections.values():
        mapping.target_collection = convert(mapping.target_collection, convention.collections)
        if convention.properties == "preserve":
            continue
        table = schema.tables.get(mapping.source_table) if schema else None
        if table is not None:
            for name in table.names:
                cased = convert(name, convention.properties)
                if name not in mapping.field_mappings and cased != name and not {name, cased} & set(RESERVED):
                    mapping.field_mappings[name] = cased
        else:
            cased = {s: convert(t, convention.properties) for s, t in mapping.field_mappings.items()}
            mapping.field_mappings = {s: t for s, t in cased.items() if t not in RESERVED}
        for x in mapping.field_expressions:
            if x.target not in RESERVED:
                x.target = convert(x.target, convention.properties)
    for edge in out.edges:
        edge.edge_collection = convert(edge.edge_collection, convention.edges)
    return out
