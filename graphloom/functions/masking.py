"""Masks: field expressions that overwrite a property with a de-identified value."""

from __future__ import annotations

from graphloom.model import FieldExpression

#: Marks a field expression as a mask, so that gates know the property as safe.
MASK_MARK = "mask:"

#: Expression of each kind of mask.
MASKS = {"hash": "MD5(TO_STRING(@{0}))", "tokenize": "SHA512(TO_STRING(@{0}))", "redact": '"***"', "nullify": "null"}


def mask(column: str, kind: str) -> FieldExpression:
    """The expression that masks a column in place."""
    if kind not in MASKS:
        raise ValueError(f"unknown mask {kind!r}; one of {', '.join(MASKS)}")
    return FieldExpression(column, [column], MASKS[kind].format(column), description=MASK_MARK + kind)


def is_mask(expression: FieldExpression) -> bool:
    return (expression.description or "").startswith(MASK_MARK)
