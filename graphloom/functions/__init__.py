"""Column functions: keys, coercion, the expression language, masks."""
