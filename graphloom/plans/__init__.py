"""Driver-side planning: sessions, mappings, validation, migration, governance, exports."""
