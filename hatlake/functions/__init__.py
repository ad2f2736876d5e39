"""Part of hatlake."""
