"""Operators for preparing training text: mixing, chat formatting, de-duplication, decontamination,
page extraction, token counts, quality, boilerplate lines and language. Nothing else in the library
imports this package."""
