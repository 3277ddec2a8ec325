"""Corpus preparation for language-model training; nothing outside this subpackage imports it."""
