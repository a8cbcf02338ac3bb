"""Inventories of files and their parsers."""
