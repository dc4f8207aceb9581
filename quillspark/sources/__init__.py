"""Readers, writers and the views the bundled queries run on."""
