"""Readers and writers for the tables the library consumes and produces."""
