"""Readers.  Text formats are parsed by built-in functions over lines that carry their place (file, ord); formats that
need a parser of their own run in mapInPandas over binary files."""
