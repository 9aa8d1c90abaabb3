"""Packrat parsing-expression grammars of source languages, and their lexers."""
