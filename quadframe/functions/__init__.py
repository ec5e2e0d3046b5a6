"""SPARQL functions and casts as Spark columns."""
