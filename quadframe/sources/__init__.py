"""Where quads come from and go to: N-Quads text, tables seen as RDF, result formats."""
