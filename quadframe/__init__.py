"""quadframe: RDF quads and training-data operators as Spark DataFrame programs."""
