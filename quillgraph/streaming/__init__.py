"""Graph patterns over streams of triples."""
