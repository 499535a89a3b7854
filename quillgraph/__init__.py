"""Graph-pattern analytics on Spark: triples, a SPARQL-style language and the plans it compiles to."""
