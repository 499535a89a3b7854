"""Graph patterns as lazy DataFrame plans."""
