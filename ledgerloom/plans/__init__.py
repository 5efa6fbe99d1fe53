"""How intermediate results are kept and moved."""
