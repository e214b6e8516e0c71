"""Compositions of operators: the experiment grid, its analysis and the registered queries."""
