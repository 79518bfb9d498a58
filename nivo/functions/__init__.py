"""Column expressions: elevation bands, danger scale, keys, number and text formatting."""
