"""Column and frame helpers the operators are built from."""
