"""See the package docstring of emberframe and README.md."""
