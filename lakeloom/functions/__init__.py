"""Functions of the expression language, as Spark columns."""
