"""The expression language: text to tokens, tree, and Spark columns."""

from .compiler import Compiler, compile_expression, layers
from .parser import ExpressionError, parse

__all__ = ["Compiler", "ExpressionError", "compile_expression", "layers", "parse"]
