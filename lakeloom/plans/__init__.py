"""Definitions: declarative documents that become one lazy DataFrame plan."""

from .definition import DefinitionError, capabilities, load, plan, run, validate

__all__ = ["DefinitionError", "capabilities", "load", "plan", "run", "validate"]
