"""The pattern/action language: parser, lowering to columns, interpreter."""

from wirelake.plans.pml.interpret import run
from wirelake.plans.pml.lower import predicate
from wirelake.plans.pml.parse import parse, parse_expression

__all__ = ["parse", "parse_expression", "predicate", "run"]
