"""A deductive analytics engine on Spark DataFrames: facts, rules, recursion, negation, grouping, time."""

from hornspark.database import Database
from hornspark.engine import Engine, Program, Relation, evaluate_text
from hornspark.lang.syntax import LanguageError
from hornspark.provenance import derive
from hornspark.values import Name

__all__ = ["Database", "Engine", "LanguageError", "Name", "Program", "Relation", "derive", "evaluate_text"]
