"""Export filters: typed specification in, one pushable predicate out."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.checks import in_date_range, parse_date_range

# Filter names and their types.
FILTER_TYPES = {
    "status": str,
    "engine_type": str,
    "category": str,
    "min_quality_score": float,
    "max_quality_score": float,
    "min_word_count": int,
    "max_word_count": int,
    "has_errors": bool,
    "start_date": str,
    "end_date": str,
}


@dataclass
class FilterSpec:
    """Checked filters with the warnings met on the way."""

    values: dict[str, Any]
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, filters: dict[str, Any]) -> FilterSpec:
        """Coerce types, drop unknown and empty entries, check ranges. Raises ValueError with all errors."""
        spec, errors = cls({}), []
        for name, value in filters.items():
            kind = FILTER_TYPES.get(name)
            if kind is None:
                spec.warnings.append(f"{name} is no known filter")
                continue
            try:
                parsed = str(value).strip() if kind is str else kind(value)
            except (TypeError, ValueError):
                errors.append(f"{name} does not read as {kind.__name__}")
                continue
            if kind is str and not parsed:
                spec.warnings.append(f"{name} is empty")
                continue
            if kind is int and parsed < 0:
                spec.warnings.append(f"{name} is below zero")
            if kind is float and not 0 <= parsed <= 1:
                spec.warnings.append(f"{name} lies outside 0 to 1")
            spec.values[name] = parsed
        errors += spec._range_errors()
        if errors:
            raise ValueError("; ".join(errors))
        return spec

    def _range_errors(self) -> list[str]:
        v, out = self.values, []
        for what in ("quality_score", "word_count"):
            low, high = v.get(f"min_{what}"), v.get(f"max_{what}")
            if low is not None and high is not None and low > high:
                out.append(f"no value lies between min_{what} and max_{what}")
        try:
            self.warnings += parse_date_range(v.get("start_date"), v.get("end_date"))[2]
        except ValueError as exc:
            out.append(str(exc))
        return out

    def column(self) -> Column:
        """The conjunction. Missing counts and scores are 0; a missing category equals nothing.

        Tests are bare comparisons, so that they reach the Parquet scan; a bound that
        admits 0 admits missing values too.
        """
        v = self.values

        def bounded(name: str, bound: float, at_least: bool) -> Column:
            c = F.col(name)
            test = c >= bound if at_least else c <= bound
            return test | c.isNull() if (0 >= bound if at_least else 0 <= bound) else test

        tests = {
            "status": lambda x: F.col("status") == x,
            "engine_type": lambda x: F.col("engine") == x,
            "category": lambda x: F.col("category") == x,
            "min_quality_score": lambda x: bounded("quality_score", x, True),
            "max_quality_score": lambda x: bounded("quality_score", x, False),
            "min_word_count": lambda x: bounded("word_count", x, True),
            "max_word_count": lambda x: bounded("word_count", x, False),
            "has_errors": lambda x: F.col("error").isNotNull() if x else F.col("error").isNull(),
            "start_date": lambda x: in_date_range(F.col("scraped_at"), x, None),
            "end_date": lambda x: in_date_range(F.col("scraped_at"), None, x),
        }
        out = F.lit(True)
        for name, value in v.items():
            out = out & tests[name](value)
        return out
