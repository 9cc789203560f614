"""Load recipes: saved paths and ordered steps, replayed on load."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.functions import columns as C
from hindsight.sources.files import read_file, replace_file
from hindsight.sources.scan import scan
from hindsight.spec.model import dump_text, parse_text

# File name, type and default path column of a saved recipe.
RECIPE_FILE = "MLTable"
RECIPE_TYPE = "mltable"
PATH_COLUMN = "Path"
PATH = "__path"


def _convert(df: DataFrame, types: dict[str, dict]) -> DataFrame:
    return df.withColumns({
        name: C.to_bool(name, t["true_values"], t["false_values"], t.get("mismatch_as") == "error")
        for name, t in types.items()
    })


STEPS = {
    "take_random_sample": lambda df, probability, seed, by_content=False: (
        C.sample_by_content(df, probability, seed) if by_content else C.sample_rows(df, probability, seed)
    ),
    "filter": C.filter_rows,
    "drop_columns": C.drop_columns,
    "keep_columns": lambda df, names: C.pick(df, *names, *[PATH for c in df.columns if c == PATH and PATH not in names]),
    "convert_column_types": _convert,
    "extract_columns_from_partition_format": lambda df, pattern: C.path_columns(df, pattern, F.col(PATH)),
}


@dataclass(frozen=True)
class Recipe:
    """Paths and steps; a step is a name and its argument (several: a mapping)."""

    paths: tuple[str, ...]
    steps: tuple[tuple[str, Any], ...] = ()
    path_column: str | None = None

    def then(self, step: str, argument: Any) -> Recipe:
        if step not in STEPS:
            raise ValueError(f"unknown step {step!r}, expected one of {sorted(STEPS)}")
        return Recipe(self.paths, (*self.steps, (step, argument)), self.path_column)

    def load(self, spark: SparkSession) -> DataFrame:
        """The scan with every step applied in order."""
        needs_path = any(name == "extract_columns_from_partition_format" for name, _ in self.steps)
        start = scan(spark, self.paths, PATH if needs_path else None)
        if self.path_column:
            start = start.select("*", F.col("_metadata.file_path").alias(self.path_column))

        def apply(df: DataFrame, step: tuple[str, Any]) -> DataFrame:
            name, argument = step
            if name == "take_random_sample":
                return df.transform(STEPS[name], **argument)
            return df.transform(STEPS[name], argument)

        return reduce(apply, self.steps, start).drop(PATH)

    def save(self, spark: SparkSession, folder: str) -> None:
        read = {"include_path_column": self.path_column is not None, "path_column": self.path_column or PATH_COLUMN}
        content = {
            "type": RECIPE_TYPE,
            "paths": [{"pattern": p} for p in self.paths],
            "transformations": [{"read_parquet": read}, *[{name: argument} for name, argument in self.steps]],
        }
        replace_file(spark, f"{folder}/{RECIPE_FILE}", dump_text(content))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Recipe:
        content = parse_text(read_file(spark, f"{folder}/{RECIPE_FILE}"))
        recipe = cls(tuple(p.get("pattern") or p.get("file") or p["folder"] for p in content["paths"]))
        for step in content.get("transformations", []):
            [(name, argument)] = step.items()
            if name == "read_parquet":
                if argument.get("include_path_column"):
                    recipe = cls(recipe.paths, recipe.steps, argument.get("path_column", PATH_COLUMN))
            else:
                recipe = recipe.then(name, argument)
        return recipe
