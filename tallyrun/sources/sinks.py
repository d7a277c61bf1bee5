"""Writers of derived answers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_bundle(answers: dict[str, DataFrame], scenarios: DataFrame, root: str, key: str = "scenario_id", form: str = "parquet") -> None:
    """Writes every derived answer, cut to ``scenarios(key)``, each to its own folder under ``root``."""
    wanted = scenarios.select(key).distinct()
    for name, answer in answers.items():
        cut = answer.join(wanted, key, "left_semi") if key in answer.columns else answer
        cut.write.mode("overwrite").format(form).save(f"{root}/{name}")


def write_catalogue(benchmark: DataFrame, ladder: DataFrame, root: str) -> None:
    """The catalogue in a stable order: benchmarks by position, ladders by scenario and preference."""
    benchmark.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").json(f"{root}/benchmark")
    order = ["scenario_name", "candidate_order"]
    ladder.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{root}/ladder")
