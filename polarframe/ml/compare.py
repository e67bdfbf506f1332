"""From feature rows to compared models: one run that trains several models and reports them side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame

from polarframe.ml.evaluate import evaluate_all, fitting_analysis, regional_summary, results_table, to_scores
from polarframe.ml.prep import build_pipeline
from polarframe.operators.distribute import settle
from polarframe.operators.labels import LABEL
from polarframe.operators.splits import undersample


@dataclass
class Comparison:
    """Fitted pipelines by model name, metrics per model and split, the train-test gap per model, and rates per region on the test rows."""

    models: dict[str, PipelineModel]
    metrics: DataFrame
    fitting: DataFrame
    regional: DataFrame


def compare_models(
    splits: dict[str, DataFrame], numeric: list[str], learners: dict[str, tuple[str, Estimator]], *, label: str = LABEL, ratio: float = 10.0,
    region: str = "regional_subset_id",
) -> Comparison:
    """Train every learner on the undersampled training rows and score all splits (``train``, ``val``, ``test``).

    ``learners`` maps a name to (kind of preprocessing, learner). Learners of one kind share its fitted preprocessing and prepared rows, which are
    written once; the narrow scores of all models and splits are evaluated in one job.
    """
    prepared, rows, regional, fitted = {}, [], [], {}
    for name, (kind, learner) in learners.items():
        if kind not in prepared:
            stages = build_pipeline(kind, numeric).fit(splits["train"])
            read = {one.getFeaturesCol() for n, (k, one) in learners.items() if k == kind}
            # Prepared rows are read by every fit and scored once: no intermediate columns.
            sides = {s: settle(stages.transform(d).select(*[c for c in d.columns if c not in numeric], *sorted(read - set(d.columns)))) for s, d in splits.items()}
            prepared[kind] = stages, sides, settle(undersample(sides["train"], ratio=ratio, label=label))
        stages, sides, fit_rows = prepared[kind]
        model = learner.fit(fit_rows)
        fitted[name] = PipelineModel([*stages.stages, model])
        probability = model.getProbabilityCol()
        for split, df in sides.items():
            scored = model.transform(df).withColumnsRenamed({model.getPredictionCol(): "prediction", probability: "probability"})
            if split == "test":  # read by the metrics and by the rates per region
                scored = settle(scored.select(region, label, "prediction", "probability"))
                regional.append(regional_summary(scored, name, region, label=label))
            rows.append(to_scores(scored, name, split, label))
    metrics = settle(evaluate_all(rows))
    return Comparison(fitted, metrics, fitting_analysis(metrics), results_table(regional))
