"""Release-year prediction from the song table to metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.functions import arrays, years
from tunegrain.operators import cleaning, evaluation, features, sampling, training
from tunegrain.runtime import materialize
from tunegrain.schema import SEGMENT_PARTS, SIGNATURE_WIDTH, segment_columns

Balance = Callable[[DataFrame], DataFrame]


@dataclass
class Report:
    model: Model | training.YearModel
    predictions: DataFrame
    metrics: DataFrame
    accuracy: DataFrame


def signature_features(
    songs: DataFrame, key: str = "song_id", columns: Sequence[str] = ("segments_timbre",)
) -> DataFrame:
    """(key, year, features) from 90-wide signatures; songs with a gap in them are left out."""
    complete = reduce(and_, [arrays.is_complete(F.col(c), SIGNATURE_WIDTH) for c in columns])
    # Filters of later steps may be evaluated before this one, so the vector is valid in any row.
    filler = F.array_repeat(F.lit(0.0), SIGNATURE_WIDTH * len(columns))
    vector = features.as_vector(F.when(complete, F.concat(*columns)).otherwise(filler))
    known = cleaning.known_year(songs).filter(complete)
    return known.select(key, "year", vector.alias("features"))


def numeric_features(
    songs: DataFrame, key: str = "song_id", mode: str = "substring", min_std: float = 1e-8
) -> tuple[DataFrame, list[str]]:
    """(key, year, features) from the numeric columns and the 12-wide parts, and the names used."""
    parts = {c: w for c, w in segment_columns(songs).items() if c in SEGMENT_PARTS}
    flat = cleaning.flatten_arrays(songs, parts)
    names = cleaning.exclude_tokens(cleaning.numeric_columns(flat, exclude=("year", key)), mode=mode)
    complete = cleaning.known_year(cleaning.drop_incomplete(flat.select(key, "year", *names), [*names, "year"]))
    kept = cleaning.required(names, cleaning.low_variance_columns(complete, names, min_std))
    return features.assemble(kept).transform(complete).select(key, "year", "features"), kept


def predict_years(
    table: DataFrame, regressor: Estimator, key: str = "song_id", balance: Balance | None = None,
    lo: float = years.YEAR_LO, hi: float = years.YEAR_HI, seed: int = 42, leaky: bool = False,
) -> Report:
    """Split, balance, fit and score a regressor of the scaled year (its label column is "label").

    Balancing repeats rows, so it is done on the training part only. `leaky` balances before the
    split, as some published results do; copies of a row then appear on both sides.
    """
    if leaky and balance is not None:
        # The split goes by copy here, which is what lets copies leak.
        mixed = balance(table)
        copy = F.concat_ws("#", F.col(key), F.col("replica"))
        train, test = sampling.split(mixed.withColumn("_copy", copy), "_copy", seed=seed)
    else:
        train, test = sampling.split(table, key, seed=seed)
        train = balance(train) if balance is not None else train
    # Trainers walk over their input many times; it is prepared once.
    train = materialize(train, "train")
    model = training.fit_year_model(train, regressor, "year", lo, hi)
    predictions = model.transform(test, as_float=True)
    whole = predictions.withColumn("predicted_year", years.to_year(F.col("prediction")))
    return Report(
        model,
        whole,
        evaluation.regression_metrics(predictions, "year"),
        evaluation.exact_accuracy(whole, "year", "predicted_year"),
    )


def predict_decades(
    table: DataFrame, key: str = "song_id", seed: int = 42, **forest_params
) -> tuple[Report, DataFrame]:
    """Weighted random forest over decades; also the decades that only the test part has."""
    labelled = features.with_class_index(table.withColumn("decade", years.decade(F.col("year"))), "decade")
    scaler = features.standard_scaler("features", "scaled")
    train, test = sampling.split(labelled, key, seed=seed)
    scaling = scaler.fit(train)
    weighted = materialize(evaluation.with_class_weights(scaling.transform(train)), "train")
    model = training.fit_forest_classifier(weighted, "scaled", **forest_params)
    predictions = model.transform(scaling.transform(test))
    report = Report(
        model,
        predictions,
        evaluation.classification_metrics(predictions),
        evaluation.majority_baseline(test),
    )
    return report, features.unseen_classes(train, test, "decade")
