"""The engine's canonical tables."""

from __future__ import annotations

#: Fixed layouts, one per table.
TABLES = {
    "samples": "split string, sample_id long, label int, pred int",
    "vectors": "split string, sample_id long, space string, value array<double>",
    "series": "split string, sample_id long, branch string, value array<array<double>>",
    "texts": "split string, sample_id long, branch string, text string",
    "images": "split string, sample_id long, branch string, px binary, h int, w int, c int",
    "neighbors": "query_id long, space string, metric string, rank int, train_id long, distance double",
    "candidates": "query_id long, generator string, cand_rank int, n_used int, anchor_id long, num map<string,array<double>>, ser map<string,array<array<double>>>, anchors map<string,long>",
    "objectives": "run_id string, combo_id string, generator string, query_id long, cand_rank int, outcome double, proximity double, sparsity double, plausibility double",
    "runs": "run_id string, combo_id string, tab_metric map<string,string>, ts_metric map<string,string>, text_config struct<encoder:string,metric:string>, image_config struct<encoder:string,metric:string>, status string, error string, runtime_sec double, n_samples long",
}


def check(df, name: str) -> None:
    """Raise where ``df`` lacks a column of the table."""
    from pyspark.sql.types import StructType

    wanted = {f.name for f in StructType.fromDDL(TABLES[name]).fields}
    if missing := wanted - set(df.columns):
        raise ValueError(f"{name} lacks {sorted(missing)}")
