"""Schemas of the tables that the operators pass on."""

from __future__ import annotations

from pyspark.sql import types as T

TRACES = T.StructType(
    [
        T.StructField("section_id", T.StringType(), False),
        T.StructField("trace_idx", T.IntegerType(), False),
        T.StructField("samples", T.ArrayType(T.FloatType()), True),
    ]
)
SEGY_TRACES = T.StructType(
    [
        T.StructField("section_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("inline_no", T.IntegerType(), True),
        T.StructField("xline_no", T.IntegerType(), True),
        T.StructField("trace_idx", T.IntegerType(), True),
        T.StructField("samples", T.ArrayType(T.FloatType()), True),
        T.StructField("status", T.StringType(), False),
    ]
)
SEGY_BANDS = T.StructType(SEGY_TRACES.fields + [T.StructField(c, T.IntegerType(), True) for c in ("tile_y", "n_traces", "n_samples")])
LABELS = "label_id int, label string, r int, g int, b int"
STRIPS = "section_id string, label_id int, tile_y int, tile_x int, row_off int, probs array<float>"
SCORED = f"{STRIPS}, error string"
PIXELS = "section_id string, label_id int, trace_idx int, sample_idx int, prob float"
MANIFEST = "section_id string, path string, artifact string, status string, error string, n_bytes long"
