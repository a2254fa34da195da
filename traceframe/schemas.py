"""Schemas of the typed tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"

DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "styles": "id STRING, resolver STRING, slant_deg DOUBLE, default_style_ratio ARRAY<DOUBLE>",
    "hands": "id STRING, style_id STRING, label STRING, era STRING",
    "sources": "id STRING, style_id STRING, kind STRING, chart_size MAP<STRING, INT>, style_ratio ARRAY<DOUBLE>, slant_deg DOUBLE, retrieved_date DATE",
    "bboxes": "source_id STRING, glyph_key STRING, y0 INT, y1 INT, x0 INT, x1 INT, baseline_y INT, midband_y INT, locked BOOLEAN",
    "templates": f"style_id STRING, glyph_key STRING, variant INT, anchors ARRAY<{POINT}>, half_widths ARRAY<DOUBLE>, entry {POINT}, exit {POINT}, advance DOUBLE, provenance_source_id STRING",
    "instances": f"source_id STRING, hand_id STRING, glyph_key STRING, glyph STRING, position STRING, variant INT, y0 INT, y1 INT, x0 INT, x1 INT, anchors ARRAY<{POINT}>, half_widths ARRAY<DOUBLE>, measurements STRUCT<specimen_id: STRING, slot: INT, geo_rmse_px: DOUBLE, xh_px: DOUBLE>, seq BIGINT",
    "pair_instances": f"source_id STRING, hand_id STRING, left_key STRING, right_key STRING, kind STRING, specimen_id STRING, slot INT, geometry STRUCT<offset: {POINT}, connector: ARRAY<{POINT}>>, measurements STRUCT<fit_ok: BOOLEAN, gen_chamfer: DOUBLE, harvest_chamfer: DOUBLE, a_resid: DOUBLE, b_resid: DOUBLE, gap_ink: BOOLEAN>",
    "word_instances": f"source_id STRING, hand_id STRING, kind STRING, specimen_id STRING, word STRING, slots ARRAY<STRING>, strokes ARRAY<ARRAY<{POINT}>>, provenance STRING, measurements STRUCT<registration_px: STRUCT<tx: DOUBLE, ty: DOUBLE, baseline_row: DOUBLE>, xh_px: DOUBLE, fit_path: STRING>",
    "aggregates": f"hand_id STRING, glyph_key STRING, variant INT, cluster_center ARRAY<{POINT}>, n_instances BIGINT, positions MAP<STRING, BIGINT>",
    "pair_aggregates": f"hand_id STRING, left_key STRING, right_key STRING, offset_center {POINT}, connector_center ARRAY<{POINT}>, n_instances BIGINT",
    "glyph_pairs": f"style_id STRING, left_key STRING, right_key STRING, variant INT, offset {POINT}, connector ARRAY<{POINT}>, approved BOOLEAN",
    "work_items": "id BIGINT, kind STRING, status STRING, understanding STRING, reproduced STRING, stage STRING, resolution STRING, note STRING, acked_at TIMESTAMP, closed_at TIMESTAMP",
    "quiz_words": "word STRING, distractors ARRAY<STRING>, era STRING, note STRING, fugen STRING",
    "pixels": "mask_id STRING, side STRING, x INT, y INT, grey DOUBLE",
    "trace": "case_id STRING, side STRING, stroke INT, pos INT, x DOUBLE, y DOUBLE",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
