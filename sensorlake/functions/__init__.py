from .fields import (as_text, compact_map, drop_nulls, extract_field, numeric_or_null, overlay, overlay_keys,
                     sensor_id, stable_avg, valid_reading)
from .ids import path_source_id, stable_ingestion_id, topic_source_id
from .timeparse import normalize_event_time, parse_timestamp
from .valuetypes import TYPE_RANK, infer_type, merged_type

__all__ = ["as_text", "compact_map", "drop_nulls", "extract_field", "numeric_or_null", "overlay", "overlay_keys",
           "sensor_id", "stable_avg", "valid_reading", "path_source_id", "stable_ingestion_id", "topic_source_id",
           "normalize_event_time", "parse_timestamp", "TYPE_RANK", "infer_type", "merged_type"]
