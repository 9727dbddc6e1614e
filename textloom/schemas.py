"""Declared schemas; nothing here is inferred at run time."""

SOURCE_REGISTRY = (
    "source_key string, path string, format string, text_field string, "
    "lang string, cleaner string, ordinal int"
)
CORPUS_ROW = "text string, lang string"
PACKED_ROW = "row_idx bigint, input_ids array<int>, attention_mask array<smallint>, shard_id bigint"
LOG_LINE = "run string, line_no bigint, line string"
METRIC_POINT = "run string, step bigint, loss double, first_pos bigint"
GENERATION = "prompt string, output string, sec double, distinct_1 double, distinct_2 double"
QUALITY_META = "language string"
QUALITY_SIGNALS = "ccnet_perplexity array<array<double>>"
