"""Schemas of the tables that stages exchange."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "array<int>": ArrayType(IntegerType())}


def _schema(columns: str) -> StructType:
    """Of "name type, name type, ..."; unlike DDL this needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


REPOSITORY = _schema("repository_url string, requested_revision string, resolved_commit string, commit_date string, fetched_at_utc string, target_directory string")
_SOURCE = "path string, extension string, language string, top_level_directory string, size_bytes long, line_count long, sha256 string, spdx_license string, encoding_status string, has_null_bytes boolean, candidate boolean, repository_commit string"
_CLEAN = f"{_SOURCE}, included boolean, exclusion_reason string, duplicate_of string, directory_tier string, hex_literal_count long, hex_literals_per_line double, cpp_relevance string, cpp_training_priority string"
SOURCE_FILES = _schema(_SOURCE)
CLEANED_FILES = _schema(_CLEAN)
SPLIT_FILES = _schema(f"{_CLEAN}, split_group string, split string")
_EXAMPLE = (
    "id string, split string, source_path string, source_sha256 string, source_commit string, split_group string, language string, extension string, directory_tier string, "
    "cpp_relevance string, cpp_training_priority string, cut_line int, prompt string, completion string, prompt_tokens int, completion_tokens int, total_tokens int, training_repeat int, fingerprint string"
)
EXAMPLES = _schema(_EXAMPLE)
BENCHMARK = _schema(f"{_EXAMPLE}, original_id string")
TOKENIZED = _schema("input_ids array<int>, attention_mask array<int>, labels array<int>")
TEACHER_SCORES = _schema("evaluation_key string, id string, source_path string, language string, cpp_priority string, negative_log_likelihood double, mean_negative_log_likelihood double, perplexity double, token_accuracy double, correct_tokens long, scored_tokens long")
GENERATION_SCORES = _schema("exact_match boolean, normalized_exact_match boolean, first_line_exact_match boolean, matching_prefix_tokens long, matching_prefix_ratio double, token_edit_distance long, token_edit_similarity double, generated_tokens long, reference_tokens long")
ADAPTERS = _schema("name string, step int, path string")
