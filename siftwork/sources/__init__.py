"""Readers and writers."""

from .pages import read_landed_pages, topic_window_filter
from .ris import parse_records, project_fields, read_tagged_records, remap_question
from .sinks import append_new, path_safe, stage, write_per_question, write_table
from .tables import project_source, read_folder, read_table, strategy_from_file_name

__all__ = [
    "read_landed_pages", "topic_window_filter", "parse_records", "project_fields",
    "read_tagged_records", "remap_question", "append_new", "path_safe", "stage",
    "write_per_question", "write_table", "project_source", "read_folder", "read_table",
    "strategy_from_file_name",
]
