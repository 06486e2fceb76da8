"""Column-level expressions (built-in Spark functions first)."""

from .ids import (clean_id, clean_year, fix_question_id, question_from_file_name,
                  std_question_id, strip_ws, year_strict)
from .keyword import And, MeshTerm, Not, Or, Term, any_of, compile_query
from .metrics import f_beta, ratio, signif
from .text import (clean_html, decode_inverted_index, embedding_text, strip_tags,
                   unescape_entities, with_inverted_index)

__all__ = [
    "clean_id", "clean_year", "fix_question_id", "question_from_file_name",
    "std_question_id", "strip_ws", "year_strict", "And", "MeshTerm", "Not", "Or",
    "Term", "any_of", "compile_query", "f_beta", "ratio", "signif", "clean_html",
    "decode_inverted_index", "embedding_text", "with_inverted_index", "strip_tags", "unescape_entities",
]
