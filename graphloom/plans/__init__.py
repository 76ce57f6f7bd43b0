"""From a grammar, bindings and sources to a graph."""

from .bindings import ExtractorBinding, ExtractorBindings, Plan, Step, coerce_bindings, join
from .evaluation import CaseResult, CorpusCase, CorpusResult, evaluate_case, evaluate_corpus
from .facade import extract
from ..policy import ExtractionPolicy

__all__ = ["CaseResult", "CorpusCase", "CorpusResult", "ExtractionPolicy", "ExtractorBinding", "ExtractorBindings", "Plan", "Step", "coerce_bindings", "evaluate_case", "evaluate_corpus", "extract", "join"]
