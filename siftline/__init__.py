"""siftline: batch retrieval, evidence ranking and corpus preparation on Spark."""

from importlib import import_module

_MODULES = {
    "config": ("Config", "load_config"),
    "functions.chunking": ("chunks",),
    "functions.dom": ("extracted",),
    "functions.text": ("is_content",),
    "operators.context": ("contexts", "prompts", "surviving"),
    "operators.lexical": ("bm25", "idf", "tfidf"),
    "operators.merge": ("merged", "relevant"),
    "operators.quality": ("chunked", "good_chunks"),
    "operators.ranking": ("rerank", "scored", "selected"),
    "plans.engine": ("Engine",),
    "scoring": ("Scorer",),
    "sources.tables": ("as_json", "fetched", "page_texts", "result_hits", "result_pages", "save_prompts"),
}
_PLACES = {name: module for module, names in _MODULES.items() for name in names}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Loads a name's module when it is first asked for, so that Python workers load what they use alone."""
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
