"""Search analytics on Spark: what applications use, under one name."""

_PUBLIC = {
    "AscDesc": "plans.criteria:Sort", "Criterion": "plans.criteria:Criterion", "CriterionError": "plans.criteria:CriterionError", "parse_criterion": "plans.criteria:parse_criterion", "parse_sort": "plans.criteria:parse_sort",
    "FilterError": "plans.filters:FilterError", "parse_filter": "plans.filters:parse", "DocumentError": "operators.lifecycle:DocumentError", "Store": "operators.lifecycle:Store",
    "FormatOptions": "functions.formatting:FormatOptions", "Matcher": "functions.formatting:Matcher", "Index": "search:Index", "Search": "search:Search", "Settings": "settings:Settings", "SettingsError": "settings:SettingsError", "RESET": "settings:RESET",
    "StoredIndex": "indexing:StoredIndex", "IndexerConfig": "indexing:IndexerConfig", "IndexDocumentsConfig": "indexing:IndexDocumentsConfig", "Aborted": "indexing:Aborted", "facet_distribution": "operators.facet_counts:distribution",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    import importlib

    if name not in _PUBLIC:
        raise AttributeError(name)
    module, thing = _PUBLIC[name].split(":")
    return getattr(importlib.import_module(f"{__name__}.{module}"), thing)
