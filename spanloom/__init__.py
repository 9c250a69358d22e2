"""spanloom: track, event and timeline analytics on Spark DataFrames."""

import importlib

_FROM = {"analyse": "api", "verify": "api", "sampled": "api", "load_settings": "config", "Settings": "config", "read_json": "sources.tables", "write_report": "sources.tables",
         "register": "functions.registry", "apply_model": "functions.registry", "Model": "functions.registry", "score_with": "functions.registry"}
_FROM |= dict.fromkeys(("candidate_pairs", "score_links", "decide", "superseded", "greedy_matching", "lineages", "lineage_table", "chain_pairs", "identity_keys",
                        "hero_members", "hero_identity", "active_at"), "operators.continuity")
_FROM |= {"fragment_rows": "sources.tables", "as_of": "operators.asof", "covering": "operators.asof", "assign_boxes": "operators.matching",
          "validate_plans": "operators.validation", "track_targets": "operators.scene", "follow": "operators.timeline", "shot_smoothing": "operators.scans",
          "job_lifecycle": "streaming.replay", "ball_history": "streaming.replay"}
__all__ = list(_FROM)


def __getattr__(name: str):
    """Loads a name's module when it is first asked for, so that tasks that import a part don't load all."""
    if name in _FROM:
        return getattr(importlib.import_module(f".{_FROM[name]}", __name__), name)
    raise AttributeError(name)


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
