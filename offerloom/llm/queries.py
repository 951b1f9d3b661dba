"""All registered queries of this subpackage."""

from importlib import import_module

from offerloom.llm.common import REGISTRY, Query

MODULES = ["langid", "licences", "embeddings", "packing", "simhash", "htmltext", "chat", "tokenfiles", "quality", "decontam", "bpetree", "spelling", "negatives"]


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"offerloom.llm.{name}")
    return REGISTRY
