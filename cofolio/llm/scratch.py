"""Written tables in the shared folder, used to cut lineage."""

from cofolio.sources.scratch import cut, shared_dir

__all__ = ["cut", "shared_dir"]
