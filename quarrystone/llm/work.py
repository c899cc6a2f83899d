"""Tables that cut a job's lineage; see `quarrystone.storage`."""

from __future__ import annotations

from quarrystone.storage import SETTING, Work, shared_folder

__all__ = ["SETTING", "Work", "shared_folder"]
