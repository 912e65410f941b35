from keyloom.sources.tables import spread, table
from keyloom.sources.text import input_manifest, read_text

__all__ = ["input_manifest", "read_text", "spread", "table"]
