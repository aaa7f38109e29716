"""procweave: code-lineage and catalog analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns), so a whole
corpus of procedure sources, DDL files or catalog rows is ordinary input and
Catalyst plans the work.
"""

from procweave.session import get_spark, ensure_checkpoint_dir, checkpoint

__all__ = ["get_spark", "ensure_checkpoint_dir", "checkpoint"]
__version__ = "0.1.0"
