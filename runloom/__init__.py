"""runloom: a PySpark engine for a training-run registry and corpus preparation.

Everything is expressed as DataFrame plans; Python runs on executors only for the
sequential pieces (best-fit packing, per-run streaming state, encoding of unseen words).
"""

from runloom.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
