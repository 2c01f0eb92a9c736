"""Bibliographic record completion, label harmonisation, corpus building and text classification on Spark."""

from paperweave.session import build_session, shared_dir, work_path

__all__ = ["build_session", "shared_dir", "work_path"]
