"""Runnable jobs over Spark tables. Each has a command line, a config file beside it and a function that takes a session."""

from jobs.common import settings as settings_of

__all__ = ["settings_of"]
